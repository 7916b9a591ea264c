"""Small state machines for each key, over ordered rows of a batch and over streams in any split, with the same results.

A machine is a function (state, row) -> (state, rows out); both states are dicts or None, rows are dicts. It has to keep
its state small: a batch streams through it sorted, one key after the other, and a stream stores it between batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

Step = Callable[[dict | None, dict], tuple[dict | None, list[dict]]]
Flush = Callable[[dict], list[dict]]


def over_batch(rows: DataFrame, key: str, order: list[str], schema: str, step: Step, flush: Flush | None = None) -> DataFrame:
    """Runs the machine over all rows of each key in order. ``flush`` gives what a key's last state still holds.

    A key is one task's work, as its order demands it, but no key is held: rows pass through.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if now is None or row[key] != now[0]:
                    if flush and state is not None:
                        out += flush(state)
                    now, state = (row[key],), None
                state, made = step(state, row)
                out += made
            yield pa.RecordBatch.from_pylist(out, target)
        if flush and state is not None:
            yield pa.RecordBatch.from_pylist(flush(state), target)

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def over_stream(rows: DataFrame, key: str, order: list[str], schema: str, state_schema: str, step: Step, idle_ms: int | None = None, gap_ms: int | None = None, flush: Flush | None = None) -> DataFrame:
    """The same over a stream whose batches come in order for each key; rows of a batch are sorted.

    With ``idle_ms`` the state of a key without rows for that long is forgotten. With ``gap_ms`` (the rows need a
    watermark on ``at``) a key is flushed when the watermark is that far behind its state's ``last`` milliseconds.
    """
    names, out_names = StructType.fromDDL(state_schema).names, StructType.fromDDL(schema).names
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.EventTimeTimeout if gap_ms else GroupStateTimeout.NoTimeout

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = dict(zip(names, map(_plain, state.get), strict=True)) if state.exists else None
        made: list[dict] = []
        if state.hasTimedOut:
            made = flush(kept) if flush and kept else []
            state.remove()
        else:
            for row in sorted((r for part in parts for r in _rows(part)), key=lambda r: [(r[c] is not None, r[c]) for c in order]):
                kept, out = step(kept, row)
                made += out
            if kept is not None:
                state.update(tuple(kept[n] for n in names))
                if idle_ms:
                    state.setTimeoutDuration(idle_ms)
                elif gap_ms:
                    state.setTimeoutTimestamp(max(kept["last"] + gap_ms, state.getCurrentWatermarkMs() + 1))
        if made:
            yield pd.DataFrame([[r[n] for n in out_names] for r in made], columns=out_names, dtype=object)

    return rows.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", timeout)


def _plain(value):
    """Python's own value of what pandas hands over; nothing for its missing ones."""
    if hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return value.tolist()
    if isinstance(value, (list, tuple)):
        return list(value)
    if value is None or pd.isna(value):
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value


def _rows(part: pd.DataFrame) -> Iterator[dict]:
    for values in part.itertuples(index=False, name=None):
        yield dict(zip(part.columns, map(_plain, values), strict=True))
