"""Changes of files, gathered until a source has been quiet, with a bound on the paths that wait."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.streaming import keyed

#: Milliseconds of quiet that end a burst, paths of a burst at most.
QUIET_MS, MOST_PATHS = 2_000, 4_096

OUT = "source string, first long, last long, paths int, overflowed boolean, newest string"
STATE = "source string, first long, last long, paths array<string>, overflowed boolean"


def gather(quiet_ms: int = QUIET_MS, most: int = MOST_PATHS) -> keyed.Step:
    """The machine of a source over (source, path, at, seq), ``at`` in milliseconds: a burst comes out when the next begins.

    A path counts once. One more than ``most`` sets ``overflowed``, and only a scan of all files can tell what changed.
    """

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        out = []
        if state is not None and row["at"] - state["last"] > quiet_ms:
            out, state = release(state), None
        s = state or {"source": row["source"], "first": row["at"], "last": row["at"], "paths": [], "overflowed": False}
        paths, over = s["paths"], s["overflowed"]
        if row["path"] not in paths:
            paths, over = (paths + [row["path"]], over) if len(paths) < most else (paths, True)
        return s | {"last": max(s["last"], row["at"]), "paths": paths, "overflowed": over}, out

    return step


def release(state: dict) -> list[dict]:
    return [{c: state[c] for c in ("source", "first", "last", "overflowed")} | {"paths": len(state["paths"]), "newest": max(state["paths"])}]


def bursts_stream(changes: DataFrame, quiet_ms: int = QUIET_MS, most: int = MOST_PATHS) -> DataFrame:
    """Bursts of a stream of (source, path, at timestamp, seq) in order; the last one comes when the watermark has passed it.

    ``session_window`` finds the same bursts, but its state would hold every path.
    """
    timed = changes.withWatermark("at", f"{quiet_ms} milliseconds").select("source", "path", "seq", F.col("at").alias("moment"), F.unix_millis(F.col("at").cast("timestamp")).alias("at"))
    return keyed.over_stream(timed, "source", ["at", "seq"], OUT, STATE, gather(quiet_ms, most), gap_ms=quiet_ms, flush=release)


def bursts(changes: DataFrame, quiet_ms: int = QUIET_MS, most: int = MOST_PATHS) -> DataFrame:
    """The same for a table, by gaps and islands; the first ``most`` paths of a burst count."""
    order = Window.partitionBy("source").orderBy("at", "seq")
    timed = changes.select("source", "path", "seq", F.unix_millis(F.col("at").cast("timestamp")).alias("at"))
    gap = F.col("at") - F.lag("at").over(order)
    island = timed.withColumn("_b", F.sum(F.when(gap > quiet_ms, 1).otherwise(0)).over(order))
    once = island.groupBy("source", "_b", "path").agg(F.min(F.struct("at", "seq")).alias("_o"), F.min("at").alias("_f"), F.max("at").alias("_l"))
    placed = once.withColumn("_n", F.row_number().over(Window.partitionBy("source", "_b").orderBy("_o")))
    kept = F.col("_n") <= most
    whole = placed.groupBy("source", "_b").agg(F.min("_f").alias("first"), F.max("_l").alias("last"), F.count_if(kept).cast("int").alias("paths"), F.max(~kept).alias("overflowed"), F.max(F.when(kept, F.col("path"))).alias("newest"))
    return whole.select("source", "first", "last", "paths", "overflowed", "newest")
