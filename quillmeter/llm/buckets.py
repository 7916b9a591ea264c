"""Counts by hashed bucket, and bitmaps of buckets: filters of a fixed size that hold back nothing frequent (PCY)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import give_back, shuffle_width

#: Buckets that are summed and sent together; Spark's bitmaps hold as many.
CHUNK = 1 << 15
#: Rows that a task sends at once.
_SENT_ROWS = 1 << 11


def has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each bucket's bit is set."""
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


class BucketCounts:
    """Counts of one task's buckets, each up to ``most``: sums of such counts reach ``most`` where the whole counts do."""

    def __init__(self, most: int, bits: int):
        self.most, self.n = most, np.zeros(1 << bits, np.min_scalar_type(2 * most))

    def add(self, buckets: np.ndarray) -> None:
        places, n = np.unique(buckets, return_counts=True)
        self.n[places] = np.minimum(self.n[places].astype(np.int64) + n, self.most)

    def rows(self) -> list[tuple[int, bytes, bytes]]:
        """(chunk, places, counts) for each chunk of buckets with a count; places and counts that aren't zero, packed."""
        out = []
        for chunk in range(0, len(self.n), CHUNK):
            part = self.n[chunk : chunk + CHUNK]
            places = np.flatnonzero(part)
            if len(places):
                out.append((chunk // CHUNK, places.astype("<u2").tobytes(), part[places].astype(_packed(self.most)).tobytes()))
        return out


def _packed(most: int) -> str:
    return "<u4" if most > 127 else "u1"


def full_buckets(rows: DataFrame, most: int, some: int = 0, bits: int = 0) -> DataFrame:
    """(bucket): those whose counts reach ``most``. All tasks' counts of a chunk meet sorted and are added up one by one.

    some, bits: of 2^bits buckets those whose counts reach ``some``, a smaller number, come too, as 2^bits + bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n = -1, np.zeros(CHUNK, np.int64)

        def full() -> pa.RecordBatch:
            found = chunk * CHUNK + np.flatnonzero(n >= most)
            if some:
                found = np.concatenate((found, (1 << bits) + chunk * CHUNK + np.flatnonzero(n >= some)))
            return pa.RecordBatch.from_arrays([pa.array(found)], ["bucket"])

        for batch in batches:
            for c, places, counts in zip(*(batch.column(x).to_pylist() for x in ("chunk", "places", "counts")), strict=True):
                if c != chunk:
                    if chunk >= 0:
                        yield full()
                    chunk, n = c, np.zeros(CHUNK, np.int64)
                n[np.frombuffer(places, "<u2")] += np.frombuffer(counts, _packed(most))
        if chunk >= 0:
            yield full()

    met = rows.select("chunk", "places", "counts").repartition(shuffle_width(rows.sparkSession), "chunk").sortWithinPartitions("chunk")
    return met.mapInArrow(run, "bucket long")


def bitmap(buckets: DataFrame, bits: int) -> np.ndarray:
    """One bit for each bucket: 2^bits bits whatever the data, so it may be held whole and broadcast."""
    place = F.col("bucket") + 1
    rows = buckets.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(max(1 << bits, CHUNK) // 8, np.uint8)
    for r in rows.collect():
        out[(r.k - 1) * CHUNK // 8 :][: CHUNK // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def only(rows: DataFrame, key: str, keys: DataFrame, bits: int = 26) -> DataFrame:
    """The rows whose ``key``, a 64-bit hash, is among ``keys`` (key), and a few more: others needn't be dealt out to meet these.

    A bitmap of fixed size (8 MB) is broadcast. ``keys`` should be a written table, as it is read for this alone.
    """
    return parted(rows, key, keys, bits)[1]


def parted(rows: DataFrame, key: str, keys: DataFrame, bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` is surely not among ``keys``, and all others; see ``only``."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.shiftrightunsigned(key, 64 - bits).alias("bucket")), bits))

    def run(batches: Iterator[pa.RecordBatch], among: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (batch.column(key).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            inside = has(shared.value, place) == among
            for i in range(0, batch.num_rows, _SENT_ROWS):
                yield batch.slice(i, _SENT_ROWS).filter(pa.array(inside[i : i + _SENT_ROWS], pa.bool_()))
        give_back()

    return tuple(rows.mapInArrow(partial(run, among=among), rows.schema) for among in (False, True))
