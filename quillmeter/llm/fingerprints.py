"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import row_slices, shuffle_width, text_or_empty
from quillmeter.llm.wordhash import Words, mixed, run_hashes

#: Bins (the top bits of a shingle's hash choose one), kept low-order bits of each bin's minimum, words of a shingle.
BINS, BITS, SHINGLE = 512, 4, 5
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - (BINS - 1).bit_length())
#: Row t holds for each bin the t-th bin that it asks when it is empty: a universal hash of bin and attempt.
_TRIES = 4096
_PROBE = np.empty((_TRIES, BINS), np.int16)
for _t in range(0, _TRIES, 64):  # in pieces: each worker makes this table
    _PROBE[_t : _t + 64] = (mixed(np.arange(_t * BINS + 1, (_t + 64) * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int16).reshape(64, BINS)
_SALT = np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
_NO_WORD = mixed(np.array([1], np.uint64))
NO_ID = -(1 << 63)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The bins' kept bits for a text's word hashes. Under SHINGLE words: one shingle; none: one fixed shingle."""
    shingles = run_hashes(hashes, min(SHINGLE, len(hashes))) if len(hashes) else _NO_WORD
    shingles = np.sort(shingles)
    at = np.searchsorted(shingles, _EDGES)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & (np.diff(np.append(at, len(shingles))) > 0)
    source = np.arange(BINS)
    empty, t = np.flatnonzero(~full), 0
    while len(empty) and t < _TRIES:
        asked = _PROBE[t : t + 32][:, empty]
        good = full[asked]
        hit = good.any(axis=0)
        source[empty[hit]] = asked[good.argmax(axis=0)[hit], np.flatnonzero(hit)]
        empty, t = empty[~hit], t + 32
    if len(empty):  # almost never; the first bin that isn't empty
        source[empty] = np.flatnonzero(full)[0]
    # mixed with the bin: a shingle that fills several bins gives each its own bits, so chance hits don't come together
    return (mixed(least[source] + _SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(sig: np.ndarray) -> str:
    """BINS values of BITS bits as hex digits."""
    return np.packbits(np.unpackbits(sig.reshape(-1, 1), axis=1)[:, 8 - BITS :].reshape(-1)).tobytes().hex()


def unpacked(hexed: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(hexed), np.uint8)).reshape(BINS, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets: kept bits also agree by chance, 1 time in 2^BITS."""
    chance = 2.0**-BITS
    return float(max(0.0, (np.mean(a == b) - chance) / (1 - chance)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, kind, ord, doc_id, text), sorted by descending id inside each bucket.

    Buckets are ranges of ids between quantiles. The first row of the next lower bucket is sent along (kind 1) after a
    bucket's own rows (kind 0); the lowest bucket gets the very first row. The driver sees one row for each bucket.
    """
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("ord", F.coalesce("doc_id", F.lit(NO_ID)))
    n = 4 * width
    found = own.agg(F.percentile_approx(F.col("ord").cast("double"), [i / n for i in range(1, n)], 10 * n).alias("q")).first().q or [0.0]
    splits = [float("-inf"), *sorted(set(found)), float("inf")]
    from pyspark.ml.feature import Bucketizer  # on the driver alone: workers need not load it

    cut = Bucketizer(splits=splits, inputCol="place", outputCol="at")
    own = cut.transform(own.withColumn("place", F.col("ord").cast("double"))).select(F.col("at").cast("int").alias("bucket"), "ord", "doc_id", "text")
    tie = F.xxhash64("text")
    heads = [(r.bucket, r.head.ord, r.head.tie) for r in own.groupBy("bucket").agg(F.max(F.struct("ord", tie.alias("tie"))).alias("head")).collect()]
    heads.sort()
    to = [(h[0], *h[1:], up[0]) for h, up in zip(heads, heads[1:] + heads[:1], strict=True)]
    small = F.broadcast(spark.createDataFrame(to, "bucket int, ord long, head_tie long, target int"))  # a row for each bucket
    first = own.join(small, ["bucket", "ord"]).where(tie == F.col("head_tie")).select(F.col("target").alias("bucket"), F.lit(1).alias("kind"), "ord", "doc_id", "text")
    rows = own.select("bucket", F.lit(0).alias("kind"), "ord", "doc_id", "text").union(first)
    return rows.repartition(width, "bucket").sortWithinPartitions("bucket", "kind", F.desc("ord"), tie.desc())


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited copy, with the likeness that the packed bits show.

    The edited text's last floor(n_chars/2) code points are the first as many (or all) of the next document by
    descending id; the first follows the last, and a single document follows itself. Rows without an id come last;
    equal ids are ordered by a hash of the text, and repeated rows follow one another. A null text counts as empty.
    Each input row gives a row; an empty table gives an empty result. Other columns are not read.
    """

    def signatures(texts: list[str]) -> list[np.ndarray]:
        w = Words(pa.array(texts, pa.string()))
        return [signature(w.hashes[a:b]) for a, b in zip(w.first, w.first[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in row_slices(batch, size=1 << 20):
                texts = part.column("text").to_pylist()
                rows = held + list(zip(part.column("bucket").to_pylist(), part.column("kind").to_pylist(), part.column("doc_id").to_pylist(), texts, signatures(texts), strict=True))
                pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[1] == 0 and x[0] == y[0]]
                edited = [x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2] for x, y in pairs]
                out = [
                    (x[2], len(x[3]), hashlib.sha256(e.encode()).hexdigest(), packed(x[4]), packed(s), likeness(x[4], s), likeness(x[4], y[4]))
                    for (x, y), e, s in zip(pairs, edited, signatures(edited), strict=True)
                ]
                held = rows[-1:]
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return with_next(docs, id_col, text_col).mapInArrow(run, SCHEMA)
