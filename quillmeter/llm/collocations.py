r"""Phrase collocations by hashed buckets: each pass counts n-grams exactly and the next length by bucket (PCY, DHP)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.buckets import BucketCounts, bitmap, full_buckets, has
from quillmeter.llm.common import drop, give_back, row_slices, text_or_empty, written
from quillmeter.llm.wordhash import _STEP, _bytes_of, mixed

#: Buckets of n-grams, and bits of a broadcast bitmap (8 MB): a fixed size. Fewer buckets let more n-grams be counted, no others.
BUCKET_BITS = 26
LONGEST = 4

PART_SCHEMA = "lang string, phrase binary, n long, chunk int, places binary, counts binary"
_PIECE_END = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_BLANK = np.isin(np.arange(256), [0x20, 0x09])


class Pieces:
    """The words ``[^\\x20\\x09]+`` of pieces of texts, A-Z as a-z.

    ``row`` is each word's row, ``codes`` its place in ``distinct``; ``next_in_piece`` tells whether the next word follows in its piece.
    """

    def __init__(self, column: pa.Array):
        data, offsets = _bytes_of(column)
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        cut = _PIECE_END[data]
        inside = ~(cut | _BLANK[data])
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[:-1] < offsets[1:]
        start[offsets[:-1][full]] = inside[offsets[:-1][full]]
        end[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        piece = np.cumsum(cut, dtype=np.int32)[starts] if len(starts) else np.empty(0, np.int32)
        self.next_in_piece = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside])]).dictionary_encode()
        self.codes = words.indices.to_numpy().astype(np.int64)
        self.distinct = words.dictionary

    def runs(self, size: int) -> np.ndarray:
        """Whether ``size`` words from each word on stand in one piece."""
        n = max(len(self.codes) - size + 1, 0)
        ok = np.ones(n, bool)
        for j in range(size - 1):
            ok &= self.next_in_piece[j : j + n]
        return ok


def _word_hashes(distinct: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 11) for w in distinct.to_pylist()], np.uint64)


def _buckets(hashes: list[np.ndarray], lang: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of n-grams by their words' hashes, first to last, and their language's."""
    out = lang * _STEP
    for h in hashes:
        out = (out + h) * _STEP
    return (mixed(out) >> np.uint64(64 - bits)).astype(np.int64)


def _rows(lang: pa.Array | None = None, phrase: pa.Array | None = None, n: np.ndarray | None = None, buckets: tuple | None = None) -> pa.RecordBatch:
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    cols = [lang, phrase, n, *(buckets or (None,) * 3)]
    size = len(next(c for c in cols if c is not None))
    return pa.RecordBatch.from_arrays([pa.nulls(size, k) if c is None else pa.array(c, k) if not isinstance(c, pa.Array) else c.cast(k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in PART_SCHEMA.split(", ")])


def _pass(own: DataFrame, size: int, least: int, parts, buckets, bits: int = BUCKET_BITS) -> DataFrame:
    """Counts of the n-grams of ``size`` words that may be frequent, by slices of text, and bucket counts of the next size.

    ``parts``: bitmap of the frequent n-grams one word shorter, both of which an n-gram must have (Apriori);
    ``buckets``: bitmap of the buckets with ``least`` n-grams of this size. Both are broadcast and of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_size = BucketCounts(least, bits) if size < LONGEST else None
        for batch in batches:
            for part in row_slices(batch):
                p, langs = Pieces(part.column("text")), part.column("lang").dictionary_encode()
                if not len(p.codes):
                    continue
                h, lang = _word_hashes(p.distinct)[p.codes], langs.indices.to_numpy()[p.row]
                lang_hash = np.array([xxhash.xxh64_intdigest(x.encode(), 12) for x in langs.dictionary.to_pylist()], np.uint64)[lang]
                may = p.runs(size)
                of = lambda at, k, h=h, lang_hash=lang_hash: _buckets([h[at + j] for j in range(k)], lang_hash[at], bits)
                at = np.flatnonzero(may)
                if size > 1:
                    at = at[has(buckets.value, of(at, size))]
                    at = at[has(parts.value, of(at, size - 1))]
                    at = at[has(parts.value, of(at + 1, size - 1))]
                    may[:] = False
                    may[at] = True
                # dense numbers of (lang, words), one word after the other: exact, and never beyond 64 bits
                key = lang[at].astype(np.int64)
                for j in range(size):
                    key = np.unique(key * len(p.distinct) + p.codes[at + j], return_inverse=True)[1] if j < size - 1 else key * len(p.distinct) + p.codes[at + j]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                first = at[first]
                if len(first):
                    words = [p.distinct.take(pa.array(p.codes[first + j])) for j in range(size)]
                    phrase = pc.binary_join_element_wise(*words, b" ") if size > 1 else words[0]
                    yield _rows(langs.dictionary.take(pa.array(lang[first])), phrase, n)
                if next_size:
                    wider = p.runs(size + 1)
                    wider &= may[: len(wider)] & may[1 : len(wider) + 1]
                    next_size.add(of(np.flatnonzero(wider), size + 1))
        if next_size:
            rows = next_size.rows()
            if rows:
                yield _rows(buckets=tuple(zip(*rows, strict=True)))
        give_back()

    return own.mapInArrow(run, PART_SCHEMA)


def _phrase_buckets(counts: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """(bucket): those of the given phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, langs = pc.split_pattern(batch.column("phrase").cast(pa.binary()).cast(pa.string()), " "), batch.column("lang").to_pylist()
            if not batch.num_rows:
                continue
            flat, at = words.flatten().cast(pa.binary()).dictionary_encode(), words.offsets.to_numpy()
            h = _word_hashes(flat.dictionary)[flat.indices.to_numpy()]
            lang = np.array([xxhash.xxh64_intdigest(x.encode(), 12) for x in langs], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_buckets([h[at[:-1] + j] for j in range(at[1] - at[0])], lang, bits))], ["bucket"])

    return counts.select("lang", "phrase").mapInArrow(run, "bucket long")


def phrase_counts(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text", bits: int = BUCKET_BITS) -> tuple[list[DataFrame], DataFrame]:
    """Written tables (lang, phrase, n) of the phrases of 1 to 4 words with ``least`` occurrences, and (lang, n) of all words.

    Pass k counts k-grams exactly that may be frequent: both parts one word shorter are frequent, and the k-gram's
    bucket is full. In the same pass, (k + 1)-grams are counted by bucket. The filters let some infrequent n-grams pass,
    which exact counting drops, and hold back none that is frequent. Counts and bitmaps have 2^``bits`` buckets.
    """
    spark, own = docs.sparkSession, docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    found: list[DataFrame] = []
    shorter = full = totals = None
    for size in range(1, LONGEST + 1):
        parts = written(_pass(own, size, least, shorter, full, bits), f"grams{size}")
        counts = parts.where("chunk is null").groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))
        if size == 1:
            totals = written(parts.where("chunk is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        found.append(written(counts.where(F.col("n") >= least), f"phrases{size}"))
        for old in (shorter, full):
            if old:
                old.destroy()
        if size < LONGEST:
            shorter = spark.sparkContext.broadcast(bitmap(_phrase_buckets(found[-1], bits), bits))
            full = spark.sparkContext.broadcast(bitmap(full_buckets(parts.where("chunk is not null"), least), bits))
        drop(parts)
    return found, totals


def _subphrases(words: Column, size: Column) -> Column:
    """All runs of 2 to size - 1 words."""
    runs = F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))
    return F.array_distinct(F.flatten(runs))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text", bits: int = BUCKET_BITS) -> DataFrame:
    r"""The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts with A-Z as a-z are split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into words ``[^\x20\x09]+``; phrases
    are 2 to 4 words of a piece. ``a`` counts the phrase's occurrences (``least`` or more), ``l`` and ``r`` those of its
    parts at the cut with the smallest score floor(2000000 a / (l + r)), the first of equal ones; ``n`` counts the
    language's words. Phrases inside a longer candidate that comes 80 % as often are left out.

    Counting is ``phrase_counts``. Parts are looked up by joins on (lang, part), all arithmetic is of integers or
    decimals without places. Only ``top`` rows of a task and language meet to be ranked.

    A null lang counts as ``und``, a null text as empty. Repeated rows count again. Other columns, ids among them, are
    not read. Rows are ordered by score and ``a`` downwards, then phrase by its bytes. An empty table gives an empty result.
    """
    found, totals = phrase_counts(docs, least, lang_col, text_col, bits)
    sized = [t.withColumn("size", F.lit(k + 1)) for k, t in enumerate(found)]
    shorter = sized[0].union(sized[1]).union(sized[2]).drop("size")
    long_ones = sized[1].union(sized[2]).union(sized[3]).withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    cuts = long_ones.select("lang", "phrase", "a", "size", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(shorter.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(shorter.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(18,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + r)").cast("long")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inside = long_ones.where("size > 2").select("lang", F.explode(_subphrases(words, F.col("size"))).alias("phrase"), "a")
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * 80))
    order = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"
    ranked = left.withColumn("rank", F.expr(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
