"""Removal of repeated byte strings: candidate stretches are cut by content, and sharded suffix arrays decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.buckets import BucketCounts, bitmap, full_buckets, has, only
from quillmeter.llm.common import drop, freed, give_back, row_slices, shuffle_width, text_or_empty
from quillmeter.llm.induced import common_prefixes, suffix_array
from quillmeter.llm.wordhash import _CHUNK, _INVERSE, _POWER, _VALUE, _bytes_of, mixed, sliding

#: Bytes of a gram: a window's anchor is its gram with the least hash, so equal windows have equal anchors at equal places.
GRAM = 64
#: Buckets of anchors, and bits of the broadcast bitmap (8 MB): a fixed size. A full one lets all stretches through.
BUCKET_BITS = 26
#: Rounds of counting anchors: each counts those that the rounds before let through, so that few are left by chance.
ROUNDS = 2
#: Bytes of the stretches whose suffixes are sorted together.
SHARD_BYTES = 2 << 20
#: Bytes of an anchor's different stretches above which its windows are dealt out one by one.
HOT_BYTES = 1 << 20
VECTOR_BYTES = 2 << 20

COUNT_SCHEMA = "chunk int, places binary, counts binary"
DOC_SCHEMA = "uid long, doc_id long, n_bytes long, kept_sha256 string, stretches array<struct<anchor:long,content:long,at:int,windows:int>>"
_STRETCHES = pa.list_(pa.struct([("anchor", pa.int64()), ("content", pa.int64()), ("at", pa.int32()), ("windows", pa.int32())]))


class Stretches:
    """The stretches of each value of a column: runs of windows with one anchor, at one place. Each window is in just one.

    ``row``: of each stretch; ``start``: its first byte among all values' bytes ``data``; ``windows``: how many;
    ``anchor``: the hash of the gram that they have. A stretch has windows + window - 1 bytes.
    """

    def __init__(self, column: pa.Array, window: int, gram: int):
        self.data, self.offsets = _bytes_of(column)
        self.window = window
        self.until = np.repeat(self.offsets[1:], np.diff(self.offsets))
        found = [self._block(a, gram) for a in range(0, max(len(self.data) - window + 1, 0), _CHUNK - window)]
        self.start, self.windows, self.anchor = (np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 3))
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1

    def _block(self, a: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows that start in a block; a run that reaches over its end is cut, which changes no result."""
        seg = self.data[a : a + _CHUNK - 1]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[seg] * _POWER[: len(seg)])))
        n = len(seg) - gram + 1
        h = mixed((total[gram:] - total[:-gram]) * _INVERSE[:n])
        place = np.uint64(_CHUNK - 1)
        # the least hash, and of equal ones the first, with its place in the low bits
        least = (sliding(np.minimum, (h & ~place) | np.arange(n, dtype=np.uint64), self.window - gram + 1) & place).astype(np.int64)[: _CHUNK - self.window]
        until = self.until[a : a + len(least)]
        ok = np.arange(a + self.window, a + self.window + len(least)) <= until
        new = np.ones(len(least) + 1, bool)
        new[1:-1] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1]) | (until[1:] != until[:-1])
        edge = np.flatnonzero(new)
        head, size = edge[:-1], np.diff(edge)
        good = ok[head]
        head, size = head[good], size[good]
        return head + a, size, h[least[head]].view(np.int64)

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.windows[i] + self.window - 1].tobytes()

    def contents(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of some stretches."""
        view, end = memoryview(self.data), self.start + self.windows + self.window - 1
        return np.array([xxhash.xxh64_intdigest(view[a:b], 7) for a, b in zip(self.start[which].tolist(), end[which].tolist(), strict=True)], np.uint64).view(np.int64)


def _buckets(anchor: np.ndarray, bits: int, round_: int = 0) -> np.ndarray:
    """Buckets of anchors; anchors that share one in a round hardly do in another."""
    h = anchor.view(np.uint64) if not round_ else mixed(anchor.view(np.uint64) + np.uint64(round_))
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _may_repeat(anchor: np.ndarray, maps: list, bits: int) -> np.ndarray:
    ok = np.ones(len(anchor), bool)
    for round_, bitmap_ in enumerate(maps):
        ok[ok] = has(bitmap_.value, _buckets(anchor[ok], bits, round_))
    return ok


def _anchor_counts(own: DataFrame, maps: list, window: int, gram: int, bits: int) -> DataFrame:
    """Bucket counts of the anchors that the bitmaps of earlier rounds let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = BucketCounts(2, bits)
        for batch in batches:
            for part in row_slices(batch, size=VECTOR_BYTES):
                anchor = Stretches(part.column("text"), window, gram).anchor
                counts.add(_buckets(anchor[_may_repeat(anchor, maps, bits)], bits, len(maps)))
        rows = counts.rows()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "places", "counts"])
        give_back()

    return own.select("text").mapInArrow(run, COUNT_SCHEMA)


def _documents(own: DataFrame, maps: list, window: int, gram: int, bits: int) -> DataFrame:
    """All documents without their texts; those with a stretch whose anchor the bitmaps let through have these stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, size=VECTOR_BYTES):
                s, n = Stretches(part.column("text"), window, gram), part.num_rows
                may = np.flatnonzero(_may_repeat(s.anchor, maps, bits))
                row, content = s.row[may], s.contents(may)
                at = np.searchsorted(row, np.arange(n + 1))
                flat = pa.StructArray.from_arrays([pa.array(s.anchor[may]), pa.array(content), pa.array((s.start[may] - s.offsets[row]).astype(np.int32)), pa.array(s.windows[may].astype(np.int32))], ["anchor", "content", "at", "windows"])
                sha = [hashlib.sha256(s.data[a:b]).hexdigest() for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("doc_id"), pa.array(np.diff(s.offsets)), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat).cast(_STRETCHES)],
                    [c.split()[0] for c in DOC_SCHEMA.split(", ")],
                )
        give_back()

    return own.mapInArrow(run, DOC_SCHEMA)


def _stretch_texts(own: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """(anchor, content, hot, bytes): the bytes of the chosen stretches, from each row of the document that stands for it.

    Only those documents' texts are dealt out.
    """
    lists = freed(chosen.groupBy("uid").agg(F.collect_list(F.struct("anchor", "content", "at", "windows", "hot")).alias("own")), "chosen")
    met = only(own.select("uid", "text"), "uid", lists.select("uid")).join(lists.hint("shuffle_hash"), "uid").select("own", F.col("text").cast("binary").alias("text"))
    cut = F.transform("own", lambda s: F.struct(s["anchor"].alias("anchor"), s["content"].alias("content"), s["hot"].alias("hot"), F.expr("text").substr(s["at"] + 1, s["windows"] + F.lit(window - 1)).alias("bytes")))
    texts = freed(met.select(F.inline(cut)), "texts")
    drop(lists)
    return texts


def repeated_windows(stretches: list[bytes], window: int) -> list[np.ndarray]:
    """For each of some different stretches the windows that start anywhere else in them.

    The stretches, with a mark after each, are one text. A window is repeated if its suffix shares ``window`` bytes with
    the suffix before it or behind it in the order; marks are in no window.
    """
    size = np.array([len(s) for s in stretches], np.int64)
    start = np.concatenate(([0], np.cumsum(size + 1)))
    t = np.frombuffer(b"\x00".join([*stretches, b""]) + b"\x00", np.uint8) + np.uint8(2)  # UTF-8 has no byte above 0xF4
    t[start[1:] - 1], t[-1] = 1, 0
    before, common = common_prefixes(t, suffix_array(t, 256))
    far = common >= window
    rep = far.copy()
    rep[before[far]] = True
    return [np.flatnonzero(rep[a : a + n - window + 1]) for a, n in zip(start[:-1].tolist(), size.tolist(), strict=True)]


def _ranges(windows: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(windows) != 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(windows, cut) if len(x)]


def _by_suffix_arrays(texts: DataFrame, shards: int, window: int) -> DataFrame:
    """(anchor, content, a, b): repeated windows of stretches. A shard holds whole anchors; a task sorts one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided() -> pa.RecordBatch:
            rows = [(*key, a, b) for key, w in zip(keys, repeated_windows(held, window), strict=True) for a, b in _ranges(w)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["anchor", "content", "a", "b"])

        shard, size, keys, held = None, 0, [], []
        for batch in batches:
            for k, anchor, content, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "anchor", "content", "bytes")), strict=True):
                if held and keys[-1] == (anchor, content):  # of another row with the same id and text
                    continue
                if held and (k != shard or size >= SHARD_BYTES and anchor != keys[-1][0]):
                    yield decided()
                    size, keys, held = 0, [], []
                shard, size = k, size + len(data)
                keys.append((anchor, content))
                held.append(data)
        if held:
            yield decided()
        give_back()

    spark = texts.sparkSession
    dealt = texts.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "content", "bytes")
    met = dealt.repartition(max(shuffle_width(spark), shards // 16), "shard").sortWithinPartitions("shard", "anchor", "content")
    return met.mapInArrow(run, "anchor long, content long, a int, b int")


def _by_single_windows(texts: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many stretches: their windows are dealt out by the windows' own hash and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "bytes")), strict=True):
                n, view = len(data) - window + 1, memoryview(data)
                h = np.array([xxhash.xxh64_intdigest(view[i : i + window], 7) for i in range(n)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(np.full(n, content)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h)], ["anchor", "content", "a", "h"])

    rows = texts.select("anchor", "content", "bytes").mapInArrow(run, "anchor long, content long, a int, h long")
    twice = rows.groupBy("anchor", "h").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(twice, ["anchor", "h"]).select("anchor", "content", "a", (F.col("a") + 1).alias("b"))


def _kept(own: DataFrame, lists: DataFrame) -> DataFrame:
    """The documents of ``lists`` (uid, gone) without the bytes in any of their ranges; no other text is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                parts, at, removed, spans = [], 0, 0, 0
                for r in sorted((r["a"], r["b"]) for r in ranges):
                    if r[0] > at or not spans:  # a run that touches the last one goes on with it
                        parts.append(text[at : r[0]])
                        at, spans = r[0], spans + 1
                    removed += max(r[1] - at, 0)
                    at = max(r[1], at)
                left = b"".join([*parts, text[at:]])
                out.append((len(text), removed, spans, hashlib.sha256(left).hexdigest()))
            size, n, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    met = only(own, "uid", lists.select("uid")).join(lists.hint("shuffle_hash"), "uid")
    return met.select("doc_id", F.col("text").cast("binary").alias("text"), "gone").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_bytes(docs: DataFrame, window: int = 200, gram: int = GRAM, bits: int = BUCKET_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere else, in the same text or another.
    ``n_spans`` counts maximal runs of bytes that go. ``kept_sha256`` is of the bytes that stay, one after the other.

    1. Each window is stood for by its gram with the least hash, the anchor. Windows with one anchor at one place form a
    stretch; each window is in one. Anchors are counted by hashed buckets, in two rounds, and the bitmaps of those that come
    twice are broadcast: other stretches have no partner. 2. Stretches are counted by (anchor, hash of their bytes). One that
    comes again is repeated as a whole. One occurrence of each goes on where its anchor has different stretches.
    3. These are dealt into shards by anchor; a shard's suffixes are sorted by induced sorting, and common prefixes in
    text order tell which windows are repeated. An anchor with very many different stretches would fill a shard: its
    windows are dealt out one by one, by hash, and counted. 4. The covered bytes are removed.

    Texts aren't written: a row is named by a 64-bit hash of id and text (so ``docs`` should give the same rows each time it
    is read), and only the texts that stand for a stretch or lose bytes are read again and dealt out.

    A null or empty text has 0 bytes. Rows without an id and repeated rows are documents like others. Other columns are
    not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    own = own.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text")
    maps: list = []
    for _ in range(ROUNDS):
        maps.append(spark.sparkContext.broadcast(bitmap(full_buckets(_anchor_counts(own, maps, window, gram, bits), 2), bits)))
    all_docs = freed(_documents(own, maps, window, gram, bits), "documents")
    for old in maps:
        old.destroy()
    stretches = all_docs.select("uid", F.inline("stretches"))
    keys = ["anchor", "content"]
    # one occurrence of each: the least (uid, at), as one number
    place = F.col("uid").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("at")
    counted = stretches.groupBy(*keys).agg(F.count("*").alias("n"), F.max("windows").alias("windows"), F.min(place.cast("decimal(30,0)")).alias("one"))
    anchors = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.sum(F.col("windows") + F.lit(window)).alias("bytes")).where("`all` > 1")
    spot = [F.expr(f"(one - pmod(one, {1 << 31})) div {1 << 31}").alias("uid"), F.expr(f"CAST(pmod(one, {1 << 31}) AS INT)").alias("at")]  # hashes may be negative
    met = freed(counted.join(anchors, "anchor").select(*keys, "n", "windows", *spot, "kinds", (F.col("bytes") > HOT_BYTES).alias("hot")), "stretches")
    whole, open_ = met.where("n > 1").select(*keys), met.where("kinds > 1").select(*keys, "uid", "at", "windows", "hot")
    texts = _stretch_texts(own, open_, window)
    total = texts.where("not hot").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    ranges = _by_suffix_arrays(texts.where("not hot"), max(1, -(-total // SHARD_BYTES)), window).union(_by_single_windows(texts.where("hot"), window))
    ranges = freed(ranges.union(whole.select(*keys, F.lit(0).alias("a"), F.lit(None).cast("int").alias("b"))), "ranges")
    drop(texts)
    gone = stretches.join(ranges, keys).select("uid", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.coalesce("b", "windows") + F.lit(window - 1)).alias("b"))
    lists = freed(gone.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("gone")), "gone")
    drop(met, ranges)
    whole = all_docs.join(lists.select("uid"), "uid", "left_anti")
    return whole.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256").union(_kept(own, lists))
