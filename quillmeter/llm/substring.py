"""Substring de-duplication: confirmed repeated phrases, sharded Aho-Corasick automata, every occurrence removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import row_slices, shuffle_width, text_or_empty, words, written
from quillmeter.llm.wordhash import Words, run_hashes, sliding

#: Words of a seed: the least seed hash of a window stands for the window, so that equal windows choose equal seeds.
SEED_WORDS = 5
#: Words that one automaton scans, and patterns that it holds, before its group is split.
SCAN_WORDS = 50_000
PATTERNS = 100_000
#: Rows without an id come after all others.
NO_ID = (1 << 63) - 1

FIRST_SCHEMA = "uid long, doc_id long, ord long, n_words long, kept_sha256 string, text string, spans array<struct<o:long,a:int,b:int>>, carried {}"
SPAN_SCHEMA = "o long, uid long, ord long, a int, n int, words binary"
_SPAN_NAMES = ["o", "uid", "ord", "a", "n", "words"]
_SPANS = pa.list_(pa.struct([("o", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))
#: Bytes of text for which numpy vectors are made at once.
VECTOR_BYTES = 2 << 20


def _text(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    doc_id, carried = F.col(id_col).cast("long"), F.struct(*carry) if carry else F.struct(F.lit(True).alias("none"))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("ord"), text_or_empty(text_col).alias("text"), carried.alias("carried"))


def window_seeds(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of words the least hash of the seeds inside it (48 bits)."""
    k = min(SEED_WORDS, window)
    return sliding(np.minimum, run_hashes(h, k) >> np.uint64(16), window - k + 1)


def _slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from row_slices(batch, text, VECTOR_BYTES)


def _seeds(own: DataFrame, window: int) -> DataFrame:
    """(seed, ord): the distinct seeds of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            w, ords = Words(part.column("text")), part.column("ord").to_numpy()
            seed, row = window_seeds(w.hashes, window).view(np.int64), w.rows(window)
            keep = row >= 0
            keep[1:] &= (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
            seed, row = seed[keep], row[keep]
            order = np.lexsort((seed, row))
            seed, row = seed[order], row[order]
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(seed[new]), pa.array(ords[row[new]])], ["seed", "ord"])

    return own.select("ord", "text").mapInArrow(run, "seed long, ord long")


def _first_pass(own: DataFrame, owners: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Documents without a repeated seed are finished; the others get spans (owner, first window, end window).

    Texts go along only where a later step needs them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for part in _slices(batches):
            w, text = Words(part.column("text")), part.column("text")
            pairs, sha, left, spans = part.column("owners"), [], [], []
            flat, at = pairs.flatten(), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(pairs), 0).to_numpy())))
            seeds, owner = flat.field("seed").to_numpy(), flat.field("o").to_numpy()
            for i in range(part.num_rows):
                found, (a, b), (p, q) = [], w.first[i : i + 2], at[i : i + 2]
                if q > p and b - a >= window:
                    order = np.argsort(seeds[p:q])
                    keys, s = seeds[p:q][order], window_seeds(w.hashes[a:b], window).view(np.int64)
                    k = np.minimum(np.searchsorted(keys, s), q - p - 1)
                    o = np.where(keys[k] == s, owner[p:q][order][k], -1)
                    hit = keys[k] == s
                    cuts = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (hit[1:] != hit[:-1]), [True])))
                    found = [{"o": int(o[x]), "a": int(x), "b": int(y)} for x, y in zip(cuts, cuts[1:], strict=False) if hit[x]]
                spans.append(found)
                sha.append(None if found else hashlib.sha256(w.joined(i)).hexdigest())
                left.append(text[i].as_py() if found or keep_text else None)
            uids = np.arange(uid, uid + part.num_rows)
            uid += part.num_rows
            cols = [pa.array(uids), part.column("doc_id"), part.column("ord"), pa.array(np.diff(w.first)), pa.array(sha, pa.string()), pa.array(left, pa.string()), pa.array(spans, _SPANS), part.column("carried")]
            yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "ord", "n_words", "kept_sha256", "text", "spans", "carried"])

    joined = own.join(owners.hint("shuffle_hash"), "ord", "left").select("doc_id", "ord", "text", "owners", "carried")
    return joined.mapInArrow(run, FIRST_SCHEMA.format(joined.schema["carried"].dataType.simpleString()))


def _flat_spans(spans: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Of all spans of a column: row, owner, first window, end window."""
    flat = spans.flatten()
    row = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).to_numpy())
    return row, flat.field("o").to_numpy(), flat.field("a").to_numpy().astype(np.int64), flat.field("b").to_numpy().astype(np.int64)


def _window_rows(open_: DataFrame, window: int) -> DataFrame:
    """(h, ord): the distinct windows in the spans of each document, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            w, ords = Words(part.column("text")), part.column("ord").to_numpy()
            row, _, a, b = _flat_spans(part.column("spans"))
            inside = np.zeros(len(w.starts) + 1, np.int32)
            np.add.at(inside, w.first[row] + a, 1)
            np.add.at(inside, w.first[row] + b, -1)
            at = np.flatnonzero(np.cumsum(inside[:-1]))
            h, row = run_hashes(w.hashes, window)[at].view(np.int64), w.rows(1)[at]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(ords[row[new]])], ["h", "ord"])

    return open_.select("ord", "text", "spans").mapInArrow(run, "h long, ord long")


def _span_rows(open_: DataFrame, window: int) -> DataFrame:
    """(o, uid, ord, a, n, words): the words of each span; ``a`` is the first one's place, ``n`` their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            w = Words(part.column("text"))
            row, o, a, b = _flat_spans(part.column("spans"))
            end = b + window - 1
            runs = [w.slice(x, y) for x, y in zip(w.first[row] + a, w.first[row] + end, strict=True)]
            uid, ord_ = (part.column(c).to_numpy()[row] for c in ("uid", "ord"))
            yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(uid), pa.array(ord_), pa.array(a.astype(np.int32)), pa.array((end - a).astype(np.int32)), pa.array(runs, pa.binary())], _SPAN_NAMES)

    return open_.select("uid", "ord", "text", "spans").mapInArrow(run, SPAN_SCHEMA)


def _passages(spans: DataFrame, confirmed: DataFrame, window: int) -> DataFrame:
    """Runs of confirmed windows in the document where they come first. ``uid`` and ``a`` aren't used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "words"):
            w, rows = Words(part.column("words")), []
            for i, (o, ord_) in enumerate(zip(part.column("o").to_pylist(), part.column("ord").to_pylist(), strict=True)):
                a, b = w.first[i : i + 2]
                hs = part.column("hs")[i].values.to_numpy()
                good = np.isin(run_hashes(w.hashes[a:b], window).view(np.int64), hs)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0])))) + a
                rows += [(o, None, ord_, 0, y - x + window - 1, w.slice(x, y + window - 1)) for x, y in zip(edge[::2], edge[1::2], strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], _SPAN_NAMES)

    lists = confirmed.groupBy("ord").agg(F.collect_list("h").alias("hs"))
    return spans.join(lists.hint("shuffle_hash"), "ord").select(*_SPAN_NAMES, "hs").mapInArrow(run, SPAN_SCHEMA)


class Automaton:
    """Aho-Corasick over word numbers: finds each window of the given passages in a run of words."""

    def __init__(self, window: int, part: int = 0, parts: int = 1):
        self.window, self.part, self.parts = window, part, parts
        self.numbers: dict[bytes, int] = {}
        self.first: list[int] = []
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.ready = False

    def add(self, passage: bytes, ord_: int) -> None:
        mine = run_hashes(Words(pa.array([passage], pa.binary())).hashes, self.window) % np.uint64(self.parts) == self.part
        ids = tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in passage.split())
        for i in np.flatnonzero(mine).tolist():
            self.trie.add_word(ids[i : i + self.window], len(self.first))
        self.first.append(ord_)

    def covered(self, run: bytes, ord_: int) -> list[tuple[int, int]]:
        """Ranges of words covered by windows that come first in a document before ``ord_``."""
        if not len(self.trie):
            return []
        if not self.ready:
            self.trie.make_automaton()
            self.ready = True
        get, out = self.numbers.get, []
        for end, k in self.trie.iter(tuple(get(x, 0) for x in run.split())):
            if self.first[k] < ord_:
                a = end - self.window + 1
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], end + 1)
                else:
                    out.append((a, end + 1))
        return out


def _located(spans: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """(uid, a, b): the covered ranges. Passages and spans of an owner meet in one group; large groups are split.

    A group with many words to scan is dealt over salts, each with a copy of the patterns; one with many patterns is cut
    into parts, each with a copy of the words. Copied patterns stay fewer than the words to scan. Rows come sorted, patterns first: a task holds one automaton at a time
    and streams the words.
    """
    sizes = spans.select("o", F.col("n").alias("scan"), F.lit(0).alias("pats")).union(passages.select("o", F.lit(0), F.col("n") - window + 1))
    sizes = sizes.groupBy("o").agg(F.ceil(F.sum("scan") / F.greatest(F.lit(SCAN_WORDS), 2 * F.sum("pats"))).alias("salts"), F.ceil(F.sum("pats") / PATTERNS).alias("parts"))
    large = written(sizes.where("salts > 1 or parts > 1"), "large")
    up_to = lambda c: F.sequence(F.lit(0), F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("int") - 1)
    parts = F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)).cast("int").alias("parts")
    a = passages.join(large, "o", "left").select("*", parts.alias("np"), F.explode(up_to(F.col("salts"))).alias("salt"))
    a = a.select("*", F.explode(up_to(F.col("parts"))).alias("part"), F.lit(0).alias("kind"))
    b = spans.join(large, "o", "left").select("*", parts.alias("np"), F.pmod(F.xxhash64("uid"), F.greatest(F.coalesce("salts", F.lit(1)), F.lit(1))).cast("int").alias("salt"))
    b = b.select("*", F.explode(up_to(F.col("parts"))).alias("part"), F.lit(1).alias("kind"))
    cols = ["o", "salt", "part", "kind", "np", "uid", "ord", "a", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, machine = None, None
        for batch in batches:
            rows = []
            for o, salt, part, kind, np_, uid, ord_, at, run_ in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                if key != (o, salt, part):
                    key, machine = (o, salt, part), Automaton(window, part, np_)
                if kind == 0:
                    machine.add(run_, ord_)
                else:
                    rows += [(uid, at + x, at + y) for x, y in machine.covered(run_, ord_)]
            cs = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cs[0], pa.int64()), pa.array(cs[1], pa.int32()), pa.array(cs[2], pa.int32())], ["uid", "a", "b"])

    spark = spans.sparkSession
    met = a.select(cols).union(b.select(cols)).repartition(shuffle_width(spark), "o", "salt", "part").sortWithinPartitions("o", "salt", "part", "kind")
    return met.mapInArrow(run, "uid long, a int, b int")


def dedup_substrings(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``, with ``keep_text`` also ``kept_text``, and ``carried``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id. Kept words
    are joined by one space; a kept text that loses nothing stays as it is. ``carried`` holds the columns ``carry``.

    1. Each window is stood for by the least hash of its five-word seeds. Seeds that two documents have are repeated;
       a seed's owner is its smallest document. 2. Windows over repeated seeds are counted by hash; those in two
    documents are confirmed. Runs of them in their first document are the passages. 3. Passages are compiled into
    Aho-Corasick automata, sharded by owner. All documents' spans over repeated seeds stream through the automaton of
    their owner; all other windows have no partner. 4. The covered words are removed.

    Null texts count as empty. Rows without an id come after all others and don't affect each other, nor do rows with
    equal ids. Each input row gives a row. Other columns are not read. An empty table gives an empty result.
    """
    own = _text(docs, id_col, text_col, carry or [])
    seeds = _seeds(own, window)
    repeated = written(seeds.groupBy("seed").agg(F.min("ord").alias("o"), F.count("*").alias("n")).where("n > 1").select("seed", "o"), "seeds")
    owners = seeds.join(repeated, "seed").groupBy("ord").agg(F.collect_list(F.struct("seed", "o")).alias("owners"))
    first = written(_first_pass(own, owners, window, keep_text), "first")
    open_ = first.where("size(spans) > 0")
    windows = _window_rows(open_, window).groupBy("h").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    spans = _span_rows(open_, window)
    passages = written(_passages(spans, windows.where("n > 1").select("h", "ord"), window), "passages")
    gone = written(_located(spans.where("o < ord"), passages, window), "gone").groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                out = []
                for text, ranges in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    w = words(text)
                    keep = np.ones(len(w), bool)
                    for r in ranges or ():
                        keep[r["a"] : r["b"]] = False
                    left = b" ".join([x for x, k in zip(w, keep.tolist(), strict=True) if k])
                    out.append((int(len(w) - keep.sum()), hashlib.sha256(left).hexdigest(), (text if keep.all() else left.decode()) if keep_text else None))
                n, sha, kept = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_words", "carried")), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names)

    names = ["doc_id", "n_words", "carried", "n_removed", "kept_sha256", "kept_text"]
    cut = open_.join(gone.hint("shuffle_hash"), "uid", "left").select("doc_id", "n_words", "carried", "text", "gone")
    cut = cut.mapInArrow(run, f"doc_id long, n_words long, carried {first.schema['carried'].dataType.simpleString()}, n_removed long, kept_sha256 string, kept_text string")
    done = first.where("size(spans) = 0").select("doc_id", "n_words", "carried", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.col("text").alias("kept_text"))
    every = done.union(cut)
    return every.select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text, *["carried"] * bool(carry))
