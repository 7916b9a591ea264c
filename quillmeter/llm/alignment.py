"""Cross-tokenizer alignment: tokens of two vocabularies grouped by common cuts, pairs counted over the corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm import tokenizing
from quillmeter.llm.common import give_back, row_slices, shuffle_width, text_or_empty, written
from quillmeter.llm.wordhash import _bytes_of

#: Text bytes of a block of documents. A block's pairs are looked up once, whatever its documents repeat.
BLOCK_BYTES = 8 << 20
#: Bytes of units that a library gets at once.
CHUNK_BYTES = 1 << 16
#: Links that are expanded at once, and links of a group from which its repeated ids are counted before they are paired.
EXPANDED = 1 << 20
LARGE_GROUP = 256
#: A pair's partial counts are dealt over so many salts first.
SALTS = 16

#: Neither vocabulary has a token across these cuts: white space begins, but no carriage return, and none stood before.
_CUT = re.compile(r"(?<=[^ \n\t\r])(?=[ \n\t])")
_UNIT_SPACE = np.isin(np.arange(256), [*b" \n\t"])
#: Texts with other white space are cut by the expression above, or not at all.
_ODD = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

PART_SCHEMA = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, sizes binary, pair long, n long, best boolean"
_NAMES = [c.split()[0] for c in PART_SCHEMA.split(", ")]
_PAIR, _UNITS, _DOC = 0, 1, 2
OUT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabularies:
    """Ids of units by a byte-level vocabulary (A) and a sentencepiece model (B), and the bytes of ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        byte = {c: b for b, c in tokenizing._BYTE_CHARS.items()} | {chr(b): b for b in tokenizing._PRINTED}
        found = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [found.get(i, b"") for i in range(max(found) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        with open(path_a) as f:
            config = json.load(f)
        level = tokenizing._rules(config)[0] is not None and config["pre_tokenizer"].get("type") == "ByteLevel"
        self.cuts = level and not any(re.search("[^▁]▁|[\n\t]", p) for p in pieces)
        self.quick = _by_ranks(config, byte) if level else None
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # an id as text with what may follow it: another id of its side, the other side, another group
        self.text_a, self.text_b = (np.array([[f"{i}{e}".encode() for e in ends] for i in range(len(t))], object) for t, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))

    def units(self, text: str) -> list[str]:
        """A text that starts with a blank, cut where both vocabularies' tokens end; whole where that isn't sure."""
        return _CUT.split(text) if self.cuts and not tokenizing._OTHER_SPACE.search(text) else [text]

    def ids_a(self, text: str, common: bool = False) -> list[int]:
        if common and self.quick:
            return self.quick(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def ids_b(self, text: str) -> list[int]:
        """The model adds a blank; it stands for the text's own first one, or goes again."""
        if text[:1] != " ":
            return self.b.encode(text, num_threads=1)[1:]
        return self.b.encode(text[1:], num_threads=1) or [self.space]


def _by_ranks(config: dict, byte: dict[str, int]) -> Callable[[str], list[int]] | None:
    """An encoder by ranks for a byte-level vocabulary whose ids rise in the order of its merges: the same ids, sooner."""
    import tiktoken

    model = config["model"]
    vocab = model["vocab"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    single = [i for t, i in vocab.items() if len(t) == 1]
    if model.get("ignore_merges") or made != sorted(set(made)) or len(single) != 256 or made[0] < max(single):
        return None
    merged = set(made)
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if len(t) == 1 or i in merged}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed by this kind
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs at[i] to at[i + 1]; empty ones are 0."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _starts(values: np.ndarray, n: int) -> np.ndarray:
    """Where each of 0 .. n - 1 begins in sorted values, and their end."""
    return np.searchsorted(values, np.arange(n + 1))


def _per_group(group: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), and how often each comes."""
    keys, n = np.unique(group * width + ids, return_counts=True)
    return keys // width, keys % width, n


def _expanded(ga: np.ndarray, a: np.ndarray, na: np.ndarray, at: np.ndarray, b: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, pair, links) of each A row with each B row of its group, some at once; B rows at[g] to at[g + 1] are those of g."""
    size = (at[1:] - at[:-1])[ga]
    ends, i = np.cumsum(size), 0
    while i < len(ga):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + EXPANDED, side="right")))
        rows = np.repeat(np.arange(i, j), size[i:j])
        place = at[ga[rows]] + np.arange(len(rows)) - (ends[rows] - size[rows] - base)
        yield ga[rows], a[rows] << 32 | b[place], na[rows] * nb[place]
        i = j


def _links(in_a: np.ndarray, a: np.ndarray, in_b: np.ndarray, b: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
    """(group, pair, links) of all groups; a pair may come several times in a group, but hardly in a large one."""
    large = np.bincount(in_a, minlength=groups) * np.bincount(in_b, minlength=groups) > LARGE_GROUP
    parts = []
    for some, counted in ((~large, lambda g, x: (g, x, np.ones(len(g), np.int64))), (large, lambda g, x: _per_group(g, x, 1 << 32))):
        of_a, of_b = some[in_a], some[in_b]
        if of_a.any():
            ga, da, ka = counted(in_a[of_a], a[of_a])
            gb, db, kb = counted(in_b[of_b], b[of_b])
            parts += _expanded(ga, da, ka, _starts(gb, groups), db, kb)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3


class Units:
    """Different units aligned, in arrays: tokens, groups and links of each, its groups as text, its pairs and their links.

    All units' tokens stand in one row: cumulative byte lengths are their ends, ends in both rows are the common cuts,
    and a token's group is the first cut at or behind its end. Units end at common cuts, so no group joins two of them.
    ``good`` is False for units whose tokens' bytes aren't their own.
    """

    def __init__(self, units: list[str], v: Vocabularies):
        self.good = np.ones(len(units), bool)
        a, b, self.n_a, self.n_b = self._encoded(units, v)
        ends_a, ends_b = np.cumsum(v.len_a[a]), np.cumsum(v.len_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)  # labels of groups
        first_a, first_b = _starts(in_a, len(cuts)), _starts(in_b, len(cuts))
        unit = np.repeat(np.arange(len(units)), self.n_a)[first_a[:-1]]  # of each group
        at = _starts(unit, len(units))
        self.n_groups = np.diff(at)
        self.n_links = _sums(np.diff(first_a) * np.diff(first_b), at)
        # ids as text, group by group: A's, then B's
        row = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[first_a[1:] - 1] = 1
        last_b[first_b[1:] - 1] = 1
        row[np.arange(len(a)) + first_b[in_a]] = v.text_a[a, last_a]
        row[np.arange(len(b)) + first_a[in_b + 1]] = v.text_b[b, last_b]
        row, ends = row.tolist(), np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        self.text = [b"".join(row[p:q]) for p, q in zip(ends, ends[1:], strict=False)]
        group, pair, links = _links(in_a, a, in_b, b, len(cuts))
        self.pairs, place = np.unique(pair, return_inverse=True)
        keys, where = np.unique(unit[group] * max(len(self.pairs), 1) + place, return_inverse=True)
        self.times = np.bincount(where, links, len(keys)).astype(np.int64) if links.sum() < 1 << 53 else _exact(where, links, len(keys))
        self.place = keys % max(len(self.pairs), 1)
        self.start = _starts(keys // max(len(self.pairs), 1), len(units))

    def _encoded(self, units: list[str], v: Vocabularies) -> tuple[np.ndarray, ...]:
        data = [u.encode() for u in units]
        size = np.array([len(d) for d in data], np.int64)
        kind = [2 if _ODD.search(u) or u[-1] in " \n\t" or not v.cuts else 0 if tokenizing._COMMON.fullmatch(u) else 1 for u in units]
        ids: list = [None] * len(units)
        parts_a, parts_b, n_a, n_b = [], [], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        at, found = 0, []
        while at < len(units):
            end, total = at, 0
            while end < len(units) and (end == at or kind[end] == kind[at] and kind[at] < 2 and total < CHUNK_BYTES):
                total += size[end]
                end += 1
            found.append((at, end))
            at = end
        for at, end in found:
            for p, q in ((at, end), *((i, i + 1) for i in range(at, end) if end - at > 1)):
                text, own = "".join(units[p:q]), b"".join(data[p:q])
                a, b = v.ids_a(text, kind[p] == 0), v.ids_b(text)
                same = b"".join([v.bytes_a[i] for i in a]) == own and b"".join([v.bytes_b[i] for i in b]) == own
                if same:
                    a, b = np.array(a, np.int64), np.array(b, np.int64)
                    ends, ea, eb = np.cumsum(size[p:q]), np.cumsum(v.len_a[a]), np.cumsum(v.len_b[b])
                    xa, xb = np.searchsorted(ea, ends), np.searchsorted(eb, ends)
                    same = bool((ea[xa] == ends).all() and (eb[xb] == ends).all())
                if same:
                    n_a[p:q], n_b[p:q] = np.diff(xa, prepend=-1), np.diff(xb, prepend=-1)
                    parts_a.append(a)
                    parts_b.append(b)
                    if q - p > 1:
                        break
                elif q - p == 1:
                    self.good[p] = False
        none = [np.empty(0, np.int64)]
        return np.concatenate(parts_a or none), np.concatenate(parts_b or none), n_a, n_b


def _exact(where: np.ndarray, links: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, where, links)
    return out


def _cut(texts: pa.Array, v: Vocabularies) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of texts that start with a blank and have common white space alone: each text's first unit, units' codes, different units."""
    data, offsets = _bytes_of(texts)
    space = _UNIT_SPACE[data]
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[offsets[:-1]] = True
    starts = np.append(np.flatnonzero(head), len(data))
    units = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return np.searchsorted(starts, offsets), units.indices.to_numpy().astype(np.int64), [u.decode() for u in units.dictionary.to_pylist()]


class Block:
    """The documents of a slice: which have tokens, the codes of their units, and how many hold each pair."""

    def __init__(self, texts: pa.Array, v: Vocabularies):
        odd = [i for i, t in enumerate(texts.to_pylist()) if t and (_ODD.search(t) or not v.cuts)]
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        plain = full.copy()
        plain[odd] = False
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        first, codes, units = _cut(spaced.filter(pa.array(plain)), v) if plain.any() else (np.zeros(1, np.int64), np.empty(0, np.int64), [])
        number = dict(zip(units, range(len(units)), strict=True)) if odd else {}
        more = [np.array([number.setdefault(u, len(number)) for u in v.units(" " + texts[i].as_py())], np.int64) for i in odd]
        units += list(number)[len(units) :]
        self.rows = np.concatenate((np.flatnonzero(plain), odd)).astype(np.int64)
        self.first = np.concatenate((first, first[-1] + np.cumsum([len(m) for m in more]))).astype(np.int64)
        self.codes = np.concatenate((codes, *more))
        order = np.argsort([bool(_ODD.search(u)) * 2 + (not tokenizing._COMMON.fullmatch(u)) for u in units], kind="stable")  # alike ones in a row: they are encoded together
        place = np.empty(len(units), np.int64)
        place[order] = np.arange(len(units))
        self.codes = place[self.codes]
        self.units = Units([units[i] for i in order.tolist()], v)
        bad = _sums(~self.units.good[self.codes], self.first)
        self.has = bad == 0
        # each document's different units; then its different pairs
        own = np.repeat(np.arange(len(self.rows)), np.diff(self.first))
        keys, self.times = np.unique(own * max(len(units), 1) + self.codes, return_counts=True)
        doc, self.code = np.divmod(keys, max(len(units), 1))
        self.at = _starts(doc, len(self.rows))
        doc, code = doc[self.has[doc]], self.code[self.has[doc]]
        size, kinds = np.diff(self.units.start)[code], max(len(self.units.pairs), 1)
        self.n = np.zeros(len(self.units.pairs), np.int64)
        ends, i = np.cumsum(size), 0
        while i < len(code):  # documents at once with some expanded pairs
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 4 * EXPANDED, side="right"))
            j = int(np.searchsorted(doc, doc[max(i, min(j, len(code)) - 1)], side="right"))
            row = np.repeat(doc[i:j], size[i:j])
            where = np.repeat(self.units.start[code[i:j]] - np.cumsum(size[i:j]) + size[i:j], size[i:j]) + np.arange(len(row))
            self.n += np.bincount(np.unique(row * kinds + self.units.place[where]) % kinds, minlength=len(self.n))
            i = j

    def batches(self, number: int, doc_id: pa.Array) -> Iterator[pa.RecordBatch]:
        u, rows = self.units, self.rows[self.has]
        sums = {c: _sums(getattr(u, c)[self.codes], self.first)[self.has] for c in ("n_a", "n_b", "n_groups", "n_links")}
        codes, first, text = self.codes.tolist(), self.first.tolist(), u.text
        sha = [hashlib.sha256(b"".join([text[c] for c in codes[first[k] : first[k + 1]]])[:-1]).hexdigest() for k in np.flatnonzero(self.has).tolist()]
        own = [(self.at[k], self.at[k + 1]) for k in np.flatnonzero(self.has).tolist()]
        packed = {c: [x[p:q].astype("<i4").tobytes() for p, q in own] for c, x in (("codes", self.code), ("times", self.times))}
        if len(rows):
            yield _batch(len(self.n), kind=_PAIR, block=number, pair=u.pairs, n=self.n)
            yield _batch(1, kind=_UNITS, block=number, sizes=[np.diff(u.start).astype("<i4").tobytes()], codes=[u.place.astype("<i4").tobytes()], times=[u.times.astype("<i8").tobytes()])
            yield _batch(len(rows), kind=_DOC, block=number, doc_id=doc_id.take(pa.array(rows)), groups_sha256=sha, **sums, **packed)
        none = np.setdiff1d(np.arange(len(doc_id)), rows)
        if len(none):
            zero = {c: 0 for c in sums}
            yield _batch(len(none), kind=_DOC, block=number, doc_id=doc_id.take(pa.array(none)), groups_sha256=[""] * len(none), codes=[b""] * len(none), times=[b""] * len(none), **zero)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: int, schema: str = PART_SCHEMA, **cols) -> pa.RecordBatch:
    """Columns by name; a single number stands for all rows, a missing column is null."""
    out, names = [], []
    for c in schema.split(", "):
        name, kind = c.split()
        x = cols.get(name)
        out.append(pa.nulls(rows, _KINDS[kind]) if x is None else pa.array(np.full(rows, x) if isinstance(x, int) else x, _KINDS[kind]))
        names.append(name)
    return pa.RecordBatch.from_arrays(out, names)


def _first_pass(own: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of three kinds: a block's pairs with the number of documents that hold them, its units, and its documents as codes of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, number = load(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in row_slices(batch, size=BLOCK_BYTES):
                yield from Block(part.column("text"), v).batches(number, part.column("doc_id"))
                number += 1
        give_back()

    return own.mapInArrow(run, PART_SCHEMA)


def _last_pass(parts: DataFrame) -> DataFrame:
    """Documents with their sums: each block's pairs come first, then its units, then its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, unit = {"n": [], "best": []}, {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if kinds[a] == _PAIR:
                    for c in pairs:
                        pairs[c].append(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64))
                elif kinds[a] == _UNITS:
                    sizes, codes, times = (np.frombuffer(part.column(c)[0].as_py(), t) for c, t in (("sizes", "<i4"), ("codes", "<i4"), ("times", "<i8")))
                    at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
                    unit = {c: _sums(np.concatenate(x)[codes] * times, at) for c, x in pairs.items()}
                    pairs = {"n": [], "best": []}
                else:
                    sums = {"n": [], "best": []}
                    for codes, times in zip(part.column("codes").to_pylist(), part.column("times").to_pylist(), strict=True):
                        codes, times = np.frombuffer(codes, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
                        for c, x in sums.items():
                            x.append(int((unit[c][codes] * times).sum()) if len(codes) else 0)
                    cols = {c: part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                    yield _batch(part.num_rows, OUT_SCHEMA, n_best=sums["best"], count_sum=sums["n"], **cols)

    return parts.mapInArrow(run, OUT_SCHEMA)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A text with a blank before it is encoded by the byte-level vocabulary ``path_a`` (A) and the sentencepiece model
    ``path_b`` (B, which adds that blank itself). Byte offsets where tokens of both end cut them into groups. Each A
    token is linked to each B token of its group; a pair of ids counts the documents that hold it linked.
    ``n_best`` are the links whose pair has the highest count of all pairs with its A id, ``count_sum`` is the sum of
    the counts over all links.

    1. Some megabytes of documents are a block. Its texts are cut where both vocabularies' tokens must end (before white
    space), and each different unit is aligned once; a large group's repeated ids are counted, not paired. A block keeps
    its units' pairs and the number of its documents for each pair. 2. Blocks' counts are added up by salted pairs, then by pairs; the
    highest count is found for each A id. 3. Counts go back to the blocks, not to the documents: pairs, units and
    documents of a block meet sorted, pairs become sums of units and these sums of documents.

    A null or empty text, and one whose tokens' bytes differ from the text's (as with U+2581 in it), has zeros and ''.
    Rows without an id and repeated rows are documents like others. Other columns are not read. An empty table gives an
    empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    parts = written(_first_pass(own, path_a, path_b), "blocks")
    pairs = parts.where(F.col("kind") == _PAIR).select("block", "pair", "n")
    salted = pairs.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = written(salted.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.shiftright("pair", 32).alias("a")
    tops = counts.groupBy(a).agg(F.max("n").alias("top"))  # a row for each id of A: broadcast
    judged = counts.select("*", a).join(F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    back = pairs.select("block", "pair").join(judged, "pair")
    null = lambda c: F.lit(None).cast(dict(x.split() for x in PART_SCHEMA.split(", "))[c]).alias(c)
    looked_up = back.select(*(F.lit(_PAIR).alias(c) if c == "kind" else F.col(c) if c in back.columns else null(c) for c in _NAMES))
    met = looked_up.union(parts.where(F.col("kind") != _PAIR).select(_NAMES))
    return _last_pass(met.repartition(shuffle_width(docs.sparkSession), "block").sortWithinPartitions("block", "kind", "pair"))
