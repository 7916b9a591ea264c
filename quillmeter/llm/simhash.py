"""SimHash near-duplicate groups by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.llm import fingerprints as fingerprints_
from quillmeter.llm.buckets import BucketCounts, bitmap, full_buckets, has, only, parted
from quillmeter.llm.common import drop, free_name, freed, give_back, row_slices, text_or_empty, words, written
from quillmeter.llm.components import connected_components
from quillmeter.llm.wordhash import Words, run_hashes

#: Bits of a fingerprint that each pivot beside the zero pivot sets; 32 such pivots cover the 64 bits. Small blocks keep
#: most of a fingerprint in its coordinates: two unlike ones share a cell about once in 10^10 pairs.
PIVOT_BITS = 2
N_PIVOTS = 64 // PIVOT_BITS
SEED = 42


def simhash64(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of a text; 0 if it has no word."""
    w = words(text or "", lower=True)
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the SimHash as a signed long. A null text counts as empty: fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                fp = np.fromiter((simhash64(t.as_py(), size) for t in part.column("text")), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def pivot_table(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Adds the Hamming distances of ``fp`` to the pivots: ``d0`` to zero, ``d1``..``d32`` to two ones each."""
    masks = [0, *(((1 << PIVOT_BITS) - 1) << (PIVOT_BITS * j) for j in range(N_PIVOTS))]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return fps.withColumns({f"d{j}": F.bit_count(F.col(fp).bitwiseXOR(F.lit(m))) for j, m in enumerate(signed)})


def cells(table: DataFrame, max_distance: int) -> DataFrame:
    """(fp, move, cell): the packed pivot coordinates of a fingerprint, move 0, and those of its neighbours one bit away.

    A flipped bit of block j moves d0 and every distance by one, d(j) against the others. So the vector of distances
    is known from the number of ones in each block, (d0 + 2 - dj) / 2, two bits each. Moves that leave the range of a
    block are left out.
    """
    ones = table.select("fp", *(F.shiftright(F.col("d0") + PIVOT_BITS - F.col(f"d{j + 1}"), 1).cast("long").alias(f"n{j}") for j in range(N_PIVOTS)))
    packed = ones.select("*", reduce(Column.bitwiseOR, (F.shiftleft(F.col(f"n{j}"), 2 * j) for j in range(N_PIVOTS))).alias("cell"))
    moves = [F.col("cell")]
    for j in range(N_PIVOTS if max_distance else 0):
        n = F.col(f"n{j}")
        to = lambda m, n=n, j=j: F.col("cell").bitwiseXOR(F.shiftleft(n.bitwiseXOR(m), 2 * j))
        moves += [F.when(n < PIVOT_BITS, to(n + 1)), F.when(n > 0, to(n - 1))]
    return packed.select("fp", F.posexplode(F.array(*moves)).alias("move", "cell")).where("cell is not null")


def linked_pairs(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """(a, b) with a < b: the pairs of different fingerprints of ``fps`` (fp, distinct) at most 2 bits apart, each once.

    Hamming distances to 33 pivots are tabulated for every fingerprint. By the triangle inequality two linked
    fingerprints differ by at most ``max_distance`` in every coordinate; they even lie at most one step each from a
    common cell of pivot space. An equi-join on cells thus forms no pair whose largest coordinate difference is over
    the limit; it loses none below it. The survivors are verified on the fingerprints. A fingerprint enters at most 65
    cells, whatever the input.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance is 0, 1 or 2")
    rows = cells(pivot_table(fps.select("fp")), max_distance)
    a = rows.select("cell", F.col("fp").alias("a"), F.col("move").alias("ma"))
    b = rows.select("cell", F.col("fp").alias("b"), F.col("move").alias("mb"))
    # a pair meets in several cells; one is kept: b unmoved, or both moved with a's block not after b's
    block = lambda m: F.floor((F.col(m) - 1) / 2)
    once = (F.col("mb") == 0) | ((F.col("ma") > 0) & ((block("ma") < block("mb")) | ((block("ma") == block("mb")) & (F.col("ma") != F.col("mb")))))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    return a.join(b, "cell").where((F.col("a") < F.col("b")) & once & near).select("a", "b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_distance: int = 2) -> DataFrame:
    """Near-duplicate groups: one row per document with ``fingerprint`` (hex), ``component_id`` and ``n_same``.

    component_id is the smallest id reachable over links between fingerprints at most ``max_distance`` bits apart;
    n_same counts the rows with just this fingerprint. Documents with equal fingerprints are one node of the graph, so
    copies are never paired. Texts without a word (null, empty, blank) have fingerprint zero and link like any other.
    Repeated rows give repeated result rows; a row without an id gets its group's component_id, null if no member has
    an id. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, size), "fps")
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_same")), "groups")
    pairs = written(linked_pairs(groups.select("fp"), max_distance), "pairs")
    roots = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    member = roots.join(groups.select(F.col("fp").alias("node"), "rep"), "node")
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    named = written(groups.join(moved, "fp", "left").select("fp", "n_same", F.coalesce("component_id", "rep").alias("component_id")), "named")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


#: Pieces of a MinHash signature that near-duplicates meet on, and bins of each. Of pairs with a similarity of 0.8, which
#: agree in a bin with 0.81, one in 5,000 meets nowhere.
BANDS, BAND_BINS = 40, 8
#: A shingle is frequent if its bucket holds so many, and surely single if it holds one; both bitmaps of 2^BUCKET_BITS
#: buckets (8 MB each) are broadcast.
FREQUENT, BUCKET_BITS = 127, 26


def _shingle_buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _shingle_counts(docs: DataFrame) -> DataFrame:
    """Bucket counts of the texts' shingles of five words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = BucketCounts(FREQUENT, BUCKET_BITS)
        for batch in batches:
            for part in row_slices(batch, size=1 << 20):
                w = Words(part.column("text"), lower=True)
                h = run_hashes(w.hashes, 5)
                counts.add(_shingle_buckets(h[w.rows(5) >= 0]))
        rows = counts.rows()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "places", "counts"])
        give_back()

    return docs.select("text").mapInArrow(run, "chunk int, places binary, counts binary")


def sketches(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(key, doc_id, fp, same, n, bands, least, top, rest) from (key, doc_id, text): SimHash, digest and number of the distinct shingles, band keys.

    A shingle is five words, all of them where there are fewer; texts without a word have one fixed shingle. ``least`` are
    the first shingles in one order of all, as many as make sure that two texts with the similarity have one in common,
    without those that surely come once, which no two texts have. ``top`` is the last of the first shingles and ``rest`` the
    number of the text's other ones. The order is of hashes, with those that come once before and frequent ones behind all
    others: a text of which a fifth comes once meets no other, and one of which a fifth isn't frequent none by a frequent one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(full_buckets(_shingle_counts(docs), FREQUENT, 2, BUCKET_BITS), BUCKET_BITS + 1))
    once = 1 << 61  # smaller ones of the order come once

    def one(text: str, hashes: np.ndarray) -> tuple:
        shingles = shingle_set(hashes)
        bins = fingerprints_.signature(hashes)[: BANDS * BAND_BINS].reshape(BANDS, BAND_BINS).astype(np.int64)
        bands = (np.arange(BANDS, dtype=np.int64) << 32) | (bins << (4 * np.arange(BAND_BINS))).sum(axis=1)
        rest = int(np.ceil(similarity * len(shingles) - 1e-9)) - 1
        buckets = _shingle_buckets(shingles)
        often = has(shared.value, buckets + (1 << BUCKET_BITS)).astype(np.uint64) + has(shared.value, buckets)
        first = np.sort(shingles >> np.uint64(3) | often << np.uint64(61))[: len(shingles) - rest].view(np.int64)
        return simhash64(text, 5), xxhash.xxh3_64_intdigest(shingles.tobytes()), len(shingles), bands, first[first >= once], first[-1], rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, size=1 << 20):
                w = Words(part.column("text"), lower=True)
                rows = [one(t.as_py(), w.hashes[w.first[i] : w.first[i + 1]]) for i, t in enumerate(part.column("text"))]
                fp, same = (np.array([r[k] for r in rows], np.uint64).view(np.int64) for k in (0, 1))
                at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS)
                bands = pa.ListArray.from_arrays(at, pa.array(np.concatenate([r[3] for r in rows])))
                ends = pa.array(np.cumsum([0, *(len(r[4]) for r in rows)]).astype(np.int32))
                least = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[4] for r in rows])))
                n, top, rest = (pa.array(x, pa.int64()) for x in ([r[k] for r in rows] for k in (2, 5, 6)))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(fp), pa.array(same), n, bands, least, top, rest], ["key", "doc_id", "fp", "same", "n", "bands", "least", "top", "rest"])
        give_back()

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, fp long, same long, n long, bands array<long>, least array<long>, top long, rest long")


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text's word hashes, in order."""
    return np.unique(run_hashes(hashes, min(5, len(hashes)))) if len(hashes) else np.zeros(1, np.uint64)


def _stars(rows: DataFrame, group: str, similarity: float) -> DataFrame:
    """(u, v): the members of each group with its first and its last one in the order of a hash; never all pairs.

    rows: (group, c, n). Pairs whose numbers of shingles rule the similarity out are left out.
    """
    by, place = Window.partitionBy(group), F.struct(F.xxhash64("c", group).alias("h"), "c", "n")
    ends = rows.select("c", "n", F.min(place).over(by).alias("a"), F.max(place).over(by).alias("b"))
    each = ends.select("c", "n", F.explode(F.array("a", "b")).alias("o")).where((F.col("c") != F.col("o.c")) & (F.least("n", "o.n") >= similarity * F.greatest("n", "o.n")))
    return each.select(F.least("c", "o.c").alias("u"), F.greatest("c", "o.c").alias("v"))


def _shared_shingles(classes: DataFrame) -> DataFrame:
    """(c, root, h) from (c, root, least): a row for each of the first shingles whose bucket two classes or more have."""

    def flat(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().view(np.uint64)

    def buckets(keys: np.ndarray) -> np.ndarray:
        return _shingle_buckets(keys << np.uint64(3))  # the order's own bits are left out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = BucketCounts(2, BUCKET_BITS)
        for batch in batches:
            counts.add(buckets(flat(batch.column("least"))))
        rows = counts.rows()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "places", "counts"])
        give_back()

    full = bitmap(full_buckets(classes.select("least").mapInArrow(count, "chunk int, places binary, counts binary"), 2), BUCKET_BITS)
    shared = classes.sparkSession.sparkContext.broadcast(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = flat(batch.column("least"))
            row = np.repeat(np.arange(batch.num_rows), batch.column("least").value_lengths().to_numpy())
            some = np.flatnonzero(has(shared.value, buckets(keys)))
            own = batch.select(["c", "root"]).take(pa.array(row[some]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(keys[some].view(np.int64))], ["c", "root", "h"])

    return classes.select("c", "root", "least").mapInArrow(run, "c long, root long, h long")


def _left_out(classes: DataFrame, roots: DataFrame, met: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs that may have the similarity, aren't connected yet and weren't compared: with them no link is lost.

    classes: (c, n, least, top, rest). Such a pair shares one of its first shingles. Groups of a shingle whose members are
    all connected are left; in the others just the members of different components meet, and a pair's common shingles
    are counted: whichever text's first ones end earlier has no other in common there, so these and its rest are the
    most that both can share. Pairs that this leaves below the similarity are ruled out without their texts.
    """
    named = classes.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("c", F.coalesce("root", "c").alias("root"), "least")
    own = _shared_shingles(named)
    mixed = own.groupBy("h").agg(F.min("root").alias("_a"), F.max("root").alias("_z")).where("_a <> _z").select("h")
    some = freed(own.join(mixed, "h").join(classes.select("c", F.struct("n", "top", "rest").alias("x")), "c"), "mixed")
    a, b = some.select("h", "c", "x", "root"), some.select("h", F.col("c").alias("d"), F.col("x").alias("y"), F.col("root").alias("other"))
    both = a.join(b, "h").where((F.col("root") < F.col("other")) & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")))
    need = F.ceil((F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-6) - F.when(F.col("x.top") < F.col("y.top"), F.col("x.rest")).otherwise(F.col("y.rest"))
    counted = both.groupBy(F.least("c", "d").alias("u"), F.greatest("c", "d").alias("v")).agg(F.count("*").alias("shared"), F.max(need).alias("need"))
    rest = freed(counted.where("shared >= need").select("u", "v").join(met, ["u", "v"], "left_anti"), "rest")
    drop(some)
    return rest


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of classes whose texts (c, text) have shingle sets of at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, size=1 << 20):
                a, b = (Words(part.column(c), lower=True) for c in ("text", "other"))
                good = []
                for i in range(part.num_rows):
                    x, y = (shingle_set(w.hashes[w.first[i] : w.first[i + 1]]) for w in (a, b))
                    met = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(met >= similarity * (len(x) + len(y) - met))
                yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
        give_back()

    ends = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("c")).join(texts, "c")
    both = ends.groupBy("u", "v").agg(F.min(F.when(F.col("c") == F.col("u"), F.col("text"))).alias("text"), F.min(F.when(F.col("c") == F.col("v"), F.col("text"))).alias("other"))
    return both.mapInArrow(run, "u long, v long")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates: the one with the smallest id, those without an id last.

    Two texts are linked if their sets of five-word shingles (lower-cased) have a Jaccard similarity of ``similarity`` or more,
    and groups are what links connect. Texts with one set are a class; classes are compared if their SimHashes lie at most two
    bits apart (pivot distance tables) or if they share a band of their MinHash signatures, as SimHashes of texts with
    that similarity lie up to a dozen bits apart. In a band each class is compared with two others at most, and in forty
    bands with others each time. What these connect needs no more comparing; all other pairs that share enough of their
    first shingles, rare ones before frequent ones, to have the similarity are compared then. Every pair is verified on the
    whole texts.

    Rows are told apart by id and whole text: of rows with both equal one stays, and which one isn't fixed; rows with one
    id and different texts are documents of their own. Null and empty texts are one class of texts without a word. An
    empty table gives an empty result.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).isNull())
    name = free_name(docs, "key")
    keyed = docs.select("*", key.alias(name))
    own = keyed.select(F.col(name).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    rows = freed(sketches(own, similarity), "sketches")
    classes = freed(rows.groupBy(F.col("same").alias("c")).agg(F.min(rank).alias("rep"), F.min("n").alias("n"), F.min(F.struct("fp", "bands", "least", "top", "rest")).alias("s")).select("c", "rep", "n", "s.*"), "classes")
    keys = freed(rows.select("key"), "keys")
    drop(rows)
    pairs = linked_pairs(classes.select("fp").distinct())
    near = classes.groupBy("fp").agg(F.min(F.struct("c", "n")).alias("m"))
    mine = near.select(F.col("fp").alias("a"), F.col("m").alias("ma")), near.select(F.col("fp").alias("b"), F.col("m").alias("mb"))
    bits = pairs.join(mine[0], "a").join(mine[1], "b").where(F.least("ma.n", "mb.n") >= similarity * F.greatest("ma.n", "mb.n")).select(F.least("ma.c", "mb.c").alias("u"), F.greatest("ma.c", "mb.c").alias("v"))
    bands = classes.select("c", "n", F.explode("bands").alias("band"))
    met = _stars(bands, "band", similarity).union(_stars(classes.select("c", "n", "fp"), "fp", similarity)).union(bits)
    met = freed(met.distinct(), "met")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        asked = freed(pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct().join(classes.select("c", F.col("rep.key").alias("key")), "c"), "asked")
        texts = only(own.select("key", "text"), "key", asked.select("key")).join(asked.hint("shuffle_hash"), "key").groupBy("c").agg(F.min("text").alias("text"))
        found = freed(_verified(pairs, texts, similarity), name)
        drop(asked)
        return found

    links = linked(met, "links")
    rest = _left_out(classes.select("c", "n", "least", "top", "rest"), connected_components(links), met, similarity)
    more = linked(rest, "more")
    roots = connected_components(links.union(more))
    grouped = classes.select("c", "rep").join(roots.select(F.col("node").alias("c"), "root"), "c", "left")
    kept = written(grouped.groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("rep").alias("rep")).select(F.col("rep.key").alias(name)), "kept")
    # only rows that go or come again are dealt out by their key, with those that share a bit of the bitmap; all others stay
    again = keys.groupBy(F.col("key").alias(name)).count().join(kept.withColumn("stays", F.lit(True)), name, "left")
    asked = freed(again.where("stays is null or count > 1").select(name), "asked")
    surely, others = parted(keyed, name, asked)
    drop(classes, met, links, rest, more, keys, asked)
    stay = others.join(kept.hint("shuffle_hash"), name, "left_semi").dropDuplicates([name])
    return surely.select(docs.columns).union(stay.select(docs.columns))
