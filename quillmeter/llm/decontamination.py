"""Benchmark decontamination: size-partitioned MinHash containment search with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import free_name, written

#: Words of a shingle, least share of an item's shingles, and sketch rows up to which the index is broadcast.
SHINGLE, CONTAINMENT, BROADCAST_ROWS = 5, 0.8, 200_000


def word_array(text: Column) -> Column:
    r"""The words ``[^\x20\x09-\x0D]+`` of a lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(words: Column, size: int, of) -> Column:
    """An array with ``of(w1, .., w_size)`` for each run of ``size`` words; empty if there are fewer words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: of([F.element_at(words, (i + j).cast("int")) for j in range(size)]))


def shingles(words: Column, size: int) -> Column:
    return _runs(words, size, lambda w: F.concat_ws(" ", *w))


def shingle_hashes(words: Column, size: int) -> Column:
    return _runs(words, size, lambda w: F.xxhash64(*w))


def item_index(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, size, n, grams, part): items with their distinct shingles, in partitions of doubling sizes.

    ``size`` is the words of a shingle: five, or all words of a shorter item. Items without a word are left out.
    """
    own = items.select(F.col(id_col).cast("long").alias("item_id"), word_array(F.col(text_col)).alias("w")).where("size(w) > 0")
    five = own.select("item_id", F.least(F.size("w"), F.lit(SHINGLE)).alias("size"), F.when(F.size("w") >= SHINGLE, F.array_distinct(shingles(F.col("w"), SHINGLE))).otherwise(F.array(F.array_join("w", " "))).alias("grams"))
    sized = five.select("*", F.size("grams").alias("n"))
    return sized.select("*", F.floor(F.log2("n")).cast("int").alias("part"))


def sketches(index: DataFrame, containment: float) -> DataFrame:
    """(item_id, size, least, h): the bottom MinHash values of each item.

    The items of a size partition keep as many as its largest item needs: a document with at least ``containment`` of an
    item's n shingles lacks at most floor((1 - containment) n), so one of the floor((1 - containment) n) + 1 smallest
    hashes is among its own. No true pair is lost.
    """
    hashes = F.array_sort(F.transform("grams", lambda g: F.xxhash64(*[F.get(F.split(g, " "), j) for j in range(SHINGLE)])))
    # a shorter item has one shingle, of all its words
    short = F.array(F.xxhash64("grams"))
    top = F.floor((F.pow(F.lit(2), F.col("part") + 1) - 1) * (1 - containment) + 1e-9) + 1
    return index.select("item_id", "size", "n", F.explode(F.slice(F.when(F.col("size") == SHINGLE, hashes).otherwise(short), 1, F.least(top.cast("int"), F.col("n")))).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): items of which a document holds enough shingles.

    Shingles are runs of five lower-cased words. Items are sketched by their smallest shingle hashes, with sketch
    lengths by size partition; documents probe the sketches with each shingle hash, whatever their length. Pairs that
    meet are verified on the shingles themselves. The probe side is never shuffled while the sketches have at most
    BROADCAST_ROWS rows (counted first); beyond that Spark joins both sides by hash value. Nor are texts shuffled to be
    verified while at most as many pairs have met.

    Items of fewer than five words count as one shingle of all their words. Null and empty texts hold nothing and items
    without a word are found nowhere. Documents without an id are not searched, as they can't be named. Rows with equal
    ids give one row for each row that holds the item. Other columns are not read; empty tables give an empty result.
    """
    index = written(item_index(items, item_id_col, item_text_col), "items")
    sketch = written(sketches(index, containment), "sketches")
    sizes = [r.size for r in index.select("size").distinct().collect()]  # one to five numbers
    rows = sketch.count()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    words = own.select("doc_id", word_array(F.col("text")).alias("w"))
    probes = None
    for size in sizes:
        hashed = _runs(F.col("w"), size, lambda w: F.xxhash64(*w)) if size == SHINGLE else _runs(F.col("w"), size, lambda w: F.xxhash64(F.array(F.concat_ws(" ", *w))))
        mine = words.select("doc_id", F.lit(size).alias("size"), F.size("w").alias("n_words"), F.explode(hashed).alias("h"))
        probes = mine if probes is None else probes.union(mine)
    if probes is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_shared long, containment double")
    keys = sketch.select(F.col("h").alias("key"), F.col("size").alias("key_size"), "item_id", "n")
    met = probes.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, (F.col("h") == F.col("key")) & (F.col("size") == F.col("key_size")) & (F.col("n_words") - F.col("size") + 1 >= F.ceil(F.col("n") * containment - 1e-9)))
    pairs = written(met.select("doc_id", "item_id").distinct(), "pairs")
    seen = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    few = pairs.count() <= BROADCAST_ROWS  # then no text is shuffled to be verified
    texts = own.join(F.broadcast(seen) if few else seen.hint("shuffle_hash"), "doc_id").select("doc_id", word_array(F.col("text")).alias("w"), F.explode("items").alias("item_id"))
    grams = index.select("item_id", "size", "n", F.col("grams").alias("wanted"))
    both = texts.join(F.broadcast(grams) if rows <= BROADCAST_ROWS else grams, "item_id")
    held = F.lit(None)
    for size in sizes:
        held = F.when(F.col("size") == size, F.size(F.array_intersect("wanted", shingles(F.col("w"), size)))).otherwise(held)
    found = both.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), held.cast("long").alias("n_shared"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= containment)


def clean_documents(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` whose text holds no item.

    Rows are told apart by id and whole text, so rows without an id are searched too, and of rows with one id only those
    go whose own text holds an item. Repeated rows share their fate. Null and empty texts hold nothing; an empty table
    gives an empty result.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))
    name = free_name(docs, "key")
    bad = contained_items(docs.select(key.alias("doc_id"), "text"), items, containment).select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, key).join(bad, name, "left_anti").select(docs.columns)
