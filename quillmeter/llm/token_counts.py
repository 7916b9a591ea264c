"""Token counts through a digest cache: each distinct text is encoded once, ever."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm import tokenizing
from quillmeter.llm.common import fresh_path, row_slices, text_or_empty

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def normalised(text: str) -> Column:
    """Content as it is counted. A null text counts as empty; nothing else may change, or the count would."""
    return text_or_empty(text)


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


class CountCache:
    """Stored counts by content digest and tokenizer version, a Parquet table in a folder that the cluster shares.

    The folder may not exist yet. Runs only append. Two runs that miss the same text at the same time both append its
    count; readers take one, and the counts are equal.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "token-cache")
        self._make()

    def _make(self) -> None:
        self.spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(self.path)

    def read(self, version: str) -> DataFrame:
        stored = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select(F.lit(version).alias("version"), "digest", F.col("n_tokens").cast("long")).write.mode("append").parquet(self.path)


def encoded_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) for rows (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizing.load(tokenizer)
        for batch in batches:
            for part in row_slices(batch):
                n = encoder.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, cache: CountCache | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Digests are joined to the stored counts. For each digest without one, one document stands (of rows without an id any
    one, if all its rows are such); only these documents' texts are encoded, and their counts are appended to the cache. Then every digest has a stored count.
    Rows, not texts, are grouped by digest, so thousands of copies of a text cost a partial minimum.

    A null text counts as empty: 0 bytes, 0 tokens. Rows without an id and repeated rows are counted like others; each
    input row gives a row. Other columns are not read. An empty table gives an empty result.
    """
    spark, version = docs.sparkSession, tokenizing.version(tokenizer)
    cache = cache or CountCache(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("text")).withColumn("digest", digest(F.col("text")))
    keyed = own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    # a digest's smallest id; where no row has one, one of its rows is taken, whichever
    stands = keyed.join(cache.read(version), "digest", "left_anti").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    named = own.join(stands.where("doc_id is not null").hint("shuffle_hash"), ["digest", "doc_id"], "left_semi")
    nameless = own.where("doc_id is null").join(stands.where("doc_id is null").select("digest").hint("shuffle_hash"), "digest", "left_semi").dropDuplicates(["digest"])
    misses = named.select("digest", "text").union(nameless.select("digest", "text"))
    new = encoded_counts(misses, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    cache.append(new, version)
    counts = cache.read(version)
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
