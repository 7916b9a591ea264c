"""Digests of sets that don't depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import digests


def digest_of_sets(rows: DataFrame, group: str, key: str, digits: int = 4) -> DataFrame:
    """(group, digest, n): a digest of each group's distinct keys, and their number.

    Keys are dealt into ranges by the first hex digits of their hash; a range's sorted keys give a framed digest, and the
    ranges' digests the group's in the same way. So one task sees a small part of a large group, and the definition
    differs from a digest of the whole sorted set.
    """
    distinct = rows.where(F.col(key).isNotNull()).select(group, F.col(key).cast("string").alias("_k")).distinct()
    ranges = distinct.groupBy(group, F.left(F.sha2("_k", 256), F.lit(digits)).alias("_range")).agg(digests.framed_set_digest(F.collect_list("_k")).alias("_h"), F.count("*").alias("_n"))
    return ranges.groupBy(group).agg(digests.framed_set_digest(F.collect_list("_h")).alias("digest"), F.sum("_n").alias("n"))
