"""Readers of transcript files, and what a line says about its workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmeter.functions import json

#: Larger files are not read.
MOST_BYTES = 50 << 20


def read_files(spark: SparkSession, folder: str, modified_after: str | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """(file, modified, number, line) of the files below a folder that match, were modified since then and aren't oversize.

    A file is one row while it is split into lines, so that these have numbers: MOST_BYTES bounds it.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    files = reader.text(folder).where(F.col("_metadata.file_size") <= MOST_BYTES)
    named = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    return named.select("file", "modified", F.posexplode(F.split("value", "\r?\n")).alias("number", "line"))


def json_lines(lines: DataFrame) -> DataFrame:
    """(file, ordinal, value) from (file, number, line): blank lines and lines without JSON go, the rest is numbered anew."""
    parsed = lines.select("file", "number", F.try_parse_json(F.trim("line")).alias("value")).where(F.col("value").isNotNull())
    return parsed.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("number")) - 1).cast("long").alias("ordinal"), "value")


def cwd(value: Column) -> Column:
    """The working folder that a line names, at the first of three places that holds one."""
    return F.coalesce(*[json.string_at(value, p) for p in ("$.cwd", "$.payload.cwd", "$.turn_context.payload.cwd")])


def file_folders(lines: DataFrame) -> DataFrame:
    """(file, cwd): every working folder that a file names, once."""
    return lines.select("file", cwd(F.col("value")).alias("cwd")).where("cwd is not null").distinct()


def newest_workspaces(lines: DataFrame, seen: DataFrame, scopes: DataFrame, most: int | None = 12) -> DataFrame:
    """(scope, workspace, last_seen): of each repository scope the workspace that was used last, the newest ones first.

    A file belongs to the first folder it names that is in ``scopes`` (workspace, scope); seen: (file, last_seen). Of
    equal times the first workspace by name counts.
    """
    named = lines.select("file", "ordinal", cwd(F.col("value")).alias("workspace")).join(scopes, "workspace")
    per_file = named.groupBy("file").agg(F.min(F.struct("ordinal", "workspace", "scope")).alias("w")).select("file", "w.workspace", "w.scope").join(seen, "file")
    last = per_file.groupBy("scope", "workspace").agg(F.max("last_seen").alias("last_seen"))
    newest = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("last_seen"), "workspace"))
    kept = last.withColumn("_n", newest).where("_n = 1").select("scope", "workspace", "last_seen")
    return kept.orderBy(F.desc("last_seen"), "scope").limit(most) if most else kept
