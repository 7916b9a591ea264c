"""Readers for Parquet tables and JSON lines."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): lines of transcript files that hold JSON, as VARIANT; other lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.expr("try_parse_json(value)").alias("value"))
    return lines.where("value is not null")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of new files."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder)


def held(df: DataFrame) -> DataFrame:
    """The rows of a frame, computed once and kept in the shared folder of ``spark.checkpoint.dir``: lost executors change nothing.

    Without that setting a local master gets a new temporary folder; any other one gets an error.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
