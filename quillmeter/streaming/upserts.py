"""Streams into keyed state: each batch is reduced, merged with the stored rows and written as a new version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_volume(events: DataFrame) -> DataFrame:
    """(hour, n, total): tumbling hours, for batch frames and for streams alike."""
    return events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "n", "total")


def _versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions of a state, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [f.getPath() for f in files.listStatus(path) if f.getPath().getName()[1:].isdigit()]
    return sorted(int(p.getName()[1:]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of a state."""
    return spark.read.parquet(f"{root}/v{_versions(spark, root)[-1]}")


def _origin(spark: SparkSession, root: str, version: int) -> str:
    """Which batch of which stream wrote a version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{version}/_origin")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return ""
    stream = files.open(path)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _write_origin(spark: SparkSession, root: str, version: int, origin: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{version}/_origin")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.writeUTF(origin)
    finally:
        stream.close()


def upsert(root: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch writes the next version of the state, from the newest one.

    A version says which batch of which stream wrote it. A batch that comes again, as after a failure, writes its version
    anew, from the version before; batches of a new stream, whose ids begin at 0, go on from the newest version. Late rows
    change the state like others. Versions that no repeated batch can need are deleted. ``merge`` gets None where there is
    no state yet. Every batch writes the whole state: meant for states that are small beside their streams.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        origin = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'called'} {batch_id}"
        versions = _versions(spark, root)
        again = bool(versions) and _origin(spark, root, versions[-1]) == origin
        version = versions[-1] if again else (versions[-1] + 1 if versions else 0)
        before = [v for v in versions if v < version]
        old = spark.read.parquet(f"{root}/v{before[-1]}") if before else None
        # a version is complete when its origin is written too
        merge(old, batch).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/v{version}")
        _write_origin(spark, root, version, origin)
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{version}/_SUCCESS")
        done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()
        for stale in before[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{stale}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return run
