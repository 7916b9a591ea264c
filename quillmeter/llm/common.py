"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are handed to Python in batches; a batch is cut into slices of about this many text bytes.
SLICE_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master (as in tests) gets a new temporary folder, as all its tasks are on one machine; any
    other master gets an error, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _tables(spark: SparkSession) -> str:
    """Where this application writes its tables."""
    return f"{shared_root(spark)}/quillmeter/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def _deleted(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables, when all that was made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        for folder in {path.rpartition("/")[0] for path in table.inputFiles()}:
            if f"/quillmeter/{spark.sparkContext.applicationId}/" in folder:
                _deleted(spark, folder)


def clean(spark: SparkSession) -> None:
    """Deletes every table that this application's operators have written; call it when their results are saved."""
    _deleted(spark, _tables(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends here and lost executors cost nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.mode("error").parquet(path)
    return spark.read.schema(schema).parquet(path)


def freed(df: DataFrame, name: str) -> DataFrame:
    """``written``, and the driver collects its garbage: Spark then deletes the files of shuffles that nothing refers to."""
    table = written(df, name)
    del df
    table.sparkSession._jvm.System.gc()
    return table


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the cluster's owner set them for its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: str, lower: bool = False) -> list[bytes]:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text as UTF-8; ``bytes.split`` cuts at just these six characters.

    lower: A-Z become a-z first; ``bytes.lower`` leaves all others.
    """
    data = text.encode("utf-8")
    return (data.lower() if lower else data).split()


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def crc_bucket(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def give_back() -> None:
    """Returns memory that a worker has freed to the system: it is used again for other operators, and its heap only grows."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def row_slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + size, side="right")))
        yield batch.slice(start, end - start)
        start = end
    if batch.num_rows and sizes[-1] > SLICE_BYTES:
        give_back()
