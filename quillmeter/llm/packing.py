"""Concatenate-and-cut packing: global offsets from prefix sums of partition totals, then fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm import tokenizing
from quillmeter.llm.common import row_slices, text_or_empty, written

TOKEN_SCHEMA = "doc_id long, part int, part_start long, n long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: a written table of token ids, with each document's start among the tokens of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, total = tokenizing.load(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.typecode).tobytes()
        size = len(end)
        for batch in batches:
            for piece in row_slices(batch):
                ids = [x + end for x in encoder.packed(piece.column("text").to_pylist())]
                n = [len(x) // size for x in ids]
                ends = list(accumulate(n, initial=total))
                total = ends[-1]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(ends[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "part_start", "n", "ids"],
                )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return written(own.mapInArrow(run, TOKEN_SCHEMA), "tokens")


def cut(doc_id: int | None, start: int, ids: bytes, size: int, dtype: str, window: int) -> list[tuple]:
    """The pieces of one document whose first token is the corpus's token ``start``."""
    n, rows, at = len(ids) // size, [], 0
    while at < n:
        sequence, offset = divmod(start + at, window)
        length = min(n - at, window - offset)
        wide = np.frombuffer(ids, dtype, length, at * size).astype("<u4")
        rows.append((doc_id, at, length, zlib.crc32(wide.tobytes()), n, sequence, offset))
        at += length
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: a run of one document's tokens within one sequence of ``window`` tokens.

    All documents' tokens, each followed by ``end_id``, form one long row of tokens that is cut every ``window`` tokens;
    only the very last sequence needs padding. The first pass writes the tokens once, with running starts inside each
    partition. The partitions' totals (one number for each partition) are summed up on the driver; the second pass adds
    a partition's offset to its documents' starts and cuts them. No document is shuffled or held with another; a
    document over several sequences gives a boundary row in each.

    Documents keep the input's partition order; equal ids and repeated rows are separate documents. A null or empty text
    is just ``end_id``. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tokens = token_table(docs, tokenizer, end_id, id_col, text_col)
    totals = sorted((r.part, r.total) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())
    offsets = list(accumulate((t for _, t in totals), initial=0))
    base = spark.createDataFrame([(p, o) for (p, _), o in zip(totals, offsets, strict=False)], "part int, base long")
    kind = tokenizing.load(tokenizer).typecode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(kind)
        for batch in batches:
            for part in row_slices(batch, "ids"):
                cols = [part.column(c) for c in ("doc_id", "start", "ids")]
                rows = [r for i in range(part.num_rows) for r in cut(*(c[i].as_py() for c in cols), dtype.itemsize, dtype, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in PIECE_SCHEMA.split(", ")])

    # a row for each partition of the first pass: broadcast
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "ids")
    return placed.mapInArrow(run, PIECE_SCHEMA)
