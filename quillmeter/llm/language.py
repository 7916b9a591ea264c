"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import row_slices

#: Hash buckets of n-grams (2 ^ FEATURE_BITS), the longest n-gram, and the count added to each bucket's.
FEATURE_BITS, LONGEST, ADDED = 16, 3, 0.5
FEATURES = 1 << FEATURE_BITS
#: Languages whose counts a task holds before it hands them on.
HELD_LANGS = 64
#: Positions of a text that are counted at once.
BLOCK = 1 << 16
_LETTER = re.compile(r"[^\W\d_]")
_STEP = np.uint32(0x9E3779B1)
_VECTOR_BYTES = 1 << 20


def blocks(texts: list[str]) -> Iterator[tuple[int, str]]:
    """(text's place, piece): lower-cased texts with a space at both ends and LONGEST - 1 zeros after it, cut into pieces.

    A piece overlaps the next one by LONGEST - 1 characters, at which none of its n-grams starts.
    """
    pad = LONGEST - 1
    for i, text in enumerate(texts):
        whole = f" {text.lower()} " + "\0" * pad
        for start in range(0, len(whole) - pad, BLOCK):
            yield i, whole[start : start + BLOCK + pad]


def counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse rows (text's place, feature, count) of some texts' hashed n-grams at a time, ordered by place and feature.

    A text's rows depend on nothing but the text; those of a long one come in several times.
    """
    held: list[tuple[int, str]] = []
    size = 0
    for i, piece in blocks(texts):
        held.append((i, piece))
        size += len(piece)
        if size >= BLOCK:
            yield _counted(held)
            held, size = [], 0
    if held:
        yield _counted(held)


def _counted(pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) for _, p in pieces]
    size = np.array([len(c) for c in codes])
    c = np.concatenate(codes)
    starts_one = np.ones(len(c), bool)
    for k in range(1, LONGEST):
        starts_one[np.cumsum(size) - k] = False
    at = np.flatnonzero(starts_one)
    row = np.repeat(np.arange(len(pieces), dtype=np.int64), size)[at] << FEATURE_BITS
    h, keys = np.zeros(len(at), np.uint32), []
    for k in range(LONGEST):
        h = (h + c[at + k] + np.uint32(k + 1)) * _STEP
        keys.append(row | ((h ^ (h >> np.uint32(15))) >> np.uint32(32 - FEATURE_BITS)))
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return np.array([i for i, _ in pieces])[key >> FEATURE_BITS], key & (FEATURES - 1), n


def train(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (FEATURES + 1 rows, the last one the priors; a column for each language).

    All rows that ``where`` holds for, with a language and a text, count, repeated ones each time; ids are not read. Each
    task sums its counts, Spark adds them up; the driver gets the matrix, a quarter of a megabyte for each language. No
    such row: no language and an empty matrix.
    """

    def out(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            f = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(f), pa.array(n[f])], ["lang", "feature", "n"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in row_slices(batch, size=_VECTOR_BYTES):
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                for lang in dict.fromkeys(langs):
                    if lang not in held and len(held) == HELD_LANGS:
                        yield from out(held)
                    mine = held.setdefault(lang, np.zeros(FEATURES + 1, np.int64))
                    own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                    for _, feature, n in counts(own):
                        mine[:FEATURES] += np.bincount(feature, n, FEATURES).astype(np.int64)
                    mine[FEATURES] += len(own)
        yield from out(held)

    rows = docs.where(where).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(run, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # at most FEATURES + 1 rows for each language
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    n = np.zeros((FEATURES + 1, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    n[table.column("feature").to_numpy().astype(np.int64), [place[x] for x in names]] = table.column("n").to_numpy()
    p = n[:FEATURES] + ADDED
    return langs, np.vstack((np.log(p / p.sum(axis=0)), np.log(n[FEATURES:] / max(n[FEATURES:].sum(), 1)))).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep_text: bool = True, made: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` (but the text's if it isn't kept) with the predicted language and its posterior probability.

    Both are functions of the text and the model alone: the same for repeated rows, alone or beside any other row.
    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Ids may be null; input columns
    of the names in ``made`` are replaced. Of equal posteriors the first language by name wins. An empty table gives an empty
    result.
    """
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = [c for c in docs.columns if c not in made]
    keep, out = docs.select(names), [c for c in names if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            for part in row_slices(batch, text_col, _VECTOR_BYTES):
                texts = part.column(text_col).to_pylist()
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                good = [i for i, t in enumerate(texts) if langs and t is not None and _LETTER.search(t)]
                if good:
                    total = np.zeros((len(good), len(langs)))
                    for row, feature, n in counts([texts[i] for i in good]):
                        heads = np.flatnonzero(np.concatenate((np.ones(1, bool), np.diff(row) != 0)))
                        for j in range(0, len(langs), HELD_LANGS):
                            some = slice(j, j + HELD_LANGS)
                            total[row[heads], some] += np.add.reduceat(logs[feature, some].astype(np.float64) * n[:, None], heads, axis=0)
                    total += logs[FEATURES]
                    best = total.argmax(axis=1)
                    post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, b, s in zip(good, best.tolist(), post.tolist(), strict=True):
                        pred[i], score[i] = langs[b], s
                cols = [*(part.column(c) for c in out), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [*out, *made])

    schema = keep.select(out).schema.add(made[0], "string").add(made[1], "double")
    return keep.mapInArrow(run, schema)
