"""Toxicity categories by a classifier chain of linear models over hashed words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import row_slices, text_or_empty, written

#: Hashed word features, labelled rows that training takes at most (about), folds, regularisation, training steps,
#: and the chi-square statistic that a feature needs.
FEATURES, TRAIN_ROWS, FOLDS, PENALTY, STEPS, DEPENDENCE = 1 << 18, 20_000, 3, 1e-4, 200, 15.0
#: Distinct words that a worker remembers; beyond it forgets all and begins anew.
REMEMBERED = 1_000_000
#: Letters of the beginnings of words that are features.
STEMS = (5, 7)
_WORD = re.compile(r"[^\W\d_]+|[^\w\s]+")


class _Features(dict):
    """A word's features: the word itself and its beginnings, which inflected and joined forms share."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        parts = [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]
        value = self[word] = tuple(xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass"), 42) % FEATURES for p in parts)
        return value


_FEATURES = _Features()


def features(text: str) -> np.ndarray:
    """The distinct hashed words of a whole text (runs of letters in lower case, and of symbols) and their beginnings."""
    return np.unique(np.fromiter(chain.from_iterable(map(_FEATURES.__getitem__, set(_WORD.findall(text.lower())))), np.int32))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], np.int64)
    return np.concatenate(rows) if rows else np.empty(0, np.int32), np.concatenate(([0], np.cumsum(size)))


def probability(model: np.ndarray, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    """model: the features' weights, one for each earlier category's probability, and the intercept."""
    return _probability(model, *_flat(rows), earlier)


def _probability(model: np.ndarray, flat: np.ndarray, at: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    some = at[1:] > at[:-1]
    z = np.zeros(len(some))
    if some.any():
        z[some] = np.add.reduceat(model[flat], at[:-1][some])  # of a row's own features alone, so that no neighbour changes its last bits
    z += (earlier * model[len(model) - 1 - earlier.shape[1] : -1]).sum(axis=1) + model[-1]
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which features' presence depends on the label, by the chi-square statistic of their fourfold table."""
    flat, at = _flat(rows)
    n, ones = len(y), y.sum()
    have = np.bincount(flat, minlength=FEATURES).astype(float)
    both = np.bincount(flat, np.repeat(y, np.diff(at)), FEATURES)
    spread = np.maximum(have * (n - have) * ones * (n - ones), 1e-9)
    return n * (both * n - have * ones) ** 2 / spread > DEPENDENCE


def fit(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression over the telling features by full-batch Adam steps: the same rows give the same model."""
    whole = np.zeros(FEATURES + earlier.shape[1] + 1)
    if not len(y):
        whole[-1] = -np.inf
        return whole
    use = telling(rows, y)
    kept, place = np.flatnonzero(use), np.cumsum(use) - 1  # the others' weights stay zero
    rows = [place[r[use[r]]] for r in rows]
    flat, at = _flat(rows)
    size, row = np.diff(at), np.repeat(np.arange(len(rows)), np.diff(at))
    w = np.zeros(len(kept) + earlier.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        r = (_probability(w, flat, at, earlier) - y) / len(y) if size.any() else (1 / (1 + np.exp(-w[-1])) - y) / len(y)
        g = np.concatenate((np.bincount(flat, r[row], len(kept)), earlier.T @ r, [r.sum()])) + PENALTY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    whole[kept], whole[FEATURES:] = w[: len(kept)], w[len(kept) :]
    return whole


def _models(rows: DataFrame, label: str, earlier: list[str], folds: int) -> list[np.ndarray]:
    """The model of all rows, then one without each fold; each is fitted in its own task, on at most about TRAIN_ROWS rows."""

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part[part.fold != key[0]].sort_values("id", kind="stable")
        w = fit([np.asarray(x, np.int32) for x in part.words], part[earlier].to_numpy(float).reshape(len(part), len(earlier)), part[label].to_numpy(float))
        return pd.DataFrame({"model": [key[0]], "w": [w]})

    each = rows.where(F.col(label).isNotNull()).select("id", "fold", "words", label, *earlier, F.explode(F.sequence(F.lit(-1), F.lit(folds - 1))).alias("model"))
    found = {r.model: np.array(r.w) for r in each.groupBy("model").applyInPandas(one, "model int, w array<double>").collect()}
    none = fit([], np.zeros((0, len(earlier))), np.zeros(0))
    return [found.get(k, none) for k in range(-1, folds)]


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, np.ndarray]]:
    """(category, model) in the order of ``categories``, whose values say from a labels row 0, 1 or null (not known).

    Training takes all labelled rows up to about TRAIN_ROWS, beyond that a share by a hash of the id. The earlier
    categories' probabilities, with which a model is trained, come from models that did not see the row: each category
    is also learned FOLDS times without one fold. Labels are joined by id; those without a document are left out. Of
    repeated ids one row counts: of labels the one with the smallest values (nulls first), of documents the one whose
    features come first in order. Without any label a category's probability is 0.
    """
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.struct(*(c.cast("double").alias(f"y_{k}") for k, c in categories.items())).alias("y")).where("id is not null")
    own = own.groupBy("id").agg(F.min("y").alias("y")).select("id", "y.*")
    n = own.count()
    taken = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, TRAIN_ROWS / max(n, 1))))
    kinds = ["id long", *(f"y_{k} double" for k in categories)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                words = pa.array([features(t) for t in part.column("text").to_pylist()], pa.list_(pa.int32()))
                names = [k.split()[0] for k in kinds]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), words], [*names, "words"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    # about TRAIN_ROWS rows of numbers: broadcast
    rows = texts.join(F.broadcast(taken), "id").select(*(k.split()[0] for k in kinds), "text").mapInArrow(run, f"{', '.join(kinds)}, words array<int>")
    rows = rows.groupBy(*(k.split()[0] for k in kinds)).agg(F.min("words").alias("words"))
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int")), "labelled")
    models_of, earlier = [], []
    for k in categories:
        last = len(models_of) == len(categories) - 1
        models = _models(rows, f"y_{k}", earlier, 0 if last else FOLDS)
        models_of.append((k, models[0]))
        if not last:
            rows = written(_out_of_fold(rows, models[1:], earlier, f"p_{k}"), "labelled")
        earlier = [*earlier, f"p_{k}"]
    return models_of


def _out_of_fold(rows: DataFrame, models: list[np.ndarray], earlier: list[str], name: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            words = [np.asarray(x, np.int32) for x in part.words]
            p = [probability(shared.value[f], [w], e[None, :])[0] for f, w, e in zip(part.fold, words, part[earlier].to_numpy(float).reshape(len(part), len(earlier)), strict=True)]
            yield part.assign(**{name: np.array(p, float)})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, {name} double")


def predict(docs: DataFrame, chain: list[tuple[str, np.ndarray]], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``p_<category>`` and ``is_<category>`` (p >= threshold) along the chain.

    A null or empty text has no words and gets the intercepts' probabilities. Repeated rows and rows without an id are
    scored like others. Other columns are not read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast([m for _, m in chain])
    names = [f"p_{k}" for k, _ in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, size=1 << 20):
                rows = [features(t) for t in part.column("text").to_pylist()]
                earlier = np.zeros((len(rows), 0))
                for model in shared.value:
                    earlier = np.column_stack((earlier, probability(model, rows, earlier)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(earlier[:, i]) for i in range(len(names)))], ["doc_id", *names])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    out = own.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in names)]))
    return out.select("doc_id", *names, *((F.col(n) >= threshold).alias(f"is_{n[2:]}") for n in names))
