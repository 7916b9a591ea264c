import random

import numpy as np
import pyspark.sql.functions as F

import corpus
from quillmeter.llm import toxicity

def chain():
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    data, labels = [], []
    for i in range(400):
        w, toxic, bad = corpus.prose(rng, 40).split(), rng.random() < 0.3, rng.random() < 0.3
        w[3:3] = rng.sample(["vile", "nasty", "horrid", "foul"], 2) if toxic else []
        w[9:9] = ["lorem", "click"] if bad else []
        data.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    data += [(None, "vile nasty", "en", "s", 1), (900, None, "en", "s", 1), (901, "", "en", "s", 1)]
    docs = corpus.table(spark, data).withColumn("tf", F.lit(1)).withColumn("p_toxic", F.lit(2))
    known = spark.createDataFrame([x for x in labels if x[0] % 4] + [(5000, 1, 1), (None, 1, 1), (8, None, None)], LABELS)
    rows = toxicity.predict(docs, toxicity.train_chain(docs, known, chain())).collect()
    assert len(rows) == len(data)
    got = {r.doc_id: r for r in rows}
    for truth, name in ((lambda x: x[2] == 1, "is_toxic"), (lambda x: x[1] == 0, "is_low_quality")):
        assert sum(getattr(got[x[0]], name) == truth(x) for x in labels if x[0] % 4 == 0) >= 97


def test_empty(spark):
    docs, none = corpus.table(spark, []), spark.createDataFrame([], LABELS)
    assert toxicity.predict(docs, toxicity.train_chain(docs, none, chain())).count() == 0
    some = toxicity.predict(corpus.table(spark, [(1, "a", "x", "y", 1)]), toxicity.train_chain(docs, none, chain())).first()
    assert some.p_toxic == 0.0 and not some.is_toxic


def brute_fit(x, earlier, y):
    """Logistic regression of a dense matrix: chi-square choice of columns, then the same steps in plain sums."""
    n, ones, have, both = len(y), y.sum(), x.sum(0), x.T @ y
    table = n * (both * n - have * ones) ** 2 / np.maximum(have * (n - have) * ones * (n - ones), 1e-9)
    full = np.hstack((x * (table > toxicity.DEPENDENCE), earlier, np.ones((n, 1))))
    w, m, v = (np.zeros(full.shape[1]) for _ in range(3))
    for t in range(1, toxicity.STEPS + 1):
        g = full.T @ ((1 / (1 + np.exp(-full @ w)) - y) / n) + toxicity.PENALTY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def test_chain_matches_brute_force(spark):
    rng = random.Random(21)
    data = [(i, " ".join(rng.choice(["vile", "spam", "good", "fine", "calm", "dull"]) for _ in range(rng.randrange(1, 7))), "en", "s", 1) for i in range(240)]
    labels = [(i, int("spam" not in t), int("vile" in t and "calm" not in t)) for i, t, *_ in data]
    docs = corpus.table(spark, [*data, (5, "zzz repeated id", "en", "s", 1)])
    got = {r.doc_id: r for r in toxicity.predict(corpus.table(spark, data), toxicity.train_chain(docs, spark.createDataFrame([*labels, (7, 1, 1), (7, 0, 1)], LABELS), chain())).collect()}
    # of the rows of ids 5 and 7 the smallest count
    texts = [t for _, t, *_ in data]
    learn = list(texts)
    learn[5] = min(texts[5], "zzz repeated id", key=lambda t: toxicity.features(t).tolist())
    low, toxic = np.array([1.0 - q for _, q, _ in labels]), np.array([float(x) for *_, x in labels])
    low[7], toxic[7] = min([(low[7], toxic[7]), (0.0, 1.0), (1.0, 1.0)])
    place = {f: j for j, f in enumerate(sorted({f for t in texts + learn for f in toxicity.features(t).tolist()}))}
    matrix = lambda ts: np.array([[float(f in set(toxicity.features(t).tolist())) for f in place] for t in ts])
    x, xl = matrix(texts), matrix(learn)
    fold = np.array([r.f for r in spark.range(240).select("id", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(toxicity.FOLDS)).alias("f")).orderBy("id").collect()])
    none, p = np.zeros((240, 0)), lambda w, x, e: 1 / (1 + np.exp(-np.hstack((x, e, np.ones((len(x), 1)))) @ w))
    out = np.zeros((240, 1))
    for k in range(toxicity.FOLDS):
        out[fold == k, 0] = p(brute_fit(xl[fold != k], none[fold != k], low[fold != k]), xl[fold == k], none[fold == k])
    first = p(brute_fit(xl, none, low), x, none)
    second = p(brute_fit(xl, out, toxic), x, first[:, None])
    assert max(abs(got[i].p_low_quality - first[i]) for i in range(240)) < 1e-6
    assert max(abs(got[i].p_toxic - second[i]) for i in range(240)) < 1e-6


def test_a_score_is_its_texts_alone():
    """The same text has the same probability to the last bit, whatever stands beside it."""
    rng = np.random.default_rng(4)
    model = rng.normal(size=toxicity.FEATURES + 2)
    rows = [rng.integers(0, toxicity.FEATURES, rng.integers(0, 400)).astype(np.int32) for _ in range(200)]
    earlier = rng.random((200, 1))
    whole = toxicity.probability(model, rows, earlier)
    for order in (rng.permutation(200), np.arange(7)):
        assert np.array_equal(toxicity.probability(model, [rows[i] for i in order], earlier[order]), whole[order])
    assert toxicity.probability(model, [rows[3]], earlier[3:4])[0] == whole[3]
