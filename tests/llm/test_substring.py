import hashlib
import random
import re

import corpus
from quillmeter.llm import substring


def brute(data, window=13):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in data]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            order = substring.NO_ID if i is None else i
            first[key] = min(order, first.get(key, order))
    out = []
    for i, w in texts:
        order, keep = substring.NO_ID if i is None else i, [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order:
                keep[k : k + window] = [False] * window
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((i, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, data, **kw):
    return sorted(map(tuple, substring.dedup_substrings(corpus.table(spark, data), **kw).collect()), key=str)


def test_matches_brute_force(spark):
    data = corpus.rows()
    assert run(spark, data) == brute(data)


def test_few_words_and_hot_passages(spark, monkeypatch):
    rng = random.Random(9)
    line = "a b c d e f g h i j k l m n o p"
    data = []
    for i in range(80):
        w = [rng.choice("xyz") for _ in range(rng.randrange(40))]
        w[rng.randrange(len(w) + 1) : 0] = line.split() if i % 3 else []
        data.append((i, " ".join(w), "en", "s", 1))
    data += [(100, " ".join(["same"] * 50), "en", "s", 1), (90, " ".join(["same"] * 20), "en", "s", 1)]
    monkeypatch.setattr(substring, "SCAN_WORDS", 100)
    monkeypatch.setattr(substring, "PATTERNS", 5)
    assert run(spark, data) == brute(data)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = corpus.table(spark, [(1, "a b", "x", "y", 1), (2, None, "x", "y", 1)]).selectExpr("doc_id", "text", "1 AS ord", "2 AS seed", "3 AS o", "4 AS uid")
    assert [r.n_words for r in substring.dedup_substrings(docs).orderBy("doc_id").collect()] == [2, 0]
