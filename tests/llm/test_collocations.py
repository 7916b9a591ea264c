import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus
from quillmeter.llm import buckets, collocations, queries

DATA = "/root/testdata/sf0.01"


def brute(data, least, top):
    total, count = Counter(), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            total[lang] += len(words)
            count.update((lang, words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    candidates = {x: a for x, a in count.items() if a >= least and len(x[1]) > 1}
    longer = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(a, longer[lang, w[i : i + k]])
    rows = {}
    for (lang, w), a in candidates.items():
        cuts = [(2000000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if not ((lang, w) in longer and 100 * longer[lang, w] >= 80 * a):
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, r in rows.items() for i, (s, a, p, x, y) in enumerate(sorted(r)[:top]))


def run(spark, data, least, top, **kw):
    return sorted(map(tuple, collocations.collocations(corpus.table(spark, data), least, top, **kw).collect()))


def chatter(n=150, seed=3):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "of", "the", "ÉTÉ", "été", "a\xa0b", "漢字", "x-y", "in", "big"]
    say = ["new york city", "of the", "in the big city", "été of", "New  York\tcity"]
    out = [(i, "".join((rng.choice(say) if rng.random() < 0.4 else rng.choice(words)) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und", ""]), "s", 1) for i in range(n)]
    return out + [(1, None, "en", "s", 1), (None, "", None, None, None), (7, "of the", "only", "s", 1)] + out[:20]


@pytest.mark.parametrize("least, top", [(3, 50), (30, 2000), (1, 7), (200, 10)])
def test_matches_brute_force(spark, least, top):
    data = chatter()
    want = brute(data, least, top)
    assert run(spark, data, least, top) == want
    assert want or least == 200


def test_full_buckets_change_nothing(spark, monkeypatch):
    """With hardly a bucket, every n-gram passes the filters: exact counts decide all the same."""
    data = corpus.rows() + chatter(60, seed=8)
    monkeypatch.setattr(collocations, "has", lambda bitmap, places: np.ones(len(places), bool))
    assert run(spark, data, 4, 100, bits=15) == brute(data, 4, 100)


def test_filters_hold_back_infrequent_phrases(spark):
    """Few n-grams but the frequent ones are counted at all."""
    data = corpus.rows()
    own = corpus.table(spark, data).selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text")
    found, _ = collocations.phrase_counts(corpus.table(spark, data), 4)
    first = collocations._pass(own, 1, 4, None, None)
    shorter = spark.sparkContext.broadcast(buckets.bitmap(collocations._phrase_buckets(found[0]), collocations.BUCKET_BITS))
    full = spark.sparkContext.broadcast(buckets.bitmap(buckets.full_buckets(first.where("chunk is not null"), 4), collocations.BUCKET_BITS))
    counted = collocations._pass(own, 2, 4, shorter, full).where("chunk is null").select("lang", "phrase").distinct().count()
    assert found[1].count() <= counted <= found[1].count() + 5


def test_large_counts_are_exact(spark):
    rows = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_001, 9_000_000_000_003)], "a long, l long, r long")
    score = "CAST(2000000 AS DECIMAL(18,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + r)"
    assert rows.selectExpr(score).first()[0] == 2000000 * 9_000_000_000_000 // 18_000_000_000_004


def test_empty_and_clashing_columns(spark):
    assert run(spark, [], 1, 5) == []
    data = [(1, "a b a b", "x", "y", 1), (1, "a b", "x", "y", 1)]
    docs = corpus.table(spark, data).selectExpr("text", "lang", "1 AS n", "2 AS phrase", "3 AS chunk", "4 AS a")
    assert sorted(map(tuple, collocations.collocations(docs, 2, 9).collect())) == brute(data, 2, 9)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.QUERIES["op11_collocations"](spark, DATA)
    want = con.execute(queries.ORACLE["op11_collocations"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
