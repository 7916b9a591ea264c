import public_tokenizers

import corpus
from quillmeter.llm import token_counts
from test_tokenizing import plain

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(data):
    n = [len(x) for x in plain(PATH, [t or "" for _, t, *_ in data])]
    return sorted(((i, len((t or "").encode()), k, k > 512) for (i, t, *_), k in zip(data, n, strict=True)), key=str)


def test_counts_match_the_library(spark):
    data = corpus.rows()
    assert sorted(map(tuple, token_counts.token_counts(corpus.table(spark, data), PATH).collect()), key=str) == want(data)


def test_cache_is_used_and_grows(spark):
    data = corpus.rows(n=20)
    cache = token_counts.CountCache(spark)
    token_counts.token_counts(corpus.table(spark, data[:15]), PATH, cache).count()
    first = spark.read.parquet(cache.path).count()
    assert first == len({t or "" for _, t, *_ in data[:15]})
    got = token_counts.token_counts(corpus.table(spark, data), PATH, cache)
    assert sorted(map(tuple, got.collect()), key=str) == want(data)
    assert spark.read.parquet(cache.path).count() == len({t or "" for _, t, *_ in data})


def test_empty_and_clashing_columns(spark):
    assert token_counts.token_counts(corpus.table(spark, []), PATH).count() == 0
    docs = corpus.table(spark, [(1, "a b", "x", "y", 1)]).selectExpr("doc_id", "text", "1 AS digest", "2 AS stand", "3 AS n_tokens")
    assert [tuple(r) for r in token_counts.token_counts(docs, PATH).collect()] == [(1, 3, 2, False)]


def test_rows_without_an_id_are_encoded_once(spark, tmp_path, monkeypatch):
    """Many nameless copies of a text give one row to encode."""
    data = [(None, "the same text", "en", "s", 1)] * 50 + [(None, "another", "en", "s", 1), (3, "named", "en", "s", 1), (None, "named", "en", "s", 1)]
    encoded, seen = token_counts.encoded_counts, []
    monkeypatch.setattr(token_counts, "encoded_counts", lambda texts, path: (seen.append(texts.count()), encoded(texts, path))[1])
    assert sorted(map(tuple, token_counts.token_counts(corpus.table(spark, data), PATH).collect()), key=str) == want(data)
    assert seen == [3]
