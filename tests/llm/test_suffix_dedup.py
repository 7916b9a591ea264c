import hashlib
import random
from collections import Counter

import pytest

import corpus
from quillmeter.llm import suffix_dedup


def brute(data, window=200):
    texts = [(i, (t or "").encode()) for i, t, *_ in data]
    count = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        go = [False] * len(t)
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                go[k : k + window] = [True] * window
        kept = bytes(b for b, g in zip(t, go, strict=True) if not g)
        spans = sum(g and not (k and go[k - 1]) for k, g in enumerate(go))
        out.append((i, len(t), sum(go), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, data, **kw):
    return sorted(map(tuple, suffix_dedup.dedup_bytes(corpus.table(spark, data), **kw).collect()), key=str)


def passages(n=90, seed=2):
    """Texts over shared passages: at any place, cut, edited, twice in one text, and runs of one letter."""
    rng = random.Random(seed)
    own = lambda k: "".join(rng.choice("etaoin shrdlu\x00é漢") for _ in range(k))
    shared = [own(k) for k in (150, 230, 400, 900)]
    out = []
    for i in range(n):
        t = own(rng.randrange(300))
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            p = p[a:] if rng.random() < 0.3 else p[: a + 1] if rng.random() < 0.3 else p[:a] + "#" + p[a:] if rng.random() < 0.5 else p
            t += p + own(rng.choice([0, 0, 1, 5, 60]))
        out.append((i, t, "en", "s", 1))
    return out + [(500, "a" * 350, "en", "s", 1), (501, "a" * 200, "en", "s", 1), (502, "b" * 201, "en", "s", 1), (503, "ab" * 400, "en", "s", 1), (504, "z" * 200, "en", "s", 1), (None, None, "en", "s", 1), (None, shared[2], "en", "s", 1)]


def test_matches_brute_force(spark):
    data = corpus.rows() + passages()
    want = brute(data)
    assert sum(r[2] > 0 for r in want) > 40
    assert run(spark, data) == want


@pytest.mark.parametrize("hot", [0, 600, 1 << 20])
def test_small_shards_and_hot_anchors(spark, monkeypatch, hot):
    """Shards of a few stretches, anchors whose windows are dealt out one by one, blocks of a few kilobytes, a full bitmap."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    data = corpus.rows(n=30) + passages(40, seed=6)
    assert run(spark, data, window=40, gram=12, bits=15) == brute(data, 40)


def test_a_template_with_a_slot(spark):
    """Many texts that differ in one place: what no two share in one piece stays."""
    rng = random.Random(3)
    a, b = (" ".join(rng.choice(corpus.WORDS) for _ in range(80)) for _ in range(2))
    data = [(i, f"{a} no. {i % 40} {b}", "en", "s", 1) for i in range(60)]
    assert run(spark, data) == brute(data)


def test_blocks_cut_stretches(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    data = [t.encode() for _, t, *_ in passages() if t]
    column = pa.array(data, pa.binary())
    whole = suffix_dedup.Stretches(column, 40, 12)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 1 << 9)
    cut = suffix_dedup.Stretches(column, 40, 12)
    covered = lambda s: np.concatenate([np.arange(a, a + n) for a, n in zip(s.start, s.windows, strict=True)])
    assert np.array_equal(covered(whole), covered(cut)) and len(cut.start) > len(whole.start)
    assert len(covered(whole)) == sum(max(len(t) - 39, 0) for t in data)


def test_repeated_windows():
    assert [w.tolist() for w in suffix_dedup.repeated_windows([b"abcdefgh", b"xbcdefgy", b"aaaaaa"], 4)] == [[1, 2, 3], [1, 2, 3], [0, 1, 2]]
    assert [w.tolist() for w in suffix_dedup.repeated_windows([b"\x00\x00\x00\x01"], 2)] == [[0, 1]]


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    data = [(1, "a b" * 100, "x", "y", 1), (2, None, "x", "y", 1)]
    docs = corpus.table(spark, data).selectExpr("doc_id", "text", "1 AS uid", "2 AS anchor", "3 AS content", "4 AS at")
    assert sorted(map(tuple, suffix_dedup.dedup_bytes(docs).collect()), key=str) == brute(data)


def test_no_text_is_written_whole_and_copies_count(spark, monkeypatch):
    """Written tables hold no whole text, and rows with equal ids and texts are documents of their own."""
    seen, write = [], suffix_dedup.freed
    monkeypatch.setattr(suffix_dedup, "freed", lambda df, name: seen.append(df.columns) or write(df, name))
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(1, t, "en", "s", 1)] * 3 + [(None, t[:500] + "#" + t[500:], "en", "s", 1)] * 2 + [(7, t[100:400], "en", "s", 1), (8, "x" * 150, "en", "s", 1)]
    for hot in (0, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
        assert run(spark, rows) == brute(rows)
    assert not any("text" in columns for columns in seen)
