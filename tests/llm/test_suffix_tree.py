import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import corpus
import numpy as np
from quillmeter.llm import suffix_tree
from quillmeter.llm.common import crc_bucket


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(data):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in data]
    c = Counter(x for (_, t, *_), h in zip(data, held, strict=True) if not h for x in tokens(t))
    n, v = sum(c.values()), len(c)
    log = lambda x: math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1)))
    return [(i, h, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(map(log, tokens(t))), 6)) for (i, t, *_), h in zip(data, held, strict=True)]


def test_base_scores_match_brute_force(spark, monkeypatch):
    data = corpus.rows()
    for head in (suffix_tree.HEAD, 20):
        monkeypatch.setattr(suffix_tree, "HEAD", head)
        got = suffix_tree.scores(corpus.table(spark, data), crc_bucket("doc_id", 10) == 0).collect()
        assert sorted((*tuple(r)[:5], round(r.base_score, 6)) for r in got if r.doc_id is not None) == sorted(r for r in brute(data) if r[0] is not None)
        assert len(got) == len(data)


def test_contexts_help_and_add_up(spark):
    rng = random.Random(7)
    follow = {w: [rng.choice("abcdefgh") for _ in range(3)] for w in "abcdefgh"}
    data = []
    for i in range(300):
        w = ["a"]
        for _ in range(rng.randrange(5, 60)):
            w.append(rng.choice(follow[w[-1]]))
        data.append((i, " ".join(w), "en", "s", 1))
    docs = corpus.table(spark, data)
    rows = suffix_tree.scores(docs, crc_bucket("doc_id", 10) == 0).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    own = docs.select("doc_id", "text")
    model, *_ = suffix_tree.train(own)
    # each state's distribution over all symbols adds up to one (with the root's unknown share)
    import numpy as np

    n = len(model.head_log) - 1
    root = (10 ** model.head_log[:n]).sum()
    for state in range(len(model.levels[0].backoff)):
        hit = model.levels[0].entries.find((np.int64(state) << 20) | np.arange(n))
        p = np.where(hit >= 0, 10 ** model.levels[0].logp[hit], 10 ** (model.levels[0].backoff[state] + model.head_log[:n])).sum()
        assert abs(p + 10 ** model.levels[0].backoff[state] * (1 - root) - 1) < 1e-6
    assert len(model.levels) == suffix_tree.DEPTH


def test_empty(spark):
    assert suffix_tree.scores(corpus.table(spark, []), crc_bucket("doc_id", 10) == 0).count() == 0
    one = suffix_tree.scores(corpus.table(spark, [(1, None, "x", "y", 1)]).selectExpr("doc_id", "text", "1 AS key", "2 AS uid", "3 AS n"), crc_bucket("doc_id", 10) == 3).first()
    assert one.n_tokens == 1


def chains(n=400):
    rng = random.Random(11)
    names = [f"w{i}" for i in range(12)]
    follow = {(a, b): rng.sample(names, 3) for a in names for b in names}
    data = []
    for i in range(n):
        w = [rng.choice(names), rng.choice(names)]
        for _ in range(rng.randrange(5, 90)):
            w.append(rng.choice(follow[w[-2], w[-1]]) if rng.random() < 0.9 else f"rare{rng.randrange(3000)}" if rng.random() < 0.5 else rng.choice(names))
            if w[-1] not in names:
                w.append(rng.choice(names))
                w.append(rng.choice(names))
        data.append((i, " ".join(w), "en", "s", 1))
    return [*data, (None, None, "en", "s", 1)]


def brute_scores(data):
    """Scores by dictionaries of whole contexts, without a bound."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in data]
    rows = [tokens(t) for _, t, *_ in data]
    c = Counter(x for r, h in zip(rows, held, strict=True) if not h for x in r)
    n, v = sum(c.values()), len(c)
    root = lambda x: math.log((c[x] + 0.1) / (n + 0.1 * (v + 1)))
    runs = lambda r, d: [((None, *r)[j : j + d], x) for j, x in enumerate((None, *r)[d:])]
    seen = [Counter(p for r, h in zip(rows, held, strict=True) if not h for p in runs(tuple(r), d)) for d in range(1, suffix_tree.DEPTH + 1)]
    states = [{} for _ in seen]
    kept = [Counter() for _ in seen]
    for d in range(len(seen)):
        total, entries = Counter(), {}
        for (ctx, x), k in seen[d].items():
            total[ctx] += k
            if k >= 2:
                entries.setdefault(ctx, {})[x] = k
        for ctx, e in entries.items():
            if total[ctx] < 50:
                continue
            q = {x: log_in(states[:d], ctx[1:], x, root) for x in e}
            rest, mass = total[ctx] - sum(e.values()), max(1 - sum(map(math.exp, q.values())), 1e-12)
            gain = sum(k * (math.log(k / total[ctx]) - q[x]) for x, k in e.items()) + (rest * math.log(rest / total[ctx] / mass) if rest > 0 else 0)
            kept[d][gain > len(e)] += 1
            if gain > len(e):
                p = {x: (k - 0.75) / total[ctx] for x, k in e.items()}
                states[d][ctx] = (math.log(max(1 - sum(p.values()), 1e-12) / mass), {x: math.log(y) for x, y in p.items()})
    out = []
    for (i, *_), r in zip(data, rows, strict=True):
        full = (None, *r)
        out.append((i, round(sum(log_in(states, full[max(0, j + 1 - suffix_tree.DEPTH) : j + 1], x, root) for j, x in enumerate(r)) / math.log(10), 5)))
    return out, kept


def log_in(states, ctx, x, root):
    value = root(x)
    for d, level in enumerate(states, 1):
        if len(ctx) >= d and ctx[len(ctx) - d :] in level:
            backoff, p = level[ctx[len(ctx) - d :]]
            value = p.get(x, value + backoff)
    return value


def test_scores_match_brute_force_beyond_broadcasts(spark, monkeypatch):
    data = chains()
    want, kept = brute_scores(data)
    assert kept[0][True] >= 10 and kept[1][True] >= 100 and kept[2][True] + kept[3][True] >= 1
    # the broadcasts are shortcuts: with next to none of them no state or next symbol is lost
    for sizes in ((suffix_tree.HEAD, suffix_tree.HOT, suffix_tree.FILTER), (5, 4, 8)):
        for name, size in zip(("HEAD", "HOT", "FILTER"), sizes, strict=True):
            monkeypatch.setattr(suffix_tree, name, size, raising=False)
        got = suffix_tree.scores(corpus.table(spark, data), crc_bucket("doc_id", 10) == 0).collect()
        assert sorted(((r.doc_id, round(r.score, 5)) for r in got), key=str) == sorted(want, key=str)


def test_shares_of_keys_give_the_same_scores(spark, monkeypatch):
    """Runs counted in several passes, each of which deals out a share of them."""
    data, write, found, seen = chains(), suffix_tree.freed, [], []
    monkeypatch.setattr(suffix_tree, "freed", lambda df, name: seen.append(name) or write(df, name))
    for share in (10.0, 0.2):
        monkeypatch.setattr(suffix_tree, "PASS_SHARE", share)
        seen.clear()
        found.append(sorted(((r.doc_id, r.n_known, round(r.score, 6)) for r in suffix_tree.scores(corpus.table(spark, data), crc_bucket("doc_id", 10) == 0).collect()), key=str))
        assert (seen.count("pairs") > seen.count("entries") > 0) == (share < 1)
    assert found[0] == found[1]


def test_few_copies_of_counts_and_values_lie_in_memory_at_once():
    """Blocks are used up as they are joined, and a bucket's values are put in order column by column."""
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 200_000, 50_000) for _ in range(20)]
    want, sizes = np.unique(np.concatenate(keys), return_counts=True)
    tracemalloc.start()
    try:
        key, n, a, b = suffix_tree._merged([[k.copy(), np.ones(len(k), np.int64), k + 1, k + 2] for k in keys])
        assert tracemalloc.get_traced_memory()[1] < 32e6 * 2  # all blocks are 32 MB; joined as a whole they took over three times that
        assert [x.tolist() for x in (key, n, a, b)] == [x.tolist() for x in (want, sizes, want + 1, want + 2)]
        distinct, values = rng.permutation(400_000) * 3, suffix_tree._Values()
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        for i in range(0, 200_000, 20_000):
            k = distinct[i : i + 20_000]
            values.take(suffix_tree.VALUES, k.tobytes(), np.stack((-k, k / 2), axis=1).tobytes())
            k = distinct[200_000 + i :][:20_000]
            values.take(suffix_tree.RUN_VALUES, k.tobytes(), (k / 4).tobytes())
        adds, found = values.find(np.array([distinct[7], distinct[200_007], 1]))
        assert tracemalloc.get_traced_memory()[1] - before < 100 * 400_000  # bytes a key; 136 before
    finally:
        tracemalloc.stop()
    assert found.tolist() == [True, True, False]
    assert adds.T.tolist() == [[-distinct[7], -distinct[7] / 2, 1], [0, distinct[200_007] / 4, 0], [0, 0, 0]]
