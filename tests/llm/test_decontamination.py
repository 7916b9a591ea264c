import random

import corpus
from quillmeter.llm import decontamination


def words(t):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]


def brute(docs, items, least=0.8):
    out = []
    for i, t, *_ in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            size = min(len(v), 5)
            if not v or i is None:
                continue
            a, b = ({tuple(x[k : k + size]) for k in range(len(x) - size + 1)} for x in (v, w))
            if len(a & b) / len(a) >= least:
                out.append((i, j, len(a), len(a & b)))
    return sorted(set(out))


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    data = corpus.rows()
    items = [(k, corpus.prose(rng, n)) for k, n in enumerate([1, 2, 4, 5, 6, 9, 17, 30, 60, 200])] + [(20, ""), (21, None), (None, "no id here at all now")]
    for k, (_, u) in enumerate(items[:10]):
        w = u.split()
        for m in range(3):
            x = list(w)
            if m and len(x) > 5:
                x[rng.randrange(len(x))] = "changed"
            data.append((200 + 3 * k + m, corpus.prose(rng, 50) + " " + " ".join(x).upper() + "\n" + corpus.prose(rng, 300), "en", "s", 1))
    docs, bench = corpus.table(spark, data), spark.createDataFrame(items, "item_id long, text string")
    want = [r for r in brute(data, items) if r[1] is not None]
    for limit in (decontamination.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
        got = [tuple(r)[:4] for r in decontamination.contained_items(docs, bench.where("item_id is not null")).collect()]
        assert sorted(set(got)) == want and len(want) > 20
    clean = {r.doc_id for r in decontamination.clean_documents(docs, bench).collect()}
    assert clean.isdisjoint({w[0] for w in want}) and None in clean


def test_empty(spark):
    docs, bench = corpus.table(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(docs, bench).count() == 0
    assert decontamination.contained_items(corpus.table(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_each_row_is_judged_by_its_own_text(spark):
    leak = "one two three four five six seven eight"
    data = [(1, f"before {leak} after", "en", "s", 1), (1, "the same id without it", "en", "s", 1), (None, leak, "en", "s", 1), (None, "clean", "en", "s", 1), (None, None, "en", "s", 1), (2, "", "en", "s", 1)]
    docs = corpus.table(spark, data).selectExpr("*", "1 AS item_id", "'x' AS w", "2 AS _bad")
    items = spark.createDataFrame([(0, leak)], "item_id long, text string")
    got = decontamination.clean_documents(docs, items)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text and r.doc_id) == [(1, "the same id without it")]
    assert got.count() == 4
