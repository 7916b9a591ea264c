import math
import random
from collections import Counter

import pyspark.sql.functions as F

import corpus
from quillmeter.llm import language

SYL = {"aa": ["tion", "the", "ing", "er"], "bb": ["ung", "sch", "keit", "ö"], "cc": ["eau", "é", "que", "oi"]}


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYL))
        out.append((i, " ".join("".join(rng.choice(SYL[lang]) for _ in range(3)) for _ in range(rng.randrange(2, 30))), lang, "s", 1))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    data = made(300, 1) + [(900, None, "aa", "s", 1), (901, "123 !", "aa", "s", 1), (902, "", None, "s", 1), (None, "tionthe the", "aa", "s", 1)]
    docs = corpus.table(spark, data)
    model = language.train(docs, F.col("doc_id") % 4 != 2)
    assert model[0] == ["aa", "bb", "cc"]
    rows = language.predict(docs.withColumn("score", F.lit(1)), model).collect()
    assert len(rows) == len(data)
    good = [r.lang_pred == r.lang for r in rows if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 4 == 2]
    assert sum(good) / len(good) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in rows)


def test_empty(spark):
    docs = corpus.table(spark, [])
    model = language.train(docs, F.lit(True))
    assert language.predict(docs, model).count() == 0
    assert language.predict(corpus.table(spark, made(2, 1)), model).first().lang_pred == "und"


def brute_features(text):
    s = f" {text.lower()} " + "\0" * (language.LONGEST - 1)
    out = []
    for i in range(len(s) - language.LONGEST + 1):
        h = 0
        for k in range(language.LONGEST):
            h = (h + ord(s[i + k]) + k + 1) * 0x9E3779B1 % 2**32
            out.append((h ^ (h >> 15)) >> 16)
    return Counter(out)


def brute_nb(learn, texts):
    """Posterior and language by plain naive Bayes over dictionaries."""
    langs = sorted({x for _, x in learn})
    count = {x: Counter() for x in langs}
    for t, x in learn:
        count[x] += brute_features(t)
    prior = Counter(x for _, x in learn)
    out = []
    for t in texts:
        total = [math.log(prior[x] / len(learn)) for x in langs]
        for f, n in brute_features(t).items():
            for j, x in enumerate(langs):
                total[j] += n * math.log((count[x][f] + language.ADDED) / (sum(count[x].values()) + language.ADDED * language.FEATURES))
        out.append((langs[total.index(max(total))], 1 / sum(math.exp(v - max(total)) for v in total)))
    return out


def test_matches_brute_force_at_any_block(spark, monkeypatch):
    data = made(60, 3)
    data += [(i + 100, t[: 1 + i % 9], x, "s", 1) for i, (_, t, x, _, _) in enumerate(data)]  # short ones, unsure
    docs = corpus.table(spark, data)
    want = {i: w for (i, *_), w in zip(data, brute_nb([(t, x) for i, t, x, *_ in data if i % 4 != 2], [t for _, t, *_ in data]), strict=True)}
    for block in (language.BLOCK, 7):
        monkeypatch.setattr(language, "BLOCK", block)
        rows = language.predict(docs, language.train(docs, F.col("doc_id") % 4 != 2)).collect()
        assert all(r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-4 for r in rows)


def test_a_score_does_not_depend_on_other_rows(spark):
    docs = corpus.table(spark, made(80, 5))
    model = language.train(docs, F.lit(True))
    text = "erer ung e"
    alone = language.predict(corpus.table(spark, [(1, text, "x", "s", 1)]), model).first().score
    for others in (["zz"], ["qq", text], ["the " * 50, "eau", text, "1"]):
        for place in range(len(others) + 1):
            data = [*others[:place], text, *others[place:]]
            rows = language.predict(corpus.table(spark, [(i, t, "x", "s", 1) for i, t in enumerate(data)]).coalesce(1), model).collect()
            assert {r.score for r in rows if r.text == text} == {alone}


def test_many_languages_and_repeated_rows(spark):
    data = [(i % 50, f"word{i}x " * 5, f"lang{i % 150:03}", "s", 1) for i in range(300)]
    docs = corpus.table(spark, data).coalesce(1)
    langs, table = language.train(docs, F.lit(True))
    assert len(langs) == 150 and table.shape == (language.FEATURES + 1, 150)
    rows = language.predict(docs.select("doc_id", "text", F.lit("mine").alias("lang_pred")), (langs, table), made=("l", "p")).collect()
    assert len(rows) == 300 and {r.lang_pred for r in rows} == {"mine"} and {r.l for r in rows} <= set(langs)
