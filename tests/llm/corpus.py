"""Small documents tables with the awkward cases: nulls, empty and long texts, ties, repeated rows."""

import random

WORDS = ["alpha", "Beta", "gamma,", "delta", "épsilon", "ζeta", "eta.", "THETA", "iota", "kappa", "λ", "mu!", "nu"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 3, 5, 12, 13, 14, 40, 120])) for _ in range(n)]
    shared = prose(rng, 30)
    for i in range(0, n, 7):
        texts[i] = texts[i] + "\n" + shared
    for i in range(3, n, 11):
        texts[i] = texts[i - 1]
    for i in range(5, n, 13):
        w = texts[i - 2].split(" ")
        w[len(w) // 2] = "edited"
        texts[i] = " ".join(w)
    texts += ["", None, " \n\t ", "one", prose(rng, 4000), "a b  c\x0bd", "tail　 ", "..."]
    out = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(4, out[4][1], None, None, None), (4, "another text with a repeated id", "en", "s", 1), (None, "a row without an id " + shared, "en", "s", 1)]
    rng.shuffle(out)
    return out


def table(spark, data=None, **kw):
    return spark.createDataFrame(rows(**kw) if data is None else data, SCHEMA)
