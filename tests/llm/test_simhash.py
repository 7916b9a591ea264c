import random
import re

import xxhash
from pyspark.sql import functions as F

import corpus
from quillmeter.llm import simhash
from quillmeter.llm.components import connected_components


def brute_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(data):
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in data]
    nodes = sorted({f for _, f in fps})
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(nodes):
        for g in nodes[:i]:
            if (f ^ g).bit_count() <= 2:
                root[find(f)] = find(g)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in fps), key=str)


def test_groups_match_brute_force(spark):
    data = corpus.rows()
    got = simhash.simhash_groups(corpus.table(spark, data)).drop("n_same")
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(data)


def test_pairs_lose_nothing(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for f in base:
        for _ in range(12):
            g = f
            for _ in range(rng.randrange(1, 4)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 63), (1 << 63) | 1, 0x11, 0x12}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for far in (0, 1, 2):
        got = [tuple(r) for r in simhash.linked_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), far).collect()]
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= far}
        assert len(got) == len(set(got)) and set(got) == want


def test_empty_and_clashing_columns(spark):
    assert simhash.simhash_groups(corpus.table(spark, [])).count() == 0
    data = [(1, "a b c d", "x", "y", 1), (2, "a b c d", "x", "y", 1)]
    docs = corpus.table(spark, data).selectExpr("doc_id", "text", "1 AS fp", "2 AS rep", "3 AS u", "4 AS d0", "5 AS cell")
    assert {r.component_id for r in simhash.simhash_groups(docs).collect()} == {1}


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))


def near_groups(rows):
    """The smallest id of each group of texts that a five-word Jaccard similarity of 0.8 or more connects."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(least.values())


def test_near_copies_meet_beyond_two_bits(spark):
    rng = random.Random(3)
    data, i = [], 0
    for _ in range(30):
        w = corpus.prose(rng, rng.choice([6, 25, 80, 300])).split()
        for edits in range(6):  # a chain of edits: each is near the one before
            data.append((i, " ".join(w), "en", "s", 1))
            w[rng.randrange(len(w))] = f"edit{i}"
            i += 1
    data += [(i + k, t, "en", "s", 1) for k, t in enumerate(["", None, " ", "one", "ONE", "two"])]
    rng.shuffle(data)
    want = near_groups(data)
    got = [r.doc_id for r in simhash.one_of_each_group(corpus.table(spark, data)).collect()]
    assert 30 < len(want) < len(data) - 40
    assert sorted(got) == want


def test_components_of_a_long_chain(spark):
    nodes = list(range(120))
    random.Random(6).shuffle(nodes)
    edges = [*zip(nodes, nodes[1:], strict=False), (500, 501), (501, 502), (502, 500), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(120), 0) | {500: 500, 501: 500, 502: 500}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_that_no_star_forms(spark, monkeypatch):
    """Every pair with the similarity counts, whether or not a first or last member of a group has a part in it."""
    rng, rows = random.Random(5), []
    for g in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(10 * g + k, " ".join([*words, *(f"x{g}y{k}z{i}" for i in range(5))]), "en", "s", 1) for k in range(4)]
    rows += [(90 + k, " ".join(f"v{k}u{i}" for i in range(40)), "en", "s", 1) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(simhash, "_stars", lambda rows, group, similarity: rows.where("false").select(F.col("c").alias("u"), F.col("c").alias("v")))
    got = sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect())
    assert got == sorted(near_groups(rows)) == [*range(0, 60, 10), 90, 91, 92]


def test_texts_with_a_common_passage_are_ruled_out_by_counts(spark, monkeypatch):
    """Texts that share a passage meet, but those below the similarity aren't compared, and none above it is lost."""
    rng, rows = random.Random(8), []
    passage = " ".join(f"p{i}" for i in range(14))
    for g in range(30):
        own = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows.append((2 * g, " ".join([*own, passage]), "en", "s", 1))
        if g < 3:
            rows.append((2 * g + 1, " ".join([*own, passage, f"x{g}"]), "en", "s", 1))
    docs, seen, verified = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), [], simhash._verified
    monkeypatch.setattr(simhash, "_stars", lambda rows, group, similarity: rows.where("false").select(F.col("c").alias("u"), F.col("c").alias("v")))
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: seen.append(pairs.count()) or verified(pairs, *a))
    for frequent in (127, 20):  # the passage's shingles are in their place, then behind all others
        monkeypatch.setattr(simhash, "FREQUENT", frequent)
        seen.clear()
        got = sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect())
        assert got == sorted(near_groups(rows)) == [2 * g for g in range(30)]
        assert sum(seen) == 3


def test_shingles_that_come_once_meet_nothing(spark):
    """Texts of which a fifth comes once have no pair, whatever passage they share; a repeated text keeps its first shingles."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, " ".join([passage, *(f"w{k}x{i}" for i in range(20))]), "en", "s", 1) for k in range(8)]
    rows += [(50 + k, " ".join([*(f"v{i}" for i in range(60)), f"u{k}"]), "en", "s", 1) for k in range(2)]
    docs = corpus.table(spark, rows)
    found = {r.doc_id: len(r.least) for r in simhash.sketches(docs.select(F.col("doc_id").alias("key"), "doc_id", "text")).collect()}
    assert {found[k] for k in range(8)} == {0} and found[50] == found[51] > 0
    assert sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect()) == near_groups(rows) == [*range(8), 50]


def test_texts_that_surely_stay_are_not_dealt_out(spark, monkeypatch):
    """Only rows that go or come again meet the kept keys; all others pass where they are read."""
    rng = random.Random(12)
    rows = [(i, corpus.prose(rng, 60), "en", "s", 1) for i in range(30)]
    rows += [rows[3], rows[3], (40, rows[5][1], "en", "s", 1), (41, rows[6][1] + " more", "en", "s", 1), (None, rows[7][1], "en", "s", 1), (None, "alone", "en", "s", 1)]
    docs, seen, parted = corpus.table(spark, rows), [], simhash.parted
    monkeypatch.setattr(simhash, "parted", lambda *a: seen.append([x.count() for x in parted(*a)]) or parted(*a))
    got = simhash.one_of_each_group(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r[0], r[1]) for r in [*rows[:30], rows[-1]]), key=str)
    assert seen == [[30, 6]]  # the row that comes three times and three that go
