import hashlib

import numpy as np
import pyarrow as pa
import xxhash

import corpus
from quillmeter.llm import fingerprints as fp
from quillmeter.llm.wordhash import Words


def sig(text):
    return fp.signature(Words(pa.array([text], pa.string())).hashes)


def test_packing_round_trip_and_equal_texts():
    s = sig("a b c d e f g")
    assert (fp.unpacked(fp.packed(s)) == s).all() and (sig("a  b c d e f\ng") == s).all()
    assert fp.likeness(sig(""), sig(" \n")) == 1 and fp.likeness(sig(""), s) < 0.2


def test_likeness_is_near_jaccard():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.3, 0.6, 0.9):
        diffs = []
        for size in (8, 40, 400, 3000):
            both = [f"w{x}" for x in rng.integers(0, 10**9, int(size * share) + 5)]
            a, b = ([f"w{x}" for x in rng.integers(0, 10**9, size - int(size * share) + 5)] for _ in "ab")
            x, y = both + a, both + b
            grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x, y)]
            diffs.append(fp.likeness(sig(" ".join(x)), sig(" ".join(y))) - len(grams[0] & grams[1]) / len(grams[0] | grams[1]))
        assert max(map(abs, diffs[1:])) < 0.12 and abs(diffs[0]) < 0.35


def test_next_and_edited_match_brute_force(spark):
    data = [r for r in corpus.rows() if r[0] not in (None, 4)]
    data.sort(key=lambda r: -r[0])
    want = []
    for r, nxt in zip(data, data[1:] + data[:1], strict=True):
        t, u = r[1] or "", nxt[1] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), fp.packed(sig(t)), fp.packed(sig(e)), fp.likeness(sig(t), sig(e)), fp.likeness(sig(t), sig(u))))
    got = sorted(map(tuple, fp.fingerprint_pairs(corpus.table(spark, data[::-1])).collect()), reverse=True)
    assert got == want


def test_awkward_rows(spark):
    assert fp.fingerprint_pairs(corpus.table(spark, [])).count() == 0
    assert fp.fingerprint_pairs(corpus.table(spark)).count() == len(corpus.rows())
    one = corpus.table(spark, [(5, "a b c d", "x", "y", 1)]).selectExpr("doc_id", "text", "1 AS ord", "2 AS bucket", "3 AS kind")
    assert [r.near_next for r in fp.fingerprint_pairs(one).collect()] == [1.0]


MASK = 2**64 - 1


def mix(h):
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & MASK
    return h ^ h >> 32


def brute_signature(text):
    """Bins, densification and bits by plain numbers, a word and a shingle at a time."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words = [mix(sum(xxhash.xxh64_intdigest(bytes([b]), 42) * pow(0xBF58476D1CE4E5B9, i, 2**64) for i, b in enumerate(w)) & MASK) for w in low.split()]
    size = min(5, len(words))
    shingles = set()
    for i in range(len(words) - size + 1 if words else 0):
        h = words[i]
        for x in words[i + 1 : i + size]:
            h = (h * 0x9E3779B97F4A7C15 + x) & MASK
        shingles.add(mix(h))
    shingles = shingles or {mix(1)}
    least = {}
    for h in shingles:
        least[h >> 55] = min(least.get(h >> 55, h), h)
    out = []
    for b in range(512):
        source, t = b, 0
        while source not in least:
            source = mix((t * 512 + b + 1) * 0x9E3779B97F4A7C15 & MASK) % 512
            t += 1
        out.append(mix((least[source] + (b + 1) * 0xD1B54A32D192ED03) & MASK) & 15)
    return out


def test_signatures_match_plain_numbers():
    rng = np.random.default_rng(9)
    texts = ["", " \n", "One", "a b", "Grüße an ALLE Welt und mehr", *(" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (4, 5, 6, 40, 900))]
    for text in texts:
        assert fp.signature(Words(pa.array([text], pa.string()), lower=True).hashes).tolist() == brute_signature(text)
