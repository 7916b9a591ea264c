import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus
from quillmeter.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NONE = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printed)}
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {c: b for b, c in chars.items()}


def groups(text, libraries):
    """Groups of (A ids, B ids) of a text by the libraries alone, one token after the other."""
    a, b, byte = libraries
    e = a.encode(" " + text, add_special_tokens=False)
    tokens_a = [(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    tokens_b = [(i, bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    if b"".join(t for _, t in tokens_a) != whole or b"".join(t for _, t in tokens_b) != whole:
        return None
    out, x, y, i, j, ids = [], 0, 0, 0, 0, ([], [])
    while i < len(tokens_a) or j < len(tokens_b):
        if x <= y and i < len(tokens_a):
            ids[0].append(tokens_a[i][0])
            x += len(tokens_a[i][1])
            i += 1
        else:
            ids[1].append(tokens_b[j][0])
            y += len(tokens_b[j][1])
            j += 1
        if x == y and ids[1]:
            out.append(ids)
            ids = ([], [])
    return out


def brute(data, libraries):
    found = [(i, groups(t, libraries) if t else None) for i, t, *_ in data]
    links = [[(p, q) for a, b in g for p in a for q in b] if g else [] for _, g in found]
    count = Counter(pair for each in links for pair in set(each))
    top = {}
    for (p, _), n in count.items():
        top[p] = max(n, top.get(p, 0))
    out = []
    for (i, g), own in zip(found, links, strict=True):
        if not g:
            out.append((i, *NONE))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(count[x] == top[x[0]] for x in own)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), best, sum(count[x] for x in own), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def longs(x):
    return np.array(x, np.int64)


def run(spark, data):
    return sorted(map(tuple, alignment.align(corpus.table(spark, data), A, B).collect()), key=str)


def odd_rows(n=300):
    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "\t", "\r", "\r\n", ";\r", "it's", "▁", "é", "漢字", "🙂", "　", "\xa0", "<|endoftext|>", "<s>", "<0x41>", "\x00", "á", "ﬁ", "①", "12345", "...", "Å", "\x85", "ééé"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25))), "en", "s", 1) for i in range(n)]


def test_matches_the_libraries(spark, libraries):
    data = corpus.rows()
    assert run(spark, data) == brute(data, libraries)


def test_odd_characters(spark, libraries):
    data = odd_rows()
    want = brute(data, libraries)
    assert run(spark, data) == want
    assert 50 < sum(r[1:] == NONE for r in want) < 280


def test_small_blocks_and_chunks(spark, libraries, monkeypatch):
    """Several blocks in a task, units encoded two at a time, few links at once: the same rows."""
    for name, value in (("BLOCK_BYTES", 1), ("CHUNK_BYTES", 9), ("EXPANDED", 3), ("SALTS", 2)):
        monkeypatch.setattr(alignment, name, value)
    v, texts = alignment.load(A, B), ["alpha beta beta", "zzzzzzqqqq wrtgh", "ééé 漢字漢字 🙂"]
    for text in texts:
        units = v.units(" " + text)
        want = ["".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";" for a, b in g) for g in _by_unit(text, units, libraries)]
        assert [x.decode() for x in alignment.Units(units, v).text] == want
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts * 3)]
    assert run(spark, data) == brute(data, libraries)


@pytest.mark.parametrize("large", [0, 256])
def test_large_groups(spark, libraries, monkeypatch, large):
    """Repeated ids of a large group are counted before they are paired; a group of a long word without common cuts."""
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    data = [(i, t, "en", "s", 1) for i, t in enumerate(["𝔘𝔫𝔦 " * 40, "qzqzqzqzqzqzqz" * 30, "one", "ᚠᚢᚦ" * 50])] + corpus.rows(n=10)
    assert run(spark, data) == brute(data, libraries)


def test_repeats_are_counted_before_they_are_paired():
    rows = alignment._links(longs([0] * 1000), longs([7] * 1000), longs([0] * 501), longs([3] * 500 + [4]), 1)
    assert [x.tolist() for x in rows] == [[0, 0], [7 << 32 | 3, 7 << 32 | 4], [500_000, 1000]]


def _by_unit(text, units, libraries):
    """The groups of each unit: groups never cross units, so whole groups are dealt out by their bytes."""
    a, _, byte = libraries
    left, out = groups(text, libraries), []
    for u in units:
        own, size = [], len(u.encode())
        while size:
            g = left.pop(0)
            size -= sum(len(a.id_to_token(i)) for i in g[0])
            own.append(g)
        out.append(own)
    return out


def test_empty_and_clashing_columns(spark, libraries):
    assert run(spark, []) == []
    data = [(1, "a b", "x", "y", 1), (None, None, "x", "y", 1), (1, "a b", "x", "y", 1)]
    docs = corpus.table(spark, data).selectExpr("doc_id", "text", "1 AS block", "2 AS pair", "3 AS kind", "4 AS n")
    assert sorted(map(tuple, alignment.align(docs, A, B).collect()), key=str) == brute(data, libraries)
