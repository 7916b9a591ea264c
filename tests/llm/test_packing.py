import zlib
from array import array

import public_tokenizers

import corpus
from quillmeter.llm import packing
from test_tokenizing import plain

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_cover_all_tokens(spark):
    data = corpus.rows()
    rows = packing.pack(corpus.table(spark, data).repartition(5), PATH, window=64).collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for k, parts in seqs.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at and n > 0
            at += n
        assert at == 64 or k == len(seqs) - 1
    ids = [x + [1] for x in plain(PATH, [t or "" for _, t, *_ in data])]
    assert sum(map(len, ids)) == sum(r.length for r in rows)
    known = {}
    for (i, *_), x in zip(data, ids, strict=True):
        known.setdefault((i, len(x)), []).append(x)
    for r in rows:
        crcs = {zlib.crc32(array("I", x[r.start : r.start + r.length]).tobytes()) for x in known[r.doc_id, r.doc_tokens]}
        assert r.ids_crc32 in crcs


def test_empty_and_clashing_columns(spark):
    assert packing.pack(corpus.table(spark, []), PATH).count() == 0
    docs = corpus.table(spark, [(1, None, "x", "y", 1)]).selectExpr("doc_id", "text", "1 AS part", "2 AS ids", "3 AS n")
    assert [r.length for r in packing.pack(docs, PATH).collect()] == [1]
