import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus
from quillmeter.llm import tokenizing

BITS = ["a", "B", "é", "é", "ß", "İ", "ǆ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", " ", "　", "'s", "'LL", "12", "٣", "<|endoftext|>", "<|startoftext|>", "<|", "%%%", "日本", "🙂", "́", "#", "\x1c", "\0"]


def plain(path, texts):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_librarys_ids(name):
    path, rng = public_tokenizers.path(name), random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(40))) for _ in range(4000)] + [t or "" for _, t, *_ in corpus.rows()]
    enc = tokenizing.Encoder(path)
    from array import array

    assert [list(array(enc.typecode, x)) for x in enc.packed(texts)] == plain(path, texts)


def test_sentencepiece_counts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "one two", "é ß 日本"]
    assert tokenizing.Encoder(path).counts(texts) == [len(model.encode(t)) for t in texts]
