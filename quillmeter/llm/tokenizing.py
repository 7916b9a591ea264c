"""Tokenizers inside tasks. Encoding a text piece by piece gives the library's ids with each distinct piece encoded once."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex

#: Distinct pieces that a worker remembers; beyond it forgets all and begins anew. Bounds memory, not results.
REMEMBERED = 500_000

#: Pieces end where white space follows other text. White space beyond these four is left to the library.
_SPACED = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Characters whose kind, case and composition no Unicode version or library treats differently.
_COMMON = re.compile("[ \n\t\r]*[!-~\xa1-\u012f\u0131-\u017f]*")
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def version(path: str) -> str:
    """Digest of what decides the counts: the vocabulary file and the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    import importlib.metadata

    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode() + f.read()).hexdigest()


@lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    """The encoder for a file, one in each Python worker."""
    return Encoder(path)


class _Memory(dict):
    """Ids by piece; a piece that isn't there is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = self.encode(piece)
        return ids


class Encoder:
    """Ids of texts as packed unsigned integers, without added special tokens, truncation or padding.

    A text is cut at white space where the vocabulary's own rules never join across it, and each distinct piece is
    encoded once and remembered. A new piece of common Latin characters is split by the vocabulary's pattern and each
    part goes to the library's merge model alone; any other piece goes through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memory = _Memory(self._piece)
        self.parts: dict[str, bytes] = {}
        self.cut = self.split = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.typecode = "H" if model.get_piece_size() <= 1 << 16 else "I"
            self._encode = lambda texts: model.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        self.typecode = "H" if whole.get_vocab_size() <= 1 << 16 else "I"
        self._encode = lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
        self._merge = whole.model.tokenize
        with open(path) as f:
            self.cut, self.split = _rules(json.load(f))

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            ids = self.parts[part] = array(self.typecode, [t.id for t in self._merge(part.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
        return ids

    def _piece(self, piece: str) -> bytes:
        if _COMMON.fullmatch(piece) and "<|" not in piece:
            return b"".join(map(self._part, self.split(piece)))
        return array(self.typecode, self._encode([piece])[0]).tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as machine integers of ``typecode`` one after the other."""
        cut = [self.cut(t) if self.cut else None for t in texts]
        whole = iter(self._encode([t for t, c in zip(texts, cut, strict=True) if c is None]))
        get = self.memory.__getitem__
        return [array(self.typecode, next(whole)).tobytes() if c is None else b"".join(map(get, c)) for c in cut]

    def counts(self, texts: list[str]) -> list[int]:
        size = array(self.typecode).itemsize
        return [len(x) // size for x in self.packed(texts)]


#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _rules(config: dict):
    """How texts may be cut so that the pieces' ids, one after the other, are the text's; how a piece splits further.

    Special tokens are found first, so they must hold no white space, start with "<|" and ignore their surroundings.
    With a byte-level pattern, tokens never cross from other text into white space. Where white space is dropped and
    only words are kept, texts may be cut at ASCII white space, which normalisation doesn't join to anything. Other
    vocabularies get (None, None): whole texts go to the library.
    """
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and re.fullmatch(r"<\|\S*", t["content"]) for t in config["added_tokens"])
    norm, pre = config["normalizer"] or {}, config["pre_tokenizer"] or {}
    if not plain or config["model"]["type"] != "BPE" or config["model"].get("dropout"):
        return None, None
    if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # fixed by this kind
        return (lambda text: None if _OTHER_SPACE.search(text) else _SPACED.findall(text)), pattern.findall
    steps = [n.get("type") for n in norm.get("normalizers", [])]
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} in norm.get("normalizers", [])  # any other replacement may join words
    kinds = pre.get("pretokenizers") or [{}]
    drops = kinds[0].get("type") == "Split" and kinds[0].get("invert") and kinds[0].get("behavior") == "Removed"
    if drops and [k.get("type") for k in kinds[1:]] == ["ByteLevel"] and not kinds[1]["use_regex"] and not kinds[1]["add_prefix_space"] and steps == ["NFC", "Replace", "Lowercase"] and blanks:
        pattern = regex.compile(kinds[0]["pattern"]["Regex"])
        return _ascii_cut, lambda piece: pattern.findall(piece.lower())
    return None, None


def _ascii_cut(text: str) -> list[str]:
    return text.split() if text.isascii() and not _OTHER_SPACE.search(text) else [w.decode() for w in text.encode().split()]
