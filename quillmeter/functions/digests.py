"""Keyed hashes, framed digests and canonical JSON, as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pad(key: bytes, fill: int) -> Column:
    return F.unhex(F.lit(bytes(b ^ fill for b in key.ljust(_BLOCK, b"\0")).hex()))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in hex of a text's UTF-8 by two built-in digests; keys of up to 64 bytes. Null for null."""
    if len(key) > _BLOCK:
        raise ValueError("a key has at most 64 bytes")
    inner = F.unhex(F.sha2(F.concat(_pad(key, 0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(_pad(key, 0x5C), inner), 256)


def ended(*parts: Column) -> Column:
    """SHA-256 in hex of texts that each end with a zero byte; null if one is null."""
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(*[x for p in parts for x in (p.cast("binary"), zero)]), 256)


def billing_identity(provider: Column, kind: Column, value: Column) -> Column:
    """SHA-256 of ``provider:kind:value`` in lower case without outer blanks; null if the value is blank."""
    low = lambda c: F.translate(F.trim(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.trim(value) != "", F.sha2(F.concat(low(provider), F.lit(":"), low(kind), F.lit(":"), low(value)), 256))


def account_identity(provider: Column, account: Column, organization: Column, mail: Column) -> Column:
    """The identity of the first that is named: account, then organization, then mail address; empty if none is."""
    each = ((F.lit("account"), account), (F.lit("organization"), organization), (F.lit("email"), mail))
    return F.coalesce(*[billing_identity(provider, k, v) for k, v in each], F.lit(""))


def evidence_ref(domain: str, *parts: Column) -> Column:
    """``sha256:`` and the digest of a domain and parts with zero bytes between them."""
    zero = F.unhex(F.lit("00"))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(domain).cast("binary"), *[x for p in parts for x in (zero, p.cast("binary"))]), 256))


def framed(parts: list[Column], width: int = 8) -> Column:
    """Bytes of texts, each after its length as a big-endian number of ``width`` bytes: no two lists look the same."""
    frame = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 2 * width, "0")), c.cast("binary"))
    return reduce(lambda a, b: F.concat(a, b), [frame(F.coalesce(p, F.lit(""))) for p in parts])


def framed_set_digest(values: Column, width: int = 8) -> Column:
    """SHA-256 in hex of an array's sorted distinct texts, framed: the same for any order and repetition."""
    frame = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 2 * width, "0")), c.cast("binary"))
    return F.sha2(F.aggregate(F.array_sort(F.array_distinct(F.array_compact(values))), F.lit("").cast("binary"), lambda acc, x: F.concat(acc, frame(x))), 256)


def canonical_json(json: Column) -> Column:
    """JSON text with keys in order and without blanks, at every depth; null for other texts and for repeated keys.

    VARIANT keeps the keys of an object in their order, so its text is canonical for objects, arrays, texts and integers.
    """
    return F.to_json(F.try_parse_json(json))
