"""Canonical JSON of whole numbers: keys in the order of their UTF-16 units, no blanks; a fraction is a fault with its place."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LEAST, _MOST = -(1 << 63), (1 << 64) - 1


class _Odd:
    """A number that is no whole one of 64 bits, or no number of JSON at all."""

    def __init__(self, said: str):
        self.said = said


def _number(said: str) -> int | _Odd:
    value = int(said) if len(said) <= 20 else None
    return value if value is not None and _LEAST <= value <= _MOST else _Odd(said)


def _refused(said: str):
    raise ValueError(said)


def _parts(value, pointer: str) -> Iterator[str]:
    if isinstance(value, _Odd):
        raise _Fault(pointer or "/")
    if isinstance(value, dict):
        opening = "{"
        for key in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass")):
            yield f"{opening}{json.dumps(key, ensure_ascii=False)}:"
            yield from _parts(value[key], f"{pointer}/{key.replace('~', '~0').replace('/', '~1')}")
            opening = ","
        yield "{}" if opening == "{" else "}"
    elif isinstance(value, list):
        opening = "["
        for i, item in enumerate(value):
            yield opening
            yield from _parts(item, f"{pointer}/{i}")
            opening = ","
        yield "[]" if opening == "[" else "]"
    else:
        yield json.dumps(value, ensure_ascii=False)


class _Fault(Exception):
    pass


def canonicalised(text: str | None) -> tuple[str | None, str | None]:
    """(canonical text, fault): the fault is ``malformed``, or the JSON pointer of the first number that is no whole one of 64 bits.

    First in the order of the canonical text; ``/`` if the text is that number. Of repeated keys the last one counts.
    """
    if text is None:
        return None, None
    try:
        value = json.loads(text, parse_float=_Odd, parse_int=_number, parse_constant=_refused)
        written = "".join(_parts(value, ""))
        written.encode()  # a lone surrogate is no text
    except _Fault as fault:
        return None, str(fault)
    except (ValueError, RecursionError):
        return None, "malformed"
    return written, None


def strict(text: Column) -> Column:
    """Struct (canonical, fault) of a JSON text, in Arrow batches: VARIANT can't tell ``1.0`` from a whole number."""

    @F.pandas_udf("canonical string, fault string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([canonicalised(t) for t in texts], columns=["canonical", "fault"], dtype=object)

    return run(text)
