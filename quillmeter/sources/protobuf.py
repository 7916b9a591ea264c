"""Trace exports in protobuf's wire format as the JSON that the same exports have: a body becomes a text in its task.

Numbers of fields are those of the public trace protocol; fields that no reader needs are passed over by their lengths.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of each message, its fields by number with the JSON name, what it holds, and whether it repeats.
MESSAGES = {
    "export": {1: ("resourceSpans", "resource_spans", True)},
    "resource_spans": {1: ("resource", "resource", False), 2: ("scopeSpans", "scope_spans", True)},
    "resource": {1: ("attributes", "pair", True)},
    "scope_spans": {2: ("spans", "span", True)},
    "span": {1: ("traceId", "hex", False), 2: ("spanId", "hex", False), 4: ("parentSpanId", "hex", False), 5: ("name", "text", False), 7: ("startTimeUnixNano", "number", False), 8: ("endTimeUnixNano", "number", False), 9: ("attributes", "pair", True)},
    "pair": {1: ("key", "text", False), 2: ("value", "any", False)},
    "any": {1: ("stringValue", "text", False), 2: ("boolValue", "flag", False), 3: ("intValue", "signed", False), 4: ("doubleValue", "double", False), 5: ("arrayValue", "none", False), 6: ("kvlistValue", "none", False), 7: ("bytesValue", "none", False)},
}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at
        if shift > 63:
            raise ValueError("a number of more than 64 bits")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: whole numbers, or the bytes of the others."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at) if kind == 2 else (-1, at)
            if size < 0 or at + size > len(data):
                raise ValueError("a field beyond the message")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _value(held: str, raw: int | bytes):
    if held in MESSAGES:
        return decoded(raw, held)
    if held == "text":
        return raw.decode()
    if held == "hex":
        return raw.hex()
    if held == "number":
        return str(struct.unpack("<Q", raw)[0])
    if held == "double":
        return struct.unpack("<d", raw)[0]
    if held == "flag":
        return bool(raw)
    return str(raw - (1 << 64) if raw >> 63 else raw) if held == "signed" else {}


def decoded(data: bytes, message: str = "export") -> dict:
    """A message as JSON has it: whole numbers of 64 bits are texts, the last one of a field that doesn't repeat counts."""
    if not isinstance(data, bytes):
        raise ValueError("a number where a message is due")
    known, out = MESSAGES[message], {}
    for number, raw in _fields(data):
        if number in known:
            name, held, repeats = known[number]
            value = _value(held, raw)
            if repeats:
                out.setdefault(name, []).append(value)
            else:
                if message == "any":
                    out.clear()  # one of its fields alone
                out[name] = value
    return out


def trace_bodies(bodies: DataFrame, content: str, kind: Column) -> DataFrame:
    """Adds ``value``: a body as VARIANT, of JSON or protobuf as its content type says; null for a body that is neither or broken."""
    by = [c for c in bodies.columns if c != content]
    low = F.lower(kind)
    form = F.when(low.contains("json"), "json").when(low.contains("protobuf") | low.contains("octet-stream"), "protobuf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for form_, data in zip(batch.column("_form").to_pylist(), batch.column("_data").to_pylist(), strict=True):
                try:
                    out.append(None if form_ is None or data is None else data.decode() if form_ == "json" else json.dumps(decoded(data), allow_nan=False))
                except Exception:  # noqa: BLE001  a body that doesn't keep to the format
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(out, pa.string())], [*by, "_written"])

    rows = bodies.select(*by, form.alias("_form"), F.col(content).cast("binary").alias("_data"))
    schema = ", ".join([*(f"`{c}` {bodies.schema[c].dataType.simpleString()}" for c in by), "_written string"])
    return rows.mapInArrow(run, schema).select(*by, F.try_parse_json("_written").alias("value"))
