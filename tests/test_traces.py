"""Traces in JSON and in protobuf: the same spans give the same rows; broken bodies give none."""

import json
import struct

from pyspark.sql import functions as F

from quillmeter.operators import evidence
from quillmeter.sources import protobuf


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data if isinstance(data, bytes) else varint(number << 3) + varint(data)


ANY = {"stringValue": lambda v: field(1, v.encode()), "boolValue": lambda v: field(2, int(v)), "intValue": lambda v: field(3, int(v) & (1 << 64) - 1), "doubleValue": lambda v: varint(33) + struct.pack("<d", v), "arrayValue": lambda v: field(5, b""), "bytesValue": lambda v: field(7, b"x")}


def pairs(items):
    return [field(1, i["key"].encode()) + field(2, b"".join(ANY[k](v) for k, v in i["value"].items())) for i in items]


def wire(export):
    out = b""
    for r in export["resourceSpans"]:
        body = field(1, b"".join(field(1, p) for p in pairs(r["resource"]["attributes"])) + field(9, 7))
        for s in r["scopeSpans"]:
            spans = b""
            for p in s["spans"]:
                start = varint(57) + struct.pack("<Q", int(p["startTimeUnixNano"])) if "startTimeUnixNano" in p else b""
                spans += field(2, field(1, b"\x01" * 16) + field(5, p["name"].encode()) + start + b"".join(field(9, x) for x in pairs(p["attributes"])) + varint(15 << 3 | 5) + b"abcd")
            body += field(2, field(1, b"scope") + spans)
        out += field(1, body)
    return out


def attr(key, **value):
    return {"key": key, "value": value}


def span(*attributes, name="call", start="1900000000123456789"):
    return {"name": name, "attributes": list(attributes)} | ({"startTimeUnixNano": start} if start else {})


EXPORT = {"resourceSpans": [
    {"resource": {"attributes": [attr("session.id", stringValue="s"), attr("agent.id", stringValue="root")]}, "scopeSpans": [
        {"spans": [span(attr("request_id", intValue="-5")), span(attr("agent.id", stringValue=" own "), attr("request_id", doubleValue=1.5)), span(name="else")]},
        {"spans": [span(attr("success", boolValue=False)), span(attr("success", boolValue=True), attr("workflow.run_id", stringValue="é" * 129)), span(start=None), span(attr("session.id", stringValue=" ")), span(attr("agent.id", arrayValue={}), attr("request_id", bytesValue="00"))]},
    ]},
    {"resource": {"attributes": []}, "scopeSpans": [{"spans": [span(attr("session_id", stringValue="t"), attr("parent_agent_id", stringValue="a\nb"), attr("client_request_id", stringValue="x" * 200))]}]},
]}


def test_json_and_protobuf_give_equal_rows(spark):
    bodies = [(1, json.dumps(EXPORT).encode(), "Application/JSON"), (2, wire(EXPORT), "application/x-protobuf"), (3, wire(EXPORT), "application/octet-stream"), (4, wire(EXPORT)[:-3], "application/x-protobuf"), (5, b"{", "text/json"), (6, wire(EXPORT), "text/plain"), (7, None, "json"), (8, b"", "protobuf")]
    rows = protobuf.trace_bodies(spark.createDataFrame(bodies, "id int, body binary, kind string"), "body", F.col("kind")).drop("kind")
    got = {}
    for r in evidence.trace_owners(rows, "value", "call").collect():
        got.setdefault(r.id, []).append(tuple(r)[1:])
    assert set(got) == {1, 2, 3} and sorted(got[1]) == sorted(got[2]) == sorted(got[3])
    owners = sorted((r[1], r[2], r[4], r[6]) for r in got[1])
    assert owners == [("s", "", "root", ""), ("s", "", "root", ""), ("s", "-5", "root", ""), ("s", "1.5", "own", ""), ("t", "", "", "")]
    assert {r[7] for r in got[1]} == {"2030-03-17T17:46:40.123456789Z"}


def test_numbers_beyond_64_bits_are_no_protobuf(spark):
    rows = spark.createDataFrame([(1, b"\x08" + b"\xff" * 11), (2, b"\x08\x01")], "id int, body binary")
    assert {r.id: r.v for r in protobuf.trace_bodies(rows, "body", F.lit("protobuf")).select("id", F.to_json("value").alias("v")).collect()} == {1: None, 2: None}


def test_numbers_of_any_size_are_written_whole(spark):
    from quillmeter.plans.traces import _varint

    numbers = [0, 127, 128, 2_097_151, 2_097_152, 6_000_001, (1 << 63) - 1, -1]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", F.unhex(_varint("n")).alias("v")).collect()
    assert {r.n: bytes(r.v) for r in got} == {n: varint(n & (1 << 64) - 1) for n in numbers}
