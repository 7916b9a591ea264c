"""Queries of trace exports, of which ``events`` makes JSON and protobuf bodies in turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmeter.operators import evidence
from quillmeter.plans.registry import query
from quillmeter.sources import protobuf
from quillmeter.sources.tables import table

_NAME, _SESSION = "CASE WHEN event_id % 7 = 0 THEN 'other' ELSE 'llm_request' END", "CASE WHEN user_id % 11 = 0 THEN ' ' ELSE concat('s', user_id) END"
_JSON = f"""concat('{{"resourceSpans":[{{"resource":{{"attributes":[{{"key":"session.id","value":{{"stringValue":"', {_SESSION}, '"}}}},{{"key":"agent_id","value":{{"stringValue":"outer"}}}}]}},"scopeSpans":[{{"spans":[{{"name":"', {_NAME}, '","startTimeUnixNano":"', nanos,
'","attributes":[{{"key":"request_id","value":{{"intValue":"', event_id, '"}}}},{{"key":"success","value":{{"boolValue":', CASE WHEN event_id % 10 = 0 THEN 'false' ELSE 'true' END, '}}}},{{"key":"agent_id","value":{{"stringValue":"', event_type, '"}}}}]}}]}}]}}]}}')"""


def _varint(n: str) -> Column:
    """A column of whole numbers of 64 bits in hexadecimal digits, seven bits to a byte, from the lowest on."""
    more = f"CASE WHEN i < 9 AND shiftrightunsigned({n}, 7 * i + 7) <> 0 THEN 128 ELSE 0 END"
    byte = f"lpad(hex((shiftrightunsigned({n}, 7 * i) & 127) + {more}), 2, '0')"
    return F.expr(f"array_join(transform(filter(sequence(0, 9), i -> i = 0 OR shiftrightunsigned({n}, 7 * i) <> 0), i -> {byte}), '')")


def _size(data: Column) -> Column:
    """A length below 16,384 in hexadecimal digits, seven bits to a byte."""
    n = (F.length(data) / 2).cast("int")
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    return F.when(n < 128, byte(n)).otherwise(F.concat(byte(n % 128 + 128), byte(F.floor(n / 128))))


def _held(number: int, data: Column) -> Column:
    """A field that holds a text or a message, in hexadecimal digits."""
    return F.concat(F.lit(f"{number << 3 | 2:02X}"), _size(data), data)


def _said(number: int, text: Column) -> Column:
    return _held(number, F.hex(F.encode(text, "UTF-8")))


def _pair(key: str, value: Column) -> Column:
    return F.concat(_said(1, F.lit(key)), _held(2, value))


def _protobuf(rows):
    """Adds ``wire``: the same export in protobuf, put together from the inside."""
    flag = F.concat(F.lit("10"), F.when(F.col("event_id") % 10 == 0, "00").otherwise("01"))
    number = F.concat(F.lit("18"), _varint("event_id"))
    nanos = F.lpad(F.hex(F.col("nanos")), 16, "0")
    start = F.concat(F.lit("39"), *[F.substr(nanos, F.lit(i), F.lit(2)) for i in range(15, 0, -2)])
    rows = rows.withColumns({"_a": _pair("session.id", _said(1, F.expr(_SESSION))), "_b": _pair("agent_id", _said(1, F.lit("outer"))), "_c": _pair("request_id", number), "_d": _pair("success", flag), "_e": _pair("agent_id", _said(1, F.col("event_type")))})
    rows = rows.withColumns({"_own": F.concat(_held(1, F.col("_a")), _held(1, F.col("_b"))), "_span": F.concat(_said(5, F.expr(_NAME)), start, *[_held(9, F.col(c)) for c in ("_c", "_d", "_e")])})
    rows = rows.withColumn("_scope", _held(2, F.col("_span")))
    rows = rows.withColumn("_res", F.concat(_held(1, F.col("_own")), _held(2, F.col("_scope"))))
    return rows.withColumn("wire", F.unhex(_held(1, F.col("_res"))))


@query("""SELECT event_id, 's' || user_id AS session, event_id::VARCHAR AS request, event_type AS agent, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS second FROM events WHERE event_id % 7 > 0 AND event_id % 10 > 0 AND user_id % 11 > 0 AND event_id % 23 > 0""")
def trace_owners(spark, sf):
    rows = table(spark, sf, "events").withColumn("nanos", F.unix_micros(F.date_trunc("second", F.col("ts").cast("timestamp"))) * 1000)
    odd = F.col("event_id") % 23 == 0
    content = F.when(odd, F.unhex(F.lit("0AFF01"))).when(F.col("event_id") % 2 == 0, F.encode(F.expr(_JSON), "UTF-8")).otherwise(F.col("wire"))
    kind = F.when((F.col("event_id") % 2 == 0) & ~odd, "application/json; charset=utf-8").otherwise("application/x-protobuf")
    bodies = _protobuf(rows).select("event_id", content.alias("content"), kind.alias("kind"))
    found = evidence.trace_owners(protobuf.trace_bodies(bodies, "content", F.col("kind")).drop("kind"), "value", "llm_request")
    second = F.date_format(F.to_timestamp("observed"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return found.select("event_id", "session", "request", "agent", second.alias("second"))
