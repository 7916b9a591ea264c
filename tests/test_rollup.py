"""Raw lines of three kinds to responses, hours and sessions."""

import json

from pyspark.sql import functions as F

from quillmeter.operators import cloud, rollup, usage


def lines(spark, rows):
    df = spark.createDataFrame([(f, i, json.dumps(v)) for f, vs in rows.items() for i, v in enumerate(vs)], "file string, ordinal long, j string")
    return df.select("file", "ordinal", F.try_parse_json("j").alias("value"))


def said(minute, message, request, output, **more):
    used = {"input_tokens": 5, "cache_read_input_tokens": 2, "cache_creation": {"ephemeral_1h_input_tokens": 3}, "output_tokens": output}
    return {"type": "assistant", "timestamp": f"2030-05-01T10:{minute:02}:00Z", "requestId": request, "message": {"id": message, "model": "m", "usage": used} | more}


def counted(minute, total, last=None, model="n"):
    shape = lambda n: {"input_tokens": n, "cached_input_tokens": n // 2, "output_tokens": 1}
    info = {"model": model, "total_token_usage": shape(total)} | ({"last_token_usage": shape(last)} if last is not None else {})
    return {"timestamp": f"2030-05-01T10:{minute:02}:00Z", "payload": {"type": "token_count", "info": info}}


def told(kind, response, cost="0.5", role="assistant"):
    return {"type": kind, "message": {"role": role, "responseId": response, "model": "p", "timestamp": 1_900_000_000_000, "usage": {"input": 1, "output": 2, "cost": {"total": cost} if cost else {}}}}


ROWS = {
    "a": [said(1, "x", "r", 1), said(2, "x", "r", 9), said(3, "y", "r", 4), said(59, None, None, 1), said(59, None, None, 1), {"type": "assistant"}, {"type": "user", "message": {"usage": {}}}],
    "b": [counted(1, 10), counted(2, 10), counted(3, 30, last=6), counted(4, 8), counted(5, 9, model=None), {"payload": {"type": "token_count", "info": None}}],
    "c": [told("message", "p1"), told("message_end", "p1"), told("message", "p2"), told("message", "p2"), told("message_end", "p2", cost=None), told("message", "p3", role="user")],
}


def test_responses_of_each_kind(spark):
    got = rollup.responses(lines(spark, ROWS)).orderBy("file", "at", "output").collect()
    first = [(r.input, r.cached, r.written, r.output) for r in got if r.source == "first"]
    assert sorted(first) == [(5, 2, 3, 1), (5, 2, 3, 1), (5, 2, 3, 4), (5, 2, 3, 9)]
    second = [(r.model, r.input, r.cached, r.output) for r in got if r.source == "second"]
    assert second == [("n", 5, 5, 1), ("n", 0, 0, 0), ("n", 3, 3, 1), ("n", 4, 4, 0), (None, 1, 0, 0)]
    third = sorted((r.input, r.output, r.pico and int(r.pico)) for r in got if r.source == "third" and r.pico is not None)
    assert third == [(1, 2, 500_000_000_000)] and sum(r.source == "third" for r in got) == 3


def test_hours_and_sessions_agree(spark):
    rows = rollup.responses(lines(spark, ROWS))
    hours = {(r.file, r.hour.hour): (r.n, r.input, r.pico) for r in rollup.hours(rows).collect()}
    assert hours == {("a", 10): (4, 20, None), ("b", 10): (4, 12, None), ("c", 17): (3, 3, None)}
    made = {r.file: r for r in rollup.sessions(rows).collect()}
    assert all(r.agrees for r in made.values()) and set(made) == {"a", "b", "c"}
    assert [(m.model, m.n, m.output) for m in made["a"].models] == [("m", 4, 15)] and made["a"].buckets[0].models[0].output == 15
    assert rollup.sessions(rows.where("false")).count() == 0


def test_lines_are_read_once_for_each_kind(spark):
    """Levels and sessions add up one reading of the responses; a response's shapes need no second one."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = rollup.responses(lines(spark, ROWS))
    for made in (rows, rollup.levels(rows), rollup.sessions(rows), rollup.hours(rows)):
        assert plan(made).count("LogicalRDD") == 3 and "Join" not in plan(made)


def test_messages_are_dealt_out_once(spark):
    rows = [(1, "a", "r", 0, "m", 1, 0, 5), (1, "a", "r", 1, "m", 1, 0, 7), (1, "b", "r", 0, None, 1, 0, 5), (1, "b", "r", 1, "", 1, 0, 5), (1, "c", "r", 0, "m", 1, 0, 5), (1, "c", "r", 1, "n", 1, 0, 5)]
    made = usage.messages(spark.createDataFrame(rows, "file long, message_id string, request_id string, ordinal long, model string, input long, cached long, output long"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert {r.message_id: r.conflict for r in made.collect()} == {"a": False, "b": False, "c": True}
    assert plan.count("Exchange hashpartitioning") <= 1 and "Expand" not in plan


def test_fields_of_a_page_are_looked_up_once(spark):
    pages = spark.createDataFrame([(1, '[{"id":"a","status":"ready","created_at":"2001-01-01T00:00:00Z","completedAt":"2000-01-01T00:00:00Z"}]')], "page long, j string").select("page", F.try_parse_json("j").alias("v"))
    made, _ = cloud.page_rows(pages, "page", "v", b"k", F.lit("2003-01-01").cast("timestamp"))
    assert [(r.lifecycle, r.created, r.completed) for r in made.collect()] == [("completed", None, None)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("$.created_at") <= 2
