"""Queries over pages of remote tasks, made from all ``orders``: runs of 16 and of 24 orders are pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.operators import cloud
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

_KEY = b"cloud-key"
_IN, _OUT = (bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
_STATUS = "CASE o_orderkey % 7 WHEN 0 THEN 'Pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'applied' WHEN 3 THEN 'Error' WHEN 4 THEN 'canceled' WHEN 5 THEN 'queued' ELSE '' END"
_ITEM = f"""concat('{{', CASE WHEN o_orderkey % 13 = 0 THEN '"id":7' WHEN o_orderkey % 2 = 0 THEN concat('"task_id":"o', o_orderkey, '"') ELSE concat('"id":"o', o_orderkey, '"') END, ',"state":"', {_STATUS}, '","environment":"', CASE o_orderkey % 3 WHEN 0 THEN 'Cloud' WHEN 1 THEN 'containerized' ELSE 'x' END,
'","attempts":', CASE WHEN o_orderkey % 5 = 0 THEN '100001' ELSE concat('', o_orderkey % 5) END, ',"createdAt":"', substr(concat('', o_orderdate), 1, 10), 'T05:00:00Z","completed_at":"', CASE WHEN o_orderkey % 11 = 0 THEN '1980-01-01T00:00:00Z' WHEN o_orderkey % 11 = 1 THEN 'soon' ELSE '2002-01-01T00:00:00+01:00' END, '"}}')"""
_PAGES = "CAST(floor(o_orderkey / 40) * 2 + CASE WHEN o_orderkey % 40 < 16 THEN 0 ELSE 1 END AS BIGINT)"


@query(f"""WITH o AS (SELECT *, {_STATUS} AS s, row_number() OVER (PARTITION BY {_PAGES} ORDER BY o_orderkey) - 1 AS place FROM orders), g AS (SELECT * FROM o WHERE place < 20 AND o_orderkey % 13 > 0 AND s <> ''),
t AS (SELECT *, o_orderdate::DATE + INTERVAL 5 HOUR AS c, CASE WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '1980-01-01 00:00:00' WHEN o_orderkey % 11 > 1 THEN TIMESTAMP '2001-12-31 23:00:00' END AS d FROM g)
SELECT {_PAGES} AS page, place::INTEGER AS place, sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode('o' || o_orderkey)))) AS entity, CASE s WHEN 'in_progress' THEN 'running' WHEN 'applied' THEN 'completed' WHEN 'Error' THEN 'failed' WHEN 'canceled' THEN 'cancelled' WHEN 'queued' THEN s ELSE 'unknown' END AS lifecycle,
CASE o_orderkey % 3 WHEN 0 THEN 'hosted' WHEN 1 THEN 'container' ELSE 'unknown' END AS environment, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS attempts, CASE WHEN d IS NULL OR c <= d THEN c END AS created, CASE WHEN d IS NULL OR c <= d THEN d END AS completed FROM t""")
def cloud_rows(spark, sf):
    made, _ = _page_rows(spark, sf)
    return made.drop("started", "updated")


@query(f"""SELECT {_PAGES} AS page, count(*)::INTEGER AS items, count(*) FILTER (place < 20 AND (o_orderkey % 13 = 0 OR o_orderkey % 7 = 6)) AS invalid, count(*) > 20 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY {_PAGES} ORDER BY o_orderkey) - 1 AS place FROM orders) GROUP BY 1""")
def cloud_pages(spark, sf):
    return _page_rows(spark, sf)[1]


def _page_rows(spark, sf):
    """Pages of up to 24 rows: a bounded list for each."""
    items = table(spark, sf, "orders").select(F.expr(_PAGES).alias("page"), "o_orderkey", F.expr(_ITEM).alias("item"))
    lists = items.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))).alias("i"))
    body = F.concat(F.lit("["), F.array_join(F.transform("i", lambda x: x["item"]), ","), F.lit("]"))
    whole = F.when(F.col("page") % 3 == 0, body).otherwise(F.concat(F.lit('{"tasks":7,"items":'), body, F.lit("}")))
    return cloud.page_rows(lists.select("page", F.try_parse_json(whole).alias("value")), "page", "value", _KEY, F.lit("2003-01-01").cast("timestamp"))


_CURSORS = """CASE event_id % 8 WHEN 0 THEN concat('{"cursor":"c', event_id, '"}') WHEN 1 THEN '{"cursor":null}' WHEN 2 THEN concat('{"next_cursor":"n', event_id, '","nextCursor":"n', event_id, '"}') WHEN 3 THEN '{"next_cursor":"a","nextCursor":"b"}'
WHEN 4 THEN '{"cursor":null,"next_cursor":"x"}' WHEN 5 THEN '{"nextCursor":null}' WHEN 6 THEN '{"cursor":5}' ELSE '{"tasks":[]}' END"""


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'next' WHEN 1 THEN 'terminal' WHEN 2 THEN 'next' WHEN 5 THEN 'ambiguous' WHEN 7 THEN 'ambiguous' END AS state, CASE event_id % 8 WHEN 0 THEN 'c' || event_id WHEN 2 THEN 'n' || event_id END AS next,
CASE event_id % 8 WHEN 3 THEN 'conflict' WHEN 4 THEN 'conflict' WHEN 6 THEN 'invalid' END AS error FROM events""")
def cloud_cursors(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_parse_json(F.expr(_CURSORS)).alias("v")).select("event_id", cloud.cursor(F.col("v")).alias("c")).select("event_id", "c.*")


@query("""WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'odd' ELSE sha256(c_name) END AS entity, CASE WHEN c_custkey % 5 = 0 THEN 'ready' ELSE 'completed' END AS state, c_custkey % 2 = 0 AS timed,
CASE WHEN c_custkey % 7 = 0 THEN ['identity', 'status', 'attempts'] WHEN c_custkey % 6 = 0 THEN ['identity', 'status', 'status'] WHEN c_custkey % 2 = 0 THEN ['identity', 'status', 'timing'] ELSE ['identity', 'status'] END AS c FROM customer)
SELECT c_custkey, regexp_matches(entity, '^[0-9a-f]{64}$') AND state IN ('queued', 'running', 'completed', 'failed', 'cancelled', 'unknown') AND len(list_distinct(c)) = len(c) AND list_has_all(['identity', 'status', 'timing', 'attempts'], c)
AND list_has_all(c, ['identity', 'status']) AND list_contains(c, 'timing') = timed AND NOT list_contains(c, 'attempts') AS valid FROM v""")
def cloud_valid(spark, sf):
    x = F.expr
    covered = x("CASE WHEN c_custkey % 6 = 0 THEN array('identity', 'status', 'status') WHEN c_custkey % 2 = 0 THEN array('identity', 'status', 'timing') ELSE array('identity', 'status') END")
    covered = F.when(x("c_custkey % 7 = 0"), F.array(F.lit("identity"), F.lit("status"), F.lit("attempts"))).otherwise(covered)
    state = x("CASE WHEN c_custkey % 5 = 0 THEN 'ready' ELSE 'completed' END")
    valid = cloud.is_valid(F.when(x("c_custkey % 4 = 0"), "odd").otherwise(F.sha2("c_name", 256)), state, F.lit("hosted"), F.lit(None).cast("long"), covered, x("c_custkey % 2 = 0"))
    return table(spark, sf, "customer").select("c_custkey", valid.alias("valid"))


@query("""WITH f AS (SELECT user_id, min(event_id) AS first, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1 ORDER BY first LIMIT 50) SELECT user_id, event_id, event_type FROM f""")
def cloud_upserts(spark, sf):
    return cloud.upserted(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], 50)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_rows(spark, sf):
    return cloud.firsts(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])
