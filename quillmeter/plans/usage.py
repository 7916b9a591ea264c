"""Queries over usage records, made from ``events``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.functions import text
from quillmeter.operators import usage
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table


@query("""WITH l AS (SELECT l_orderkey % 500 AS file, l_orderkey AS m, l_suppkey % 3 AS r, l_linenumber AS o, CASE WHEN l_orderkey % 19 = 0 THEN l_returnflag ELSE 'A' END AS model, CASE WHEN l_orderkey % 17 = 0 THEN l_linenumber ELSE 1 END AS i, floor(l_quantity)::BIGINT AS out FROM lineitem),
d AS (SELECT DISTINCT ON (file, m, r, o) file, m, r, o, max(model) OVER w AS model, max(i) OVER w AS i, max(out) OVER w * CASE WHEN m % 2 = 0 THEN 1 ELSE o END AS out FROM l WINDOW w AS (PARTITION BY file, m, r, o)),
p AS (SELECT *, lag(out) OVER (PARTITION BY file, m, r ORDER BY o) AS before FROM d)
SELECT file, m AS message_id, r AS request_id, arg_max(out, o)::BIGINT AS output, max(o)::BIGINT AS ordinal, count(DISTINCT (model, i)) > 1 OR bool_or(coalesce(out < before, false)) AS conflict FROM p GROUP BY 1, 2, 3""")
def usage_messages(spark, sf):
    k = F.col("l_orderkey")
    lines = table(spark, sf, "lineitem").select(
        (k % 500).alias("file"), k.alias("message_id"), (F.col("l_suppkey") % 3).alias("request_id"), F.col("l_linenumber").cast("long").alias("ordinal"), F.when(k % 19 == 0, F.col("l_returnflag")).otherwise("A").alias("model"),
        F.when(k % 17 == 0, F.col("l_linenumber")).otherwise(1).alias("input"), F.floor("l_quantity").alias("output"),
    )
    key = ["file", "message_id", "request_id", "ordinal"]
    lines = lines.repartition(*key[:3]).groupBy(*key).agg(F.max("model").alias("model"), F.max("input").alias("input"), F.lit(0).alias("cached"), (F.max("output") * F.when(F.col("message_id") % 2 == 0, 1).otherwise(F.col("ordinal"))).alias("output"))
    return usage.messages(lines).select("file", "message_id", "request_id", "output", "ordinal", "conflict")


@query("""WITH r AS (SELECT conv_id AS file, turn, role, CASE WHEN conv_id % 3 = 0 THEN 2 END AS start, role = 'assistant' AND conv_id % 2 = 0 AS trigger, CASE WHEN turn < conv_id % 4 THEN CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN '' ELSE 'parent' END END AS forked FROM conversations),
o AS (SELECT *, coalesce(start, min(CASE WHEN trigger THEN turn END) OVER (PARTITION BY file), 0) AS a, bool_or(coalesce(forked = '', false)) OVER (PARTITION BY file) AS quarantined FROM r)
SELECT file, count(*) AS records, count(*) FILTER (turn >= a) AS owned, count(*) FILTER (forked IS NULL OR forked = '') AS unforked, bool_or(quarantined) AS quarantined FROM o GROUP BY 1""")
def owned_records(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr("conv_id AS file", "turn AS ordinal", "role", "CASE WHEN conv_id % 3 = 0 THEN 2L END AS start", "concat('s', conv_id) AS session", "CASE WHEN turn < conv_id % 4 THEN CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN '' ELSE 'parent' END END AS forked")
    own = usage.owned(rows, "start", (F.col("role") == "assistant") & (F.col("file") % 2 == 0)).groupBy("file").agg(F.count("*").alias("owned"))
    free = usage.without_forks(rows, "session", "forked").groupBy("file").agg(F.count("*").alias("unforked"))
    odd = rows.groupBy("file").agg(F.count("*").alias("records"), F.coalesce(F.bool_or(F.col("forked") == ""), F.lit(False)).alias("quarantined"))
    none = F.lit(0).cast("long")
    return odd.join(own, "file", "left").join(free, "file", "left").select("file", "records", F.coalesce("owned", none).alias("owned"), F.coalesce("unforked", none).alias("unforked"), "quarantined")


@query("""WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 4 > 0 THEN json_extract_string(props, '$.k')::BIGINT END AS total, CASE WHEN event_id % 6 = 0 THEN event_id % 9 END AS delta FROM events),
y AS (SELECT *, coalesce(last_value(total IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM x)
SELECT user_id, sum(coalesce(delta, CASE WHEN total < p THEN total ELSE total - p END, 0))::BIGINT AS used FROM y GROUP BY 1""")
def counter_used(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 > 0, F.get_json_object("props", "$.k").cast("long")).alias("total"), F.when(F.col("event_id") % 6 == 0, F.col("event_id") % 9).alias("delta"))
    return usage.counter_used(rows, "user_id", "event_id", "total", "delta").groupBy("user_id").agg(F.sum("used").alias("used"))


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, 'message' AS shape FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_custkey, o_orderpriority, 'message_end' FROM orders WHERE o_orderkey % 4 <> 0),
c AS (SELECT o_custkey, o_orderpriority, count(*) FILTER (shape = 'message') AS a, count(*) FILTER (shape = 'message_end') AS b FROM s GROUP BY 1, 2) SELECT o_custkey, o_orderpriority, greatest(a, b) AS n, a > 0 AND b > 0 AND a <> b AS retry FROM c""")
def reconciled_messages(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    side = lambda k, name: orders.where(F.col("o_orderkey") % k != 0).withColumn("shape", F.lit(name))
    return usage.reconciled(side(3, "message").union(side(4, "message_end")), ["o_custkey", "o_orderpriority"], "shape")


@query("""WITH u AS (SELECT *, CASE WHEN event_id % 50 > 0 THEN (event_id * 1250000)::DECIMAL(28, 0) END AS pico FROM events)
SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, user_id % 3 AS selector, sum(event_id % 100)::BIGINT AS tokens, CASE WHEN count(pico) = count(*) THEN sum(pico)::DECIMAL(38, 0) END AS pico, count(*) AS n FROM u GROUP BY 1, 2, 3""")
def usage_hours(spark, sf):
    rows = table(spark, sf, "events").select("ts", "event_type", (F.col("user_id") % 3).alias("selector"), (F.col("event_id") % 100).alias("tokens"), F.when(F.col("event_id") % 50 > 0, (F.col("event_id") * 1_250_000).cast("decimal(28,0)")).alias("pico"))
    return usage.hourly(rows, "ts", ["event_type", "selector"], ["tokens"], "pico").withColumn("pico", F.col("pico").cast("decimal(38,0)"))


@query("""WITH b AS (SELECT DISTINCT CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE -1 - o_custkey END AS s, o_orderkey AS r FROM orders), e AS (SELECT o_custkey AS s, o_orderkey AS r, o_custkey % 7 + CASE WHEN o_orderkey % 60 = 0 THEN 1 ELSE 0 END AS a FROM orders WHERE o_orderkey % 100 <> 4 UNION ALL SELECT o_custkey, o_orderkey, o_custkey % 7 FROM orders WHERE o_orderkey % 84 = 0),
m AS (SELECT b.s, b.r, count(e.a) AS n, min(e.a) AS lo, max(e.a) AS hi FROM b LEFT JOIN e USING (s, r) GROUP BY 1, 2) SELECT s AS session, CASE WHEN bool_and(n = 1) AND min(lo) = max(hi) THEN min(lo) END AS account, bool_and(n = 1) AND coalesce(min(lo) = max(hi), false) AS complete FROM m GROUP BY 1""")
def request_coverage(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("request"))
    account = F.col("session") % 7
    once = orders.where("request % 100 <> 4").withColumn("account", account + F.when(F.col("request") % 60 == 0, 1).otherwise(0))
    billed = orders.select(F.expr("CASE WHEN request % 4 = 0 THEN session ELSE -1 - session END").alias("session"), "request")
    return usage.covered(billed, once.union(orders.where("request % 84 = 0").withColumn("account", account)), "session", "request", "account")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'Tidy [path] up' END AS title FROM customer""")
def session_titles(spark, sf):
    x = F.expr
    made = usage.title(x("CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE ' ' END"), x("CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END"), text.prompt_label(F.lit("Tidy src/a.py up")))
    return table(spark, sf, "customer").select("c_custkey", made.alias("title"))
