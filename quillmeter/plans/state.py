"""Queries over stored state and new scans, and the reports that clients ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.operators import reports, state
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _at(text):
    return F.lit(text).cast("timestamp")


@query("""WITH f AS (SELECT user_id % 200 AS workspace, event_id AS file, ts AS mtime, 'a' AS destination FROM events), c AS (SELECT workspace, file, mtime, CASE WHEN workspace % 7 = 0 THEN 'b' ELSE 'a' END AS destination, TIMESTAMP '2024-01-20 00:00:00' - to_days((workspace % 9)::INTEGER) AS uploaded FROM f WHERE workspace % 5 > 0 AND NOT (workspace % 11 = 1 AND file % 10 = 0)),
x AS (SELECT workspace, count(*) AS n FROM f GROUP BY 1), y AS (SELECT workspace, count(*) AS n, max(destination) AS d, max(uploaded) AS u FROM c GROUP BY 1)
SELECT x.workspace FROM x LEFT JOIN y USING (workspace) WHERE y.n IS NULL OR x.n <> y.n OR y.d <> 'a' OR y.u <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY""")
def workspaces_to_rescan(spark, sf):
    files = table(spark, sf, "events").select((F.col("user_id") % 200).alias("workspace"), F.col("event_id").alias("file"), F.col("ts").cast("timestamp").alias("mtime"), F.lit("a").alias("destination"))
    w = F.col("workspace")
    cache = files.where((w % 5 > 0) & ~((w % 11 == 1) & (F.col("file") % 10 == 0))).withColumn("destination", F.when(w % 7 == 0, "b").otherwise("a"))
    cache = cache.withColumn("uploaded", F.timestamp_add("DAY", (-(w % 9)).cast("int"), _at("2024-01-20")))
    return state.to_rescan(files, cache, _at("2024-01-20"))


@query(f"""SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 5 = 0 OR c_custkey % 10 >= 7""")
def uploads_due(spark, sf):
    k = F.col("c_custkey")
    payloads = table(spark, sf, "customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"))
    old = payloads.where(k % 4 > 0).select("c_custkey", F.when(k % 5 == 0, "x").otherwise(F.col("digest")).alias("digest"), F.timestamp_add("DAY", (-(k % 10)).cast("int"), _at("2024-01-20")).alias("published"))
    return state.to_upload(payloads, old, "c_custkey", "digest", "published", _at("2024-01-20")).select("c_custkey")


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, ts < TIMESTAMP '2024-01-18' AS old, ts >= TIMESTAMP '2024-01-15' AS fresh FROM events GROUP BY ALL),
o AS (SELECT user_id, hour, sum(n)::BIGINT AS n FROM h WHERE old GROUP BY 1, 2), f AS (SELECT user_id, hour, sum(n)::BIGINT * 10 AS n FROM h WHERE fresh GROUP BY 1, 2)
SELECT user_id, hour, coalesce(f.n, o.n) AS n FROM o FULL JOIN f USING (user_id, hour)""")
def late_buckets(spark, sf):
    events = table(spark, sf, "events")
    hours = lambda rows, times: rows.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg((F.count("*") * times).alias("n"))
    return state.replaced(hours(events.where("ts < timestamp'2024-01-18'"), 1), hours(events.where("ts >= timestamp'2024-01-15'"), 10), ["user_id", "hour"])


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN 'T00:00:00Z' ELSE 'T00:00:00.750Z' END AS seen FROM orders ORDER BY seen DESC, o_orderkey DESC LIMIT 5000")
def newest_watermarks(spark, sf):
    seen = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "T00:00:00Z").otherwise("T00:00:00.750Z"))
    return state.kept_newest(table(spark, sf, "orders").select("o_orderkey", seen.alias("seen")), [F.desc("seen"), F.desc("o_orderkey")], 5000)


@query("SELECT o_custkey, max(o_orderdate::DATE::VARCHAR) AS seen FROM orders GROUP BY 1 ORDER BY seen DESC, o_custkey LIMIT 400")
def newest_cache_rows(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("seen"))
    return state.kept_newest(rows, [F.desc("seen"), F.asc("o_custkey")], 400)


@query("""WITH s AS (SELECT user_id, event_id, date_trunc('minute', ts)::TIMESTAMP AS at_, value FROM events), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, at_ ORDER BY event_id DESC) = 1)
SELECT user_id, event_id, at_ AS at FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_ DESC) <= 6""".replace(" AS at FROM", ' AS "at" FROM'))
def context_history(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("at"))
    return state.history(rows, "user_id", "at", "event_id", 6)


@query(f"""SELECT event_id FROM events WHERE event_id % 9 > 0 AND epoch({_NOW} - ts) <= CASE WHEN event_id % 2 = 0 THEN 30 ELSE 7 END * 86400""")
def retained_queue(spark, sf):
    at = F.when(F.col("event_id") % 9 > 0, F.col("ts").cast("timestamp"))
    days = F.when(F.col("event_id") % 2 == 0, 30).otherwise(7)
    return state.within(table(spark, sf, "events"), at, _at("2024-01-20"), days).select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 5 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 3 = 1)")
def committable_entries(spark, sf):
    k = F.col("c_custkey")
    index = table(spark, sf, "customer").select("c_custkey", F.sha2("c_name", 256).alias("mark"))
    committed = index.where(k % 2 == 0).select("c_custkey", F.when(k % 3 == 1, F.col("mark")).otherwise("old").alias("mark"))
    return state.committable(index, committed, index.where(k % 5 == 0), "c_custkey", "mark", k % 6 == 0).select("c_custkey")


@query("""WITH r AS (SELECT event_id, user_id % 6 AS gateway, event_type, date_trunc('hour', ts)::TIMESTAMP AS b, event_id % 100 AS t, CASE WHEN event_id % 3 = 1 THEN 'plan' || (event_id % 5) END AS plan, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts::DATE::VARCHAR || 'Z' END AS seen FROM events)
SELECT gateway, event_type, count(DISTINCT b) AS buckets, sum(t)::BIGINT AS tokens, arg_min(plan, event_id) FILTER (plan IS NOT NULL) AS plan, max(seen) AS last_seen FROM r GROUP BY 1, 2""")
def detected_uses(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 6).alias("gateway"), "event_type", F.date_trunc("hour", "ts").alias("b"), (e % 100).alias("t"), F.when(e % 3 == 1, F.concat(F.lit("plan"), e % 5)).alias("plan"), F.when(e % 4 != 0, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("Z"))).alias("seen"),
    )
    return state.detected(rows, ["gateway", "event_type"], "b", "t", ["plan"], "seen", "event_id")


@query("""WITH w(k, limited, percent, pos) AS (VALUES ('building', false, 40.0, 0), ('automobile', false, 90.0, 1), ('building', true, 10.0, 2), ('machinery', false, 55.0, 3), ('household', false, 55.0, 4), ('machinery', false, 55.0, 5))
SELECT c_custkey, limited, percent::DOUBLE AS percent, c_mktsegment = 'BUILDING' OR c_custkey % 2 = 0 AND c_mktsegment = 'FURNITURE' AS matches FROM customer LEFT JOIN (SELECT k, arg_max(limited, (limited, percent, pos)) AS limited, arg_max(percent, (limited, percent, pos)) AS percent FROM w GROUP BY 1) ON k = lower(c_mktsegment)""")
def quota_windows(spark, sf):
    windows = spark.createDataFrame([(["Building"], False, 40.0, 0), (["AUTOMOBILE"], False, 90.0, 1), (["building"], True, 10.0, 2), (["machinery", "household"], False, 55.0, 4), (["Machinery"], False, 55.0, 5)], "plan_keys array<string>, limited boolean, percent double, pos int")
    rows = state.with_quota(table(spark, sf, "customer"), windows, "c_mktsegment")
    other = F.when(F.col("c_custkey") % 2 == 0, "team_furniture").otherwise("xbuilding")
    matches = state.products_match(F.col("c_mktsegment"), other) | state.products_match(F.col("c_mktsegment"), F.lit(" building"))
    return rows.select("c_custkey", "limited", "percent", matches.alias("matches"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'protocol' WHEN c_custkey % 7 = 0 THEN 'account' WHEN c_custkey % 5 = 0 THEN 'blocking' WHEN c_acctbal < 0 THEN 'warning' WHEN c_custkey % 3 = 0 THEN 'setup' ELSE 'healthy' END AS state,
array_to_string(list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'signed_out' END, CASE WHEN c_acctbal < 0 THEN 'low_quota' END, CASE WHEN c_custkey % 5 = 0 THEN 'no_source' END, CASE WHEN c_custkey % 11 = 0 THEN 'old_protocol' END, CASE WHEN c_custkey % 3 = 0 THEN 'setup_open' END], lambda x: x IS NOT NULL), ',') AS blockers FROM customer""")
def health_states(spark, sf):
    k = F.col("c_custkey")
    rules = [("signed_out", "account", k % 7 == 0), ("low_quota", "warning", F.col("c_acctbal") < 0), ("no_source", "blocking", k % 5 == 0), ("old_protocol", "protocol", k % 11 == 0), ("setup_open", "setup", k % 3 == 0)]
    return table(spark, sf, "customer").select("c_custkey", state.health(rules).alias("h")).select("c_custkey", "h.state", F.array_join("h.blockers", ",").alias("blockers"))


@query("""WITH s AS (SELECT s_suppkey % 40 AS name, 0 AS scope, max(s_suppkey) AS port FROM supplier GROUP BY 1 UNION ALL SELECT c_custkey % 60, 1, max(c_custkey) FROM customer WHERE c_custkey % 60 >= 30 GROUP BY 1 UNION ALL SELECT n_nationkey + 20, 2, n_nationkey FROM nation)
SELECT name, arg_max(port, scope)::BIGINT AS port, max(scope)::INTEGER AS scope, name % 4 = 0 AS disabled FROM s GROUP BY name""")
def overlaid_servers(spark, sf):
    top = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 40).alias("name")).agg(F.max("s_suppkey").cast("long").alias("port"))
    project = table(spark, sf, "customer").where("c_custkey % 60 >= 30").groupBy((F.col("c_custkey") % 60).alias("name")).agg(F.max("c_custkey").alias("port"))
    settings = table(spark, sf, "nation").select((F.col("n_nationkey") + 20).cast("long").alias("name"), F.col("n_nationkey").cast("long").alias("port"))
    return state.overlaid([top.withColumn("name", F.col("name").cast("long")), project, settings], "name", spark.range(0, 200, 4).withColumnRenamed("id", "name"))


@query("""SELECT date_trunc('week', timezone('America/New_York', timezone('UTC', o_orderdate)))::DATE AS bucket, count(*) AS orders, sum(o_totalprice::DECIMAL(18, 2))::DECIMAL(28, 2) AS cost FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND o_orderstatus = 'F' AND o_custkey % 10 = 3 GROUP BY 1""")
def costs_in_zone(spark, sf):
    return reports.costs(table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_custkey % 10 = 3"), "o_orderdate", "o_totalprice", "1998-01-01", "1999-01-01", "week", "America/New_York")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 50000 AND 400000 AND contains(lower(o_orderpriority), 'urg') AND (o_totalprice, o_orderkey) > (60000.5, 7) ORDER BY o_totalprice, o_orderkey LIMIT 40""")
def sessions_filtered(spark, sf):
    where = {"o_orderstatus": ["O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}
    page = reports.sessions(table(spark, sf, "orders"), "o_orderkey", where, "o_totalprice", 50000, 400000, ("o_orderpriority", "URG"), descending=False, after=(60000.5, 7), limit=40)
    return page.select("o_orderkey", "o_totalprice")


@query("""WITH u AS (SELECT user_id, count(*) AS n, avg(value) AS mean, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT user_id, r.rule, r.rank FROM u, LATERAL (VALUES ('deep_context', 1, mean > 60), ('many_errors', 2, errors * 4 > n), ('quiet', 3, n < 60)) r(rule, rank, holds) WHERE holds ORDER BY rank, user_id LIMIT 100""")
def recommendations(spark, sf):
    users = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return reports.recommended(users, "user_id", [("deep_context", F.col("mean") > 60), ("many_errors", F.col("errors") * 4 > F.col("n")), ("quiet", F.col("n") < 60)], 100)
