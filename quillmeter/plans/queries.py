"""Queries over the tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.functions import digests, numbers, text
from quillmeter.operators import joins, packing, posture, windows
from quillmeter.operators import transcripts as transcripts_ops
from quillmeter.operators.sets import digest_of_sets
from quillmeter.plans.registry import ORACLE, QUERIES, query
from quillmeter.sources.tables import table


def _day(c: str = "ts"):
    return F.to_date(c)


@query("""
WITH s AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg FROM conversations),
r AS (SELECT *, ceil(length(text) / 4)::BIGINT AS tokens, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS residency FROM s)
SELECT role, count(*) AS events, sum(tokens)::BIGINT AS tokens, sum(tokens * residency)::BIGINT AS resident_tokens FROM r GROUP BY role""")
def composition_residency(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("tokens", text.token_estimate(F.col("text")))
    rows = windows.residency(turns, "conv_id", "turn", F.col("role") == "assistant", F.col("role") == "system")
    return rows.groupBy("role").agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("residency")).alias("resident_tokens"))


@query("""WITH x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT event_type, count(*) AS runs FROM x WHERE p IS NULL OR p <> event_type GROUP BY event_type""")
def fragment_collapse(spark, sf):
    return windows.collapse_runs(table(spark, sf, "events"), "user_id", "event_id", "event_type").groupBy("event_type").agg(F.count("*").alias("runs"))


@query("SELECT lang, source, count(*) AS documents, sum(ceil(length(text) / 4))::BIGINT AS tokens FROM documents GROUP BY lang, source")
def token_estimate_docs(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


@query(r"""SELECT CASE WHEN regexp_matches(p, '(^|[/\\])MEMORY\.md$') OR contains(p, 'AutoMem/') OR contains(p, '/memory/') OR contains(p, '\memory\') THEN 'memory_notes' WHEN lower(p) LIKE '%.md' OR lower(p) LIKE '%.markdown' THEN 'doc_reads_md'
WHEN lower(p) LIKE '%.html' OR lower(p) LIKE '%.htm' THEN 'doc_reads_html' ELSE 'code_reads' END AS kind, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, split_part(url, '?', 1) ||
CASE page_id % 8 WHEN 0 THEN '/MEMORY.md' WHEN 1 THEN '/memory.MD' WHEN 2 THEN '/AutoMem/x' WHEN 3 THEN '\memory\y.html' WHEN 4 THEN '/a.Markdown' WHEN 5 THEN '/b.HTM' WHEN 6 THEN '/x.mdx' ELSE '' END AS p FROM pages) GROUP BY kind""")
def path_class(spark, sf):
    ends = F.array(*map(F.lit, ("/MEMORY.md", "/memory.MD", "/AutoMem/x", "\\memory\\y.html", "/a.Markdown", "/b.HTM", "/x.mdx", "")))
    path = F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.element_at(ends, (F.col("page_id") % 8 + 1).cast("int")))
    return table(spark, sf, "pages").groupBy(text.path_class(path).alias("kind")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{text.WHITE}+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, list_transform(w[1:4096], lambda x: CASE WHEN regexp_matches(x, '^[^A-Za-z0-9]*[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR regexp_matches(regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'),
'^([0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}|[0-9]{{4,}}|[0-9A-Fa-f]{{16,}})$') THEN '<dynamic>' ELSE x END) AS w FROM t)
SELECT sha256(nullif(left(lower(array_to_string(w, ' ')), 4096), '')) AS template, count(*) AS n, min(doc_id) AS first_doc FROM u GROUP BY 1""")
def template_normalize(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(text.template(F.col("text")), 256).alias("template"))
    return docs.groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""SELECT slug, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN '__all__' ELSE left(regexp_replace(lower(trim(p_type)), '[^a-z0-9._-]', '-', 'g'), 64) END AS slug FROM part) WHERE regexp_matches(slug, '^[a-z0-9]') GROUP BY slug""")
def model_slug(spark, sf):
    name = F.when(F.col("p_partkey") % 10 == 0, " __ALL__ ").otherwise(F.col("p_type"))
    return table(spark, sf, "part").select(text.slug(name).alias("slug")).where("slug is not null").groupBy("slug").agg(F.count("*").alias("n"))


@query("SELECT CASE upper(trim(c_mktsegment)) WHEN 'BUILDING' THEN 'desktop' WHEN 'MACHINERY' THEN 'cli' WHEN 'FURNITURE' THEN 'web' ELSE 'other' END AS surface, count(*) AS n FROM customer GROUP BY 1")
def surface_map(spark, sf):
    surface = text.closed_map(F.col("c_mktsegment"), {"building": "desktop", "machinery": "cli", "furniture": "web"})
    return table(spark, sf, "customer").groupBy(surface.alias("surface")).agg(F.count("*").alias("n"))


@query("""SELECT CASE user_id % 4 WHEN 0 THEN 'Team Standard' WHEN 1 THEN 'A_b ' || upper(left(event_type, 1)) || substr(event_type, 2) WHEN 2 THEN 'Max' ELSE upper(left(event_type, 1)) || substr(event_type, 2) || '-x' END AS label, count(*) AS n FROM events GROUP BY 1""")
def plan_label(spark, sf):
    name = F.expr("CASE user_id % 4 WHEN 0 THEN ' TEAM_standard ' WHEN 1 THEN concat('a_b  ', event_type) WHEN 2 THEN 'max' ELSE concat(event_type, '-x') END")
    return table(spark, sf, "events").groupBy(text.plan_label(name).alias("label")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'F')
SELECT coalesce(o_orderpriority, 'other') AS category, count(*) AS results, sum(event_id)::BIGINT AS total FROM events LEFT JOIN (SELECT * FROM c WHERE r = 1) ON user_id = o_custkey GROUP BY 1""")
def call_result_join(spark, sf):
    calls = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    last = joins.last_of(calls, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    joined = table(spark, sf, "events").join(last, F.col("user_id") == F.col("o_custkey"), "left")
    return joined.groupBy(F.coalesce("o_orderpriority", F.lit("other")).alias("category")).agg(F.count("*").alias("results"), F.sum("event_id").alias("total"))


@query("""WITH o AS (SELECT CASE WHEN event_id % 5 = 0 THEN user_id ELSE -1 - event_id END AS k, min(event_type) AS v, count(DISTINCT event_type) AS n FROM events GROUP BY 1),
u AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_custkey ELSE -1 - o_orderkey END AS k, min(o_orderpriority) AS v, count(DISTINCT o_orderpriority) AS n, count(*) FILTER (o_orderkey % 11 = 0) AS gaps FROM orders GROUP BY 1),
s AS (SELECT c_custkey, c_mktsegment, coalesce(o.n, 0) AS no, o.v AS ov, CASE WHEN u.k IS NULL THEN 0 WHEN u.gaps > 0 OR u.n > 1 THEN 2 ELSE 1 END AS nu, u.v AS uv, coalesce(p.n, 0) AS np, p.v AS pv
FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN u ON u.k = c_custkey LEFT JOIN o p ON p.k = c_custkey - 1 AND c_custkey % 3 = 0),
r AS (SELECT CASE WHEN no > 1 OR nu > 1 OR (no = 1 AND nu = 1 AND ov <> uv) THEN 'conflict' WHEN no = 1 THEN 'observation' WHEN nu = 1 THEN 'usage' WHEN np > 1 THEN 'conflict' WHEN np = 1 THEN 'lineage' WHEN c_mktsegment = 'BUILDING' THEN 'login' ELSE 'none' END AS origin, * FROM s)
SELECT origin, CASE origin WHEN 'observation' THEN ov WHEN 'usage' THEN uv WHEN 'lineage' THEN pv WHEN 'login' THEN c_mktsegment END AS account, count(*) AS n FROM r GROUP BY 1, 2""")
def account_precedence(spark, sf):
    # every row is an observation; those of other sessions than the customers' find no partner
    seen = table(spark, sf, "events").select(F.expr("CASE WHEN event_id % 5 = 0 THEN user_id ELSE -1 - event_id END").alias("c_custkey"), F.col("event_type").alias("account"))
    used = table(spark, sf, "orders").select(F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_custkey ELSE -1 - o_orderkey END").alias("c_custkey"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("account"))
    parents = seen.select((F.col("c_custkey") + 1).alias("c_custkey"), "account").where("c_custkey % 3 = 0")
    login = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment"))
    rows = joins.account_of(table(spark, sf, "customer"), "c_custkey", "account", seen, used, parents, login)
    return rows.groupBy("origin", "account").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT doc_id, strlen(b.text) AS n, min(item_id) AS item_id, count(DISTINCT item_id) AS k FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE strlen(b.text) >= 24 GROUP BY 1, 2)
SELECT doc_id, item_id AS label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM m) WHERE r = 1 AND k = 1""")
def containment_longest(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("text").alias("signature"), "item_id")
    return joins.longest_contained(table(spark, sf, "documents"), "text", "doc_id", items, "signature", "item_id")


@query("""SELECT rule, count(*) AS n, min(event_id) AS first_event FROM events JOIN (VALUES ('hourly', 0, NULL, NULL, NULL, NULL), ('sunday', NULL, NULL, 7, NULL, NULL), ('noon', NULL, 12, NULL, NULL, 1), ('second', NULL, 9, NULL, 2, NULL)) r(rule, mi, h, wd, d, mo)
ON (mi IS NULL OR mi = minute(ts)) AND (h IS NULL OR h = hour(ts)) AND (wd IS NULL OR wd % 7 = dayofweek(ts)) AND (d IS NULL OR d = day(ts)) AND (mo IS NULL OR mo = month(ts)) GROUP BY rule""")
def calendar_match(spark, sf):
    rules = spark.createDataFrame([("hourly", 0, None, None, None, None), ("sunday", None, None, 7, None, None), ("noon", None, 12, None, None, 1), ("second", None, 9, None, 2, None)], "rule string, minute int, hour int, weekday int, day int, month int")
    return joins.calendar_matches(table(spark, sf, "events"), "ts", rules).groupBy("rule").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT user_id, value AS used, CASE WHEN value >= 100 THEN 'exhausted' WHEN value >= 80 THEN 'near' WHEN value IS NOT NULL THEN 'ok' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def quota_overlay(spark, sf):
    top = joins.last_of(table(spark, sf, "events").select("user_id", "value", "event_id"), ["user_id"], [F.col("value"), F.col("event_id")])
    return top.select("user_id", F.col("value").alias("used"), numbers.quota_state(F.col("value")).alias("state"))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, ts < TIMESTAMP '2024-01-20' AS old, ts >= TIMESTAMP '2024-01-12' AS fresh FROM events GROUP BY ALL),
o AS (SELECT user_id, hour, sum(n)::BIGINT AS n, 'plan' || (user_id % 3) AS plan, user_id % 5 AS product FROM h WHERE old GROUP BY ALL), f AS (SELECT user_id, hour, sum(n)::BIGINT * 2 AS n, CASE WHEN user_id % 2 = 0 THEN 'new' END AS plan, NULL::BIGINT AS product FROM h WHERE fresh GROUP BY ALL),
m AS (SELECT user_id, hour, coalesce(f.n, o.n) AS n, coalesce(f.plan, o.plan) AS plan, coalesce(f.product, o.product) AS product FROM o FULL JOIN f USING (user_id, hour)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hour DESC) AS r FROM m)
SELECT user_id, count(*) AS hours, sum(n)::BIGINT AS events, min(hour) AS oldest, max(plan) AS plan, max(product) AS product FROM r WHERE r <= 24 GROUP BY user_id""")
def merge_detected_uses(spark, sf):
    events = table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    hours = lambda rows: rows.groupBy("user_id", "hour").agg(F.count("*").alias("n"))
    old = hours(events.where("ts < timestamp'2024-01-20'")).withColumns({"plan": F.concat(F.lit("plan"), F.col("user_id") % 3), "product": F.col("user_id") % 5})
    fresh = hours(events.where("ts >= timestamp'2024-01-12'")).select("user_id", "hour", (F.col("n") * 2).alias("n"), F.when(F.col("user_id") % 2 == 0, "new").alias("plan"), F.lit(None).cast("long").alias("product"))
    kept = windows.newest(joins.merge_latest(old, fresh, ["user_id", "hour"], ["n", "plan", "product"]), ["user_id"], [F.desc("hour")], 24)
    return kept.groupBy("user_id").agg(F.count("*").alias("hours"), F.sum(numbers.saturating_total(F.col("n"))).alias("events"), F.min("hour").alias("oldest"), F.max("plan").alias("plan"), F.max("product").alias("product"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, round(sum(value::DECIMAL(18,6)), 2)::DECIMAL(18,2) AS total FROM events GROUP BY 1")
def recent_volume(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")), 2).cast("decimal(18,2)").alias("total")).select(F.col("w.start").alias("hour"), "n", "total")


@query("""WITH n AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events), r AS (SELECT event_id, ts, CASE WHEN event_id % 5 > 0 THEN event_id % 1000 END AS first_turn, CASE WHEN event_id % 3 > 0 THEN (value * 9000)::BIGINT END AS peak,
CASE WHEN event_id % 2 = 0 THEN event_id % 4 END AS compactions, event_id % 7 AS reread FROM events, n WHERE ts BETWEEN now - INTERVAL 7 DAY AND now + INTERVAL 5 MINUTE),
p AS (SELECT peak, ts, event_id FROM r WHERE peak IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 14)
SELECT count(*) AS sessions, floor(median(first_turn))::BIGINT AS typical_first_turn, count(peak) AS peak_sessions, count(*) FILTER (peak > 200000) AS evidenced, CASE WHEN count(peak) > 0 THEN count(*) FILTER (peak > 200000) END AS deep,
CASE WHEN count(peak) > 0 AND count(peak) = count(*) FILTER (peak > 200000) THEN count(*) FILTER (peak > 1000000) END AS over_window, sum(compactions)::BIGINT AS compactions, sum(reread)::BIGINT AS reread,
(SELECT string_agg(peak::VARCHAR, ',' ORDER BY ts, event_id) FROM p) AS peaks FROM r HAVING count(*) > 0""")
def posture_summary(spark, sf):
    events = table(spark, sf, "events")
    rows = events.select(
        "event_id", "ts", F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 1000).alias("first_turn"), F.when(F.col("event_id") % 3 > 0, F.round(F.col("value") * 9000).cast("long")).alias("peak"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 4).alias("compactions"), (F.col("event_id") % 7).alias("reread"),
    )
    now = events.agg((F.max("ts") - F.expr("interval 1 day")).alias("now"))  # one row
    return posture.summary(rows, now, "ts", "event_id").withColumn("peaks", F.array_join("peaks", ","))


@query("""SELECT l_suppkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag DESC) AS r FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r = 1""")
def dominant_model(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return joins.last_of(n.withColumn("flag", F.col("l_returnflag")).drop("l_returnflag"), ["l_suppkey"], [F.col("n"), F.col("flag")]).select("l_suppkey", F.col("flag").alias("l_returnflag"))


@query("""WITH b AS (SELECT user_id, date_trunc('hour', ts) AS start, CASE WHEN user_id % 4 > 0 THEN max(ts) END AS active FROM events GROUP BY 1, 2),
l AS (SELECT user_id, arg_max(start, (coalesce(active, start), start)) AS start FROM b GROUP BY 1),
m AS (SELECT e.user_id, event_type, count(*) AS n FROM events e JOIN l ON l.user_id = e.user_id AND date_trunc('hour', e.ts) = l.start GROUP BY 1, 2)
SELECT user_id, event_type FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def latest_model(spark, sf):
    events = table(spark, sf, "events").withColumn("start", F.date_trunc("hour", "ts"))
    buckets = events.groupBy("user_id", "start").agg(F.max("ts").alias("active")).withColumn("active", F.when(F.col("user_id") % 4 > 0, F.col("active")))
    last = joins.last_of(buckets.select("user_id", "start", F.coalesce("active", "start").alias("o")), ["user_id"], [F.col("o"), F.col("start")]).select("user_id", "start")
    n = events.join(last, ["user_id", "start"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return windows.newest(n, ["user_id"], [F.desc("n"), F.asc("event_type")], 1).select("user_id", "event_type")


@query("""WITH c AS (SELECT max(ts) - INTERVAL 1 HOUR AS now FROM events), o AS (SELECT user_id, max(ts) AS seen FROM events, c WHERE ts < now - INTERVAL 30 MINUTE GROUP BY 1), n AS (SELECT user_id, max(ts) AS seen FROM events, c WHERE ts >= now - INTERVAL 60 MINUTE GROUP BY 1)
SELECT n.user_id, n.seen::TIMESTAMP AS last_seen, o.seen::TIMESTAMP AS before FROM n LEFT JOIN o USING (user_id), c WHERE (o.seen IS NULL OR n.seen > o.seen) AND n.seen BETWEEN now - INTERVAL 15 MINUTE AND now + INTERVAL 5 MINUTE ORDER BY n.seen DESC, n.user_id LIMIT 100""")
def active_sessions(spark, sf):
    events = table(spark, sf, "events")
    now = events.agg((F.max("ts") - F.expr("interval 1 hour")).alias("now"))  # one row
    timed = events.join(F.broadcast(now))
    state = timed.where("ts < now - interval 30 minutes").groupBy("user_id").agg(F.max("ts").alias("seen"))
    fresh = timed.where("ts >= now - interval 60 minutes").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return posture.active(fresh, state, now, "user_id", "seen").orderBy(F.desc("last_seen"), "user_id").limit(100)


@query("""SELECT CAST(ts AS DATE) AS day, event_type AS surface, user_id % 5 AS model, CASE WHEN count(k) > 0 THEN least(sum(k), 1000000000000000)::BIGINT END AS tokens, count(*) AS n
FROM (SELECT *, nullif(json_extract_string(props, '$.k')::BIGINT, 0) AS k FROM events) GROUP BY 1, 2, 3""")
def provider_day(spark, sf):
    k = F.nullif(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    rows = table(spark, sf, "events").select(_day().alias("day"), F.col("event_type").alias("surface"), (F.col("user_id") % 5).alias("model"), k.alias("k"))
    return rows.groupBy("day", "surface", "model").agg(numbers.reported_sum(F.col("k"), 10**15).cast("long").alias("tokens"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (event_type <> 'click') AS known FROM events GROUP BY 1)
SELECT day, total, known, total - known AS missing FROM d WHERE total <> known""")
def provider_mismatch(spark, sf):
    days = table(spark, sf, "events").groupBy(_day().alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "click").alias("known"))
    return days.where("total <> known").withColumn("missing", F.col("total") - F.col("known"))


@query("""SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // 200)::BIGINT AS chunk, ((row_number() OVER (ORDER BY c_custkey) - 1) % 200)::BIGINT AS place FROM customer""")
def chunk_rows(spark, sf):
    return windows.chunks(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 200)


@query("""SELECT o_orderstatus, count(*) AS kept FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS a, CASE WHEN o_orderkey % 4 > 1 THEN o_orderdate + INTERVAL 90 DAY END AS b, CASE WHEN o_orderkey % 6 = 1 THEN o_orderdate + INTERVAL 1 YEAR END AS c FROM orders)
WHERE greatest(a, b, c) >= TIMESTAMP '1997-01-01' OR greatest(a, b, c) IS NULL GROUP BY 1""")
def cutoff_filter(spark, sf):
    t = F.col("o_orderdate")
    times_ = [F.when(F.col("o_orderkey") % 3 > 0, t), F.when(F.col("o_orderkey") % 4 > 1, t + F.expr("interval 90 days")), F.when(F.col("o_orderkey") % 6 == 1, t + F.expr("interval 1 year"))]
    last = F.greatest(*times_)  # skips nulls
    return table(spark, sf, "orders").where(last.isNull() | (last >= F.lit("1997-01-01").cast("timestamp"))).groupBy("o_orderstatus").agg(F.count("*").alias("kept"))


@query("SELECT count(*) AS kept FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS t FROM events) WHERE t IS NULL OR t >= TIMESTAMP '2024-01-10'")
def retention_kept(spark, sf):
    t = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    return table(spark, sf, "events").select(t.alias("t")).where("t is null or t >= timestamp'2024-01-10'").agg(F.count("*").alias("kept"))


@query("SELECT count(*) AS kept FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS t FROM events) WHERE t >= TIMESTAMP '2024-01-10'")
def retention_dropped(spark, sf):
    t = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    return table(spark, sf, "events").select(t.alias("t")).where("t >= timestamp'2024-01-10'").agg(F.count("*").alias("kept"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pending(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_retain(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query("""WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT k AS l_suppkey, a.n AS n_left, coalesce(b.n, 0) AS n_right FROM a LEFT JOIN b USING (k) WHERE a.n <> coalesce(b.n, 0)""")
def multiset_ack(spark, sf):
    rows = table(spark, sf, "lineitem")
    return joins.multiset_difference(rows, rows.where("l_returnflag <> 'R'"), ["l_suppkey"])


@query("""SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_id DESC) AS r FROM
(SELECT *, 0 AS v FROM events WHERE event_type = 'click' UNION ALL SELECT *, 1 FROM events WHERE event_type = 'view')) WHERE r = 1""")
def union_latest(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "value", "event_type")
    both = events.where("event_type = 'click'").withColumn("v", F.lit(0)).unionByName(events.where("event_type = 'view'").withColumn("v", F.lit(1)))
    return joins.last_of(both, ["user_id"], [F.col("v"), F.col("event_id")]).select("user_id", "value")


@query("""WITH c AS (SELECT event_type AS reason, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS sent FROM events GROUP BY 1) SELECT reason, greatest(coalesce(c.n, 0) - coalesce(c.sent, 0), 0) AS n FROM (VALUES ('click'), ('purchase'), ('timeout'), ('refused')) d(reason) LEFT JOIN c USING (reason)""")
def loss_report(spark, sf):
    events = table(spark, sf, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("counted"), F.count_if(F.col("event_id") % 3 == 0).alias("acknowledged"))
    left = events.select("reason", F.greatest(F.col("counted") - F.col("acknowledged"), F.lit(0)).alias("n"))
    return joins.closed_domain(left, "reason", ["click", "purchase", "timeout", "refused"], "n")


@query("""WITH k AS (SELECT DISTINCT c_nationkey, c_name AS k, left(sha256(c_name), 4) AS bucket FROM customer),
b AS (SELECT c_nationkey, bucket, sha256(unhex(string_agg(printf('%016x', strlen(k)) || hex(encode(k)), '' ORDER BY k))) AS h, count(*) AS n FROM k GROUP BY 1, 2)
SELECT c_nationkey, sha256(unhex(string_agg(printf('%016x', 64) || hex(encode(h)), '' ORDER BY h))) AS digest, sum(n)::BIGINT AS n FROM b GROUP BY 1""")
def inventory_digest(spark, sf):
    return digest_of_sets(table(spark, sf, "customer"), "c_nationkey", "c_name")


@query("""WITH x AS (SELECT user_id, event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events), y AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM x)
SELECT user_id, sum(CASE WHEN p IS NULL OR k < p THEN k ELSE k - p END)::BIGINT AS used FROM y GROUP BY user_id""")
def cumulative_reset(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return windows.counter_deltas(rows, "user_id", ["event_id"], "k").groupBy("user_id").agg(F.sum("delta").alias("used"))


@query("""SELECT user_id, count(*) AS n FROM (SELECT *, epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM
(SELECT user_id, event_id, ts AS t FROM events UNION ALL SELECT user_id, event_id + 1000000, ts + to_microseconds((event_id % 4) * 40000) FROM events WHERE event_id % 3 = 0)) WHERE gap IS NULL OR gap > 100000 GROUP BY user_id""")
def compaction_pairs(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    echo = events.where("event_id % 3 = 0").select("user_id", (F.col("event_id") + 1_000_000).alias("event_id"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 4 * 40_000).alias("ts"))
    return windows.without_echoes(events.union(echo), "user_id", "ts", "event_id", 0.1).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, (sum((i - c) * 500 + c * 50 + w * 625 + o * 3000) / 100000000::DECIMAL(28, 8))::DECIMAL(28, 8) AS cost FROM (SELECT l_suppkey, floor(l_extendedprice)::DECIMAL(18, 0) AS i, floor(l_extendedprice / 3)::DECIMAL(18, 0) AS c, l_linenumber::DECIMAL(18, 0) AS w, floor(l_quantity)::DECIMAL(18, 0) AS o FROM lineitem) GROUP BY 1""".replace(
    "(sum((i - c) * 500 + c * 50 + w * 625 + o * 3000) / 100000000::DECIMAL(28, 8))::DECIMAL(28, 8)", "(sum((i - c) * 500 + c * 50 + w * 625 + o * 3000)::DECIMAL(28, 0)::DECIMAL(38, 8) * 0.00000001::DECIMAL(9, 8))::DECIMAL(28, 8)"))
def cost_estimate(spark, sf):
    whole = lambda c: F.floor(c).cast("long")
    cost = numbers.token_cost(whole(F.col("l_extendedprice")), whole(F.col("l_extendedprice") / 3), F.col("l_linenumber").cast("long"), whole(F.col("l_quantity")))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(cost).cast("decimal(28,8)").alias("cost"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[mail]', 'g'), '([Bb]earer|[Tt]oken:?|[Pp]assword:?) +[^ \n]+', '\1 [redacted]', 'g'), '[A-Za-z0-9_]{32,}', '[key]', 'g')) AS redacted_sha256 FROM documents""")
def redact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.redacted(F.col("text")), 256).alias("redacted_sha256"))


@query("""SELECT date_trunc('month', o_orderdate)::DATE AS bucket, o_orderpriority, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS cost FROM orders GROUP BY 1, 2""")
def costs_by_bucket(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("bucket"), "o_orderpriority")
    return rows.agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("cost"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (200000, 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50""")
def sessions_page(spark, sf):
    after = (F.col("o_totalprice") < 200000) | ((F.col("o_totalprice") == 200000) & (F.col("o_orderkey") < 0))
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").where(after).orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(50)


@query("""SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('click', 'error') AND value >= 10 AND user_id % 4 = 1 AND contains(lower(props), '"k": 7') ORDER BY value DESC, event_id LIMIT 25""")
def impact_filter(spark, sf):
    rows = table(spark, sf, "events").where("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-20' and event_type in ('click', 'error') and value >= 10 and user_id % 4 = 1")
    rows = rows.where(F.lower("props").contains('"k": 7'))
    return rows.orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "event_type", "value")


@query("""WITH r AS (SELECT conv_id, turn, sum(ceil(length(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS upto FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 4 < 3) SELECT conv_id, count(*) AS turns, max(upto)::BIGINT AS tokens FROM r WHERE upto <= 400 GROUP BY 1""")
def context_budget(spark, sf):
    rows = table(spark, sf, "conversations").where("role in ('user', 'assistant') and conv_id % 4 < 3").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("t"))
    upto = F.sum("t").over(windows.Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(windows.Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).where("upto <= 400").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("upto").alias("tokens"))


@query("""SELECT event_id, field, value FROM (SELECT event_id, unnest(['event_type', 'day', 'user']) AS field, unnest([event_type, strftime(ts, '%Y-%m-%d'), user_id::VARCHAR]) AS value FROM events) WHERE value IS NOT NULL""")
def facts_eav(spark, sf):
    facts = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in (("event_type", F.col("event_type")), ("day", F.date_format("ts", "yyyy-MM-dd")), ("user", F.col("user_id").cast("string")))])
    return table(spark, sf, "events").select("event_id", F.inline(facts)).where("value is not null")


@query("""WITH r AS (SELECT user_id, event_id, sum(strlen(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 1 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, count(*) AS facts, max(size)::BIGINT AS bytes FROM r WHERE n = 1 OR (n <= 24 AND size <= 120) GROUP BY 1""")
def fact_trim(spark, sf):
    by = windows.Window.partitionBy("user_id").orderBy("event_id")
    size = F.sum(F.octet_length("props") + 1).over(by.rowsBetween(windows.Window.unboundedPreceding, 0)) + 1
    rows = table(spark, sf, "events").select("user_id", size.alias("size"), F.row_number().over(by).alias("n"))
    return rows.where("n = 1 or (n <= 24 and size <= 120)").groupBy("user_id").agg(F.count("*").alias("facts"), F.max("size").alias("bytes"))


@query("""SELECT event_type, count(*) AS n, min(ts::DATE) AS first_day FROM (SELECT event_type, ts - to_days((event_id % 120)::INTEGER) AS ts FROM events) WHERE ts::DATE BETWEEN DATE '2024-01-25' - 91 AND DATE '2024-01-25' GROUP BY 1""")
def window_filter(spark, sf):
    day = F.date_sub(F.to_date("ts"), (F.col("event_id") % 120).cast("int"))
    rows = transcripts_ops.in_window(table(spark, sf, "events").select("event_type", day.alias("day")), F.lit("2024-01-25").cast("date"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))


@query("SELECT count(*) AS kept, count(DISTINCT user_id) AS sessions FROM (SELECT user_id, CASE WHEN event_id % 7 > 0 THEN ts - to_days((event_id % 200)::INTEGER) END AS t FROM events) WHERE t >= TIMESTAMP '2024-01-20' - INTERVAL 90 DAY")
def watermark_retention(spark, sf):
    t = F.when(F.col("event_id") % 7 > 0, F.timestamp_add("DAY", (-(F.col("event_id") % 200)).cast("int"), F.col("ts")))
    rows = table(spark, sf, "events").select("user_id", t.alias("t")).where(F.col("t") >= F.lit("2024-01-20").cast("timestamp_ntz") - F.expr("interval 90 days"))
    return rows.agg(F.count("*").alias("kept"), F.count_distinct("user_id").alias("sessions"))


@query("""SELECT c_custkey, (('0x' || substr(sha256('cadence.phase:v1' || c_name), 1, 16))::UBIGINT % 300)::BIGINT AS phase FROM customer""")
def cadence_phase(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numbers.phase(F.col("c_name"), 300, "cadence.phase:v1").alias("phase"))


@query("""SELECT source, sum(ceil(length(text) / 4))::BIGINT AS tokens FROM documents GROUP BY source ORDER BY tokens DESC, source LIMIT 10""")
def top_files(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source").agg(F.sum(text.token_estimate(F.col("text"))).alias("tokens"))
    return rows.orderBy(F.desc("tokens"), "source").limit(10)


@query("""WITH o AS (SELECT c_custkey, max(o_totalprice) AS p, bool_or(o_orderstatus = 'P') AS d, count(*) AS n FROM (SELECT o_custkey AS c_custkey, * FROM orders) WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1),
n AS (SELECT c_custkey, max(o_totalprice) FILTER (o_orderstatus <> 'F') AS p, bool_or(o_orderstatus = 'P') AS d, count(*) AS n FROM (SELECT o_custkey AS c_custkey, * FROM orders) WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT c_custkey, coalesce(n.p, o.p)::DECIMAL(18, 2) AS price, coalesce(n.d, false) OR coalesce(o.d, false) AS discovered, coalesce(n.n, o.n) AS n FROM o FULL JOIN n USING (c_custkey)""")
def source_upsert(spark, sf):
    rows, split = table(spark, sf, "orders").withColumn("c_custkey", F.col("o_custkey")), F.lit("2000-01-01").cast("timestamp")

    def side(part, price):
        return part.groupBy("c_custkey").agg(F.max(price).cast("decimal(18,2)").alias("price"), F.bool_or(F.col("o_orderstatus") == "P").alias("discovered"), F.count("*").alias("n"))

    old = side(rows.where(F.col("o_orderdate") < split), F.col("o_totalprice"))
    new = side(rows.where(F.col("o_orderdate") >= split), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    return joins.merge_latest(old, new, ["c_custkey"], ["price", "n"], either=["discovered"])


@query("""WITH m AS (SELECT event_id, n_name, CASE WHEN user_id % 25 = n_nationkey THEN 10 ELSE 0 END + CASE WHEN day(ts) % 5 = n_regionkey THEN 2 ELSE 0 END + CASE WHEN hour(ts) = n_nationkey THEN 1 ELSE 0 END AS score FROM events JOIN nation ON true),
t AS (SELECT *, max(score) OVER (PARTITION BY event_id) AS top FROM m WHERE score >= 3)
SELECT event_id, min(n_name) AS label, any_value(score)::INTEGER AS score FROM t WHERE score = top GROUP BY event_id HAVING count(DISTINCT n_name) = 1""")

def scored_match(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name")
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    user, day, hour = F.col("user_id") % 25, F.day("ts") % 5, F.hour("ts")
    points = [(user == F.col("n_nationkey"), 10), (day == F.col("n_regionkey"), 2), (hour == F.col("n_nationkey"), 1)]
    # three points need the first signal, or both others
    meet = [([user], [F.col("n_nationkey")]), ([day, hour], [F.col("n_regionkey"), F.col("n_nationkey")])]
    return joins.best_scored(events, "event_id", nation, "n_name", points, 3, meet)


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id + 1000000, turn, role, CASE WHEN turn < conv_id % 5 THEN text ELSE text || '!' END FROM conversations),
r AS (SELECT conv_id, role || chr(1) || text AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c),
b AS (SELECT c.conv_id, c.p, c.s IS NOT DISTINCT FROM o.s AND o.p IS NOT NULL AS same FROM r c LEFT JOIN r o ON o.conv_id = c.conv_id - 1000000 AND o.p = c.p),
e AS (SELECT conv_id, count(*) AS n, min(p) FILTER (NOT same) AS stop FROM b GROUP BY 1)
SELECT conv_id, coalesce(stop - 1, n) AS shared, n - coalesce(stop - 1, n) AS own FROM e""")
def prefix_split(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    forked = F.when(F.col("turn") < F.col("conv_id") % 5, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    rows = rows.union(rows.select((F.col("conv_id") + 1_000_000).alias("conv_id"), "turn", "role", forked.alias("text")))
    rows = rows.select("conv_id", "turn", F.sha2(digests.framed([F.col("role"), F.col("text")]), 256).alias("s"))
    parents = rows.select("conv_id").distinct().withColumn("parent", F.col("conv_id") - 1_000_000)
    return joins.common_prefix(rows, "conv_id", "turn", "s", parents, "parent")


@query("""WITH RECURSIVE d AS (SELECT coalesce(source, '') AS g, source, doc_id, coalesce(strlen(text), 0) + 1 AS n, row_number() OVER (PARTITION BY source ORDER BY sha256(coalesce(text, '')), doc_id) AS r FROM documents),
f AS (SELECT g, source, doc_id, r, n, 0 AS batch, 1 AS k, n AS total FROM d WHERE r = 1
UNION ALL SELECT d.g, d.source, d.doc_id, d.r, d.n, CASE WHEN x THEN f.batch + 1 ELSE f.batch END, CASE WHEN x THEN 1 ELSE f.k + 1 END, CASE WHEN x THEN d.n ELSE f.total + d.n END
FROM f JOIN d ON d.g = f.g AND d.r = f.r + 1, LATERAL (SELECT f.k >= 50 OR f.total + d.n > 2097150 AS x))
SELECT source, doc_id, n::BIGINT AS size, batch::BIGINT AS batch FROM f""")
def pack_items(spark, sf):
    body = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select("source", "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.sha2(body, 256).alias("fingerprint"))
    return packing.greedy_batches(docs, "source", ["fingerprint", "doc_id"], "size", 50, (2 << 20) - 2).drop("fingerprint")


@query("""WITH RECURSIVE d AS (SELECT event_type AS g, CAST(ts AS DATE) + (user_id % 9 * 40)::INTEGER AS day, count(*) % 50 + 1 AS n FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY day) AS r FROM d),
f AS (SELECT g, r, day, n, 0 AS batch, DATE '2023-12-01' AS start, n AS total FROM o WHERE r = 1
UNION ALL SELECT o.g, o.r, o.day, o.n, CASE WHEN x THEN f.batch + 1 ELSE f.batch END, CASE WHEN x THEN o.day ELSE f.start END, CASE WHEN x THEN o.n ELSE f.total + o.n END
FROM f JOIN o ON o.g = f.g AND o.r = f.r + 1, LATERAL (SELECT f.total + o.n > 60 OR o.day - f.start + 1 > 200 AS x)),
b AS (SELECT g, batch, min(start) AS first_day, sum(n)::BIGINT AS n, count(*) AS days FROM f GROUP BY 1, 2)
SELECT g AS event_type, batch, first_day, coalesce(lead(first_day) OVER (PARTITION BY g ORDER BY batch) - 1, DATE '2025-06-30') AS last_day, n, days FROM b""")
def pack_days(spark, sf):
    day = F.date_add(F.to_date("ts"), (F.col("user_id") % 9 * 40).cast("int"))
    days = table(spark, sf, "events").groupBy("event_type", day.alias("day")).agg((F.count("*") % 50 + 1).alias("n"))  # no day is over a batch's size
    return packing.day_batches(days, "event_type", "day", "n", F.lit("2023-12-01").cast("date"), F.lit("2025-06-30").cast("date"), most_rows=60)


@query(f"""SELECT c_custkey, sha256(unhex('{bytes(b ^ 0x5C for b in b"install-key".ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in b"install-key".ljust(64, bytes(1))).hex()}') || encode(c_name)))) AS opaque_id FROM customer""")
def hmac_ids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", digests.hmac_sha256(b"install-key", F.col("c_name")).alias("opaque_id"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '{"a":[{"b":"x, y: ' || event_type || '","c":null},true],"k":' || event_id || ',"é":-1}' ELSE '{"k":' || json_extract(props, '$.k')::VARCHAR || '}' END AS canonical FROM events""")
def canonical_json(spark, sf):
    made = F.expr("""CASE WHEN event_id % 5 = 0 THEN concat('{"k":1,"k":', event_id, '}') WHEN event_id % 5 = 1 THEN concat(' {"é" : -1, "k":', event_id, ', "a": [ {"c":null , "b":"x, y: ', event_type, '"}, true ] }') ELSE props END""")
    return table(spark, sf, "events").select("event_id", digests.canonical_json(made).alias("canonical"))


# further queries, by subject
from quillmeter.plans import attribution, canonical, checks, cloud, definitions, evidence, provider, redaction, repositories, rollup, scalars, state, streams, traces, transcripts, uploads, usage  # noqa: E402

__all__ = ["ORACLE", "QUERIES", "attribution", "canonical", "checks", "cloud", "definitions", "evidence", "provider", "redaction", "repositories", "rollup", "scalars", "state", "streams", "traces", "transcripts", "uploads", "usage"]
