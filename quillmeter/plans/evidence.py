"""Queries over telemetry evidence and snapshots, made from ``events``, ``orders`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.operators import evidence, snapshots
from quillmeter.plans.registry import query
from quillmeter.sources import reports
from quillmeter.sources.tables import table

_BODY = """concat('{"resourceLogs":[{"resource":{"attributes":[{"key":"host","value":{"stringValue":"h', user_id % 3, '"}},{"key":"kind","value":{"stringValue":"resource"}}]},"scopeLogs":[{"logRecords":[',
'{"timeUnixNano":"', 1700000000000000000 + event_id * 1000000007, '","body":{"stringValue":"', CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'api_request' END, '"},"attributes":[{"key":"id","value":{"intValue":"', event_id, '"}}',
CASE WHEN event_id % 2 = 0 THEN ',{"key":"kind","value":{"boolValue":true}}' ELSE ',{"key":"list","value":{"arrayValue":{"values":[]}}}' END, ']},{"observedTimeUnixNano":"1000","body":{"stringValue":"api_request"},"attributes":[]}]}]}]}')"""


@query("""WITH r AS (SELECT event_id, 0 AS l, 1700000000000000000 + event_id * 1000000007 AS t, 'h' || (user_id % 3) AS host, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'resource' END AS kind, event_id::VARCHAR AS id FROM events WHERE event_id % 3 > 0
UNION ALL SELECT event_id, 1, 1000, 'h' || (user_id % 3), 'resource', NULL FROM events)
SELECT event_id, l::INTEGER AS place, strftime(make_timestamp((t // 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN t % 1000000000 = 0 THEN '' ELSE '.' || rtrim(lpad((t % 1000000000)::VARCHAR, 9, '0'), '0') END || 'Z' AS at_, host, kind, id, 2 + (id IS NOT NULL)::INTEGER AS n FROM r""")
def log_records(spark, sf):
    found = evidence.log_records(table(spark, sf, "events").select("event_id", F.try_parse_json(F.expr(_BODY)).alias("body")), "body", "api_request")
    return found.select("event_id", F.col("place.l").alias("place"), F.col("at").alias("at_"), *[F.col("attributes")[k].alias(k) for k in ("host", "kind", "id")], F.size("attributes").alias("n"))


@query("""WITH l AS (SELECT o_custkey AS owner, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_custkey END AS session, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 8 END AS request, o_orderpriority AS fp, o_orderkey % 13 = 0 AS bad, o_orderkey AS n FROM orders),
u AS (SELECT owner, request FROM l WHERE NOT bad AND session = owner AND request IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT fp) > 1), c AS (SELECT owner, count(*) AS conflicting FROM u GROUP BY 1)
SELECT owner, count(*) AS lines, count(*) FILTER (bad) AS malformed, count(*) FILTER (NOT bad AND session <> owner) AS wrong_session, count(*) FILTER (NOT bad AND request IS NULL) AS missing_id, max(n) >= 14000 AS oversized, coalesce(any_value(c.conflicting), 0) AS conflicting FROM l LEFT JOIN c USING (owner) GROUP BY 1""")
def evidence_health(spark, sf):
    return evidence.report(_evidence(spark, sf), "session", "owner", "request", "fp", F.col("bad"), F.col("n"), 14_000)


@query("""SELECT owner, fp, min(n) AS n FROM (SELECT o_custkey AS owner, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_custkey END AS session, o_orderpriority AS fp, o_orderkey AS n FROM orders) WHERE session = owner GROUP BY 1, 2""")
def evidence_lines(spark, sf):
    return evidence.lenient(_evidence(spark, sf), "session", "owner", "fp", "n").select("owner", "fp", "n")


def _evidence(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("owner"), F.when(k % 7 == 0, -1).otherwise(F.col("o_custkey")).alias("session"), F.when(k % 5 > 0, k % 8).alias("request"), F.col("o_orderpriority").alias("fp"), (k % 13 == 0).alias("bad"), k.alias("n")
    )


@query("""WITH l AS (SELECT user_id AS request, ['low', 'HIGH', 'medium', 'none', 'max'][event_id % 5 + 1] AS effort, sha256(event_type) AS s, event_id FROM events) SELECT request, arg_min(effort, (s, event_id)) AS effort FROM l WHERE effort IN ('low', 'medium', 'high', 'xhigh', 'max') GROUP BY 1""")
def effort_by_request(spark, sf):
    effort = F.element_at(F.array(*map(F.lit, ("low", "HIGH", "medium", "none", "max"))), (F.col("event_id") % 5 + 1).cast("int"))
    lines = table(spark, sf, "events").select(F.col("user_id").alias("request"), effort.alias("effort"), evidence.shard(F.col("event_type")).alias("s"), "event_id")
    return evidence.effort_by_request(lines, "request", "effort", ["s", "event_id"])


@query("""WITH u AS (SELECT user_id, event_id, sum(strlen(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS u FROM events) SELECT user_id, event_id FROM u WHERE u + CASE WHEN user_id % 3 = 0 THEN 300 ELSE 0 END <= 500""")
def appended_evidence(spark, sf):
    sizes = table(spark, sf, "events").where("user_id % 3 = 0").select("user_id").distinct().withColumn("bytes", F.lit(300))
    return evidence.appended(table(spark, sf, "events").select("user_id", "event_id", "props"), sizes, "user_id", "props", "event_id", 500).select("user_id", "event_id")


@query("""WITH o AS (SELECT CASE WHEN event_id % 20 = 0 THEN user_id ELSE -1 - event_id END AS request, min(event_type) AS owner FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 1), t AS (SELECT o_custkey AS request, max(o_totalprice)::DECIMAL(18, 2) AS cost FROM orders GROUP BY 1)
SELECT c_custkey AS request, owner, cost FROM customer LEFT JOIN o ON o.request = c_custkey LEFT JOIN t ON t.request = c_custkey""")
def attributed_requests(spark, sf):
    owners = table(spark, sf, "events").select(F.expr("CASE WHEN event_id % 20 = 0 THEN user_id ELSE -1 - event_id END").alias("request"), F.col("event_type").alias("owner"))
    costs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("request")).agg(F.max("o_totalprice").cast("decimal(18,2)").alias("cost"))
    return evidence.attributed(table(spark, sf, "customer").select(F.col("c_custkey").alias("request")), owners, costs, "request")


#: The seven parts of a snapshot, of a customer's own columns, and what is stored of them: older values, nothing, or the same.
_PARTS = {"usage": "c_acctbal", "timing": "c_custkey * 7", "model": "c_mktsegment", "compaction": "c_custkey % 11", "title": "c_name", "labels": "c_nationkey", "attribution": "concat(c_mktsegment, c_nationkey)"}
_STORED = {"usage": "CASE WHEN c_acctbal < 0 THEN 0.5 ELSE c_acctbal END", "timing": "c_custkey * 7 - c_custkey % 9 % 2", "model": "CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END", "compaction": "c_custkey % 10", "title": "CASE WHEN c_custkey % 13 = 0 THEN upper(c_name) ELSE c_name END", "labels": "c_nationkey", "attribution": "concat(lower(c_mktsegment), c_nationkey)"}
_DIFFERS = ", ".join(f"CASE WHEN ({_PARTS[p]}) IS DISTINCT FROM (CASE WHEN c_custkey % 8 > 0 THEN {_STORED[p]} END) THEN '{p}' END" for p in _PARTS)


@query(f"""WITH c AS (SELECT c_custkey, array_to_string(list_filter([{_DIFFERS}], lambda x: x IS NOT NULL), ',') AS changed FROM customer) SELECT * FROM c WHERE changed <> ''""")
def changed_snapshots(spark, sf):
    rows = table(spark, sf, "customer")
    hashed = lambda df, made: df.select("c_custkey", *snapshots.component_hashes({p: F.expr(e) for p, e in made.items()}).values())
    stored = hashed(rows.where("c_custkey % 8 > 0"), _STORED)
    return snapshots.changed(hashed(rows, _PARTS), stored, "c_custkey", list(_PARTS)).withColumn("changed", F.array_join("changed", ","))


@query("""WITH r AS (SELECT DISTINCT 'machine' || (user_id % 4) AS scope, event_type AS source, 'sha256:' || sha256(user_id::VARCHAR) AS fp FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12')
SELECT scope, source, sha256(unhex(printf('%08x', 11) || hex(encode('manifest/v1')) || printf('%08x', strlen(scope)) || hex(encode(scope)) || printf('%08x', strlen(source)) || hex(encode(source)) || string_agg(printf('%08x', strlen(fp)) || hex(encode(fp)), '' ORDER BY fp))) AS digest, count(*) AS n FROM r GROUP BY 1, 2""")
def window_manifest(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit("machine"), F.col("user_id") % 4).alias("scope"), F.col("event_type").alias("source"), F.concat(F.lit("sha256:"), F.sha2(F.col("user_id").cast("string"), 256)).alias("fp"), "ts")
    return snapshots.manifest(rows, "scope", "source", "fp", "ts", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"), "manifest/v1")


@query("""WITH s AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'done' WHEN c_custkey % 4 = 0 THEN 'retry' WHEN c_custkey % 5 = 0 THEN 'empty' ELSE 'retry' END AS s FROM customer) SELECT count(*) AS scanned, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'empty') AS empty, count(*) FILTER (s = 'retry') AS retry FROM s""")
def scan_counts(spark, sf):
    k = F.col("c_custkey")
    files = snapshots.file_status(table(spark, sf, "customer"), "c_custkey", (k % 4 == 0).cast("int"), (k % 3 == 0).cast("int"), k % 5 == 0)
    return snapshots.sync_counts(files, "status")


_CRON = """CASE c_custkey % 8 WHEN 0 THEN concat(c_custkey % 60, ' ', c_custkey % 24, ' * * *  run   job ', c_custkey) WHEN 1 THEN '*/5 * * * * x' WHEN 2 THEN '# 1 2 3 4 5 x' WHEN 3 THEN concat('  0 9 1 1 ', c_custkey % 9, ' backup') WHEN 4 THEN '1,2 * * * * x' WHEN 5 THEN 'PATH=/bin' WHEN 6 THEN '60 1 * * * x' ELSE '* * * * 7 a b' END"""


@query("""WITH c AS (SELECT c_nationkey, c_custkey, c_custkey % 8 AS k FROM customer) SELECT c_nationkey AS file, c_custkey AS number, CASE k WHEN 0 THEN c_custkey % 60 WHEN 3 THEN 0 END::INTEGER AS minute, CASE k WHEN 0 THEN c_custkey % 24 WHEN 3 THEN 9 END::INTEGER AS hour, CASE k WHEN 3 THEN 1 END::INTEGER AS day, CASE k WHEN 3 THEN 1 END::INTEGER AS month,
CASE k WHEN 3 THEN c_custkey % 9 WHEN 7 THEN 7 END::INTEGER AS weekday, CASE k WHEN 0 THEN 'run job ' || c_custkey WHEN 3 THEN 'backup' ELSE 'a b' END AS command FROM c WHERE k = 0 OR k = 7 OR (k = 3 AND c_custkey % 9 < 8) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 20""")
def crontab_rows(spark, sf):
    lines = table(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("number"), F.expr(_CRON).alias("line"))
    return reports.crontab(lines, "file", "number", "line", 20)


_MARK = """CASE c_custkey % 6 WHEN 0 THEN concat('### Section ', c_custkey % 4) WHEN 1 THEN '| Tool | Tokens | % |' WHEN 2 THEN '|---|---|---|' WHEN 3 THEN concat('| **tool', c_custkey, '** | ', c_custkey % 50, '.5k | 1% |') WHEN 4 THEN concat('| x', c_custkey, ' | note | ', c_custkey, ' tokens |') ELSE 'text' END"""


@query("""WITH c AS (SELECT c_nationkey AS file, c_custkey AS number, last_value(CASE WHEN c_custkey % 6 = 0 THEN 'Section ' || (c_custkey % 4) END IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS section FROM customer)
SELECT file, number, section, CASE WHEN number % 6 = 3 THEN 'tool' ELSE 'x' END || number AS name, CASE WHEN number % 6 = 3 THEN (number % 50) * 1000 + 500 ELSE number END AS tokens FROM c WHERE number % 6 IN (3, 4) AND section IS NOT NULL""")
def context_tables(spark, sf):
    lines = table(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("number"), F.expr(_MARK).alias("line"))
    return reports.context_tables(lines, "file", "number", "line")


_HEAD = """CASE c_custkey % 5 WHEN 0 THEN concat(' **Model:** `m-', c_custkey % 7, '` ') WHEN 1 THEN concat('**Tokens:** ', c_custkey % 90, '.5k / ', 1 + c_custkey % 3, 'm (', c_custkey % 100, '%)') WHEN 2 THEN concat('**Tokens:** ', c_custkey, ' / 100k (', c_custkey % 9, '.25 %)')
WHEN 3 THEN CASE WHEN c_custkey % 3 = 0 THEN '**Tokens:** many / 1m (4%)' ELSE '**Tokens:** 5 / 9' END ELSE '**Model:** ' END"""


@query("""WITH c AS (SELECT c_nationkey AS file, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'm-' || (c_custkey % 7) END AS model, CASE c_custkey % 5 WHEN 1 THEN (c_custkey % 90) * 1000 + 500 WHEN 2 THEN c_custkey END AS used, CASE c_custkey % 5 WHEN 1 THEN (1 + c_custkey % 3) * 1000000 WHEN 2 THEN 100000 END AS w,
CASE c_custkey % 5 WHEN 1 THEN (c_custkey % 100)::DOUBLE WHEN 2 THEN c_custkey % 9 + 0.25 END AS percent FROM customer)
SELECT file, arg_max(model, k) FILTER (model IS NOT NULL) AS model, arg_max(used, k) FILTER (used IS NOT NULL) AS used, arg_max(w, k) FILTER (w IS NOT NULL) AS "window", (arg_max(percent, k) FILTER (percent IS NOT NULL))::DOUBLE AS percent FROM c GROUP BY file""")
def context_headlines(spark, sf):
    lines = table(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("number"), F.expr(_HEAD).alias("line"))
    return reports.context_headlines(lines, "file", "number", "line")
