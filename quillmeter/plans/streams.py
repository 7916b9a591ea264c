"""Queries of page scans, session activity and bursts of changes, over whole tables; streams of the same rows give the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.plans.registry import query
from quillmeter.sources.tables import table
from quillmeter.streaming import activity, scans, watching

#: Pages of a user's list, one for each event: some are strangers, some lists repeat a cursor, break or end early.
_NUMBERED = "SELECT *, CASE WHEN event_id % 11 = 0 THEN -1 ELSE sum(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS p FROM events"
_PAGE = """CAST(user_id AS {string}) AS scan, event_id AS seq, CASE WHEN user_id % 9 = 4 THEN 'head' ELSE 'full' END AS mode, CASE WHEN user_id % 18 = 4 THEN event_type END AS known, CASE WHEN p < 0 THEN 'stranger' WHEN p > 0 THEN concat('c', p) END AS cursor,
CASE WHEN p >= 3 AND user_id % 5 = 1 THEN 'ambiguous' WHEN p >= 20 + user_id % 7 THEN 'terminal' ELSE 'next' END AS state, CASE WHEN p >= 3 AND user_id % 5 = 1 OR p >= 20 + user_id % 7 THEN NULL WHEN p = 7 AND user_id % 8 = 2 THEN 'c3' ELSE concat('c', p + 1) END AS next,
NOT (p = 5 AND user_id % 10 = 3) AND NOT (p = 0 AND user_id % 25 = 7) AS valid, p = 9 AND user_id % 6 = 5 AS truncated, event_type AS digest, {list}(concat('e', floor(value)), event_type, concat('k', event_id % 13), concat('e', floor(value))) AS entities"""
_DUCK_PAGE = _PAGE.format(string="VARCHAR", list="list_value").replace("floor(value)", "floor(value)::BIGINT")

#: The rule of a scan: from page to page by cursor, with all that was seen carried along.
_WALK = f"""n AS ({_NUMBERED}), g AS (SELECT {_DUCK_PAGE} FROM n),
f AS (SELECT a.scan, a.seq, min(b.seq) AS then FROM g a JOIN g b ON a.scan = b.scan AND a.next = b.cursor AND b.seq > a.seq GROUP BY 1, 2),
s AS (SELECT scan, min(seq) AS seq FROM g WHERE cursor IS NULL GROUP BY 1),
w AS (SELECT g.*, 1 AS page, CASE WHEN valid THEN [next] ELSE [] END AS seen, CASE WHEN valid THEN list_distinct(entities) ELSE []::VARCHAR[] END AS keys, false AS churn FROM s JOIN g USING (scan, seq)
UNION ALL SELECT g.*, w.page + 1, list_append(w.seen, g.next), CASE WHEN g.valid THEN list_distinct(list_concat(w.keys, g.entities)) ELSE w.keys END, g.next IS NOT NULL AND list_contains(w.seen, g.next)
FROM w JOIN f USING (scan, seq) JOIN g ON g.scan = w.scan AND g.seq = f.then WHERE w.valid AND w.state = 'next' AND w.mode = 'full' AND NOT w.truncated AND NOT w.churn AND w.page < 100 AND len(w.keys) < 2000),
e AS (SELECT *, CASE WHEN NOT valid THEN CASE WHEN len(keys) > 0 THEN 'degraded' ELSE 'failed' END WHEN state = 'ambiguous' THEN 'degraded' WHEN mode = 'head' AND digest IS NOT NULL AND digest IS NOT DISTINCT FROM known THEN 'unchanged' WHEN state = 'terminal' AND NOT truncated AND NOT churn THEN 'healthy'
WHEN mode = 'head' OR truncated OR churn OR len(keys) >= 2000 OR page >= 100 THEN 'degraded' END AS outcome, CASE WHEN NOT valid THEN 'invalid' WHEN state = 'ambiguous' THEN 'ambiguous' WHEN mode = 'head' AND digest IS NOT DISTINCT FROM known THEN NULL WHEN state = 'terminal' AND NOT truncated AND NOT churn THEN NULL
WHEN mode = 'head' THEN 'head' WHEN truncated THEN 'truncated' WHEN churn THEN 'cursor repeated' WHEN len(keys) >= 2000 THEN 'keys' WHEN page >= 100 THEN 'pages' END AS reason FROM w)"""


def _pages(spark, sf):
    numbered = table(spark, sf, "events")
    numbered.createOrReplaceTempView("_page_events")
    return spark.sql(_NUMBERED.replace("FROM events", "FROM _page_events")).selectExpr(*_split(_PAGE.format(string="STRING", list="array")))


def _split(exprs: str) -> list[str]:
    """Expressions between the commas outside of brackets."""
    out, depth, now = [], 0, ""
    for c in exprs:
        depth += (c == "(") - (c == ")")
        out, now = ([*out, now], "") if c == "," and not depth else (out, now + c)
    return [*out, now]


@query(f"WITH RECURSIVE {_WALK} SELECT scan, outcome, reason, (page - CASE WHEN valid THEN 0 ELSE 1 END)::INTEGER AS pages, len(keys)::INTEGER AS keys FROM e WHERE outcome IS NOT NULL")
def page_scan_ends(spark, sf):
    return scans.scanned(_pages(spark, sf)).where("outcome is not null").select("scan", "outcome", "reason", "pages", "keys")


@query(f"""WITH RECURSIVE {_WALK}, r AS (SELECT scan, page, unnest(entities) AS entity, unnest(range(len(entities))) AS place FROM e WHERE valid AND outcome IS DISTINCT FROM 'unchanged'),
l AS (SELECT scan, entity, max((page, place)) AS l FROM r GROUP BY 1, 2) SELECT scan, entity, l[1]::INTEGER AS page, l[2]::INTEGER AS place, ((row_number() OVER (PARTITION BY scan ORDER BY entity) - 1) // 200)::INTEGER AS chunk FROM l""")
def page_scans(spark, sf):
    return scans.chunks(scans.scanned(_pages(spark, sf))).select("scan", "entity", "page", "place", "chunk")


_AT = "ts - make_interval(0, 0, 0, 0, 0, CAST(event_id % 5 * 7 - CASE WHEN event_id % 13 = 0 THEN 36 ELSE 0 END AS INT), 0)"
_DUCK_AT = "ts - to_minutes((event_id % 5 * 7 - CASE WHEN event_id % 13 = 0 THEN 36 ELSE 0 END)::INTEGER)"


@query(f"""WITH r AS (SELECT user_id::VARCHAR AS session, event_id AS seq, date_trunc('second', {_DUCK_AT}) AS t, ts + to_days(CASE WHEN event_id % 50 = 0 THEN 100 ELSE 0 END) AS now FROM events WHERE event_id % 17 > 0),
h AS (SELECT *, max(t) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM r),
k AS (SELECT *, CASE WHEN h >= now - INTERVAL 90 DAY THEN h END AS k FROM h)
SELECT session, seq, strftime(k, '%Y-%m-%dT%H:%M:%SZ') AS previous, (k IS NULL OR t > k) AS advanced, (k IS NULL OR t > k) AND t >= now - INTERVAL 15 MINUTE AND t <= now + INTERVAL 5 MINUTE AS active FROM k""")
def activity_rows(spark, sf):
    said = F.when(F.col("event_id") % 17 == 0, "soon").otherwise(F.date_format(F.expr(_AT), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    now = F.expr("ts + make_interval(0, 0, 0, CAST(CASE WHEN event_id % 50 = 0 THEN 100 ELSE 0 END AS INT), 0, 0, 0)")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), said.alias("said"), now.alias("now"))
    return activity.advanced(rows).drop("said")


@query("""WITH c AS (SELECT event_type AS source, 'p' || (event_id * 7 % 40) AS path, epoch_us(ts) // 1000 AS t, event_id AS seq FROM events),
i AS (SELECT *, sum(g) OVER (PARTITION BY source ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS b FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY source ORDER BY t, seq) > 600000 THEN 1 ELSE 0 END AS g FROM c)),
o AS (SELECT source, b, path, min((t, seq)) AS o, min(t) AS f, max(t) AS l FROM i GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY source, b ORDER BY o) AS n FROM o)
SELECT source, min(f) AS first, max(l) AS last, (count(*) FILTER (n <= 12))::INTEGER AS paths, bool_or(n > 12) AS overflowed, max(path) FILTER (n <= 12) AS newest FROM n GROUP BY source, b""")
def path_bursts(spark, sf):
    changes = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.expr("concat('p', event_id * 7 % 40)").alias("path"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return watching.bursts(changes, quiet_ms=600_000, most=12)
