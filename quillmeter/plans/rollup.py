"""Queries from raw transcript lines to hours and sessions of usage; the lines are JSON texts made from all ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.operators import rollup
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

_STAMP = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_N = "CAST(floor(value) AS BIGINT)"
#: A user's lines are of one kind; some are of no use: other types, no usage, no model.
_LINE = f"""CASE WHEN event_id % 31 = 0 THEN '{{"type":"summary"}}' WHEN event_id % 37 = 0 THEN '{{broken' WHEN user_id % 3 = 0 THEN concat('{{"type":"assistant","timestamp":"', {_STAMP}, '","requestId":"r', event_id div 500, '","message":{{"id":"m', event_id div 500, '","model":"', event_type,
'","usage":{{"input_tokens":', 100 + event_id % 7, ',"cache_read_input_tokens":', event_id % 50, ',"cache_creation":{{"ephemeral_5m_input_tokens":', event_id % 5, ',"ephemeral_1h_input_tokens":', event_id % 3, '}},"output_tokens":', {_N}, '}}}}}}')
WHEN user_id % 3 = 1 THEN concat('{{"type":"event_msg","timestamp":"', {_STAMP}, '","payload":{{"type":"token_count","info":{{', CASE WHEN event_id % 41 = 0 THEN '' ELSE concat('"model":"', event_type, '",') END,
CASE WHEN event_id % 4 = 0 THEN concat('"last_token_usage":{{"input_tokens":', event_id % 90, ',"cached_input_tokens":', event_id % 60, ',"output_tokens":7}},') ELSE '' END, '"total_token_usage":{{"input_tokens":', event_id % 1000 * 10, ',"cached_input_tokens":', event_id % 1000 * 4, ',"output_tokens":', event_id % 700, '}}}}}}}}')
ELSE concat('{{"type":"message', CASE WHEN event_id % 5 < 2 THEN '_end' ELSE '' END, '","message":{{"role":"', CASE WHEN event_id % 29 = 0 THEN 'user' ELSE 'assistant' END, '","responseId":"p', event_id div 300, '","model":"', event_type, '","timestamp":', unix_seconds(CAST(ts AS TIMESTAMP)) * 1000,
',"usage":{{"input":', event_id % 11, ',"output":', {_N}, ',"cacheRead":3,"cacheWrite":', event_id % 2, ',"cost":{{', CASE WHEN event_id % 40 = 0 THEN '' ELSE concat('"total":0.', lpad(CAST(event_id % 99991 AS STRING), 6, '0'), '5') END, '}}}}}}}}') END"""

#: The rules of the three kinds, from the fields that the lines were made of.
_ROWS = """e AS (SELECT *, date_trunc('second', ts)::TIMESTAMP AS t, floor(value)::BIGINT AS v FROM events WHERE event_id % 31 > 0 AND event_id % 37 > 0),
a AS (SELECT 'first' AS source, user_id AS file, max((event_id, t, event_type, 100 + event_id % 7, event_id % 50, event_id % 5 + event_id % 3, v)) AS l FROM e WHERE user_id % 3 = 0 GROUP BY user_id, event_id // 500),
b AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN event_id % 90 END AS li, CASE WHEN event_id % 4 = 0 THEN event_id % 60 END AS lc, CASE WHEN event_id % 4 = 0 THEN 7 END AS lo, event_id % 1000 * 10 AS ti, event_id % 1000 * 4 AS tc, event_id % 700 AS txo FROM e WHERE user_id % 3 = 1),
g AS (SELECT *, coalesce(lag(ti) OVER w, 0) AS pi, coalesce(lag(tc) OVER w, 0) AS pc, coalesce(lag(txo) OVER w, 0) AS po FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT *, coalesce(li, CASE WHEN ti < pi THEN ti ELSE ti - pi END) AS ui, coalesce(lc, CASE WHEN tc < pc THEN tc ELSE tc - pc END) AS uc, coalesce(lo, CASE WHEN txo < po THEN txo ELSE txo - po END) AS uo FROM g),
p AS (SELECT user_id AS file, greatest(count(*) FILTER (event_id % 5 >= 2), count(*) FILTER (event_id % 5 < 2)) AS n, max(event_id) AS last FROM e WHERE user_id % 3 = 2 AND event_id % 29 > 0 GROUP BY user_id, event_id // 300),
r AS (SELECT source, file, l[2] AS t, l[3] AS model, l[4] AS input, l[5] AS cached, l[6] AS written, l[7] AS output, NULL::DECIMAL(38, 0) AS pico FROM a
UNION ALL SELECT 'second', user_id, t, event_type, ui - least(ui, uc), least(ui, uc), 0, uo, NULL FROM h WHERE event_id % 41 > 0
UNION ALL SELECT 'third', p.file, t, event_type, event_id % 11, 3, event_id % 2, v, CASE WHEN event_id % 40 > 0 THEN (event_id % 99991 * 10 + 5)::DECIMAL(38, 0) * 100000 END FROM p JOIN e ON e.event_id = p.last, range(n) x(i))"""


def _lines(spark, sf):
    made = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("ordinal"), F.try_parse_json(F.expr(_LINE)).alias("value"))
    return made.where("value is not null")


@query(f"""WITH {_ROWS} SELECT date_trunc('hour', t)::TIMESTAMP AS hour, source, file, model, sum(input)::BIGINT AS input, sum(cached)::BIGINT AS cached, sum(written)::BIGINT AS written, sum(output)::BIGINT AS output,
CASE WHEN count(pico) = count(*) THEN sum(pico)::DECIMAL(38, 0) END AS pico, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""")
def usage_from_lines(spark, sf):
    return rollup.hours(rollup.responses(_lines(spark, sf)))


@query(f"""WITH {_ROWS} SELECT source, file, count(DISTINCT model)::INTEGER AS models, count(DISTINCT date_trunc('hour', t))::INTEGER AS hours, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, true AS agrees FROM r GROUP BY 1, 2""")
def usage_sessions(spark, sf):
    made = rollup.sessions(rollup.responses(_lines(spark, sf)))
    inner = F.flatten(F.transform("buckets", lambda b: b["models"]))
    total = lambda c: F.aggregate(inner, F.lit(0).cast("long"), lambda s, m: s + m[c]).alias(c)
    return made.select("source", "file", F.size("models").alias("models"), F.size("buckets").alias("hours"), total("input"), total("output"), "agrees")


@query(f"""WITH {_ROWS}, l AS (SELECT source, file, model, NULL::TIMESTAMP AS hour, input, cached, written, output FROM r UNION ALL SELECT source, file, model, date_trunc('hour', t)::TIMESTAMP, input, cached, written, output FROM r)
SELECT source, file, model, hour, sum(input)::BIGINT AS input, sum(cached)::BIGINT AS cached, sum(written)::BIGINT AS written, sum(output)::BIGINT AS output, count(*) AS n FROM l GROUP BY 1, 2, 3, 4""")
def usage_levels(spark, sf):
    return rollup.levels(rollup.responses(_lines(spark, sf)))
