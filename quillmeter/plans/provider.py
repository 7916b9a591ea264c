"""Queries over daily provider reports: their JSON objects are made from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.operators import provider
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

_SURFACES = {"desktop_app": "desktop", "cli": "cli", "web": "web"}
_REPORT = """concat('{"date":"', CASE WHEN event_id % 10 = 0 THEN 'soon' ELSE concat(substr(concat('', ts), 1, 10), 'T00:00:00Z') END, '","client_id":"', CASE user_id % 4 WHEN 0 THEN 'Desktop_App' WHEN 1 THEN 'CLI' WHEN 2 THEN ' web ' ELSE 'zzz' END,
'","model":"', CASE WHEN event_id % 7 = 0 THEN '__all__' ELSE concat('M ', user_id % 3) END, '"', CASE event_id % 3 WHEN 0 THEN concat(',"input_tokens":', event_id) WHEN 1 THEN concat(',"uncached_input_tokens":', event_id, ',"input_tokens":1') ELSE concat(',"mystery_', event_id % 20, '":1') END,
CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(',"output_tokens":', event_id % 5) END, CASE WHEN user_id % 5 = 0 THEN ',"turns":-1' ELSE ',"turns":2,"credits":0.25' END, '}')"""
_SQL = """WITH r AS (SELECT event_id, CASE WHEN event_id % 10 > 0 THEN strftime(ts, '%Y-%m-%d') END AS day, CASE user_id % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'cli' WHEN 2 THEN 'web' ELSE 'other' END AS surface,
CASE WHEN event_id % 7 > 0 THEN 'm-' || (user_id % 3) END AS model, CASE WHEN event_id % 3 < 2 THEN event_id END AS input_tokens, CASE WHEN event_id % 4 > 0 THEN event_id % 5 END AS output_tokens,
CASE WHEN user_id % 5 > 0 THEN 2 END AS turns, CASE WHEN user_id % 5 > 0 THEN 0.25::DECIMAL(18, 6) END AS credits FROM events),
c AS (SELECT * FROM r WHERE day BETWEEN '2024-01-03' AND '2024-01-20'),
g AS (SELECT 'day' AS grain, day, NULL::VARCHAR AS surface, NULL::VARCHAR AS model, * EXCLUDE (day, surface, model) FROM c UNION ALL SELECT 'surface', day, surface, NULL, * EXCLUDE (day, surface, model) FROM c
UNION ALL SELECT 'model', day, NULL, model, * EXCLUDE (day, surface, model) FROM c WHERE model IS NOT NULL UNION ALL SELECT 'surface_model', day, surface, model, * EXCLUDE (day, surface, model) FROM c WHERE model IS NOT NULL),
s AS (SELECT grain, day, surface, model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(turns)::BIGINT AS turns, sum(credits)::DECIMAL(38, 6) AS credits, count(*) AS n FROM g GROUP BY 1, 2, 3, 4)
"""


def _readings(spark, sf):
    return provider.readings(table(spark, sf, "events").select(F.try_parse_json(F.expr(_REPORT)).alias("value")), "value", _SURFACES)


@query(_SQL + "SELECT * FROM s")
def provider_grains(spark, sf):
    return provider.grains(provider.covered(_readings(spark, sf), "2024-01-03", "2024-01-20"))


@query(
    _SQL
    + """, k AS (SELECT day, sum(credits) AS credits, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(turns)::BIGINT AS turns FROM s WHERE grain = 'surface' AND surface <> 'other' GROUP BY 1),
m AS (SELECT s.day, p.pos, p.metric, p.provider, p.clients FROM s JOIN k ON k.day = s.day, LATERAL (VALUES (0, 'credits', s.credits::DECIMAL(28, 6)::VARCHAR, k.credits::DECIMAL(28, 6)::VARCHAR), (1, 'input_tokens', s.input_tokens::VARCHAR, k.input_tokens::VARCHAR),
(2, 'output_tokens', s.output_tokens::VARCHAR, k.output_tokens::VARCHAR), (3, 'turns', s.turns::VARCHAR, k.turns::VARCHAR)) p(pos, metric, provider, clients) WHERE s.grain = 'day')
SELECT day, metric, provider, clients FROM m WHERE provider <> clients ORDER BY day, pos LIMIT 12"""
)
def provider_totals_check(spark, sf):
    return provider.mismatches(provider.grains(provider.covered(_readings(spark, sf), "2024-01-03", "2024-01-20")))


@query(
    _SQL
    + """SELECT count(*) AS n, count(*) FILTER (day IS NULL) AS no_day, count(*) FILTER (day NOT BETWEEN '2024-01-03' AND '2024-01-20') AS outside, count(*) FILTER (surface = 'other') AS unknown_client, count(*) FILTER (model IS NULL) AS no_model,
count(*) FILTER (input_tokens IS NULL) AS no_input_tokens, count(*) FILTER (output_tokens IS NULL) AS no_output_tokens, count(*) FILTER (turns IS NULL) AS no_turns,
(SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT 'mystery_' || (event_id % 20) AS k FROM r WHERE event_id % 3 = 2 ORDER BY k LIMIT 12)) AS unknown_keys FROM r"""
)
def provider_accounting(spark, sf):
    return provider.accounting(_readings(spark, sf), "2024-01-03", "2024-01-20").withColumn("unknown_keys", F.array_join("unknown_keys", ","))


_WIRE = """CASE event_id % 6 WHEN 0 THEN concat('{"day":"', substr(concat('', ts), 1, 10), '","kind":"', event_type, '","n":', event_id, '}') WHEN 1 THEN concat('{"day":"', substr(concat('', ts), 1, 19), '"}') WHEN 2 THEN '{"kind":"view","note":"x"}'
WHEN 3 THEN concat('{"kind":["', event_type, '"]}') WHEN 4 THEN '{"n":null,"kind":"View"}' ELSE '{}' END"""


@query("SELECT event_id, event_id % 6 = 0 OR event_id % 6 = 5 AS content_free FROM events")
def content_free(spark, sf):
    classes = {"day": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "kind": "^[a-z]{1,12}$", "n": "^[0-9]+$"}
    return table(spark, sf, "events").select("event_id", provider.is_content_free(F.try_parse_json(F.expr(_WIRE)), classes).alias("content_free"))
