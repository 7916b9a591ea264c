"""Queries that derive facts of sessions: headers are made from ``customer`` and ``events``, prompts from ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.operators import attribution
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

_AGENT = "CASE c_custkey % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'pi' END"
_ORIGINATOR = "CASE c_custkey % 5 WHEN 0 THEN ' Codex Desktop' WHEN 1 THEN 'codex-TUI' WHEN 2 THEN 'codex_exec' ELSE 'x' END"
_SOURCE = "CASE c_custkey % 4 WHEN 0 THEN 'EXEC' WHEN 1 THEN 'cli' ELSE 'vscode' END"
_ENTRY = "CASE c_custkey % 4 WHEN 0 THEN 'cli' WHEN 1 THEN 'sdk-cli' WHEN 2 THEN 'claude-desktop' ELSE 'other' END"
_THREAD = "CASE c_custkey % 7 WHEN 0 THEN 'automation' WHEN 1 THEN 'subagent' ELSE 'user' END"


@query(f"""WITH h AS (SELECT c_custkey, c_name, {_AGENT} AS agent, lower(trim({_ORIGINATOR})) AS o, lower({_SOURCE}) AS s, {_ENTRY} AS e, {_THREAD} AS t FROM customer),
p AS (SELECT *, CASE agent WHEN 'codex' THEN CASE WHEN o = 'codex desktop' THEN 'codex_desktop' WHEN o = 'codex-tui' THEN 'codex_cli' WHEN o = 'codex_exec' THEN o WHEN s = 'exec' THEN 'codex_exec' WHEN s = 'cli' THEN 'codex_cli' END
WHEN 'claude' THEN CASE e WHEN 'cli' THEN 'claude_cli' WHEN 'sdk-cli' THEN 'claude_sdk' WHEN 'claude-desktop' THEN 'claude_desktop' END ELSE 'pi_cli' END AS surface FROM h),
f AS (SELECT c_name AS session, unnest([(1, 'origin_kind', CASE WHEN agent = 'codex' AND t = 'automation' THEN 'provider_scheduled_task' WHEN agent = 'codex' AND (t = 'subagent' OR c_custkey % 11 = 0) THEN 'subagent' WHEN agent = 'claude' AND c_custkey % 13 = 1 THEN 'subagent' END),
(2, 'scheduler_kind', CASE WHEN agent = 'codex' AND t = 'automation' THEN 'codex_scheduled' END), (3, 'provider_surface', surface),
(4, 'execution_mode', CASE WHEN agent = 'codex' AND surface = 'codex_exec' THEN 'headless' WHEN agent = 'claude' AND c_custkey % 8 = 0 THEN 'background' WHEN agent = 'claude' AND e = 'sdk-cli' THEN 'headless' END),
(5, 'parent_session_ref', CASE WHEN c_custkey % 6 = 0 THEN 'Customer#' || (c_custkey - 1) END), (6, 'workflow_orchestration', CASE WHEN c_custkey % 9 = 0 THEN 'dynamic' END)]) AS f FROM p)
SELECT session, (row_number() OVER (PARTITION BY session ORDER BY f[1]) - 1)::INTEGER AS place, f[2] AS field, f[3] AS value, CASE f[2] WHEN 'workflow_orchestration' THEN 'provider_artifact' ELSE 'provider_native' END AS kind,
'sha256:' || sha256('session-attribution-evidence:v1' || chr(0) || session || chr(0) || f[2] || chr(0) || f[3]) AS evidence FROM f WHERE f[3] IS NOT NULL""")
def provider_facts(spark, sf):
    x = F.expr
    parent = x("CASE WHEN c_custkey % 6 = 0 THEN concat('Customer#', c_custkey - 1) END")
    group = attribution.provider_facts(x(_AGENT), x(_THREAD), x("c_custkey % 11 = 0"), x("c_custkey % 13 = 1"), x(_ORIGINATOR), x(_SOURCE), x(_ENTRY), x("CASE WHEN c_custkey % 8 = 0 THEN 'bg' END"), parent, x("c_custkey % 9 = 0"))
    return attribution.facts(table(spark, sf, "customer"), "c_name", [group]).drop("label", "strength")


@query("""WITH w AS (SELECT CASE WHEN event_id % 37 = 0 THEN user_id ELSE -1 - event_id END AS worker, event_type AS kind, 'c' || min(event_id % 4) AS controller FROM events GROUP BY 1, 2), l AS (SELECT worker, min(kind) AS kind, min(controller) AS controller FROM w GROUP BY 1 HAVING count(*) = 1),
s AS (SELECT c_custkey, 'u' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '_agent-' || c_custkey ELSE '' END AS session, CASE WHEN c_custkey % 5 = 0 THEN 'root' || c_custkey END AS f FROM customer),
f AS (SELECT session, unnest([(1, 'root_session_ref', coalesce(f, split_part(session, '_agent-', 1))), (2, 'agent_kind', CASE WHEN c_custkey % 2 = 0 THEN 'Explore' ELSE repeat('é', 65) END), (3, 'agent_ref', session), (4, 'spawn_depth', (c_custkey % 3)::VARCHAR),
(5, 'parent_session_ref', controller), (6, 'origin_kind', CASE WHEN controller IS NOT NULL THEN 'agent_spawn' END), (7, 'agent_kind', kind)]) AS f FROM s LEFT JOIN l ON worker = c_custkey)
SELECT session, (row_number() OVER (PARTITION BY session ORDER BY f[1]) - 1)::INTEGER AS place, f[2] AS field, f[3] AS value FROM f WHERE f[3] IS NOT NULL AND strlen(f[3]) BETWEEN 1 AND 128""")
def subagent_facts(spark, sf):
    events = table(spark, sf, "events").groupBy(F.expr("CASE WHEN event_id % 37 = 0 THEN user_id ELSE -1 - event_id END").alias("worker"), F.col("event_type").alias("kind")).agg(F.concat(F.lit("c"), F.min(F.col("event_id") % 4)).alias("controller"))
    rows = table(spark, sf, "customer").selectExpr("c_custkey", "concat('u', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('_agent-', c_custkey) ELSE '' END) AS session", "CASE WHEN c_custkey % 5 = 0 THEN concat('root', c_custkey) END AS f")
    rows = rows.join(attribution.launched(events, "worker"), F.col("worker") == F.col("c_custkey"), "left")
    kind = F.when(F.col("c_custkey") % 2 == 0, "Explore").otherwise(F.repeat(F.lit("é"), F.lit(65)))
    tree = attribution.subagent_facts(attribution.root_session(F.col("session"), F.col("f")), kind, F.col("session"), F.lit(None).cast("string"), F.col("c_custkey") % 3)
    return attribution.facts(rows, "session", [tree, attribution.launch_facts(F.col("controller"), F.lit(None).cast("string"), F.col("kind"))]).select("session", "place", "field", "value")


@query("""WITH s AS (SELECT c_custkey, 't' || c_custkey AS session, CASE WHEN c_custkey % 3 = 0 THEN 'r' || (c_custkey // 3) END AS root, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 5 = 0 THEN repeat('x', 97) END AS label FROM customer),
f AS (SELECT session, unnest([(1, 'root_session_ref', root, NULL), (2, 'agent_kind', 'codex_subagent', CASE WHEN strlen(label) <= 96 THEN label END), (3, 'agent_ref', session, NULL), (4, 'spawn_depth', CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 4)::VARCHAR END, NULL)]) AS f FROM s)
SELECT session, (row_number() OVER (PARTITION BY session ORDER BY f[1]) - 1)::INTEGER AS place, f[2] AS field, f[3] AS value, f[4] AS label FROM f WHERE f[3] IS NOT NULL""")
def thread_facts(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey", "concat('t', c_custkey) AS session", "CASE WHEN c_custkey % 3 = 0 THEN concat('r', c_custkey div 3) END AS root", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 5 = 0 THEN repeat('x', 97) END AS label")
    depth = F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 4)
    return attribution.facts(rows, "session", [attribution.thread_facts(F.col("root"), F.col("session"), depth, F.col("label"))]).select("session", "place", "field", "value", "label")


_ASKED = "CASE conv_id % 4 WHEN 0 THEN concat('/Deploy now ', conv_id % 3) WHEN 1 THEN concat('Check order 2024-01-', 10 + conv_id % 9, ' today') WHEN 2 THEN '  ' ELSE concat('Please see src/a.py and ', conv_id % 2) END"
_GROUP_KEY = b"grouping-key"
_IN, _OUT = (bytes(b ^ x for b in _GROUP_KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(f"""WITH s AS (SELECT DISTINCT conv_id, CASE conv_id % 4 WHEN 0 THEN '/deploy now ' || (conv_id % 3) WHEN 1 THEN 'check order <dynamic> today' WHEN 3 THEN 'please see src/a.py and ' || (conv_id % 2) END AS template,
CASE conv_id % 4 WHEN 0 THEN '[path] now ' || (conv_id % 3) WHEN 1 THEN 'Check order 2024-01-' || (10 + conv_id % 9) || ' today' WHEN 3 THEN 'Please see [path] and ' || (conv_id % 2) END AS label FROM conversations),
f AS (SELECT conv_id::VARCHAR AS session, unnest([(1, 'template_group_id', sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode('template_group:' || template)))), CASE WHEN conv_id % 4 = 0 THEN '/Deploy now ' || (conv_id % 3) ELSE label END),
(2, 'schedule_definition_id', CASE WHEN conv_id % 10 = 1 THEN 'plan' || (conv_id % 3) END, NULL), (3, 'skill_id', 'a', NULL), (4, 'skill_id', CASE WHEN conv_id % 2 = 1 THEN 'b' END, NULL), (5, 'slash_skill', CASE WHEN conv_id % 4 = 0 THEN 'deploy' END, NULL),
(6, 'scheduler_kind', CASE WHEN conv_id % 3 > 0 THEN 'cron' END, NULL)]) AS f FROM s)
SELECT session, (row_number() OVER (PARTITION BY session ORDER BY f[1]) - 1)::INTEGER AS place, f[2] AS field, f[3] AS value, f[4] AS label FROM f WHERE f[3] IS NOT NULL""")
def grouping_facts(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.expr(_ASKED).alias("prompt")).distinct().withColumn("conv_id", F.col("session"))
    schedule = F.expr("CASE WHEN conv_id % 10 = 1 THEN concat('plan', conv_id % 3) END")
    skills = F.expr("array('a', 'a', CASE WHEN conv_id % 2 = 1 THEN 'b' ELSE 'a' END)")
    group = attribution.grouping_facts(_GROUP_KEY, F.col("prompt"), schedule, skills, F.expr("conv_id % 3 = 0"), F.lit("cron"))
    return attribution.facts(rows, "session", [group]).select("session", "place", "field", "value", "label")


_COMMAND = """CASE c_custkey % 5 WHEN 0 THEN concat('cd /x && codex exec ''Tidy up the whole repository number ', c_custkey, '''') WHEN 1 THEN concat('claude -p short', c_custkey) WHEN 2 THEN 'claude --print "old" ; claude --print "Write the weekly report of all changes"'
WHEN 3 THEN '(/usr/bin/Claude) --resume' ELSE 'make all' END"""


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'codex' WHEN 4 THEN NULL ELSE 'claude' END AS agent, CASE c_custkey % 5 WHEN 0 THEN 'tidy up the whole repository number ' || CASE WHEN c_custkey >= 1000 THEN '<dynamic>' ELSE c_custkey::VARCHAR END
WHEN 2 THEN 'write the weekly report of all changes' END AS prompt FROM customer""")
def scheduled_commands(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", attribution.provider_of(F.expr(_COMMAND)).alias("p")).select("c_custkey", "p.*")


@query("""WITH s AS (SELECT c_name AS session, CASE WHEN c_custkey % 3 = 0 THEN 'p' || (c_custkey % 10) END AS parent, CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN 'r' END AS root FROM customer)
SELECT session, session AS other FROM s UNION SELECT session, parent FROM s WHERE parent IS NOT NULL UNION SELECT session, root FROM s WHERE root IS NOT NULL""")
def evidence_sessions(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_name", "CASE WHEN c_custkey % 3 = 0 THEN concat('p', c_custkey % 10) END AS parent", "CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN 'r' END AS root")
    return attribution.evidence_sessions(rows, "c_name", ["parent", "root"])
