"""Queries over transcripts: their JSON lines are made from ``conversations``, a file for each; the SQL needs no JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.operators import transcripts
from quillmeter.plans.registry import query
from quillmeter.sources import transcripts as source
from quillmeter.sources.tables import table

_AT = "concat('2026-0', 1 + conv_id % 9, '-', lpad(concat('', 1 + turn + conv_id % 20), 2, '0'), 'T0', turn % 10, ':00:00Z')"
_NAME = "CASE (conv_id + turn) % 8 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'Task' WHEN 3 THEN 'WebFetch' WHEN 4 THEN 'mcp_Browser_click' WHEN 5 THEN 'Edit' WHEN 6 THEN 'NotebookRead' ELSE 'Read' END"
_PATH = "CASE conv_id % 6 WHEN 0 THEN concat('/ws/app/src/a', conv_id % 3, '.py') WHEN 1 THEN '/ws/app/MEMORY.md' WHEN 2 THEN '/ws/app/doc/x.markdown' WHEN 3 THEN '/ws/app/index.HTM' WHEN 4 THEN '/home/z/b.py' ELSE '/ws/app/memory/n.txt' END"
_JSON_TEXT = "substr(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)"
_HEAD = f"""concat('{{"type":"KIND","timestamp":"', {_AT}, '","sessionId":"s', conv_id, '"', CASE WHEN conv_id % 11 = 3 THEN concat(',"isSidechain":true,"agentId":"a', conv_id, '"') ELSE '' END"""
_LINE = f"""CASE WHEN role = 'system' THEN {_HEAD.replace('KIND', 'system')}, CASE WHEN conv_id % 2 = 0 THEN ',"subtype":"compact_boundary"' ELSE '' END, '}}')
WHEN role = 'assistant' THEN {_HEAD.replace('KIND', 'assistant')}, ',"message":{{', CASE WHEN conv_id % 7 = 0 THEN '' ELSE concat('"id":"m', floor(turn / 4), '",') END, '"content":[{{"type":"text","text":"x"}},',
CASE WHEN conv_id % 13 = 2 THEN concat('{{"type":"tool_use","id":"t', turn, '","name":"Bash"}},') ELSE '' END, '{{"type":"tool_use","id":"t', turn, '","name":"', {_NAME}, '","input":{{"file_path":"', {_PATH}, '"}}}}]}}}}')
WHEN conv_id % 5 = 0 THEN {_HEAD.replace('KIND', 'attachment')}, CASE WHEN turn = 4 THEN ',"isCompactSummary":1' ELSE '' END, ',"attachment":{{"filename":"', {_PATH}, '","content":', {_JSON_TEXT}, ',"addedLines":["one",2]}}}}')
ELSE {_HEAD.replace('KIND', 'user')}, CASE WHEN turn = 4 AND conv_id % 3 = 0 THEN ',"isCompactSummary":true' ELSE ',"isCompactSummary":0' END, ',"message":{{"content":[{{"type":"tool_result","tool_use_id":"t', turn - 1, '","content":',
CASE WHEN conv_id % 5 = 1 THEN {_JSON_TEXT} ELSE concat('[{{"type":"text","text":', {_JSON_TEXT}, '}},"plain"', CASE WHEN turn % 4 = 2 THEN ',{{"type":"image"}}' ELSE '' END, ']') END, '}}', CASE WHEN turn % 6 = 2 THEN ',{{"type":"image"}}' ELSE '' END, ']}}}}') END"""


def _lines(spark, sf, line: str):
    """Lines of all files, and before each file's a blank one and one that is no JSON."""
    rows = table(spark, sf, "conversations").selectExpr("concat('/logs/conv_', conv_id, '.jsonl') AS file", "turn AS number", f"{line} AS line")
    junk = rows.select("file").distinct().select("file", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("number"), F.lit(x).alias("line")) for n, x in ((-2, "  "), (-1, "not json {"))])).alias("j")).select("file", "j.*")
    return source.json_lines(rows.union(junk))


def _first_kind(spark, sf):
    rows = transcripts.entries(_lines(spark, sf, _LINE), F.lit("2026-01-01").cast("date"))
    return transcripts.in_window(rows, F.lit("2026-08-15").cast("date"))


_SQL = f"""WITH a AS (SELECT *, strptime({_AT}, '%Y-%m-%dT%H:%M:%SZ') AS tm, role = 'user' AND conv_id % 5 = 0 AS att, {_NAME} AS name, {_PATH} AS path,
max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pa FROM conversations),
b AS (SELECT *, role = 'assistant' AND (conv_id % 7 = 0 OR pa IS NULL OR pa // 4 <> turn // 4) AS is_turn, (role = 'system' AND conv_id % 2 = 0) OR (role = 'user' AND turn = 4 AND (att OR conv_id % 3 = 0)) AS cut FROM a),
s AS (SELECT *, sum(cut::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg, min(tm) OVER (PARTITION BY conv_id) AS started FROM b),
r AS (SELECT *, coalesce(sum(is_turn::INT) OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS residency FROM s),
u AS (SELECT r.conv_id, r.turn, r.text, r.tm, r.att, r.residency, r.started, r.path AS own_path, c.name, c.path FROM r LEFT JOIN a c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 AND c.role = 'assistant' WHERE r.role = 'user'),
f AS (SELECT *, CASE WHEN att THEN own_path ELSE path END AS p FROM u),
k AS (SELECT *, CASE WHEN regexp_matches(p, '(^|/)MEMORY\\.md$') OR contains(p, '/memory/') THEN 'memory_notes' WHEN lower(p) LIKE '%.markdown' THEN 'doc_reads_md' WHEN lower(p) LIKE '%.htm' THEN 'doc_reads_html' ELSE 'code_reads' END AS kind FROM f),
e AS (SELECT conv_id, turn, 0 AS block, 0 AS part, tm, residency, started, p AS path, 0 AS images,
CASE WHEN att THEN CASE kind WHEN 'memory_notes' THEN kind ELSE 'harness_attachments' END WHEN name IS NULL THEN 'other_tools' WHEN name = 'Bash' THEN 'shell_output' WHEN name IN ('Read', 'NotebookRead') THEN kind WHEN name = 'Task' THEN 'agent_results'
WHEN name = 'WebFetch' THEN 'web_fetch_search' WHEN name = 'mcp_Browser_click' THEN 'browser_and_images' ELSE 'other_tools' END AS category,
ceil((length(text) + CASE WHEN att THEN 6 WHEN conv_id % 5 = 1 THEN 0 ELSE 6 END) / 4)::BIGINT AS tokens FROM k
UNION ALL SELECT conv_id, turn, 0, 1, tm, residency, started, NULL, 1, 'browser_and_images', 1300 FROM f WHERE NOT att AND conv_id % 5 <> 1 AND turn % 4 = 2
UNION ALL SELECT conv_id, turn, 1, 0, tm, residency, started, NULL, 1, 'browser_and_images', 1300 FROM f WHERE NOT att AND turn % 6 = 2),
w AS (SELECT *, CAST(tm AS DATE) AS day, 's' || conv_id || CASE WHEN conv_id % 11 = 3 THEN ' (subagent:a' || conv_id || ')' ELSE '' END AS session FROM e WHERE CAST(tm AS DATE) BETWEEN DATE '2026-08-15' - 91 AND DATE '2026-08-15')
"""


@query(_SQL + "SELECT day, category, count(*) AS events, sum(tokens)::BIGINT AS tokens, sum(tokens * residency)::BIGINT AS resident_tokens, sum(images)::BIGINT AS images FROM w GROUP BY day, category")
def compose_daily(spark, sf):
    return transcripts.daily(_first_kind(spark, sf))


@query(
    _SQL
    + """SELECT CASE WHEN path LIKE '/ws/app/%' THEN substr(path, 9) ELSE regexp_extract(path, '[^/]+$') END AS name, arg_max(category, ('/logs/conv_' || conv_id || '.jsonl', turn, block, part)) AS category, count(*) AS events,
sum(tokens)::BIGINT AS tokens, max(tm) AS last_access FROM w WHERE path IS NOT NULL GROUP BY path ORDER BY tokens DESC, name LIMIT 100"""
)
def compose_files(spark, sf):
    return transcripts.top_files(_first_kind(spark, sf), F.lit("/ws/app"))


@query(
    _SQL
    + f""", c AS (SELECT session, category, min(started) AS started, sum(tokens)::BIGINT AS t, list_position({list(transcripts.CATEGORIES)}, category) AS place FROM w GROUP BY session, category)
SELECT 'sha256:' || sha256(session || chr(0)) AS session, min(started) AS started, sum(t)::BIGINT AS tokens, arg_max(category, (t, -place)) AS top_category FROM c GROUP BY c.session HAVING sum(t) > 0 ORDER BY tokens DESC, session LIMIT 200"""
)
def compose_sessions(spark, sf):
    return transcripts.top_sessions(_first_kind(spark, sf))


_CALL = "CASE (conv_id + turn) % 6 WHEN 0 THEN 'Local_Exec' WHEN 1 THEN 'web_search' WHEN 2 THEN 'take_screenshot' WHEN 3 THEN 'spawn_agent' WHEN 4 THEN 'view' ELSE 'apply_patch' END"
_TURN_KIND = "CASE conv_id % 4 WHEN 0 THEN 'function_call' WHEN 1 THEN 'custom_tool_call' ELSE 'local_shell_call' END"
_PAYLOAD = f"""concat('{{"ts":"', {_AT}, '","type":"', CASE WHEN role = 'system' THEN 'session_meta","payload":{{"session_id":"s' ELSE 'item","payload":{{"type":"' END, CASE WHEN role = 'system' THEN concat(conv_id, '"')
WHEN role = 'assistant' AND conv_id % 4 = 3 THEN 'agent_message"' WHEN role = 'assistant' THEN concat({_TURN_KIND}, '","call_id":"c', turn, CASE WHEN conv_id % 4 = 2 THEN '"' ELSE concat('","name":"', {_CALL}, '"') END)
WHEN conv_id % 6 = 0 AND turn = 2 THEN 'context_compacted"' WHEN conv_id % 4 < 3 THEN concat({_TURN_KIND}, '_output","call_id":"c', turn - 1, '","output":', {_JSON_TEXT})
WHEN turn % 3 = 0 THEN concat('message","role":"', CASE WHEN conv_id % 8 = 3 THEN 'developer' ELSE 'user' END, '","content":[{{"type":"input_text","text":', {_JSON_TEXT}, '}},{{"type":"input_image"}}]')
WHEN turn % 3 = 1 THEN concat('web_search_end","query":"q, ', turn, '","hits":[1,2]') ELSE concat('mcp_tool_call_end","invocation":{{"server":"my', CASE WHEN conv_id % 8 = 3 THEN 'Playwright' ELSE 'python' END, '"}},"result":{{"Ok":{{"content":[{{"type":"text","text":', {_JSON_TEXT}, '}}]}}}}') END, '}}}}')"""


@query(f"""WITH b AS (SELECT *, CAST(strptime({_AT}, '%Y-%m-%dT%H:%M:%SZ') AS DATE) AS day, role = 'assistant' AS is_turn, role = 'user' AND conv_id % 6 = 0 AND turn = 2 AS cut, {_CALL} AS call FROM conversations),
s AS (SELECT *, sum(cut::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg FROM b),
r AS (SELECT *, coalesce(sum(is_turn::INT) OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS residency FROM s),
u AS (SELECT r.*, c.role AS caller, c.call AS called FROM r LEFT JOIN b c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 AND c.role = 'assistant' WHERE r.role = 'user' AND NOT r.cut),
e AS (SELECT day, residency, 0 AS images, ceil(CASE WHEN conv_id % 4 = 3 AND turn % 3 = 1 THEN length('{{"hits": [1, 2], "query": "q, ' || turn || '", "type": "web_search_end"}}') ELSE length(text) END / 4)::BIGINT AS tokens,
CASE WHEN conv_id % 4 < 3 THEN CASE WHEN caller IS NULL THEN 'other_tools' WHEN conv_id % 4 = 2 OR called = 'Local_Exec' THEN 'shell_output' WHEN called = 'web_search' THEN 'web_fetch_search' WHEN called = 'take_screenshot' THEN 'browser_and_images'
WHEN called = 'spawn_agent' THEN 'agent_results' WHEN called = 'view' THEN 'code_reads' ELSE 'other_tools' END
WHEN turn % 3 = 0 THEN CASE WHEN conv_id % 8 = 3 THEN 'harness_attachments' END WHEN turn % 3 = 1 THEN 'web_fetch_search' WHEN conv_id % 8 = 3 THEN 'browser_and_images' ELSE 'shell_output' END AS category FROM u
UNION ALL SELECT day, residency, 1, 1300, 'browser_and_images' FROM u WHERE conv_id % 4 = 3 AND turn % 3 = 0)
SELECT day, category, count(*) AS events, sum(tokens)::BIGINT AS tokens, sum(tokens * residency)::BIGINT AS resident_tokens, sum(images)::BIGINT AS images FROM e WHERE category IS NOT NULL GROUP BY day, category""")
def compose_calls(spark, sf):
    return transcripts.daily(transcripts.call_entries(_lines(spark, sf, _PAYLOAD), F.lit("2026-01-01").cast("date")))


_CWD = """CASE conv_id % 4 WHEN 0 THEN concat('{"cwd":"/ws/', conv_id % 9, '"}') WHEN 1 THEN concat('{"cwd":7,"payload":{"cwd":"/ws/', (conv_id + turn) % 5, '"}}') WHEN 2 THEN concat('{"turn_context":{"payload":{"cwd":"/ws/', conv_id % 7, '"}}}') ELSE '{"cwd":null}' END"""
_CWD_SQL = "SELECT '/logs/conv_' || conv_id || '.jsonl' AS file, conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '/ws/' || (conv_id % 9) WHEN 1 THEN '/ws/' || ((conv_id + turn) % 5) WHEN 2 THEN '/ws/' || (conv_id % 7) END AS cwd FROM conversations"


@query(f"SELECT DISTINCT file, cwd FROM ({_CWD_SQL}) WHERE cwd IS NOT NULL")
def transcript_folders(spark, sf):
    return source.file_folders(_lines(spark, sf, _CWD))


@query(f"""WITH s(workspace, scope) AS (VALUES ('/ws/0', 'A'), ('/ws/1', 'A'), ('/ws/2', 'B'), ('/ws/3', 'B'), ('/ws/4', 'C'), ('/ws/6', 'C'), ('/ws/8', 'D')),
f AS (SELECT file, conv_id, arg_min(cwd, turn) AS workspace FROM ({_CWD_SQL}) WHERE cwd IN (SELECT workspace FROM s) GROUP BY file, conv_id),
l AS (SELECT scope, workspace, max(TIMESTAMP '2026-01-01 00:00:00' + to_days(CAST(conv_id % 17 AS INTEGER))) AS last_seen FROM f JOIN s USING (workspace) GROUP BY scope, workspace)
SELECT scope, workspace, last_seen FROM l QUALIFY row_number() OVER (PARTITION BY scope ORDER BY last_seen DESC, workspace) = 1 ORDER BY last_seen DESC, scope LIMIT 3""")
def newest_workspaces(spark, sf):
    scopes = spark.createDataFrame([("/ws/0", "A"), ("/ws/1", "A"), ("/ws/2", "B"), ("/ws/3", "B"), ("/ws/4", "C"), ("/ws/6", "C"), ("/ws/8", "D")], "workspace string, scope string")
    seen = table(spark, sf, "conversations").groupBy("conv_id").count().selectExpr("concat('/logs/conv_', conv_id, '.jsonl') AS file", "timestampadd(DAY, CAST(conv_id % 17 AS INT), TIMESTAMP '2026-01-01 00:00:00') AS last_seen")
    return source.newest_workspaces(_lines(spark, sf, _CWD), seen, scopes, 3)


@query("SELECT '/logs/conv_' || conv_id || '.jsonl' AS file, count(*) AS lines, max(turn) - min(turn) AS last_ordinal FROM conversations GROUP BY conv_id")
def jsonl_lines(spark, sf):
    return _lines(spark, sf, _LINE).groupBy("file").agg(F.count("*").alias("lines"), F.max("ordinal").alias("last_ordinal"))
