"""Queries of redaction over whole texts of ``documents`` and ``pages``; the SQL runs the same rules over lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.functions import redaction, text
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

#: Lines as programs write them, behind the texts: the keys and values come from the row itself.
_SAID = """concat(text, chr(10), CASE doc_id % 9 WHEN 0 THEN concat('Authorization: Bearer ', sha2(source, 256)) WHEN 1 THEN concat('read path=/home/', source, '/x by user_', doc_id) WHEN 2 THEN concat(source, '_key=1 serial=', doc_id, ' api_key=', lang)
WHEN 3 THEN concat('prompt=say ', text) WHEN 4 THEN concat('the token expired ', lang, ' token ', source, '-', doc_id, '-Ab') WHEN 5 THEN concat('(sk-', lang, ') "AKIA', upper(substr(sha2(text, 256), 1, 16)), '"') WHEN 6 THEN sha2(text, 256)
WHEN 7 THEN concat(substr(sha2(text, 256), 1, 8), '-', substr(sha2(text, 256), 9, 4), '-4a4a-8a8a-', substr(sha2(text, 256), 1, 12)) ELSE concat('password: ', source, ' Password: Prompt=x ', lang) END)"""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _or(pattern: str, values) -> str:
    return "(" + " OR ".join(pattern.format("'" + v + "'") for v in values) + ")"


_MACHINE_KEY = f"({{0}} IN ({_quoted(redaction.MACHINE_KEYS)}) OR {_or('suffix({{0}}, {})', redaction.MACHINE_ENDS)})"
_KEY_CLASS = (
    f"CASE WHEN {_or('contains({{0}}, {})', redaction.SECRET_KEYS)} THEN 'secret' WHEN contains({{0}}, 'path') OR {{0}} = 'file' OR suffix({{0}}, '_file') THEN 'path' WHEN {_MACHINE_KEY} THEN 'machine' "
    f"WHEN contains({{0}}, 'account_id') OR contains({{0}}, 'organization_id') OR {{0}} IN ({_quoted(redaction.ACCOUNT_KEYS)}) THEN 'account' WHEN contains({{0}}, 'raw_prompt') OR contains({{0}}, 'user_prompt') OR {{0}} = 'prompt' OR suffix({{0}}, '_prompt') THEN 'prompt' END"
)
_MARK = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in redaction.MARKS.items()) + " ELSE {} END"


def _redacted_sql(source: str, key: str) -> str:
    """CTEs from ``source`` (``key``, x) to ``redacted`` (``key``, r)."""
    shapes = _or("regexp_matches(v[i], {})", redaction.SHAPES)
    secret = f"((contains(b[i], '=') AND v[i] <> '' AND {_or('contains(k[i], {})', redaction.ASSIGNED_KEYS)}) OR {_or('starts_with(l[i], {})', redaction.VENDOR_STARTS)} OR {shapes} OR (regexp_matches(v[i], '^[A-Za-z0-9_+=.-]{{24,}}$') AND regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]') AND regexp_matches(v[i], '[A-Za-z0-9]{{20}}')))"
    opaque = "(regexp_matches(v[i], '^[A-Za-z0-9_+/=.-]{12,}$') AND (regexp_matches(v[i], '[0-9_+/=.-]') OR (regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[a-z]'))))"
    machine = f"CASE WHEN contains(b[i], '=') THEN v[i] <> '' AND {_MACHINE_KEY.format('k[i]')} ELSE regexp_matches(l[i], '{redaction.UUID}') OR regexp_matches(l[i], '{redaction.MACHINE_ID}') END"
    prompt = _or("starts_with(" + _LOW.format("b[i]") + ", {})", ("prompt=", "raw_prompt=", "user_prompt="))
    around = redaction.AROUND.replace("'", "''")
    label = f"regexp_replace({_LOW.format('y')}, ':$', '') IN ({_quoted(redaction.LABELS)})"
    return f"""w AS (SELECT {key}, list_filter(regexp_split_to_array(x, '{text.WHITE}+'), lambda y: y <> '') AS w FROM {source}),
b AS (SELECT *, list_transform(w, lambda y: regexp_replace(y, '{around}', '', 'g')) AS b FROM w),
v AS (SELECT *, list_transform(b, lambda y: CASE WHEN contains(y, '=') THEN substr(y, instr(y, '=') + 1) ELSE y END) AS v, list_transform(b, lambda y: {_LOW.format("split_part(y, '=', 1)")}) AS k, list_transform(b, lambda y: {label}) AS a FROM b),
l AS (SELECT *, list_transform(v, lambda y: {_LOW.format('y')}) AS l FROM v),
c AS (SELECT *, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN a[i] THEN '' WHEN i > 1 AND a[i - 1] THEN CASE WHEN {secret} OR {opaque} THEN 'secret' ELSE '' END
WHEN {_or('starts_with(l[i], {})', redaction.PATH_STARTS)} THEN 'path' WHEN {machine} THEN 'machine' WHEN regexp_matches(l[i], '{redaction.ACCOUNT_ID}') THEN 'account' WHEN {prompt} THEN 'prompt' WHEN {secret} THEN 'secret' ELSE '' END) AS c FROM l),
redacted AS (SELECT {key}, array_to_string(list_transform(range(1, CASE WHEN list_position(c, 'prompt') > 0 THEN list_position(c, 'prompt') ELSE len(w) END + 1), lambda i: {_MARK.format('c[i]', 'w[i]')}), ' ') AS r FROM c)"""


def _for_duckdb(expr: str) -> str:
    return expr.replace("sha2(source, 256)", "sha256(source)").replace("sha2(text, 256)", "sha256(text)")


@query(f"""WITH t AS (SELECT doc_id, {_for_duckdb(_SAID)} AS x FROM documents), {_redacted_sql("t", "doc_id")} SELECT doc_id, sha256(r) AS redacted_sha256, strlen(r)::INTEGER AS n_bytes FROM redacted""")
def redact_tokens(spark, sf):
    said = table(spark, sf, "documents").select("doc_id", redaction.redacted(F.expr(_SAID)).alias("r"))
    return said.select("doc_id", F.sha2("r", 256).alias("redacted_sha256"), F.octet_length("r").alias("n_bytes"))


#: Keys of an object and what they hold, of a page.
_FIELDS = {
    "url": "url", "page": "html", "Session_Token": "url", "config_path": "url", "x_file": "url", "disk_serial": "url", "organization_id": "url", "User_Prompt": "url",
    "note": "concat('cookie=', url, ' for acct_', page_id, ' \"token\" ', substr(url, 8))", "pathology": "url", "tokens": "url", "serials": "url",
}


@query(f"""WITH f AS (SELECT page_id, unnest([{", ".join(f"{{'key': '{k}', 'x': {v}}}" for k, v in _FIELDS.items())}], recursive := true) FROM pages), {_redacted_sql("f", "page_id, key")},
o AS (SELECT page_id, string_agg('"' || key || '":' || to_json({_MARK.format(_KEY_CLASS.format(_LOW.format('key')), 'r')})::VARCHAR, ',' ORDER BY key) AS o FROM redacted GROUP BY page_id)
SELECT page_id, sha256('{{"client_secret":"[REDACTED]","items":[{{' || o || '}},3],"size":' || page_id || '}}') AS redacted_sha256 FROM o""")
def redact_json(spark, sf):
    inner = F.struct(*[F.expr(v).alias(k) for k, v in _FIELDS.items()])
    held = F.struct(F.col("page_id").alias("size"), F.struct("url").alias("first"))  # goes as a whole
    whole = F.concat(F.lit('{"size":'), F.col("page_id").cast("string"), F.lit(',"items":['), F.to_json(inner), F.lit(', 3],"client_secret":'), F.to_json(held), F.lit("}"))
    return table(spark, sf, "pages").select("page_id", F.sha2(redaction.redacted_json(whole), 256).alias("redacted_sha256"))
