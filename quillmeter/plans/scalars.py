"""Queries of scalar functions: their inputs are texts made from the tables by the same SQL on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.functions import digests, numbers, text, times
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

_COUNTS = """CASE o_orderkey % 9 WHEN 0 THEN concat('~', o_orderkey % 100, '.', o_orderkey % 10, 'k') WHEN 1 THEN concat('<', o_orderkey, ',000 tokens') WHEN 2 THEN concat('**', o_orderkey % 7, 'm**')
WHEN 3 THEN concat(o_orderkey, 'B') WHEN 4 THEN concat('-', o_orderkey) WHEN 5 THEN 'n/a' WHEN 6 THEN concat(' ', o_orderkey, ' tokens ') WHEN 7 THEN 'k' ELSE concat(o_orderkey % 50, '.25K') END"""


@query(f"""WITH a AS (SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(trim({_COUNTS}), '^\\*+|\\*+$', '', 'g'), '^~+', ''), '^<+', '') AS t FROM orders),
b AS (SELECT o_orderkey, lower(trim(replace(replace(t, ',', ''), 'tokens', ''))) AS t FROM a)
SELECT o_orderkey, CASE WHEN x >= 0 THEN round(x * CASE right(t, 1) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'b' THEN 1000000000 ELSE 1 END)::BIGINT END AS n
FROM (SELECT *, TRY_CAST(trim(regexp_replace(t, '[kmb]$', '')) AS DOUBLE) AS x FROM b)""")
def count_texts(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{_COUNTS} AS t").select("o_orderkey", text.count_text(F.col("t")).alias("n"))


_MONEY = """CASE o_orderkey % 7 WHEN 0 THEN concat(o_orderkey % 1000, '.', o_orderkey % 10, '0000049999') WHEN 1 THEN concat(o_orderkey, '.', '0000005') WHEN 2 THEN concat('', o_orderkey) WHEN 3 THEN concat('-', o_orderkey)
WHEN 4 THEN concat(o_orderkey % 10, 'e3') WHEN 5 THEN concat(o_orderkey % 100, '.') ELSE concat('.', o_orderkey) END"""


@query(f"""SELECT o_orderkey, CASE WHEN regexp_matches(t, '^[0-9]+(\\.[0-9]*)?$') THEN (floor(CAST(rtrim(t, '.') AS DECIMAL(38, 12)) * 1000000)::BIGINT
+ CASE WHEN substr(rpad(split_part(t, '.', 2), 7, '0'), 7, 1) >= '5' THEN 1 ELSE 0 END)::BIGINT END AS micros FROM (SELECT o_orderkey, {_MONEY} AS t FROM orders)""")
def micro_dollars(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{_MONEY} AS t").select("o_orderkey", numbers.micro_dollars(F.col("t")).alias("micros"))


_COUNTER = """CASE event_id % 9 WHEN 0 THEN concat('{"input_tokens": ', event_id, '}') WHEN 1 THEN concat('{"input_tokens": "x", "tokens": ', event_id, '}') WHEN 2 THEN concat('{"tokens": ', event_id, '.9}')
WHEN 3 THEN concat('{"input_tokens": -', event_id, '}') WHEN 4 THEN '{"other": 1}' WHEN 5 THEN '{"input_tokens": null, "tokens": 3}' WHEN 6 THEN '{"input_tokens": 1000000000000001, "tokens": 2}'
WHEN 7 THEN '[1]' ELSE concat('{"tokens": 5, "input_tokens": ', event_id, '}') END"""


@query(f"""WITH j AS (SELECT event_id, CAST({_COUNTER} AS JSON) AS j FROM events),
k AS (SELECT event_id, j, CASE WHEN json_type(j, '$.input_tokens') IS NOT NULL THEN 'input_tokens' ELSE 'tokens' END AS k FROM j),
v AS (SELECT event_id, json_type(j, '$.' || k) AS kind, json_extract_string(j, '$.' || k) AS v FROM k)
SELECT event_id, CASE WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND floor(CAST(v AS DOUBLE)) BETWEEN 0 AND 1e15 THEN floor(TRY_CAST(v AS DECIMAL(38, 6)))::BIGINT END AS n FROM v""")
def first_counters(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"try_parse_json({_COUNTER}) AS j")
    return rows.select("event_id", numbers.first_counter(F.col("j"), ["input_tokens", "tokens"], 10**15).alias("n"))


@query("""SELECT o_orderkey, floor(greatest(0, least(100, o_totalprice / 4000 - 10)) + 0.5)::INTEGER AS percent,
coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END, CASE WHEN o_custkey > 0 THEN o_custkey END)::BIGINT AS active_tokens FROM orders""")
def context_fill(spark, sf):
    active = numbers.first_positive(F.col("o_orderkey") % 3, F.col("o_orderkey") % 5, F.col("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", numbers.percent(F.col("o_totalprice") / 4000 - 10).alias("percent"), active.alias("active_tokens"))


_LINE_TIME = """CASE event_id % 6 WHEN 0 THEN concat(substr(concat('', ts), 1, 10), 'T', substr(concat('', ts), 12, 8), 'Z') WHEN 1 THEN concat(substr(concat('', ts), 1, 10), 'T23:30:00.5-02:00')
WHEN 2 THEN 'yesterday' WHEN 3 THEN CAST(NULL AS STRING) WHEN 4 THEN concat(substr(concat('', ts), 1, 10), 'T00:10:00.123456789+00:30') ELSE concat(substr(concat('', ts), 1, 10), 'T12:00:00') END"""
_LINE_ALIAS = "CASE WHEN event_id % 12 IN (2, 3) THEN concat(substr(concat('', ts), 1, 10), 'T01:02:03Z') END"


@query(f"""SELECT event_id, CASE WHEN regexp_matches(t, '^[0-9-]{{10}}T[0-9:]{{8}}(\\.[0-9]+)?(Z|[+-][0-9:]{{5}})$') THEN CAST(timezone('UTC', CAST(t AS TIMESTAMPTZ)) AS DATE) ELSE DATE '2000-01-01' END AS day
FROM (SELECT event_id, coalesce({_LINE_TIME.replace("STRING", "VARCHAR")}, {_LINE_ALIAS}) AS t FROM events)""")
def line_days(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"{_LINE_TIME} AS t", f"{_LINE_ALIAS} AS a")
    return rows.select("event_id", times.line_day(F.col("t"), F.col("a"), F.lit("2000-01-01").cast("date")).alias("day"))


_DAY_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN substr(concat('', o_orderdate), 1, 10) WHEN 1 THEN concat(substr(concat('', o_orderdate), 1, 10), 'T00:00:00Z') WHEN 2 THEN concat(substr(concat('', o_orderdate), 1, 8), '31')
WHEN 3 THEN concat(substr(concat('', o_orderdate), 1, 10), 'x') WHEN 4 THEN concat(substr(concat('', o_orderdate), 1, 10), ' 11:00') ELSE '2024-13-01' END"""


@query(f"""WITH d AS (SELECT o_orderkey, TRY_CAST(CASE WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$') THEN left(t, 10) END AS DATE) AS d FROM (SELECT o_orderkey, {_DAY_TEXT} AS t FROM orders))
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS day, (DATE '2002-01-01' - d + 1)::BIGINT AS span, DATE '2001-12-31' AS last_day, d BETWEEN DATE '2001-12-31' - 119 AND DATE '2001-12-31' AS in_window FROM d""")
def provider_days(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_DAY_TEXT} AS t").withColumn("day", times.provider_day(F.col("t")))
    first, last = times.collection_window(F.lit("2002-01-01 08:00:00").cast("timestamp"))
    day = F.to_date("day")
    return rows.select("o_orderkey", "day", times.day_span(day, F.lit("2002-01-01").cast("date")).cast("long").alias("span"), last.alias("last_day"), day.between(first, last).alias("in_window"))


@query("""SELECT event_id, strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN r = 0 THEN '' ELSE '.' || rtrim(lpad(r::VARCHAR, 9, '0'), '0') END || 'Z' AS at
FROM (SELECT event_id, 1700000000 + event_id * 977 AS s, (event_id * 7919007) % 1000000000 * (event_id % 3) % 1000000000 AS r FROM events)""")
def nano_times(spark, sf):
    nanos = F.expr("(1700000000 + event_id * 977) * 1000000000 + (event_id * 7919007) % 1000000000 * (event_id % 3) % 1000000000")
    return table(spark, sf, "events").select("event_id", times.nanos_text(nanos).alias("at"))


_WAIT = """CASE event_id % 6 WHEN 0 THEN concat('', event_id) WHEN 1 THEN concat('Mon, 01 Jan 2024 00:', lpad(concat('', event_id % 60), 2, '0'), ':30 GMT') WHEN 2 THEN ' ' WHEN 3 THEN 'soon' WHEN 4 THEN '-5' ELSE '99999999999999999999' END"""


@query(f"""SELECT event_id, CASE WHEN w IS NOT NULL THEN least(greatest(w, 0), 1800)::BIGINT END AS seconds, shape AS is_second FROM (SELECT event_id, regexp_matches(u, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}Z$') AS shape,
CASE WHEN regexp_matches(trim(t), '^[0-9]+$') THEN TRY_CAST(trim(t) AS DOUBLE) WHEN regexp_matches(t, 'GMT$') THEN epoch(strptime(t, '%a, %d %b %Y %H:%M:%S GMT')) - epoch(TIMESTAMP '2024-01-01 00:20:00') END AS w
FROM (SELECT event_id, {_WAIT} AS t, CASE WHEN event_id % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2024-01-01T00:00:00.5Z' END AS u FROM events))""")
def retry_delays(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"{_WAIT} AS t", "CASE WHEN event_id % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2024-01-01T00:00:00.5Z' END AS u")
    return rows.select("event_id", times.retry_after(F.col("t"), F.lit("2024-01-01 00:20:00").cast("timestamp")).alias("seconds"), times.is_utc_second(F.col("u")).alias("is_second"))


_PROMPT = """CASE doc_id % 7 WHEN 0 THEN concat('/Fix-', doc_id % 5, ': ', text) WHEN 1 THEN concat('/help ', text) WHEN 2 THEN concat('Run it. Its prompt is: see /usr/lib/x', doc_id, ' and (src/a.py) now ', text)
WHEN 3 THEN concat('<environment_context>', text) WHEN 4 THEN '  ' WHEN 5 THEN concat('/a b', text) ELSE text END"""


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, {_PROMPT} AS t FROM documents),
k AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{text.WHITE}+'), lambda x: x <> '') AS w, lower(t) AS low,
CASE WHEN contains(lower(t), 'its prompt is:') THEN substr(t, instr(lower(t), 'its prompt is:') + 14) ELSE t END AS said FROM p),
s AS (SELECT doc_id, w[1] AS f, contains(low, '<instructions>') OR contains(low, '<environment_context>') OR contains(low, 'agents.md instructions') OR contains(low, 'knowledge cutoff:') OR contains(low, 'current date:') AS private,
list_transform(list_filter(regexp_split_to_array(said, '{text.WHITE}+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(regexp_replace(x, '^["''()\\[\\]{{}},;]+|["''()\\[\\]{{}},;]+$', '', 'g'), '^.:[\\\\/]|^/[^/][^/]*/|^[^/]+/|\\\\|^~/') THEN '[path]' ELSE x END) AS w FROM k),
n AS (SELECT doc_id, f, private, [x FOR i IN range(1, 97) FOR x IN [array_to_string(w[1:i], ' ')] IF i <= len(w) AND strlen(x) <= 96] AS labels FROM s)
SELECT doc_id, CASE WHEN f LIKE '/%' AND regexp_matches(lower(regexp_replace(substr(f, 2), '[:,.]+$', '')), '^[a-z0-9_.-]{{1,64}}$') AND lower(regexp_replace(substr(f, 2), '[:,.]+$', '')) NOT IN ('compact', 'help', 'login', 'logout', 'model', 'review', 'status')
THEN lower(regexp_replace(substr(f, 2), '[:,.]+$', '')) END AS skill, CASE WHEN NOT private AND len(labels) > 0 THEN labels[-1] END AS label FROM n""".replace("[x FOR i IN range(1, 97) FOR x IN [array_to_string(w[1:i], ' ')] IF i <= len(w) AND strlen(x) <= 96]", "[array_to_string(w[1:i], ' ') FOR i IN range(1, 97) IF i <= len(w) AND strlen(array_to_string(w[1:i], ' ')) <= 96]"))
def skills_and_labels(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{_PROMPT} AS t")
    return rows.select("doc_id", text.slash_skill(F.col("t")).alias("skill"), text.prompt_label(F.col("t")).alias("label"))


_PATH = """CASE page_id % 8 WHEN 0 THEN concat('/ws/app/src/', page_id, '.py') WHEN 1 THEN concat('/ws/application/', page_id, '.py') WHEN 2 THEN '/ws/app/../x' WHEN 3 THEN concat('/home/me/', page_id, '.md') WHEN 4 THEN '~' WHEN 5 THEN concat('C:/tmp/', page_id)
WHEN 6 THEN concat('/ws/app/a', chr(92), 'b ', page_id) ELSE url END"""
_UNSAFE = " OR ".join(f"contains(lower(x), '{m}')" for m in text.UNSAFE_MARKS)


@query(f"""WITH p AS (SELECT page_id, html, {_PATH} AS t FROM pages),
c AS (SELECT page_id, html, CASE WHEN t LIKE '/ws/app/_%' THEN replace(substr(t, 9), chr(92), '/') ELSE nullif(regexp_extract(t, '([^/]+)/*$', 1), '') END AS c FROM p),
x AS (SELECT page_id, array_to_string(list_filter(regexp_split_to_array(html, '{text.WHITE}+'), lambda v: v <> ''), ' ') AS x,
CASE WHEN NOT (regexp_matches(c, '^[/~\\\\]') OR contains(c, '..') OR contains(c, ':/') OR contains(c, ':' || chr(92))) THEN c END AS name FROM c)
SELECT page_id, CASE WHEN NOT ({_UNSAFE}) AND x <> '' THEN left(x, 100) END AS safe, name FROM x""")
def safe_names(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", "html", f"{_PATH} AS path")
    return rows.select("page_id", text.safe_text(F.col("html"), 100).alias("safe"), text.relative_or_name(F.lit("/ws/app"), F.col("path")).alias("name"))


_KEY = b"a key of this test"
_INNER, _OUTER = (bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(f"""SELECT c_custkey, sha256(c_name || chr(0) || c_mktsegment || chr(0)) AS ended, sha256('provider:account:' || lower(c_name)) AS billing, 'sha256:' || sha256('evidence:v1' || chr(0) || c_name || chr(0) || c_mktsegment) AS evidence,
sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || unhex(printf('%016x', strlen(c_name))) || encode(c_name) || unhex(printf('%016x', strlen(c_mktsegment))) || encode(c_mktsegment)))) AS keyed FROM customer""")
def keyed_digests(spark, sf):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey", digests.ended(name, segment).alias("ended"), digests.account_identity(F.lit(" Provider"), name, segment, segment).alias("billing"),
        digests.evidence_ref("evidence:v1", name, segment).alias("evidence"), digests.hmac_sha256(_KEY, digests.framed([name, segment])).alias("keyed"),
    )
