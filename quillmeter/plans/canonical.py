"""Queries of canonical JSON and of hashes over it, from all ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.functions import canonical
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

#: A text whose last element may be a fraction (with an exponent, too), and whose integers may pass 64 bits.
_TEXT = """concat('{ "z": [1, {"', event_type, '" : ', CASE WHEN event_id % 4 = 0 THEN concat(event_id, '.0') WHEN event_id % 4 = 1 THEN concat(event_id, 'e1') ELSE concat('', event_id) END, '}], "a/~b": ', CASE WHEN event_id % 5 = 0 THEN '18446744073709551616' WHEN event_id % 5 = 1 THEN '18446744073709551615' ELSE '-9223372036854775808' END,
', "\ue000": null, "\U0001f600": "', event_type, '\\\\u00e9\\\\n"', CASE WHEN event_id % 17 = 0 THEN ']' ELSE '}' END)"""


@query(f"""WITH t AS (SELECT event_id, event_type, event_id % 4 < 2 AS odd, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '18446744073709551615' ELSE '-9223372036854775808' END AS big, event_id % 17 = 0 AS bad FROM events)
SELECT event_id, CASE WHEN NOT bad AND NOT odd AND big IS NOT NULL THEN sha256('{{"a/~b":' || big || ',"z":[1,{{"' || event_type || '":' || event_id || '}}],"{chr(0x1F600)}":"' || event_type || 'é\\n","{chr(0xE000)}":null}}') END AS canonical_sha256,
CASE WHEN bad THEN 'malformed' WHEN big IS NULL THEN '/a~1~0b' WHEN odd THEN '/z/1/' || event_type END AS fault FROM t""")
def canonical_strict(spark, sf):
    said = table(spark, sf, "events").select("event_id", canonical.strict(F.expr(_TEXT)).alias("c"))
    return said.select("event_id", F.sha2("c.canonical", 256).alias("canonical_sha256"), "c.fault")


#: The four parts of a snapshot that no policy changes.
NEUTRAL = ("usage", "timing", "model", "compaction")


@query("""WITH u AS (SELECT user_id, count(*) AS n, max(event_id) AS last, max(event_type) AS model, count(*) FILTER (event_type = 'view') AS k FROM events GROUP BY 1)
SELECT user_id, sha256('{"compaction":' || k || ',"model":"' || model || '","timing":{"last":' || last || '},"usage":{"requests":' || n || '}}') AS content_hash FROM u""")
def content_hashes(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.max("event_type").alias("model"), F.count_if(F.col("event_type") == "view").alias("k"), F.max("value").alias("title"))
    parts = {"usage": F.struct(F.col("n").alias("requests")), "timing": F.struct("last"), "model": F.col("model"), "compaction": F.col("k"), "title": F.col("title")}
    # a snapshot's title is one of the parts that policies change: it has no say
    bodies = per.select("user_id", F.to_json(F.struct(*[parts[name].alias(name) for name in NEUTRAL])).alias("body"))
    said = bodies.select("user_id", canonical.strict(F.col("body")).alias("c"))
    return said.select("user_id", F.sha2("c.canonical", 256).alias("content_hash"))
