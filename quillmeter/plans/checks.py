"""Queries of checks at the borders of the data, made from ``customer``, ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.operators import checks, snapshots
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

_EVENT = """concat('{"schema":"launch/v1","controller_session_ref":"', CASE WHEN event_id % 7 = 1 THEN 'w1' ELSE concat('c', user_id) END, '","worker_session_ref":"', CASE WHEN event_id % 7 = 2 THEN 'a b' WHEN event_id % 7 = 1 THEN 'w1' ELSE concat('w', event_id) END,
'","relationship_kind":"controller_worker","workflow_ref":', CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"wf-1"' END, ',"pr_ref":', CASE WHEN event_id % 11 = 0 THEN '0' WHEN event_id % 2 = 0 THEN '5' ELSE 'null' END, ',"launch_ts":"2024-01-01T00:00:0', event_id % 10, CASE WHEN event_id % 13 = 0 THEN '.5Z' ELSE 'Z' END,
'","capture_source":"', CASE WHEN event_id % 17 = 0 THEN 'x' ELSE 'relay' END, '"', CASE WHEN event_id % 19 = 0 THEN ',"extra":1' WHEN event_id % 19 = 1 THEN '' ELSE ',"evidence":"direct"' END, '}')"""


@query(f"""WITH e AS (SELECT *, {_EVENT} AS body FROM events), r AS (SELECT *, CASE WHEN event_id % 19 = 0 THEN 'unknown_key' WHEN event_id % 19 = 1 THEN 'missing_key' WHEN event_id % 17 = 0 THEN 'unknown_capture_source' WHEN event_id % 7 = 2 THEN 'bad_worker_ref' WHEN event_id % 7 = 1 THEN 'self_launch'
WHEN event_id % 11 = 0 THEN 'bad_pr_ref' WHEN event_id % 13 = 0 THEN 'bad_launch_ts' WHEN event_id % 23 = 0 THEN 'filename_mismatch' END AS reason FROM e)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN 'c' || user_id END AS controller, CASE WHEN reason IS NULL THEN 'w' || event_id END AS worker, CASE WHEN reason IS NULL AND event_id % 2 = 1 THEN 'wf-1' END AS workflow, CASE WHEN reason IS NULL THEN 'relayed' END AS agent_kind FROM r""")
def launch_inbox(spark, sf):
    files = table(spark, sf, "events").select("event_id", F.expr(_EVENT).alias("body"))
    files = files.withColumn("name", F.when(F.col("event_id") % 23 == 0, "other.json").otherwise(F.concat(F.sha2("body", 256), F.lit(".json"))))
    return checks.launch_events(files, "name", "body", "launch/v1", {"relay": "relayed"}).drop("body", "name")


#: Objects with keys of a part's own words, nested by its number, and values that look like keys; every other one has a name of the list, changed in case and marks.
_KEY = "CASE WHEN p_partkey % 2 = 0 THEN replace(replace(p_name, ' ', '_'), 'a', 'A') WHEN p_partkey % 3 = 0 THEN upper({named}) ELSE concat({named}, CASE WHEN p_partkey % 5 = 0 THEN 's' ELSE '-' END) END"
_MANIFEST = """CASE p_partkey % 4 WHEN 0 THEN concat('{"a":[{"', {key}, '":', p_partkey, '}]}') WHEN 1 THEN concat('{"note":"', {named}, ':","', {key}, '":{"b":null}}') WHEN 2 THEN concat('{"x":{"y":{"', {key}, '":"', {named}, '"}}}') ELSE concat('["', {named}, '",{"', {key}, '":[]}]') END"""


def _manifest(named: str) -> str:
    return _MANIFEST.replace("{key}", _KEY.format(named=named)).replace("{named}", named)


_FIELDS = "'accesskeyid', 'awsaccesskeyid', 'secretaccesskey', 'awssecretaccesskey', 'sessiontoken', 'awssessiontoken', 'privatekey', 'clientemail'"


@query(f"""WITH m AS (SELECT p_partkey, {_manifest(f"([{_FIELDS}])[1 + p_partkey % 8]")} AS body FROM part)
SELECT p_partkey, list_has_any(list_transform(regexp_extract_all(body, '"([^"]*)":', 1), lambda k: lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g'))), [{_FIELDS}]) AS secret FROM m""")
def secret_fields(spark, sf):
    named = f"element_at(array({_FIELDS}), 1 + CAST(p_partkey % 8 AS INT))"
    return table(spark, sf, "part").select("p_partkey", checks.holds_secret(F.try_parse_json(F.expr(_manifest(named)))).alias("secret"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'too many' WHEN c_custkey % 9 = 1 THEN 'value' WHEN c_custkey % 9 = 2 THEN 'label incomplete' WHEN c_custkey % 9 = 3 THEN 'label unsafe' WHEN c_custkey % 9 = 4 THEN 'label source' WHEN c_custkey % 9 = 5 THEN 'too long' END AS fault FROM customer""")
def fact_faults(spark, sf):
    fact = lambda field, value, label=None, source=None: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(label).cast("string").alias("label"), F.lit(source).cast("string").alias("label_source"))
    one = fact("skill_id", F.col("c_name"), "tidy up", "skill_name")
    odd = [F.repeat(F.lit("x"), F.lit(129)), F.col("c_name")]
    k = F.col("c_custkey") % 9
    facts = (
        F.when(k == 0, F.array_repeat(one, 25)).when(k == 1, F.array(one, fact("x", odd[0]))).when(k == 2, F.array(fact("skill_id", odd[1], "a"))).when(k == 3, F.array(one, fact("skill_id", odd[1], "see /usr/lib/x", "skill_name")))
        .when(k == 4, F.array(fact("other", odd[1], "a", "skill_name"))).when(k == 5, F.array_repeat(fact("x", F.repeat(F.lit("x"), F.lit(400))), 22)).otherwise(F.array(one, fact("x", odd[1])))
    )
    return table(spark, sf, "customer").select("c_custkey", checks.fact_fault(facts).alias("fault"))


@query("""SELECT c_custkey, NULL::VARCHAR AS account, CASE WHEN c_custkey % 3 > 0 THEN c_name || ' on ' || c_mktsegment END AS note, c_mktsegment FROM customer""")
def status_for_upload(spark, sf):
    note = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("see /Users/x/"), "c_name")).otherwise(F.concat("c_name", F.lit("  on "), "c_mktsegment"))
    status = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("account"), note.alias("note"), "c_mktsegment", F.lit(1).alias("posture"))
    return checks.for_upload(status, ["account"], ["note"], ["posture"])


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 3 = 0 THEN 1.5 END)::DOUBLE AS used, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds((c_custkey % 2000)::INTEGER) END AS seen,
c_custkey % 4 > 0 AND c_custkey % 2000 BETWEEN 100 AND 1000 AS fresh, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_custkey % 4 = 0 THEN 'never_seen' END], lambda x: x IS NOT NULL), ',') AS warnings FROM customer""")
def meter_rows(spark, sf):
    k = F.col("c_custkey")
    seen = F.when(k % 4 > 0, F.timestamp_add("SECOND", (k % 2000).cast("int"), F.lit("2024-01-01").cast("timestamp")))
    status = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.when(k % 2 == 0, F.col("c_acctbal")).alias("a"), F.when(k % 3 == 0, 1.5).alias("b"), F.when(k % 2 == 0, seen).alias("s"), seen.alias("t"))
    warnings = F.array(F.when(F.col("c_acctbal") < 0, "debt"), F.when(k % 4 == 0, "never_seen"))
    return checks.meter(status, "c_custkey", ["a", "b"], ["s", "t"], F.lit("2024-01-01 00:16:40").cast("timestamp"), warnings).withColumn("warnings", F.array_join("warnings", ","))


@query("""SELECT o_orderkey, o_orderdate + to_days(CASE WHEN o_orderkey % 2 = 0 THEN 2 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS at_ FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0""")
def posture_evidence(spark, sf):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    items = table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 0, 1).alias("a"), F.when(k % 5 == 0, "x").alias("b"), F.when(k % 7 == 0, 2.5).alias("c"), F.when(k % 2 == 0, t + F.expr("interval 2 days")).alias("t2"), F.when(k % 3 == 0, t + F.expr("interval 1 day")).alias("t1"), t.alias("t0"))
    return checks.posture_rows(items, ["a", "b", "c"], ["t2", "t1", "t0"]).select("o_orderkey", F.col("at").alias("at_"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 10 END AS digests, array_to_string(list_filter(['title', CASE WHEN c_custkey % 2 = 0 THEN 'label' END], lambda x: x IS NOT NULL), ',') AS dropped FROM customer""")
def policy_audit(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        "c_custkey", (k % 3).alias("a"), (k % 5).alias("b"), F.col("c_name").alias("title"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("label"), F.lit("art").alias("artifact"), F.lit("who").alias("fact"), F.lit("shown").alias("display"),
    )
    parts = dict(zip(snapshots.POLICY_PARTS, ("title", "label", "artifact", "fact", "display"), strict=True))
    digests = snapshots.policy_digests(rows, "c_custkey", parts)
    after = snapshots.projected(rows, parts, {p: F.lit(p not in ("titles", "labels")) for p in parts})
    dropped = snapshots.aligned(rows, after, ["c_custkey", "a", "b"], ["title", "label", "artifact", "fact", "display"])
    return digests.join(dropped, "c_custkey").select("c_custkey", F.col("digests").cast("int").alias("digests"), F.array_join("dropped", ",").alias("dropped"))


@query("""SELECT c_custkey, sha256(unhex(string_agg(printf('%016x', strlen(x)) || hex(encode(x)), '' ORDER BY i))) AS identity, c_custkey % 2 = 0 AND c_custkey % 3 = 1 AS usage_union FROM
(SELECT c_custkey, unnest([c_custkey::VARCHAR, (c_custkey * 1000003)::VARCHAR, 'v' || (c_custkey % 3), CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END]) AS x, unnest([1, 2, 3, 4]) AS i FROM customer) GROUP BY 1""")
def scan_identities(spark, sf):
    k = F.col("c_custkey")
    identity = snapshots.scan_identity(k, k * 1_000_003, F.concat(F.lit("v"), k % 3), F.when(k % 4 != 0, F.col("c_name")))
    rows = table(spark, sf, "customer").select("c_custkey", identity.alias("identity"))
    return snapshots.union_marker(rows, "c_custkey", k % 2 == 0, F.lit(1), k % 3)
