"""Queries of upload answers, the ledger of a destination, and records that tell of one event."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.operators import uploads, windows
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

#: The answer to a batch: an outcome for each item, with what may go wrong by the item's own numbers.
_OUTCOME = "CASE WHEN k % 5 < 2 THEN 'accepted' WHEN k % 5 = 2 THEN 'unchanged' WHEN k % 5 = 3 THEN 'rejected' WHEN b % 83 = 5 THEN 'lost' ELSE 'conflict' END"
_SESSION = "CASE WHEN k % 997 = 1 THEN concat('p', k, 'x') WHEN k % 499 = 3 THEN ' ' ELSE concat('p', k) END"
_COUNT = "n + CASE WHEN k % 613 = 5 THEN 1 WHEN k % 617 = 7 THEN -1 ELSE 0 END"


@query(f"""WITH r AS (SELECT l_orderkey % 1500 AS b, l_partkey AS k FROM lineitem), a AS (SELECT b, k, 'p' || k AS session, sha256(k::VARCHAR) AS fingerprint, count(*) AS n FROM r GROUP BY 1, 2),
o AS (SELECT b, {_OUTCOME} AS outcome, {_SESSION} AS session, fingerprint, ({_COUNT})::BIGINT AS n, k % 701 > 8 AS permanent FROM a WHERE k % 811 <> 9 UNION ALL SELECT b, 'accepted', session, fingerprint, n, true FROM a WHERE k % 907 = 4),
s AS (SELECT b, session, fingerprint, count(*) AS rows, sum(n) AS said, bool_or(trim(session) = '' OR n < 1 OR outcome = 'lost') AS bad, bool_or(outcome = 'rejected' AND NOT permanent) AS again, sum(CASE WHEN outcome IN ('accepted', 'unchanged') THEN n ELSE 0 END) AS good FROM o GROUP BY 1, 2, 3),
c AS (SELECT b, sum(CASE WHEN k % 5 < 3 THEN n ELSE 0 END) + CASE WHEN b % 71 = 3 THEN 1 ELSE 0 END AS accepted FROM a GROUP BY b),
p AS (SELECT coalesce(a.b, s.b) AS b, bool_or(coalesce(bad, false)) AS malformed, bool_or(a.n IS NULL) AS foreign_, bool_or(coalesce(rows > 1, false)) AS repeated, bool_or(coalesce(said > a.n, false)) AS excess, bool_or(coalesce(coalesce(said, 0) < a.n, false)) AS short, bool_or(coalesce(again, false)) AS retryable, coalesce(sum(good), 0) AS good
FROM a FULL JOIN s ON a.b = s.b AND a.session = s.session AND a.fingerprint = s.fingerprint GROUP BY 1)
SELECT p.b AS batch, array_to_string(list_filter([CASE WHEN malformed THEN 'malformed' END, CASE WHEN foreign_ THEN 'foreign' END, CASE WHEN repeated THEN 'repeated' END, CASE WHEN excess THEN 'excess' END, CASE WHEN short THEN 'short' END, CASE WHEN retryable THEN 'retryable' END, CASE WHEN good <> accepted THEN 'count' END], lambda x: x IS NOT NULL), ',') AS faults
FROM p JOIN c ON c.b = p.b""")
def ack_faults(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey % 1500 AS b", "l_partkey AS k")
    request = rows.selectExpr("b AS batch", "concat('p', k) AS session", "sha2(CAST(k AS STRING), 256) AS fingerprint")
    items = rows.groupBy("b", "k").agg(F.count("*").alias("n")).withColumn("fingerprint", F.expr("sha2(CAST(k AS STRING), 256)"))
    said = items.where("k % 811 <> 9").selectExpr("b AS batch", f"{_OUTCOME} AS outcome", f"{_SESSION} AS session", "fingerprint", f"{_COUNT} AS n", "k % 701 > 8 AS permanent")
    again = items.where("k % 907 = 4").selectExpr("b AS batch", "'accepted' AS outcome", "concat('p', k) AS session", "fingerprint", "n", "true AS permanent")
    counted = items.groupBy(F.col("b").alias("batch")).agg(F.expr("sum(CASE WHEN k % 5 < 3 THEN n ELSE 0 END) + CASE WHEN b % 71 = 3 THEN 1 ELSE 0 END").alias("accepted"))
    return uploads.ack_faults(request, said.union(again), counted, "batch").select("batch", F.array_join("faults", ",").alias("faults"))


#: Saves of two kinds of writers: those that read the newest state, and those that read an older one.
_SAVES = """SELECT o_custkey % 40 AS destination, o_orderkey AS seq, sum(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS generation,
{fingerprint} AS fingerprint, CASE WHEN o_orderkey % 3 = 0 THEN 'quarantined' WHEN o_orderkey % 3 = 1 THEN 'accepted' ELSE 'retried' END AS outcome, 1000000000 + o_orderkey * 100 AS at_, concat('w', o_orderkey % 2) AS witness FROM {orders}"""


@query(f"""WITH s AS ({_SAVES.format(fingerprint="sha256((o_custkey * 7 + o_orderkey % 5)::VARCHAR)", orders="orders")}),
t AS (SELECT a.destination, a.seq, min(b.seq) AS then FROM s a JOIN s b ON a.destination = b.destination AND b.generation = a.generation + 1 AND b.seq > a.seq GROUP BY 1, 2),
w AS (SELECT destination, min(seq) AS seq FROM s WHERE generation = 0 GROUP BY 1 UNION ALL SELECT t.destination, t.then FROM w JOIN t USING (destination, seq)),
i AS (SELECT destination, fingerprint, bool_or(outcome = 'accepted') AS inside, max(seq) FILTER (outcome = 'quarantined') AS q FROM s JOIN w USING (destination, seq) GROUP BY 1, 2),
h AS (SELECT i.*, s.witness = 'w1' AS same, s.at_ + 604800 + ((('0x' || sha256(i.fingerprint)[1:16])::UBIGINT) % 604800)::BIGINT AS retry_after FROM i LEFT JOIN s ON s.destination = i.destination AND s.seq = i.q WHERE inside OR q IS NOT NULL),
d AS (SELECT *, NOT inside AND (NOT same OR retry_after <= 1001400000) AS due FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY destination, due ORDER BY same NULLS FIRST, retry_after, fingerprint) AS n FROM d)
SELECT destination, fingerprint, CASE WHEN inside THEN 'accepted' WHEN due AND n <= 50 THEN 'retry' ELSE 'quarantined' END AS state, CASE WHEN NOT inside THEN retry_after END AS retry_after FROM n""".replace("WITH s AS", "WITH RECURSIVE s AS"))
def ledger_state(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("_ledger_orders")
    saves = spark.sql(_SAVES.format(fingerprint="sha2(CAST(o_custkey * 7 + o_orderkey % 5 AS STRING), 256)", orders="_ledger_orders")).withColumnRenamed("at_", "at")
    return uploads.ledger_state(saves, uploads.won_saves(saves), F.lit(1_001_400_000), F.lit("w1"))


_RECORDS = """SELECT user_id, event_id, ts AS t, true AS new FROM {events} UNION ALL SELECT user_id, event_id + 1000000, ts + {ms}(event_id % 9 * 30 - 120), false FROM {events} WHERE event_id % 3 = 0
UNION ALL SELECT user_id, event_id + 2000000, ts + {ms}(event_id % 4 * 40), false FROM {events} WHERE event_id % 7 = 0"""


@query(f"""WITH r AS ({_RECORDS.format(events="events", ms="to_milliseconds")}), a AS (SELECT user_id, event_id, epoch_us(t) AS t, new FROM r),
p AS (SELECT l.user_id, l.event_id, l.t, c.event_id AS c, abs(l.t - c.t) AS gap, row_number() OVER (PARTITION BY l.user_id, l.event_id ORDER BY abs(l.t - c.t), c.t) AS n FROM a l JOIN a c ON NOT l.new AND c.new AND l.user_id = c.user_id AND abs(l.t - c.t) <= 100000),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, c ORDER BY gap, t, event_id) AS k FROM p WHERE n = 1)
SELECT a.user_id, a.event_id, EXISTS (SELECT 1 FROM k WHERE k.user_id = a.user_id AND k.c = a.event_id) AS paired FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = a.user_id AND k.event_id = a.event_id AND k.k = 1)""")
def compaction_events(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("t"))
    moved = lambda ms: F.timestamp_micros(F.unix_micros("t") + ms * 1000)
    old = events.where("event_id % 3 = 0").select("user_id", (F.col("event_id") + 1_000_000).alias("event_id"), moved(F.col("event_id") % 9 * 30 - 120).alias("t"), F.lit(False).alias("new"))
    older = events.where("event_id % 7 = 0").select("user_id", (F.col("event_id") + 2_000_000).alias("event_id"), moved(F.col("event_id") % 4 * 40).alias("t"), F.lit(False).alias("new"))
    return windows.paired(events.withColumn("new", F.lit(True)).union(old).union(older), "user_id", "t", "event_id", F.col("new")).select("user_id", "event_id", "paired")
