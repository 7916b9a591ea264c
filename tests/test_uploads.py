"""Two writers of one ledger, refused items and their time, and records of one event against brute force."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillmeter.operators import snapshots, state, uploads, windows

ENTRY = "destination string, seq long, generation long, fingerprint string, outcome string, at long, witness string"


def test_two_interleaved_writers(spark):
    """A and B both read generation 0; A saves first, so B's save is lost with all that it says, until it reads again."""
    rows = [
        ("d", 1, 0, "a1", "accepted", 10, "w"), ("d", 2, 0, "b1", "accepted", 11, "w"), ("d", 3, 1, "b1", "quarantined", 12, "w"), ("d", 4, 1, "a2", "accepted", 13, "w"),
        ("d", 5, 0, "b2", "accepted", 14, "w"), ("d", 6, 2, "b2", "quarantined", 15, "old"), ("d", 7, 3, "b2", "quarantined", 16, "w"), ("d", 8, 9, "x", "accepted", 17, "w"), ("e", 1, 1, "x", "accepted", 1, "w"),
    ]
    saves = spark.createDataFrame(rows, ENTRY)
    won = uploads.won_saves(saves)
    assert sorted((r.destination, r.seq) for r in won.collect()) == [("d", 1), ("d", 3), ("d", 6), ("d", 7)]
    state = {r.fingerprint: (r.state, r.retry_after) for r in uploads.ledger_state(saves, won, F.lit(20), F.lit("w")).collect()}
    wait = lambda f, at: at + uploads.RETRY_SECONDS + int.from_bytes(hashlib.sha256(f.encode()).digest()[:8], "big") % uploads.RETRY_SECONDS
    assert state == {"a1": ("accepted", None), "b1": ("quarantined", wait("b1", 12)), "b2": ("quarantined", wait("b2", 16))}
    later = {r.fingerprint: r.state for r in uploads.ledger_state(saves, won, F.lit(wait("b1", 12)), F.lit("new")).collect()}
    assert later == {"a1": "accepted", "b1": "retry", "b2": "retry"}


def test_few_are_tried_again(spark):
    saves = spark.createDataFrame([("d", i, i, f"f{i}", "quarantined", i, "w" if i % 2 else "old") for i in range(9)], ENTRY)
    got = {r.fingerprint: r.state for r in uploads.ledger_state(saves, saves, F.lit(1 << 40), F.lit("w"), 6).collect()}
    assert [f for f, s in sorted(got.items()) if s == "quarantined"] != [] and all(got[f"f{i}"] == "retry" for i in range(0, 9, 2))
    assert sum(s == "retry" for s in got.values()) == 6


@pytest.mark.parametrize("change, fault", [
    ({}, []), ({"outcome": "lost"}, ["malformed", "count"]), ({"session": "other"}, ["foreign", "short"]), ({"n": 3}, ["excess", "count"]), ({"n": 1}, ["short", "count"]), ({"n": 0}, ["malformed", "short", "count"]),
    ({"outcome": "rejected"}, ["count"]), ({"outcome": "rejected", "permanent": False}, ["retryable", "count"]), ({"twice": True}, ["repeated", "excess", "count"]), ({"fingerprint": "abc"}, ["malformed", "foreign", "short"]),
])
def test_each_rule_of_an_answer(spark, change, fault):
    digest = "ab" * 32
    request = spark.createDataFrame([("b", "s", digest)] * 2 + [("b", "t", digest), ("none", "s", digest)], "batch string, session string, fingerprint string")
    row = {"batch": "b", "outcome": "accepted", "session": "s", "fingerprint": digest, "n": 2, "permanent": True}
    twice = change.pop("twice", False) if "twice" in (change := dict(change)) else False
    rows = [row | change] + [row] * twice + [row | {"session": "t", "n": 1, "outcome": "conflict"}]
    outcomes = spark.createDataFrame([tuple(r[c] for c in row) for r in rows], "batch string, outcome string, session string, fingerprint string, n long, permanent boolean")
    accepted = spark.createDataFrame([("b", 2), ("none", 0)], "batch string, accepted long")
    got = {r.batch: r.faults for r in uploads.ack_faults(request, outcomes, accepted, "batch").collect()}
    assert got == {"b": fault, "none": ["short"]}


def told_once(rows, most):
    """Each old record chooses its nearest new one; each new one takes its nearest old one."""
    new = [r for r in rows if r[3]]
    wants = {}
    for g, i, t, is_new in rows:
        near = sorted((abs(t - u), u, j) for h, j, u, _ in new if h == g and abs(t - u) <= most)
        if not is_new and near:
            wants.setdefault((g, near[0][2]), []).append((near[0][0], t, i))
    taken = {(g, min(w)[2]): j for (g, j), w in wants.items()}
    return sorted((g, i, (g, i) in wants) for g, i, t, _ in rows if (g, i) not in taken)


def test_records_of_one_event(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), i, rng.randrange(2500), rng.random() < 0.4) for i in range(240)]
    rows += [(9, 1000, 0, True), (9, 1001, 80, False), (9, 1002, 160, False), (9, 1003, 240, True), (9, 1004, 100, False)]
    start = datetime.datetime(2030, 1, 1, tzinfo=datetime.timezone.utc)
    df = spark.createDataFrame([(g, i, start + datetime.timedelta(milliseconds=t), n) for g, i, t, n in rows], "g int, i int, t timestamp, new boolean")
    got = windows.paired(df, "g", "t", "i", F.col("new"))
    assert sorted((r.g, r.i, r.paired) for r in got.collect()) == told_once(rows, 100)
    assert got.columns == ["g", "i", "t", "new", "paired"]


def test_rows_of_one_name_are_one_record(spark):
    """Two older rows share a name, and a third has a current one's: the nearer one counts, and all rows of a taken name go."""
    rows = [(1, 10, 1_000, True), (1, 11, 60_000, True), (1, 5, 1_020, False), (1, 5, 61_000, False), (1, 11, 1_010, False), (1, 7, 900_000, False)]
    df = spark.createDataFrame(rows, "g int, i int, ms long, new boolean").select("g", "i", F.timestamp_millis("ms").alias("t"), "new")
    got = sorted((r.i, r.paired) for r in windows.paired(df, "g", "t", "i", F.col("new")).collect())
    # 11 tells of 10 at 10 ms, 5 of 10 at 20 ms: 11 is taken, with the current row of its name
    assert got == [(5, False), (5, False), (7, False), (10, True)]


def test_age_to_the_microsecond(spark):
    rows = spark.createDataFrame([(1, "2024-01-13 00:00:00"), (2, "2024-01-12 23:59:59.999999"), (3, "2024-01-12 23:59:59"), (4, None)], "i int, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r.i for r in state.within(rows, F.col("t"), F.lit("2024-01-20").cast("timestamp"), 7).collect()] == [1]


def test_policy_digests_stay_in_their_row(spark):
    """A snapshot's digests are counted without a row for each policy; rows of one snapshot count together."""
    rows = spark.createDataFrame([(1, "t", "l"), (1, "t", "m"), (2, "t", None)], "i int, t string, l string").withColumns({c: F.lit(c) for c in ("a", "f", "d")})
    got = snapshots.policy_digests(rows, "i", dict(zip(snapshots.POLICY_PARTS, ("t", "l", "a", "f", "d"), strict=True)))
    assert {r.i: r.digests for r in got.collect()} == {1: 30, 2: 10}
    assert "Generate" not in got._jdf.queryExecution().toString()
