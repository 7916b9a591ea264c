"""Functions against golden values and plain Python."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillmeter.functions import numbers, text, times
from quillmeter.operators import joins, packing, usage

#: Published costs: input, cached input and output tokens, dollars.
COSTS = [(20681755, 20253696, 36892, "13.373903"), (20218739, 19746816, 41624, "13.481743"), (4949500, 4690688, 12852, "4.024964"), (19828892, 19484928, 36574, "12.559504")]


def test_published_costs(spark):
    rows = spark.createDataFrame(COSTS, "i long, c long, o long, want string")
    for r in rows.select("want", numbers.token_cost(F.col("i"), F.col("c"), F.lit(0).cast("long"), F.col("o")).alias("cost")).collect():
        assert r.cost.quantize(Decimal("0.000001")) == Decimal(r.want)


def test_saturating_total_stops_at_the_largest_long(spark):
    big = numbers.LARGEST
    rows = spark.createDataFrame([(big, 1), (None, None), (big - 1, 1), (3, None)], "a long, b long")
    assert [r.t for r in rows.select(numbers.saturating_total(F.col("a"), F.col("b")).alias("t")).collect()] == [big, 0, big, 3]


def test_money_rounds_at_the_seventh_digit_alone(spark):
    cases = {"0.0000004999999999999": 0, "0.0000005": 1, "1": 1000000, "12.3": 12300000, "-1": None, "1e3": None, ".5": None, "": None, " 2.0000015 ": 2000002}
    rows = spark.createDataFrame(list(cases.items()), "t string, want long").select("t", "want", numbers.micro_dollars(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in rows.collect())


def test_templates(spark):
    cases = [
        ("gpt4 and v2 stay", "gpt4 and v2 stay"),
        ("Run 2024-01-02T03 (550e8400-e29b-41d4-a716-446655440000), 12345! 123", "run <dynamic> <dynamic> <dynamic> 123"),
        ("<environment_context>\n<cwd>/x</cwd></environment_context>  <recommended_plugins>a</recommended_plugins> Do it", "do it"),
        ("<environment_context>no folder</environment_context> x", "<environment_context>no folder</environment_context> x"),
        ("# AGENTS.md instructions for /x\n<INSTRUCTIONS>abc</INSTRUCTIONS> Go 0123456789abcdef", "go <dynamic>"),
        (" \n ", None),
    ]
    rows = spark.createDataFrame(cases, "t string, want string").select("t", "want", text.template(F.col("t")).alias("got"))
    assert [r.got for r in rows.collect()] == [w for _, w in cases]


def test_instants(spark):
    cases = [("2026-07-19T23:30:00.5-02:00", "2026-07-20 01:30:00.5"), ("2026-07-19T10:00:00Z", "2026-07-19 10:00:00"), ("2026-07-19 10:00:00", None), ("2026-13-19T10:00:00Z", None), (None, None)]
    rows = spark.createDataFrame(cases, "t string, want string").select(times.instant(F.col("t")).alias("got"), F.col("want").cast("timestamp").alias("want"))
    assert all(r.got == r.want for r in rows.collect())


def test_longest_contained_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["red", "green", "blue", "yellow", "violet", "ab"])
    texts = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(900, None), (901, ""), (902, "xx" + "abcdefghijklmnopqrstuvwxyz" + "yy")]
    signatures = [(f"s{i}", t[a : a + rng.randrange(24, 60)]) for i in range(60) for _, t in [rng.choice(texts[:80])] for a in [rng.randrange(max(len(t) - 24, 1))]]
    signatures += [("one", "abcdefghijklmnopqrstuvwxyz"), ("two", "green greenish"), ("null", None)]
    want = {}
    for i, t in texts:
        met = {}
        for label, s in signatures:
            if s and len(s) >= 24 and t and s in t:
                met.setdefault(len(s), set()).add(label)
        if met and len(met[max(met)]) == 1:
            want[i] = next(iter(met[max(met)]))
    got = joins.longest_contained(spark.createDataFrame(texts, "id long, t string"), "t", "id", spark.createDataFrame(signatures, "label string, s string"), "s", "label")
    assert len(want) > 10 and {r.id: r.label for r in got.collect()} == want


def test_calendar_in_local_time(spark):
    events = spark.sql("select * from values (1, timestamp'2024-01-01 04:30:00'), (2, timestamp'2024-07-07 12:00:00') as t(id, ts)")
    rules = spark.createDataFrame([("new_year_eve", None, 23, None, 31, 12), ("sunday", None, None, 7, None, None), ("any", None, None, None, None, None)], "rule string, minute int, hour int, weekday int, day int, month int")
    got = joins.calendar_matches(events, "ts", rules, "America/New_York").select("id", "rule").collect()
    assert sorted(map(tuple, got)) == [(1, "any"), (1, "new_year_eve"), (1, "sunday"), (2, "any"), (2, "sunday")]
    assert joins.calendar_matches(events, "ts", rules.where("false")).count() == 0


def test_a_day_too_large_for_a_batch_is_refused(spark):
    days = spark.createDataFrame([("a", "2024-01-01", 2000)], "g string, d string, n long").withColumn("d", F.to_date("d"))
    edge = F.lit("2024-01-01").cast("date")
    with pytest.raises(Exception, match="more rows than a batch holds"):
        packing.day_batches(days, "g", "d", "n", edge, edge).collect()


def test_repeated_checkpoints_add_nothing(spark):
    rows = spark.createDataFrame([(1, 1, 10, None), (1, 2, 10, None), (1, 3, 25, None), (1, 4, 5, None), (1, 5, 9, 100), (1, 6, 9, None)], "g int, o int, total long, delta long")
    assert [r.used for r in usage.counter_used(rows, "g", "o", "total", "delta").orderBy("o").collect()] == [10, 0, 15, 5, 100, 0]
