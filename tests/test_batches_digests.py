"""Greedy batches, keyed hashes and canonical JSON against plain Python."""

import hashlib
import hmac
import random
import struct

from pyspark.sql import functions as F

from quillmeter.functions import digests
from quillmeter.operators import packing


def test_greedy_batches(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5, 30, 200])) for i in range(400)]
    got = packing.greedy_batches(spark.createDataFrame(data, "g string, i long, n long").repartition(7), "g", ["i"], "n", 4, 60)
    want = []
    for g in ("a", "b", None):
        batch = count = total = 0
        for _, i, n in sorted((r for r in data if r[0] == g), key=lambda r: r[1]):
            if count and (count >= 4 or total + (n or 0) > 60):
                batch, count, total = batch + 1, 0, 0
            count, total = count + 1, total + (n or 0)
            want.append((i, batch))
    assert sorted((r.i, r.batch) for r in got.collect()) == sorted(want)
    assert got.where("false").count() == 0
    assert packing.greedy_batches(spark.createDataFrame([], "g string, i long, n long"), "g", ["i"], "n", 4, 60).count() == 0


def test_digests(spark):
    texts = ["", "a", "Grüße 🙂", "x" * 500, None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", digests.hmac_sha256(b"key", F.col("t")).alias("h")).collect():
        assert r.h == (None if r.t is None else hmac.new(b"key", r.t.encode(), hashlib.sha256).hexdigest())
    cut = lambda s: struct.pack(">Q", len(s.encode())) + s.encode()
    got = frame.select("t", digests.framed([F.col("t"), F.lit("é")]).alias("f")).collect()
    assert all(bytes(r.f) == cut(r.t or "") + cut("é") for r in got)
    sets = spark.createDataFrame([(["b", "a", None, "b"],), ([],)], "v array<string>").select(digests.framed_set_digest(F.col("v")).alias("d")).collect()
    assert [r.d for r in sets] == [hashlib.sha256(cut("a") + cut("b")).hexdigest(), hashlib.sha256(b"").hexdigest()]


def test_canonical_json(spark):
    rows = [('{ "b": 1, "a": [ {"z": "}", "c": null} ] }', '{"a":[{"c":null,"z":"}"}],"b":1}'), ('{"a":"1"}', '{"a":"1"}'), ("no json", None), (None, None), ('{"a":1,"a":2}', None)]
    got = spark.createDataFrame(rows, "j string, want string").select("want", digests.canonical_json(F.col("j")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
