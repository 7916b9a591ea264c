"""Keyed state from a stream: repeated batches, late rows, hours that are replaced."""

import datetime

from pyspark.sql import functions as F

from quillmeter.operators import joins
from quillmeter.sources.tables import event_stream
from quillmeter.streaming import upserts

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, rows):
    return spark.createDataFrame([(i, datetime.datetime(2024, 1, 1, h), 1, "view", v, "{}") for i, h, v in rows], SCHEMA)


def merge(old, batch):
    fresh = upserts.hourly_volume(batch)
    if old is None:
        return fresh
    return joins.merge_latest(old, fresh, ["hour"], ["n", "total"])


def test_stream_of_files_into_state(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/state"
    run = upserts.upsert(root, merge)

    def drain():
        query = event_stream(spark, source).writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    def state():
        return {r.hour.hour: (r.n, r.total) for r in upserts.current(spark, root).collect()}

    events(spark, [(1, 3, 1.0), (2, 3, 2.0), (3, 4, 5.0)]).write.parquet(source)
    drain()
    assert state() == {3: (2, 3.0), 4: (1, 5.0)}
    # late rows of hour 3 replace it; hour 4 stays
    events(spark, [(4, 3, 9.0)]).write.mode("append").parquet(source)
    drain()
    assert state() == {3: (1, 9.0), 4: (1, 5.0)}


def test_a_new_stream_goes_on_from_the_state(spark, tmp_path):
    """Batch ids begin anew with a new checkpoint; nothing is lost."""
    root = str(tmp_path / "state")
    for k in (56, 57):
        upserts.upsert(root, merge)(events(spark, [(k, k % 24, 1.0)]), k)
    events(spark, [(3, 3, 2.0)]).write.parquet(str(tmp_path / "in"))
    for n, ckpt in ((2, "one"), (3, "two")):
        query = event_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(upserts.upsert(root, merge)).option("checkpointLocation", str(tmp_path / ckpt)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        assert {r.hour.hour for r in upserts.current(spark, root).collect()} == {8, 9, 3}
        assert upserts._versions(spark, root)[-1] == n
    upserts.upsert(root, merge)(events(spark, [(4, 4, 2.0)]), 0)
    assert {r.hour.hour for r in upserts.current(spark, root).collect()} == {8, 9, 3, 4}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    run = upserts.upsert(str(tmp_path), merge)
    first, second = events(spark, [(1, 1, 1.0)]), events(spark, [(2, 2, 2.0)])
    for batch, k in ((first, 0), (second, 1), (second, 1)):
        run(batch, k)
    assert sorted((r.hour.hour, r.n) for r in upserts.current(spark, str(tmp_path)).collect()) == [(1, 1), (2, 1)]
    for k in range(2, 6):  # old versions go, but the one before the last stays for a repeated batch
        run(events(spark, [(9, k, 1.0)]), k)
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("v")) == ["v4", "v5"]
    assert upserts.current(spark, str(tmp_path)).count() == 5
    assert upserts.hourly_volume(events(spark, [])).select(F.count("*")).first()[0] == 0
