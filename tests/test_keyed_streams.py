"""State machines over streams in any split against the same over tables."""

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillmeter.streaming import activity, scans, watching

PAGE = "scan string, seq long, mode string, known string, cursor string, state string, next string, valid boolean, truncated boolean, digest string, entities array<string>"


def streamed(spark, tmp_path, rows, order, splits, make):
    """The rows that a stream gives over files of ``splits`` parts of the rows in order."""
    data = sorted(rows.collect(), key=lambda r: tuple(r[c] for c in order))
    folder, name = tmp_path / f"in{splits}", f"out_{splits}_{random.randrange(1 << 30)}"
    folder.mkdir()
    size = -(-len(data) // splits)
    for k in range(0, len(data), size):
        spark.createDataFrame(data[k : k + size], rows.schema).coalesce(1).write.parquet(str(tmp_path / f"p{splits}-{k}"))
        (file,) = [f for f in (tmp_path / f"p{splits}-{k}").iterdir() if f.name.endswith(".parquet")]
        os.rename(file, folder / f"{k:06}.parquet")
        os.utime(folder / f"{k:06}.parquet", (time.time() - 5000 + k, time.time() - 5000 + k))
    stream = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ckpt{splits}")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert query.exception() is None
    return spark.table(name)


def plain(df, columns=None):
    return sorted((tuple(r) for r in df.select(columns or df.columns).collect()), key=str)


def page(scan, seq, cursor, state="next", next_=None, mode="full", known=None, valid=True, truncated=False, digest="d", entities=("a", "b")):
    return (scan, seq, mode, known, cursor, state, next_, valid, truncated, digest, list(entities))


def pages(spark):
    chain = lambda scan, n, **last: [page(scan, i, f"c{i}" if i else None, next_=f"c{i + 1}", entities=[f"e{(i * 3 + j) % 11}" for j in range(4)]) for i in range(n)] + [page(scan, n, f"c{n}", **last)]
    rows = chain("whole", 14, state="terminal") + chain("ambiguous", 2, state="ambiguous") + chain("cut", 3, state="terminal", truncated=True) + chain("broken", 2, valid=False)
    rows += [page("none", 0, None, valid=False), page("none", 1, None, state="terminal")]
    rows += [page("churn", 0, None, next_="x"), page("churn", 1, "x", next_="y"), page("churn", 2, "y", next_="x"), page("churn", 3, "x", next_="z")]
    rows += chain("open", 5, next_="c6") + [page("open", 90, "c2", next_="c3", entities=["stranger"])]
    rows += [page("head", 0, None, mode="head", state="terminal"), page("known", 0, None, mode="head", known="d"), page("more", 0, None, mode="head", next_="x")]
    rows += chain("long", 30, state="terminal") + [page("odd", 0, None, state=None), page(None, 0, None, state="terminal")]
    return spark.createDataFrame(rows, PAGE)


def test_page_scans(spark):
    found = scans.scanned(pages(spark), most_pages=20, most_keys=40)
    ends = {r.scan: (r.outcome, r.reason, r.pages, r.keys) for r in found.where("outcome is not null").collect()}
    assert ends == {
        "whole": ("healthy", None, 15, 13), "ambiguous": ("degraded", "ambiguous", 3, 9), "cut": ("degraded", "truncated", 4, 12), "broken": ("degraded", "invalid", 2, 7), "none": ("failed", "invalid", 0, 0),
        "churn": ("degraded", "cursor repeated", 3, 2), "head": ("healthy", None, 1, 2), "known": ("unchanged", None, 1, 2), "more": ("degraded", "head", 1, 2), "long": ("degraded", "pages", 20, 11), "odd": ("failed", "invalid", 0, 0),
    }
    rows = {r.scan: r.n for r in found.where("entity is not null").groupBy("scan").agg(F.count("*").alias("n")).collect()}
    assert rows["whole"] == 14 * 4 + 2 and rows["open"] == 5 * 4 + 2 and "known" not in rows and "none" not in rows
    few = scans.scanned(pages(spark).where("scan = 'whole'"), most_keys=6)
    assert [tuple(r) for r in few.where("outcome is not null").select("outcome", "reason", "keys").collect()] == [("degraded", "keys", 6)]
    made = scans.chunks(found.where("scan = 'whole'"), 5).orderBy("entity").collect()
    assert [r.chunk for r in made] == [0] * 5 + [1] * 5 + [2] * 3
    assert {r.entity: r.page for r in made}["a"] == 15


@pytest.mark.parametrize("splits", [1, 3, 10])
def test_page_scans_in_any_number_of_cycles(spark, tmp_path, splits):
    want = plain(scans.scanned(pages(spark), most_pages=20, most_keys=40))
    got = streamed(spark, tmp_path, pages(spark).where("scan is not null"), ["seq", "scan"], splits, lambda s: scans.scanned_stream(s, most_pages=20, most_keys=40))
    assert plain(got) == want


def instants(spark):
    rng, start = random.Random(5), datetime.datetime(2030, 5, 1)
    rows = []
    for seq in range(240):
        now = start + datetime.timedelta(minutes=seq * 3) + datetime.timedelta(days=200 if seq > 200 else 0)
        at = now + datetime.timedelta(minutes=rng.choice([-40, -20, -15, -3, 0, 4, 5, 6]))
        rows.append((f"s{rng.randrange(6)}", seq, rng.choice([at.isoformat() + "Z", at.isoformat() + "Z", at.isoformat() + "+00:00", "soon"]), now))
    return spark.createDataFrame(rows, "session string, seq long, said string, now timestamp")


@pytest.mark.parametrize("splits", [1, 4, 9])
def test_activity_in_any_split(spark, tmp_path, splits):
    rows = instants(spark)
    want = plain(activity.advanced(rows))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # with idle states, Spark would go on with empty batches
    try:
        assert plain(streamed(spark, tmp_path, rows, ["seq"], splits, activity.advanced_stream)) == want
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert any(r[5] for r in want) and any(r[3] and not r[4] for r in want) and sum(r[3] is None for r in want) >= 8


def changes(spark):
    rng, at, rows = random.Random(6), datetime.datetime(2030, 5, 1), []
    for seq in range(200):
        at += datetime.timedelta(milliseconds=rng.choice([0, 10, 900, 2000, 2001, 5000]))
        rows.append((rng.choice(["a", "b"]), f"/p{rng.randrange(7)}", at, seq))
    return spark.createDataFrame(rows, "source string, path string, at timestamp, seq long")


def test_bursts_of_a_table(spark):
    got = plain(watching.bursts(changes(spark), most=3))
    state, want = {}, []
    step = watching.gather(most=3)
    for r in sorted(changes(spark).collect(), key=lambda r: (r.at, r.seq)):
        state[r.source], out = step(state.get(r.source), {"source": r.source, "path": r.path, "at": int(r.at.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000), "seq": r.seq})
        want += out
    want += [w for s in state.values() for w in watching.release(s)]
    assert got == sorted(((w["source"], w["first"], w["last"], w["paths"], w["overflowed"], w["newest"]) for w in want), key=str)
    assert any(r[4] for r in got) and any(r[3] > 1 for r in got)


@pytest.mark.parametrize("splits", [2, 7])
def test_bursts_of_a_stream(spark, tmp_path, splits):
    """All bursts but the last of each source, which waits for the watermark, and those too if later rows move it on."""
    rows = changes(spark).union(spark.createDataFrame([("c", "/late", datetime.datetime(2031, 1, 1), 500)], changes(spark).schema))
    got = plain(streamed(spark, tmp_path, rows, ["at", "seq"], splits, lambda s: watching.bursts_stream(s, most=3)))
    want = plain(watching.bursts(rows, most=3))
    assert set(got) <= set(want) and {w for w in want if w[0] != "c"} - set(got) <= {max(w for w in want if w[0] == k) for k in "ab"}
