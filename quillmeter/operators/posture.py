"""How deep sessions fill their context, and which of them are active."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A peak over the first number proves the long window, which is the second.
DEEP, LONG_WINDOW = 200_000, 1_000_000


def summary(rows: DataFrame, now: DataFrame, time: str, id_: str, days: int = 7, most_peaks: int = 14) -> DataFrame:
    """One row over the sessions of the last ``days`` (and five minutes ahead of now), none if there is no session.

    rows: time, id, first_turn, peak, compactions, reread. Counts stay null where nothing was reported: ``deep`` without a
    peak, ``over_window`` unless every peak proves its window, ``compactions`` without a count. ``peaks`` are the newest
    ones, oldest first. now: one row with ``now``.
    """
    recent = rows.join(F.broadcast(now)).where(F.col(time).between(F.col("now") - F.expr(f"interval {days} days"), F.col("now") + F.expr("interval 5 minutes")))
    deep, peaks = F.count_if(F.col("peak") > DEEP), F.count("peak")
    one = recent.agg(
        F.count("*").alias("sessions"), F.floor(F.median("first_turn")).alias("typical_first_turn"), peaks.alias("peak_sessions"), deep.alias("evidenced"), F.when(peaks > 0, deep).alias("deep"),
        F.when((peaks > 0) & (peaks == deep), F.count_if(F.col("peak") > LONG_WINDOW)).alias("over_window"), F.sum("compactions").alias("compactions"), F.sum("reread").alias("reread"),
    ).where("sessions > 0")
    last = recent.where("peak is not null").orderBy(F.desc(time), F.desc(id_)).limit(most_peaks)
    drawn = last.agg(F.transform(F.array_sort(F.collect_list(F.struct(time, id_, "peak"))), lambda r: r["peak"]).alias("peaks"))
    return one.join(F.broadcast(drawn))


def active(fresh: DataFrame, state: DataFrame, now: DataFrame, key: str, seen: str) -> DataFrame:
    """(key, last_seen, before): rows that moved on from the stored instant and lie within 15 minutes before and 5 after now."""
    joined = fresh.select(key, F.col(seen).alias("last_seen")).join(state.select(key, F.col(seen).alias("before")), key, "left").join(F.broadcast(now))
    moved = F.col("before").isNull() | (F.col("last_seen") > F.col("before"))
    near = F.col("last_seen").between(F.col("now") - F.expr("interval 15 minutes"), F.col("now") + F.expr("interval 5 minutes"))
    return joined.where(moved & near).select(key, "last_seen", "before")
