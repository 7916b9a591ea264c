"""Stored activity of sessions: each row is held against the newest instant that its session had before."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions import times
from quillmeter.streaming import keyed

#: Minutes that a session counts as active, minutes that clocks may differ, days that an instant is kept.
ACTIVE_MINUTES, AHEAD_MINUTES, KEPT_DAYS = 15, 5, 90

OUT = "session string, seq long, said string, previous string, advanced boolean, active boolean"
STATE = "at long, said string"
_MINUTE, _DAY = 60_000_000, 86_400_000_000


def advance(state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
    """The machine of one session; ``at`` and ``now`` are microseconds.

    ``previous`` is the text of the newest instant so far, while that is not older than 90 days. A row advances the
    session if it is newer, and makes it active if it is also within the last 15 minutes, or 5 minutes ahead at most.
    Late rows give a row out like others, neither advanced nor active; the stored instant never goes back.
    """
    at, now = row["at"], row["now"]
    held = state if state and state["at"] >= now - KEPT_DAYS * _DAY else None
    new = held is None or at > held["at"]
    active = new and now - ACTIVE_MINUTES * _MINUTE <= at <= now + AHEAD_MINUTES * _MINUTE
    out = {"session": row["session"], "seq": row["seq"], "said": row["said"], "previous": held["said"] if held else None, "advanced": new, "active": active}
    newest = {"at": at, "said": row["said"]} if state is None or at > state["at"] else state
    return newest, [out]


def _read(rows: DataFrame) -> DataFrame:
    """(session, seq, said, at, now) in microseconds; rows whose text is no instant are left out."""
    at = F.unix_micros(times.instant(F.col("said")))
    return rows.select(F.col("session").cast("string").alias("session"), "seq", "said", at.alias("at"), F.unix_micros(F.col("now").cast("timestamp")).alias("now")).where("at is not null and now is not null")


def advanced_stream(rows: DataFrame) -> DataFrame:
    """For a stream of (session, seq, said, now): what each row does to its session. State is forgotten after 90 idle days.

    Sessions wait for that by the clock, so a query that is to end (``availableNow``) needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off, or Spark goes on with empty batches.
    """
    return keyed.over_stream(_read(rows), "session", ["seq"], OUT, STATE, advance, idle_ms=KEPT_DAYS * 86_400_000)


def advanced(rows: DataFrame) -> DataFrame:
    """The same for a table, by windows: the newest instant of the session's rows before."""
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # the first text of the newest instant
    held = F.max(F.struct("at", (-F.col("seq")).alias("o"), "said")).over(before)
    seen = _read(rows).withColumn("_h", held)
    kept = F.col("_h.at") >= F.col("now") - KEPT_DAYS * _DAY
    new = ~F.coalesce(kept, F.lit(False)) | (F.col("at") > F.col("_h.at"))
    active = new & F.col("at").between(F.col("now") - ACTIVE_MINUTES * _MINUTE, F.col("now") + AHEAD_MINUTES * _MINUTE)
    return seen.select("session", "seq", "said", F.when(kept, F.col("_h.said")).alias("previous"), new.alias("advanced"), active.alias("active"))
