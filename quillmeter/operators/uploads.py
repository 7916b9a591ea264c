"""What became of uploads: whether an answer covers its request, and the ledger of what a destination has or refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.streaming import keyed

#: The outcomes of an answer, those that count as accepted, and how many items are tried again in a cycle.
OUTCOMES, ACCEPTED, RETRIES = ("accepted", "unchanged", "rejected", "conflict"), ("accepted", "unchanged"), 50
#: Seconds that a refused item waits, and twice that at most: a choice of ours.
RETRY_SECONDS = 7 * 86_400


def ack_faults(request: DataFrame, outcomes: DataFrame, accepted: DataFrame, batch: str) -> DataFrame:
    """(batch, faults): what is wrong with each batch's answer; no faults, no objection.

    request: (batch, session, fingerprint), a row for each item; outcomes: (batch, outcome, session, fingerprint, n,
    permanent), ``n`` occurrences; accepted: (batch, accepted), as the answer counts. The outcomes must be disjoint and
    together cover the request as a multiset: ``malformed`` (blank session, no digest, no occurrence, unknown outcome), ``foreign``
    (not asked for), ``repeated`` (an item in two outcomes, or twice in one), ``excess`` and ``short`` (occurrences), ``retryable`` (a
    rejection that isn't permanent), ``count`` (accepted and unchanged ones are others than counted). Batches without an
    answer are ``short``.
    """
    item = [batch, "session", "fingerprint"]
    asked = request.groupBy(*item).agg(F.count("*").alias("asked"))
    bad = (F.trim("session") == "") | ~F.col("fingerprint").rlike("^[0-9A-Fa-f]{64}$") | (F.col("n") < 1) | ~F.col("outcome").isin(*OUTCOMES)
    marked = outcomes.withColumns({"_bad": F.coalesce(bad, F.lit(True)), "_again": (F.col("outcome") == "rejected") & ~F.coalesce("permanent", F.lit(False))})
    said = marked.groupBy(*item).agg(F.count("*").alias("rows"), F.sum("n").alias("said"), F.max("_bad").alias("bad"), F.max("_again").alias("again"), F.sum(F.when(F.col("outcome").isin(*ACCEPTED), F.col("n")).otherwise(0)).alias("good"))
    both = asked.join(said, item, "full")
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    per = both.groupBy(batch).agg(
        any_("bad").alias("malformed"), any_(F.col("asked").isNull()).alias("foreign"), any_(F.col("rows") > 1).alias("repeated"), any_(F.col("said") > F.col("asked")).alias("excess"),
        any_(F.coalesce("said", F.lit(0)) < F.col("asked")).alias("short"), any_("again").alias("retryable"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
    )
    counted = per.join(accepted, batch, "left").withColumn("count", ~F.col("good").eqNullSafe(F.coalesce("accepted", F.lit(0))))
    names = ("malformed", "foreign", "repeated", "excess", "short", "retryable", "count")
    return counted.select(batch, F.array_compact(F.array(*[F.when(F.col(n), n) for n in names])).alias("faults"))


def _turn(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
    """Compare and swap: a save whose generation is the current one wins and begins the next; others are lost."""
    generation = state["generation"] if state else 0
    won = row["generation"] == generation
    return {"generation": generation + won}, [row] if won else []


def won_saves(saves: DataFrame) -> DataFrame:
    """Of a log of saves (destination, seq, generation) in order those that count: ``generation`` is the one that the writer had read.

    One number is kept for each destination while its saves stream by.
    """
    schema = f"destination {saves.schema['destination'].dataType.simpleString()}, seq long, generation long"
    return keyed.over_batch(saves.select("destination", F.col("seq").cast("long").alias("seq"), F.col("generation").cast("long").alias("generation")), "destination", ["seq"], schema, _turn)


def retry_after(fingerprint: Column, at: Column, seconds: int = RETRY_SECONDS) -> Column:
    """When a refused item may be tried again, in seconds: a week and a share of another by its own digest."""
    # the first eight bytes of the digest, as two halves: they may pass a signed long
    half = lambda a: F.conv(F.substr(F.sha2(fingerprint.cast("binary"), 256), F.lit(a), F.lit(8)), 16, 10).cast("decimal(20,0)")
    return (at + seconds + ((half(1) * (1 << 32) + half(9)) % seconds)).cast("long")


def ledger_state(entries: DataFrame, won: DataFrame, now: Column, witness: Column, most: int = RETRIES) -> DataFrame:
    """(destination, fingerprint, state, retry_after): what a destination has ``accepted``, what is ``quarantined`` and what to ``retry``.

    entries: (destination, seq, fingerprint, outcome, at, witness) of all saves, of which those in ``won`` count; ``at`` in
    seconds. A quarantined item is due once its time has come, or at once if it was refused under another ``witness`` (the
    parser or policy that made it). At most ``most`` of a destination are tried again in a cycle: those of other
    witnesses first, then the longest due.
    """
    kept = entries.join(won.select("destination", "seq"), ["destination", "seq"], "left_semi")
    last = F.max(F.when(F.col("outcome") == "quarantined", F.struct("seq", "at", F.col("witness").alias("by"))))
    items = kept.groupBy("destination", "fingerprint").agg(F.max(F.col("outcome") == "accepted").alias("_in"), last.alias("_q")).where(F.col("_in") | F.col("_q").isNotNull())
    held = items.select("destination", "fingerprint", "_in", retry_after(F.col("fingerprint"), F.col("_q.at")).alias("retry_after"), (F.col("_q.by") == witness).alias("_same"))
    due = ~F.col("_in") & (~F.col("_same") | (F.col("retry_after") <= now))
    first = F.row_number().over(Window.partitionBy("destination", due).orderBy("_same", "retry_after", "fingerprint"))
    state = F.when(F.col("_in"), "accepted").when(due & (first <= most), "retry").otherwise("quarantined")
    return held.select("destination", "fingerprint", state.alias("state"), F.when(~F.col("_in"), F.col("retry_after")).alias("retry_after"))
