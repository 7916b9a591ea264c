"""Usage of models from transcript records: repeated lines, owned parts, reconciled messages, hourly groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def messages(lines: DataFrame, order: str = "ordinal") -> DataFrame:
    """(file, message_id, request_id, model, input, cached, output, ordinal, conflict): one row for each message of a file.

    A message comes in several lines while it streams: input, cached and model must agree, output must not fall, and the
    last line counts. A message that breaks a rule is a conflict, which makes its file one to read again.
    """
    key = ["file", "message_id", "request_id"]
    # lines of a message are dealt out and sorted once: the window's order serves the grouping too
    before = F.lag("output").over(Window.partitionBy(*key).orderBy(order))
    falls = lines.withColumn("_falls", before.isNotNull() & (F.col("output") < before))
    last = F.max(F.struct(order, "model", "input", "cached", "output")).alias("_l")
    said = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("model", "input", "cached")])
    differs = F.min(said) < F.max(said)
    return falls.groupBy(*key).agg(last, (differs | F.bool_or("_falls")).alias("conflict")).select(*key, "_l.model", "_l.input", "_l.cached", "_l.output", F.col(f"_l.{order}").alias("ordinal"), "conflict")


def without_forks(lines: DataFrame, session: str, marker: str) -> DataFrame:
    """(lines, quarantined): lines without those copied from another session; an odd marker quarantines its file."""
    odd = F.max(F.col(marker) == "").over(Window.partitionBy("file"))
    flagged = lines.withColumn("quarantined", F.coalesce(odd, F.lit(False)))
    return flagged.where(F.col(marker).isNull() | (F.col(marker) == "") | (F.col(marker) == F.col(session)))


def owned(records: DataFrame, start: str, trigger: Column) -> DataFrame:
    """Records of a file from where its own history starts: a given ordinal, else its first trigger; all without either."""
    by = Window.partitionBy("file")
    at = F.coalesce(F.min(start).over(by), F.min(F.when(trigger, F.col("ordinal"))).over(by), F.lit(0))
    return records.withColumn("_at", at).where("ordinal >= _at").drop("_at")


def counter_used(rows: DataFrame, group: str, order: str, total: str, delta: str) -> DataFrame:
    """Adds ``used``: a response's own delta where it has one, else what the cumulative total grew by.

    A repeated checkpoint (equal total, no delta) adds nothing; a smaller total starts anew and counts whole.
    """
    before = F.coalesce(F.last(total, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grown = F.when(F.col(total) < before, F.col(total)).otherwise(F.col(total) - before)
    return rows.withColumn("used", F.coalesce(F.col(delta), grown, F.lit(0)))


def reconciled(shapes: DataFrame, keys: list[str], shape: str, last: Column | None = None) -> DataFrame:
    """(keys, n, retry): how often a response counts; both shapes must name it equally often, where both are there at all.

    last: what else is kept of each response, as ``_l``. shape: ``message`` or ``message_end``. Where the counts differ, the larger one counts and the response is to be read again.
    """
    own = [] if last is None else [last.alias("_l")]
    n = shapes.groupBy(*keys).agg(F.count_if(F.col(shape) == "message").alias("_a"), F.count_if(F.col(shape) == "message_end").alias("_b"), *own)
    return n.select(*keys, *n.columns[len(keys) + 2 :], F.greatest("_a", "_b").alias("n"), ((F.col("_a") > 0) & (F.col("_b") > 0) & (F.col("_a") != F.col("_b"))).alias("retry"))


def hourly(usage: DataFrame, time: str, keys: list[str], sums: list[str], cost: str) -> DataFrame:
    """(hour, keys, sums, cost, n): tumbling hours; a cost that one message lacks is unknown for the group."""
    whole = F.when(F.count(cost) == F.count("*"), F.sum(cost)).alias(cost)
    return usage.groupBy(F.window(time, "1 hour").alias("_w"), *keys).agg(*[F.sum(c).alias(c) for c in sums], whole, F.count("*").alias("n")).select(F.col("_w.start").alias("hour"), *keys, *sums, cost, "n")


def totals_agree(usage: DataFrame, hours: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """(keys, sums) of the groups whose hours don't add up to their total; no row if all is well."""
    whole = usage.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return whole.exceptAll(hours.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]))


def covered(billed: DataFrame, evidence: DataFrame, session: str, request: str, account: str) -> DataFrame:
    """(session, account, complete): complete if evidence names every billed request once and just one account."""
    seen = evidence.groupBy(session, request).agg(F.count("*").alias("_n"), F.min(account).alias("_a"), F.max(account).alias("_z"), F.count_if(F.col(account).isNull()).alias("_gaps"))
    met = billed.select(session, request).distinct().join(seen, [session, request], "left")
    one = F.min("_a") == F.max("_z")
    good = F.bool_and(F.coalesce((F.col("_n") == 1) & (F.col("_gaps") == 0), F.lit(False))) & one
    return met.groupBy(session).agg(F.coalesce(good, F.lit(False)).alias("complete"), F.min("_a").alias(account)).select(session, F.when(F.col("complete"), F.col(account)).alias(account), "complete")


def title(index: Column, stored: Column, prompt_label: Column) -> Column:
    """A session's title: from the index, else the state database, else the label of its first prompt; blanks don't count."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(index), some(stored), some(prompt_label))
