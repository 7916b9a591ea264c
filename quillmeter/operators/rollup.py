"""From raw lines of three kinds of transcripts to hours of usage by model, and to sessions with their hours inside.

Lines come as (file, ordinal, value), a VARIANT each. All kinds give the same rows: (source, file, at, model, input,
cached, written, output, pico), a row for each response, with input that is neither read from nor written to a cache.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import json, times
from quillmeter.operators import usage

COUNTS = ("input", "cached", "written", "output")
_ROWS = ["source", "file", "at", "model", *COUNTS, "pico"]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def _no_cost() -> Column:
    return F.lit(None).cast("decimal(38,0)").alias("pico")


def _stamp(v: Column) -> Column:
    """The text of a line's time, as a column of its own: it is read once, though its instant needs it often."""
    return F.coalesce(json.string_at(v, "$.timestamp"), json.string_at(v, "$.ts")).alias("_at")


def first_kind(lines: DataFrame) -> DataFrame:
    """Assistant lines with usage: those with one message and request id are one response, of which the last line counts."""
    v = F.col("value")
    number = lambda path: _zero(json.long_at(v, f"$.message.usage.{path}"))
    said = lines.where((json.string_at(v, "$.type") == "assistant") & (json.kind(json.at(v, "$.message.usage")) == "OBJECT")).select(
        "file", "ordinal", _stamp(v), json.string_at(v, "$.message.id").alias("m"), json.string_at(v, "$.requestId").alias("r"), json.string_at(v, "$.message.model").alias("model"),
        number("input_tokens").alias("input"), number("cache_read_input_tokens").alias("cached"), (number("cache_creation.ephemeral_5m_input_tokens") + number("cache_creation.ephemeral_1h_input_tokens")).alias("written"), number("output_tokens").alias("output"),
    )
    said = said.withColumn("at", times.instant(F.col("_at"))).drop("_at")
    whole = F.max(F.struct("ordinal", "at", "model", *COUNTS)).alias("_l")
    # a line without ids is a response of its own
    own = F.when(F.col("m").isNull() & F.col("r").isNull(), F.col("ordinal"))
    return said.groupBy("file", "m", "r", own.alias("_o")).agg(whole).select(F.lit("first").alias("source"), "file", "_l.at", "_l.model", *[F.col("_l")[c].alias(c) for c in COUNTS], _no_cost())


def second_kind(lines: DataFrame) -> DataFrame:
    """Token counts of responses: their own where they are told, else what the running totals grew by; a smaller total starts anew.

    Input comes with its cached part, which is taken out of it.
    """
    v, info = F.col("value"), "$.payload.info"
    rows = lines.where((json.string_at(v, "$.payload.type") == "token_count") & (json.kind(json.at(v, info)) == "OBJECT")).select(
        "file", "ordinal", _stamp(v), json.string_at(v, f"{info}.model").alias("model"),
        *[json.long_at(v, f"{info}.{shape}_token_usage.{key}").alias(f"{shape}_{name}") for shape in ("total", "last") for name, key in (("input", "input_tokens"), ("cached", "cached_input_tokens"), ("output", "output_tokens"))],
    )
    rows = rows.withColumn("at", times.instant(F.col("_at"))).drop("_at")
    for name in ("input", "cached", "output"):
        rows = usage.counter_used(rows, "file", "ordinal", f"total_{name}", f"last_{name}").withColumnRenamed("used", f"used_{name}")
    cached = F.least("used_input", "used_cached")
    return rows.select(F.lit("second").alias("source"), "file", "at", "model", (F.col("used_input") - cached).alias("input"), cached.alias("cached"), F.lit(0).cast("long").alias("written"), F.col("used_output").alias("output"), _no_cost())


def third_kind(lines: DataFrame) -> DataFrame:
    """Responses that two shapes of lines tell of: a response counts as often as the shape says that names it more often.

    Its numbers, time and cost are those of its last line. Costs are in 10^-12 of their unit.
    """
    v = F.col("value")
    number = lambda key: _zero(json.long_at(v, f"$.message.usage.{key}"))
    cost = F.try_variant_get(v, "$.message.usage.cost.total", "decimal(26,12)")
    said = lines.where(json.string_at(v, "$.type").isin("message", "message_end") & (json.string_at(v, "$.message.role") == "assistant")).select(
        "file", "ordinal", json.string_at(v, "$.type").alias("shape"), json.string_at(v, "$.message.responseId").alias("response"), F.timestamp_millis(json.long_at(v, "$.message.timestamp")).alias("at"), json.string_at(v, "$.message.model").alias("model"),
        number("input").alias("input"), number("cacheRead").alias("cached"), number("cacheWrite").alias("written"), number("output").alias("output"), (cost * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(38,0)").alias("pico"),
    ).where("response is not null")
    last = F.max(F.struct("ordinal", "at", "model", *COUNTS, "pico")).alias("_l")
    each = usage.reconciled(said, ["file", "response"], "shape", last).select("file", "_l.at", "_l.model", *[F.col("_l")[c].alias(c) for c in (*COUNTS, "pico")], F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i"))
    return each.withColumn("source", F.lit("third")).select(*_ROWS)


def responses(lines: DataFrame) -> DataFrame:
    """The responses of lines of all kinds; a file's lines are of one kind, which their own fields tell."""
    return first_kind(lines).unionByName(second_kind(lines)).unionByName(third_kind(lines))


def hours(rows: DataFrame) -> DataFrame:
    """(hour, source, file, model, counts, pico, n): responses without a time or a model are left out."""
    return usage.hourly(rows.where("at is not null and model is not null"), "at", ["source", "file", "model"], list(COUNTS), "pico").withColumn("pico", F.col("pico").cast("decimal(38,0)"))


def levels(rows: DataFrame) -> DataFrame:
    """(source, file, model, hour, counts, n): the rows of whole sessions, with a null hour, then those of their hours."""
    timed = rows.where("at is not null and model is not null")
    start = timed.select("source", "file", "model", *COUNTS, F.window("at", "1 hour")["start"].alias("_h"))
    both = start.select("source", "file", "model", *COUNTS, F.explode(F.array(F.lit(None).cast("timestamp"), F.col("_h"))).alias("hour"))
    return both.groupBy("source", "file", "model", "hour").agg(*[F.sum(c).alias(c) for c in COUNTS], F.count("*").alias("n"))


def sessions(rows: DataFrame) -> DataFrame:
    """(source, file, models, buckets, agrees): totals by model, hours with their models inside, and whether the hours add up to the totals.

    Both are added up from the responses, each by itself but in one reading; a session's hours and models are few.
    """
    inner = levels(rows).groupBy("source", "file", "hour").agg(F.array_sort(F.collect_list(F.struct("model", *COUNTS, "n"))).alias("_m"))
    timed = F.when(F.col("hour").isNotNull(), F.struct("hour", F.col("_m").alias("models")))
    both = inner.groupBy("source", "file").agg(F.first(F.when(F.col("hour").isNull(), F.col("_m")), ignorenulls=True).alias("models"), F.array_sort(F.collect_list(timed)).alias("buckets"))
    flat = F.flatten(F.transform("buckets", lambda b: b["models"]))
    added = lambda items, c: F.aggregate(items, F.lit(0).cast("long"), lambda s, m: s + m[c])

    def agree(c: str) -> Column:
        each = F.forall("models", lambda m: added(F.filter(flat, lambda x: x["model"] == m["model"]), c) == m[c])
        return each & added(flat, c).eqNullSafe(added(F.col("models"), c))

    agrees = reduce(Column.__and__, map(agree, (*COUNTS, "n")))
    return both.select("source", "file", "models", "buckets", F.coalesce(agrees, F.lit(False)).alias("agrees"))
