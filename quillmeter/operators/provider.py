"""Daily usage as a provider reports it: days, clients and models normalised, counters summed at four grains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import json, numbers, text, times

#: The largest sums of tokens, events and credits; keys of each counter in the order they are asked for.
MOST_TOKENS, MOST_EVENTS, MOST_CREDITS = 10**15, 10**9, 1e9
COUNTERS = {
    "input_tokens": (("uncached_input_tokens", "input_tokens"), MOST_TOKENS),
    "output_tokens": (("output_tokens",), MOST_TOKENS),
    "turns": (("turn_count", "turns"), MOST_EVENTS),
}
KNOWN_KEYS = ("date", "day", "client_id", "client", "model", "credits", *(k for keys, _ in COUNTERS.values() for k in keys))
GRAINS = ("day", "surface", "model", "surface_model")


def readings(rows: DataFrame, value: str, surfaces: dict[str, str]) -> DataFrame:
    """Adds day, surface, model, the counters and ``unknown_keys`` (40 characters each) to rows of JSON objects."""
    v = F.col(value)
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    kind = json.kind(json.at(v, "$.credits"))
    credits = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, "$.credits", "double"))
    return rows.select(
        "*", times.provider_day(json.first_string(v, ["date", "day"])).alias("day"), text.closed_map(json.first_string(v, ["client_id", "client"]), surfaces).alias("surface"), text.slug(json.first_string(v, ["model"])).alias("model"),
        F.when((credits >= 0) & (credits <= MOST_CREDITS), credits).cast("decimal(28,6)").alias("credits"),
        *[numbers.first_counter(v, keys, most).alias(name) for name, (keys, most) in COUNTERS.items()],
        F.transform(F.array_except(F.map_keys(fields), F.array(*map(F.lit, KNOWN_KEYS))), lambda k: F.left(k, F.lit(40))).alias("unknown_keys"),
    )


def covered(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Readings of the days from first to last, as texts; those without a day go."""
    return rows.where(F.col("day").between(first, last))


def grains(rows: DataFrame) -> DataFrame:
    """(grain, day, surface, model, counters, credits, n): sums of each day, and by surface, by model and by both.

    A counter that no row reports stays null; sums stop at their largest value. One shuffle for all grains; rows without
    a model don't count for the grains by model.
    """
    none = F.lit(None).cast("string")
    keys = [(none, none), (F.col("surface"), none), (none, F.col("model")), (F.col("surface"), F.col("model"))]
    each = F.array(*[F.when(F.lit("model" not in g) | F.col("model").isNotNull(), F.struct(F.lit(g).alias("grain"), s.alias("surface"), m.alias("model"))) for g, (s, m) in zip(GRAINS, keys, strict=True)])
    long = rows.select("day", "credits", *COUNTERS, F.explode(F.array_compact(each)).alias("g")).select("g.*", "day", "credits", *COUNTERS)
    sums = [numbers.reported_sum(F.col(c).cast("decimal(38,0)"), most).cast("long").alias(c) for c, (_, most) in COUNTERS.items()]
    credits = F.when(F.count("credits") > 0, F.least(F.sum("credits"), F.lit(MOST_CREDITS).cast("decimal(38,6)"))).alias("credits")
    return long.groupBy("grain", "day", "surface", "model").agg(*sums, credits, F.count("*").alias("n"))


def mismatches(sums: DataFrame, other: str = "other", most: int = 12) -> DataFrame:
    """(day, metric, provider, clients): day totals that differ from the sum over recognised clients, where both report it."""
    total = sums.where("grain = 'day'")
    known = sums.where((F.col("grain") == "surface") & (F.col("surface") != other)).groupBy("day").agg(*[F.sum(c).alias(f"_{c}") for c in (*COUNTERS, "credits")])
    shown = lambda c: F.col(c).cast("decimal(28,6)").cast("string") if c.endswith("credits") else F.col(c).cast("string")
    each = F.array(*[F.struct(F.lit(c).alias("metric"), shown(c).alias("provider"), shown(f"_{c}").alias("clients")) for c in ("credits", *COUNTERS)])
    long = total.join(known, "day").select("day", F.posexplode(each).alias("pos", "m")).select("day", "pos", "m.*")
    return long.where("provider <> clients").orderBy("day", "pos").limit(most).select("day", "metric", "provider", "clients")


def accounting(rows: DataFrame, first: str, last: str, most: int = 12) -> DataFrame:
    """One row: how many rows came, had no day, lay outside, had an unknown client or no model; the smallest unknown keys."""
    day = F.col("day")
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if(day.isNull()).alias("no_day"), F.count_if(~day.between(first, last)).alias("outside"), F.count_if(F.col("surface") == "other").alias("unknown_client"),
        F.count_if(F.col("model").isNull()).alias("no_model"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in COUNTERS],
    )
    keys = rows.select(F.explode("unknown_keys").alias("k")).distinct().orderBy("k").limit(most).agg(F.array_sort(F.collect_list("k")).alias("unknown_keys"))
    return counts.join(F.broadcast(keys))  # one row each


def is_content_free(value: Column, classes: dict[str, str]) -> Column:
    """Whether an object has no key beside ``classes`` and every text in it matches its key's pattern; nothing is nested."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    patterns = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])

    def fine(e: Column) -> Column:
        kind, pattern = json.kind(e["value"]), F.try_element_at(patterns, e["key"])
        said = F.regexp_like(F.try_variant_get(e["value"], "$", "string"), pattern)
        return pattern.isNotNull() & F.when(kind == "STRING", said).otherwise(~kind.isin("OBJECT", "ARRAY"))

    return F.coalesce(F.forall(entries, fine), F.lit(False))
