"""Pages of remote tasks: rows, cursors, states and the observations that are kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions import digests, json, text, times

#: Rows of a page that count, attempts and new keys at most; names of states and environments.
PAGE_ROWS, MOST_ATTEMPTS, MOST_KEYS = 20, 100_000, 2_000
_TIMES = ("created", "started", "updated", "completed")
STATES = {
    "queued": "queued", "running": "running", "in_progress": "running", "ready": "completed", "applied": "completed", "completed": "completed", "succeeded": "completed", "success": "completed",
    "failed": "failed", "error": "failed", "cancelled": "cancelled", "canceled": "cancelled",
}
ENVIRONMENTS = {"hosted": "hosted", "cloud": "hosted", "provider_cloud": "hosted", "container": "container", "containerized": "container"}


def _named(value: Column, known: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), text.ascii_lower(value)), F.lit("unknown"))


def lifecycle(value: Column) -> Column:
    """The state of a task; what a provider calls pending may be either, so it is unknown."""
    return _named(value, STATES)


def environment(value: Column) -> Column:
    return _named(value, ENVIRONMENTS)


def _cursor(value: Column) -> Column:
    """``ok`` for null and for a text of 1 to 4,096 bytes."""
    size = F.octet_length(F.try_variant_get(value, "$", "string"))
    return F.when(json.kind(value) == "VOID", True).when(json.kind(value) == "STRING", (size > 0) & (size <= 4096)).otherwise(False)


def cursor(page: Column) -> Column:
    """(state, next, error) of a page: ``next``, ``terminal`` or ``ambiguous``; names that disagree are an error.

    ``cursor`` is the official name: null there ends the scan. ``next_cursor`` and ``nextCursor`` may stand for it, but
    null in one of them proves nothing.
    """
    names = ("cursor", "next_cursor", "nextCursor")
    raw = {n: json.at(page, f"$.{n}") for n in names}
    said = F.array_compact(F.array(*[F.when(raw[n].isNotNull(), F.coalesce(F.try_variant_get(raw[n], "$", "string"), F.lit("\0"))) for n in names]))
    odd = F.coalesce(F.array_contains(F.array_compact(F.array(*[F.when(raw[n].isNotNull(), _cursor(raw[n])) for n in names])), False), F.lit(False))
    error = F.when(odd, "invalid").when(F.size(F.array_distinct(said)) > 1, "conflict")
    value = F.nullif(F.try_element_at(said, F.lit(1)), F.lit("\0"))
    state = F.when(error.isNotNull(), None).when(value.isNotNull(), "next").when(raw["cursor"].isNotNull(), "terminal").otherwise("ambiguous")
    return F.struct(state.alias("state"), F.when(error.isNull(), value).alias("next"), error.alias("error"))


def page_rows(pages: DataFrame, page: str, value: str, key: bytes, observed: Column) -> tuple[DataFrame, DataFrame]:
    """Observations of pages, and (page, items, invalid, truncated): rows without an id or a state don't count.

    Times after ``observed`` and texts that are none are left out; if the times of a row contradict each other, all are.
    """
    v = F.col(value)
    items = F.coalesce(F.when(json.kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")), json.first_items(v, ["tasks", "items", "data"]))
    rows = pages.select(page, F.posexplode(F.slice(items, 1, PAGE_ROWS)).alias("place", "row"))
    # each step is a column of its own: a field is looked up once, its text made once, though an instant needs it often
    named = {"id": ["id", "task_id"], "status": ["status", "state"], "environment": ["environment_kind", "environment"]} | {n: [f"{n}_at", f"{n}At"] for n in _TIMES}
    r = F.col("row")
    attempts = F.coalesce(*[json.long_at(r, f"$.{k}") for k in ("attempt_total", "attempt_count", "attempts")])
    fields = rows.select(page, "place", attempts.alias("_n"), *[json.at(r, f"$.{k}").alias(f"_v_{k}") for keys in named.values() for k in keys])
    first = lambda keys: F.nullif(F.coalesce(*[json.string(F.col(f"_v_{k}")) for k in keys]), F.lit(""))
    said = fields.select(page, "place", "_n", *[first(keys).alias(n) for n, keys in named.items()])
    dated = said.withColumns({n: F.when(F.octet_length(n) <= 64, times.instant(F.col(n))) for n in _TIMES})
    read = dated.select(page, "place", "id", "status", environment(F.col("environment")).alias("environment"), F.when(F.col("_n") <= MOST_ATTEMPTS, F.col("_n")).alias("attempts"), *[F.when(F.col(n) <= observed, F.col(n)).alias(n) for n in _TIMES])
    good = F.col("id").isNotNull() & F.col("status").isNotNull()
    later = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.lit(False))
    wrong = later("created", "started") | later("started", "completed") | later("created", "completed")
    timed = read.withColumn("_w", wrong)
    kept = [F.when(~F.col("_w"), F.col(n)).alias(n) for n in _TIMES]
    made = timed.where(good).select(page, "place", digests.hmac_sha256(key, F.col("id")).alias("entity"), lifecycle(F.col("status")).alias("lifecycle"), "environment", "attempts", *kept)
    counted = pages.select(page, F.coalesce(F.size(items), F.lit(0)).alias("items")).join(read.groupBy(page).agg(F.count_if(~good).alias("invalid")), page, "left")
    return made, counted.select(page, "items", F.coalesce("invalid", F.lit(0)).alias("invalid"), (F.col("items") > PAGE_ROWS).alias("truncated"))


def coverage(attempts: Column, *times_: Column) -> Column:
    """What an observation covers: identity and status always, timing with any time, attempts with a number."""
    timed = F.coalesce(*times_).isNotNull()
    return F.array_compact(F.array(F.lit("identity"), F.lit("status"), F.when(timed, "timing"), F.when(attempts.isNotNull(), "attempts")))


def is_valid(entity: Column, state: Column, environment_: Column, attempts: Column, covered: Column, timed: Column) -> Column:
    """Whether an observation keeps its rules: known names, coverage without repeats that says what is there."""
    closed = state.isin(*set(STATES.values()), "unknown") & environment_.isin("hosted", "container", "unknown")
    fields = F.size(F.array_except(covered, F.array(*map(F.lit, ("identity", "status", "timing", "attempts"))))) == 0
    says = F.array_contains(covered, "identity") & F.array_contains(covered, "status") & (F.array_contains(covered, "timing") == timed) & (F.array_contains(covered, "attempts") == attempts.isNotNull())
    return entity.rlike("^[0-9a-f]{64}$") & closed & fields & says & (F.size(F.array_distinct(covered)) == F.size(covered)) & (F.coalesce(attempts, F.lit(0)) <= MOST_ATTEMPTS)


def upserted(rows: DataFrame, key: str, order: list[str], most: int = MOST_KEYS) -> DataFrame:
    """The last row of each key, of the ``most`` keys that came first: an ordered scan into a map of bounded size."""
    place = F.struct(*order)
    firsts = rows.groupBy(key).agg(F.min(place).alias("_first"), F.max(F.struct(*order, *[c for c in rows.columns if c not in (*order, key)])).alias("_last"))
    return firsts.orderBy("_first", key).limit(most).select(key, "_last.*")


def firsts(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
