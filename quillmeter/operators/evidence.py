"""Evidence of requests from telemetry logs and evidence files: reading, checking and looking up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions import json, text, times
from quillmeter.functions.values import bound

#: Efforts that count.
EFFORTS = ("low", "medium", "high", "xhigh", "max")


def any_text(value: Column) -> Column:
    """Text of a telemetry value: strings, whole numbers (which come as texts), numbers and truth values; null for others."""
    string = json.string_at(value, "$.stringValue")
    whole = F.coalesce(json.string_at(value, "$.intValue"), F.try_variant_get(value, "$.intValue", "string"))
    double = F.try_variant_get(value, "$.doubleValue", "string")
    return F.coalesce(string, whole, double, F.try_variant_get(value, "$.boolValue", "string"))


def attributes(value: Column, path: str) -> Column:
    """Map of the attributes under a path; those without a text are left out, the last one of a name counts."""
    items = F.coalesce(json.items_at(value, path), F.array().cast("array<variant>"))
    pairs = F.transform(items, lambda a: F.named_struct(F.lit("k"), json.string_at(a, "$.key"), F.lit("v"), any_text(json.at(a, "$.value"))))
    good = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    placed = F.array_sort(F.transform(good, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))

    def last_of_each(found: Column) -> Column:
        last = F.filter(found, lambda p, i: ~F.get(found, i + 1)["k"].eqNullSafe(p["k"]))
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))

    return bound(placed, last_of_each)


def log_records(bodies: DataFrame, value: str, name: str) -> DataFrame:
    """Log records of OTLP JSON bodies whose body text is ``name``: (place, at, attributes); a record's attributes win over its resource's."""
    by = [c for c in bodies.columns if c != value]
    resources = bodies.select(*by, F.posexplode(json.items_at(F.col(value), "$.resourceLogs")).alias("r", "res"))
    scopes = resources.select(*by, "r", attributes(F.col("res"), "$.resource.attributes").alias("_own"), F.posexplode(json.items_at(F.col("res"), "$.scopeLogs")).alias("s", "sc"))
    records = scopes.select(*by, "r", "s", "_own", F.posexplode(json.items_at(F.col("sc"), "$.logRecords")).alias("l", "rec")).where(json.string_at(F.col("rec"), "$.body.stringValue") == name)
    records = records.withColumn("_mine", attributes(F.col("rec"), "$.attributes"))
    mine = F.col("_mine")
    kept = F.map_filter("_own", lambda k, v: ~F.array_contains(F.map_keys(mine), k))
    nano = F.coalesce(json.string_at(F.col("rec"), "$.timeUnixNano"), json.string_at(F.col("rec"), "$.observedTimeUnixNano")).try_cast("long")
    return records.select(*by, F.struct("r", "s", "l").alias("place"), times.nanos_text(nano).alias("at"), F.map_concat(kept, mine).alias("attributes"))


def lenient(lines: DataFrame, session: str, owner: str, key: str, order: str) -> DataFrame:
    """Evidence lines of the session that their file belongs to, one for each fingerprint: the first one."""
    good = lines.where(F.col(session).eqNullSafe(F.col(owner)) & F.col(key).isNotNull())
    return good.withColumn("_n", F.row_number().over(Window.partitionBy(owner, key).orderBy(order))).where("_n = 1").drop("_n")


def report(lines: DataFrame, session: str, owner: str, request: str, key: str, malformed: Column, size: Column, most_bytes: int = 64 << 20) -> DataFrame:
    """(owner, lines, malformed, wrong_session, missing_id, oversized, conflicting): the health of each file's evidence.

    A request with several fingerprints conflicts. Other counts are of the lines that can be read.
    """
    fine = ~malformed
    counts = lines.groupBy(owner).agg(
        F.count("*").alias("lines"), F.count_if(malformed).alias("malformed"), F.count_if(fine & ~F.col(session).eqNullSafe(F.col(owner))).alias("wrong_session"), F.count_if(fine & F.col(request).isNull()).alias("missing_id"),
        (F.max(size) >= most_bytes).alias("oversized"),
    )
    usable = lines.where(fine & F.col(session).eqNullSafe(F.col(owner)) & F.col(request).isNotNull())
    twice = usable.groupBy(owner, request).agg(F.count_distinct(key).alias("_k")).groupBy(owner).agg(F.count_if(F.col("_k") > 1).alias("conflicting"))
    return counts.join(twice, owner, "left").withColumn("conflicting", F.coalesce("conflicting", F.lit(0)))


def effort_by_request(lines: DataFrame, request: str, effort: str, order: list[str]) -> DataFrame:
    """(request, effort): the first write in order; efforts out of the closed set don't count."""
    good = lines.where(F.col(request).isNotNull() & F.col(effort).isin(*EFFORTS))
    return good.groupBy(request).agg(F.min(F.struct(*order, effort))[effort].alias(effort))


def shard(session: Column) -> Column:
    """The name of a session's evidence file."""
    return F.sha2(session, 256)


def appended(new: DataFrame, sizes: DataFrame, session: str, line: str, order: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Lines that are still written: a session's file takes lines in order until it holds ``most_bytes``."""
    upto = F.sum(F.octet_length(line) + 1).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    held = new.withColumn("_u", upto).join(sizes, session, "left")
    return held.where(F.coalesce("bytes", F.lit(0)) + F.col("_u") <= most_bytes).select(new.columns)


def attributed(evidence: DataFrame, owners: DataFrame, transcript: DataFrame, request: str) -> DataFrame:
    """Evidence with the trace's owner and the transcript's row of the same request; requests with two owners have none."""
    one = owners.groupBy(request).agg(F.min("owner").alias("owner"), F.count_distinct("owner").alias("_k")).where("_k = 1").drop("_k")
    return evidence.join(one, request, "left").join(transcript, request, "left")


#: Names of the fields of a request's owner, in the order in which they are looked for, and their bytes at most.
OWNER_FIELDS = {
    "session": ("session.id", "session_id"), "request": ("request_id", "gen_ai.response.id"), "client_request": ("client_request_id",), "agent": ("agent.id", "agent_id"),
    "parent_agent": ("parent_agent_id", "parent.agent.id"), "workflow": ("workflow.run_id", "workflow_run_id"),
}
MOST_FIELD = 256


def _bounded(found: Column, names: tuple[str, ...]) -> Column:
    """The attribute under the first name that is there, without blanks at its ends; empty if it is long or holds control characters."""
    said = F.coalesce(*[F.try_element_at(found, F.lit(n)) for n in names])
    plain = text.trimmed(said)
    return F.coalesce(F.when((F.octet_length(plain) <= MOST_FIELD) & ~plain.rlike(r"\p{Cntrl}|[\x{80}-\x{9f}]"), plain), F.lit(""))


def trace_owners(bodies: DataFrame, value: str, name: str) -> DataFrame:
    """(place, session, request, client_request, agent, parent_agent, workflow, observed) of trace bodies' spans called ``name``.

    A span's attributes win over its resource's; arrays, maps and bytes are left out. Spans that failed (``success`` is
    false), that name no session or have no start are dropped.
    """
    by = [c for c in bodies.columns if c != value]
    resources = bodies.select(*by, F.posexplode(json.items_at(F.col(value), "$.resourceSpans")).alias("r", "res"))
    scopes = resources.select(*by, "r", attributes(F.col("res"), "$.resource.attributes").alias("_own"), F.posexplode(json.items_at(F.col("res"), "$.scopeSpans")).alias("s", "sc"))
    spans = scopes.select(*by, "r", "s", "_own", F.posexplode(json.items_at(F.col("sc"), "$.spans")).alias("l", "span")).where(json.string_at(F.col("span"), "$.name") == name)
    spans = spans.withColumn("_mine", attributes(F.col("span"), "$.attributes"))
    kept = F.map_filter("_own", lambda k, v: ~F.array_contains(F.map_keys(F.col("_mine")), k))
    start = F.coalesce(json.string_at(F.col("span"), "$.startTimeUnixNano").try_cast("long"), json.long_at(F.col("span"), "$.startTimeUnixNano"))
    rows = spans.select(*by, F.struct("r", "s", "l").alias("place"), F.map_concat(kept, "_mine").alias("_a"), times.nanos_text(start).alias("observed"))
    fields = [_bounded(F.col("_a"), names).alias(n) for n, names in OWNER_FIELDS.items()]
    owners = rows.where(F.coalesce(F.try_element_at("_a", F.lit("success")) != "false", F.lit(True))).select(*by, "place", *fields, "observed")
    return owners.where("session <> '' and observed is not null")
