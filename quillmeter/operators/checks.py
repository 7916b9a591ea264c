"""Checks at the borders of the data: closed schemas, limits, forbidden fields, and what may leave a machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import json, text, times

#: The keys of a launch event, and bytes of its file; limits of facts; secret fields, in letters and digits alone.
LAUNCH_KEYS = ("schema", "controller_session_ref", "worker_session_ref", "relationship_kind", "workflow_ref", "pr_ref", "launch_ts", "capture_source", "evidence")
LAUNCH_BYTES = 4096
MOST_FACTS, MOST_BYTES, MOST_VALUE, MOST_LABEL = 24, 8192, 128, 96
LABEL_SOURCES = {"agent_kind": "agent_label", "template_group_id": "prompt_prefix", "skill_id": "skill_name"}
SECRET_FIELDS = ("accesskeyid", "awsaccesskeyid", "secretaccesskey", "awssecretaccesskey", "sessiontoken", "awssessiontoken", "privatekey", "clientemail")


def launch_events(files: DataFrame, name: str, body: str, schema: str, kinds: dict[str, str]) -> DataFrame:
    """Files with ``reason``, null for an accepted one, and its controller, worker, workflow and agent kind.

    A file holds one object of just the nine keys, in 4 KiB at most, and is named by its content's digest. kinds: the agent
    kind by capture source. The first reason in order counts.
    """
    files, v = files.withColumn("_v", F.try_parse_json(body)), F.col("_v")
    files = files.withColumns({f"_{k}": json.string_at(v, f"$.{k}") for k in LAUNCH_KEYS})
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    wanted = F.array(*map(F.lit, LAUNCH_KEYS))
    said = {k: F.col(f"_{k}") for k in LAUNCH_KEYS}
    ref = lambda k: F.coalesce(said[k].rlike("^[A-Za-z0-9_.:-]{1,128}$"), F.lit(False))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), said["capture_source"])
    pr = json.at(v, "$.pr_ref")
    reason = (
        F.when(F.octet_length(body) > LAUNCH_BYTES, "oversized")
        .when(v.isNull(), "not_json")
        .when(json.kind(v) != "OBJECT", "not_object")
        .when(F.size(F.array_except(keys, wanted)) > 0, "unknown_key")
        .when(F.size(F.array_except(wanted, keys)) > 0, "missing_key")
        .when(~said["schema"].eqNullSafe(F.lit(schema)), "unknown_schema")
        .when(~said["relationship_kind"].eqNullSafe(F.lit("controller_worker")), "bad_relationship_kind")
        .when(~said["evidence"].eqNullSafe(F.lit("direct")), "bad_evidence")
        .when(kind.isNull(), "unknown_capture_source")
        .when(~ref("controller_session_ref"), "bad_controller_ref")
        .when(~ref("worker_session_ref"), "bad_worker_ref")
        .when((json.kind(json.at(v, "$.workflow_ref")) != "VOID") & ~ref("workflow_ref"), "bad_workflow_ref")
        .when(said["controller_session_ref"] == said["worker_session_ref"], "self_launch")
        .when((json.kind(pr) != "VOID") & ~F.coalesce(json.long_at(v, "$.pr_ref") > 0, F.lit(False)), "bad_pr_ref")
        .when(~F.coalesce(times.is_utc_second(said["launch_ts"]), F.lit(False)), "bad_launch_ts")
        .when(~F.startswith(F.col(name), F.sha2(body, 256)), "filename_mismatch")
    )
    judged = files.withColumn("reason", reason)
    good = F.col("reason").isNull()
    fields = {"controller": said["controller_session_ref"], "worker": said["worker_session_ref"], "workflow": said["workflow_ref"], "agent_kind": kind}
    return judged.select("*", *[F.when(good, c).alias(k) for k, c in fields.items()]).drop("_v", *(f"_{k}" for k in LAUNCH_KEYS))


def field_names(value: Column) -> Column:
    """Every key of a JSON value, at any depth, with repeats."""
    named = F.regexp_extract_all(F.to_json(value), F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"):?'), F.lit(0))
    return F.transform(F.filter(named, lambda n: n.endswith(":")), lambda n: F.substring(n, 2, 1_000_000).substr(F.lit(1), F.char_length(n) - 3))


def holds_secret(value: Column) -> Column:
    """Whether an object names a secret at any depth, whatever its case and punctuation."""
    bare = F.transform(field_names(value), lambda k: text.ascii_lower(F.regexp_replace(k, "[^A-Za-z0-9]", "")))
    return F.arrays_overlap(bare, F.array(*map(F.lit, SECRET_FIELDS)))


def fact_fault(facts: Column) -> Column:
    """What is wrong with an array of facts (field, value, label, label_source), null if nothing is."""
    sources = F.create_map(*[F.lit(x) for pair in LABEL_SOURCES.items() for x in pair])
    size = lambda f: F.octet_length(f["value"])
    empty = F.exists(facts, lambda f: ~F.coalesce((size(f) > 0) & (size(f) <= MOST_VALUE), F.lit(False)))
    half = F.exists(facts, lambda f: f["label"].isNull() != f["label_source"].isNull())
    unsafe = F.exists(facts, lambda f: F.coalesce((f["label"] == "") | (F.octet_length(f["label"]) > MOST_LABEL) | f["label"].rlike(r"\p{Cntrl}") | F.exists(text.tokens(f["label"]), text.is_local_path), F.lit(False)))
    wrong = F.exists(facts, lambda f: f["label"].isNotNull() & ~F.coalesce(F.try_element_at(sources, f["field"]) == f["label_source"], F.lit(False)))
    bytes_ = F.octet_length(F.to_json(facts))
    return F.when(F.size(facts) > MOST_FACTS, "too many").when(bytes_ > MOST_BYTES, "too long").when(empty, "value").when(half, "label incomplete").when(unsafe, "label unsafe").when(wrong, "label source")


def for_upload(status: DataFrame, ids: list[str], texts: list[str], dropped: list[str], marks: tuple[str, ...] = text.UNSAFE_MARKS) -> DataFrame:
    """A status row as it may leave: identifiers null, texts null where they name a path or a secret, ``dropped`` columns gone."""
    own = {c: F.lit(None).cast(status.schema[c].dataType) for c in ids}
    own |= {c: text.safe_text(F.col(c), 512, marks) for c in texts}
    return status.withColumns(own).drop(*dropped)


def meter(status: DataFrame, source: str, used: list[str], seen: list[str], now: Column, warnings: Column, fresh_minutes: int = 15) -> DataFrame:
    """(source, used, seen, fresh, warnings): a coarse row for each source: first value that is there, warnings up to eight."""
    at = F.coalesce(*seen)
    fresh = F.coalesce(F.timestamp_diff("SECOND", at, now).between(0, fresh_minutes * 60), F.lit(False))
    return status.select(source, F.coalesce(*used).alias("used"), at.alias("seen"), fresh.alias("fresh"), F.slice(F.array_compact(warnings), 1, 8).alias("warnings"))


def posture_rows(items: DataFrame, measures: list[str], at: list[str]) -> DataFrame:
    """Rows with at least one measure, and ``at``: the first of the times that is there."""
    return items.where(F.coalesce(*[F.col(m).cast("string") for m in measures]).isNotNull()).withColumn("at", F.coalesce(*at))
