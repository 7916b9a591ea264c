"""Facts about how sessions came about, as rows of field and value with evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import digests, text

#: Most facts of a session, bytes of a value and of a label, skills; names of clients of the first provider.
MOST_FACTS, MOST_VALUE, MOST_LABEL, MOST_SKILLS = 24, 128, 96, 8
DESKTOP = ("codex desktop", "codex_work_desktop", "codex_desktop")
TERMINAL = ("codex_cli_rs", "codex-tui", "codex_tui")
SOURCES = {"cli": "codex_cli", "codex_cli": "codex_cli", "codex_cli_rs": "codex_cli", "exec": "codex_exec", "codex_exec": "codex_exec"}
ENTRIES = {"claude-desktop": "claude_desktop", "cli": "claude_cli", "sdk-cli": "claude_sdk"}


def _lookup(known: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), key)


def surface(agent: Column, originator: Column, source: Column, entry: Column) -> Column:
    """Which client a session ran in; the originator's name goes before the source's. agent: codex, claude or pi."""
    low, other = text.ascii_lower(F.trim(originator)), text.ascii_lower(F.trim(source))
    first = F.when(low.isin(*DESKTOP), "codex_desktop").when(low.isin(*TERMINAL), "codex_cli").when(low == "codex_exec", "codex_exec").otherwise(_lookup(SOURCES, other))
    return F.when(agent == "codex", first).when(agent == "claude", _lookup(ENTRIES, entry)).when(agent == "pi", "pi_cli")


def mode(agent: Column, surface_: Column, entry: Column, kind: Column) -> Column:
    """``headless`` or ``background`` where the provider's own header says so."""
    return F.when((agent == "codex") & (surface_ == "codex_exec"), "headless").when((agent == "claude") & (kind == "bg"), "background").when((agent == "claude") & (entry == "sdk-cli"), "headless")


def fact(field: str, value: Column, kind: str = "provider_native", strength: str = "direct", label: Column | None = None, when: Column | None = None) -> Column:
    """A fact, or null where its value is null, empty or over 128 bytes; a label over 96 bytes is left out."""
    size, none = F.octet_length(value), F.lit(None).cast("string")
    good = (size > 0) & (size <= MOST_VALUE)
    shown = none if label is None else F.when((F.octet_length(label) > 0) & (F.octet_length(label) <= MOST_LABEL), label)
    made = F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), shown.alias("label"), F.lit(kind).alias("kind"), F.lit(strength).alias("strength"))
    return F.when(good if when is None else good & when, made)


def provider_facts(agent: Column, thread: Column, subagent: Column, side: Column, originator: Column, source: Column, entry: Column, kind: Column, parent: Column, workflow: Column) -> list[Column]:
    """What the provider's header alone tells, in order of weight."""
    where = surface(agent, originator, source, entry)
    spawned = F.when(agent == "codex", (thread == "subagent") | ((thread.isNull() | (thread != "automation")) & subagent)).when(agent == "claude", side)
    planned = (agent == "codex") & (thread == "automation")
    return [
        fact("origin_kind", F.when(planned, "provider_scheduled_task").when(spawned, "subagent")),
        fact("scheduler_kind", F.when(planned, "codex_scheduled")),
        fact("provider_surface", where),
        fact("execution_mode", mode(agent, where, entry, kind)),
        fact("parent_session_ref", parent),
        fact("workflow_orchestration", F.when(workflow, "dynamic"), "provider_artifact"),
    ]


def subagent_facts(root: Column, kind: Column, ref: Column, workflow: Column, depth: Column) -> list[Column]:
    """Root, kind, ref, workflow and depth of a subagent, in this order: the tail goes first where room is short."""
    return [fact("root_session_ref", root), fact("agent_kind", kind, "provider_artifact"), fact("agent_ref", ref), fact("workflow_ref", workflow), fact("spawn_depth", depth.cast("string"), "provider_artifact")]


def thread_facts(root: Column, session: Column, depth: Column, label: Column) -> list[Column]:
    """The same for the other provider, whose kind is fixed and may carry a label."""
    return [
        fact("root_session_ref", root, "provider_artifact"), fact("agent_kind", F.lit("codex_subagent"), "provider_artifact", label=label), fact("agent_ref", session, "provider_artifact"),
        fact("spawn_depth", depth.cast("string"), "provider_artifact"),
    ]


def launch_facts(controller: Column, workflow: Column, kind: Column) -> list[Column]:
    """What an unambiguous launch event tells of the session that it started; ``controller`` is null without one."""
    known = controller.isNotNull()
    return [fact("parent_session_ref", controller, "launch_event"), fact("origin_kind", F.when(known, "agent_spawn"), "launch_event"), fact("workflow_ref", F.when(known, workflow), "launch_event"), fact("agent_kind", F.when(known, kind), "launch_event")]


def grouping_facts(key: bytes, prompt: Column, schedule: Column, skills: Column, origin_known: Column, scheduler: Column) -> list[Column]:
    """What groups sessions: a keyed id of the prompt's template, a schedule, skills (eight at most), a scheduler if the origin is unknown."""
    template = text.template(prompt)
    skill = lambda i: F.try_element_at(F.slice(F.array_distinct(F.coalesce(skills, F.array().cast("array<string>"))), 1, MOST_SKILLS), F.lit(i + 1))
    return [
        fact("template_group_id", digests.hmac_sha256(key, F.concat(F.lit("template_group:"), template)), "local_template", label=text.prompt_label(prompt)), fact("schedule_definition_id", schedule, "provider_artifact", "corroborated"),
        *[fact("skill_id", skill(i), "local_skill") for i in range(MOST_SKILLS)], fact("slash_skill", text.slash_skill(prompt), "local_prompt"), fact("scheduler_kind", scheduler, "local_scheduler", "corroborated", when=~origin_known),
    ]


def facts(rows: DataFrame, session: str, groups: list[list[Column]], domain: str = "session-attribution-evidence:v1") -> DataFrame:
    """(session, place, field, value, label, kind, strength, evidence): the facts of all groups in order, 24 at most."""
    every = F.slice(F.array_compact(F.array(*reduce(lambda a, b: a + b, groups))), 1, MOST_FACTS)
    long = rows.select(F.col(session).cast("string").alias("session"), F.posexplode(every).alias("place", "f")).select("session", "place", "f.*")
    return long.withColumn("evidence", digests.evidence_ref(domain, F.col("session"), F.col("field"), F.col("value")))


def launched(events: DataFrame, worker: str) -> DataFrame:
    """Launch events of workers that just one event names; ambiguous workers are left out. Repeated rows are one event."""
    cols = [c for c in events.columns if c != worker]
    per = events.groupBy(worker).agg(F.count_distinct(F.struct(*[F.col(c) for c in cols])).alias("_k"), F.min(F.struct(*cols)).alias("_e"))
    return per.where("_k = 1").select(worker, "_e.*")


def root_session(session: Column, fact_value: Column) -> Column:
    """The session at the top of a tree: as a fact has it, else what comes before ``_agent-``, else the session itself."""
    return F.coalesce(fact_value, F.substring_index(session, "_agent-", 1))


def evidence_sessions(rows: DataFrame, session: str, refs: list[str]) -> DataFrame:
    """(session, other): itself and every session it refers to, each once."""
    return rows.select(F.col(session).alias("session"), F.explode(F.array_distinct(F.array_compact(F.array(session, *refs)))).alias("other")).distinct()


def provider_of(command: Column) -> Column:
    """(agent, prompt): which tool a scheduled command runs, and the template of the prompt after its last mark, 24 characters at least."""
    low = text.ascii_lower(command)
    marks = (("codex", "codex exec"), ("claude", "claude --print"), ("claude", "claude -p"))
    after = lambda m: F.substring_index(low, m, -1)
    bare = F.transform(text.tokens(command), lambda t: text.ascii_lower(F.substring_index(F.regexp_replace(t, "^['\"();&]+|['\"();&]+$", ""), "/", -1)))
    named = F.try_element_at(F.filter(bare, lambda t: t.isin("codex", "claude")), F.lit(1))
    agent, rest = named, F.lit(None).cast("string")
    for who, mark in reversed(marks):
        agent, rest = F.when(low.contains(mark), who).otherwise(agent), F.when(low.contains(mark), after(mark)).otherwise(rest)
    prompt = F.regexp_replace(text.template(rest), "^['\"]+|['\"]+$", "")
    return F.struct(agent.alias("agent"), F.when(F.char_length(prompt) >= 24, prompt).alias("prompt"))
