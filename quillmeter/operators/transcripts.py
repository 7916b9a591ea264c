"""What transcripts of coding agents bring into the context: entries by tool, with tokens, residency, images and files.

Lines come as (file, ordinal, value): a VARIANT for each line of JSON, numbered within its file from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions import digests, json, text, times
from quillmeter.operators import windows

#: The categories in their order, of which the first wins among equals, and the tokens of an image.
CATEGORIES = ("harness_attachments", "shell_output", "code_reads", "doc_reads_md", "doc_reads_html", "memory_notes", "browser_and_images", "web_fetch_search", "agent_results", "other_tools")
IMAGE_TOKENS = 1300
#: Names of shell tools of the second kind of transcript.
SHELL_NAMES = ("exec", "shell", "local_shell", "bash", "shell_command", "container.exec", "run_command", "wait", "write_stdin", "read_stdout", "kill", "kill_command")


def tool_category(name: Column, path: Column) -> Column:
    """Category of a tool's result in transcripts of the first kind; the first rule that fits counts."""
    low = text.ascii_lower(name)
    screen = text.has_any(low, ("browser", "chrome", "computer", "screenshot")) | low.startswith("preview_")
    return (
        F.when(name == "Bash", "shell_output")
        .when(name.isin("Read", "NotebookRead"), text.path_class(path))
        .when(name.isin("Task", "Agent"), "agent_results")
        .when(name.isin("WebFetch", "WebSearch"), "web_fetch_search")
        .when(screen, "browser_and_images")
        .otherwise("other_tools")
    )


def call_category(name: Column) -> Column:
    """Category of a call's output in transcripts of the second kind; ``other_tools`` for an unknown call."""
    low = text.ascii_lower(name)
    return (
        F.when(low.isin(*SHELL_NAMES) | text.has_any(low, ("exec", "shell")), "shell_output")
        .when(text.has_any(low, ("web", "search", "fetch")), "web_fetch_search")
        .when(text.has_any(low, ("browser", "computer", "screenshot")), "browser_and_images")
        .when(low.contains("agent"), "agent_results")
        .when(low.isin("read_file", "view", "read"), "code_reads")
        .otherwise("other_tools")
    )


def server_category(server: Column, tool: Column) -> Column:
    """Category of a tool server's result by the names of server and tool."""
    low = text.ascii_lower(F.concat_ws(" ", F.coalesce(server, F.lit("")), F.coalesce(tool, F.lit(""))))
    return (
        F.when(text.has_any(low, ("chrome", "browser", "playwright", "screenshot", "dom_snapshot", "domsnapshot")), "browser_and_images")
        .when(text.has_any(low, ("web", "search", "fetch")), "web_fetch_search")
        .when(text.has_any(low, ("repl", "exec", "shell", "node", "python", "js")), "shell_output")
        .when(low.contains("agent"), "agent_results")
        .otherwise("other_tools")
    )


def _timed(lines: DataFrame, file_day: Column) -> DataFrame:
    stamp, alias = json.string_at(F.col("value"), "$.timestamp"), json.string_at(F.col("value"), "$.ts")
    return lines.withColumn("at", times.line_instant(stamp, alias)).withColumn("day", F.coalesce(F.to_date("at"), file_day))


def _with_images(rows: DataFrame) -> DataFrame:
    """An entry for the text and one for the images beside it."""
    own = F.struct("category", "tokens", F.lit(0).cast("long").alias("images"), "path", F.lit(0).alias("part"))
    seen = F.struct(F.lit("browser_and_images").alias("category"), (F.col("images") * IMAGE_TOKENS).alias("tokens"), "images", F.lit(None).cast("string").alias("path"), F.lit(1).alias("part"))
    each = F.when(F.col("images") > 0, F.when(F.col("category").isNull(), F.array(seen)).otherwise(F.array(own, seen))).when(F.col("category").isNotNull(), F.array(own))
    kept = [c for c in rows.columns if c not in ("category", "tokens", "images", "path")]
    return rows.select(*kept, F.explode(each).alias("e")).select(*kept, "e.*")


def entries(lines: DataFrame, file_day: Column, subagents: bool = True) -> DataFrame:
    """(session, file, ordinal, block, part, category, tokens, images, path, residency, at, day) of the first kind.

    A tool's result takes the name and file of the last call with its id in the same file; without one it is
    ``other_tools``. Assistant lines that repeat the message id of the one before are one turn. A session is the last
    ``sessionId`` of its file, else the file's name; a file with a side chain is a session of its own (or left out).
    """
    v = F.col("value")
    base = _timed(lines, file_day).withColumns({"kind": F.coalesce(json.string_at(v, "$.type"), F.lit("")), "sid": json.string_at(v, "$.sessionId"), "agent": json.string_at(v, "$.agentId")})
    message = F.when(json.kind(json.at(v, "$.message")) == "OBJECT", json.at(v, "$.message"))
    base = base.withColumns({"mid": json.string_at(message, "$.id"), "blocks": json.items_at(message, "$.content"), "side": F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False))})
    by_file, order = Window.partitionBy("file"), Window.partitionBy("file").orderBy("ordinal")
    last_id = F.max(F.when(F.col("sid").isNotNull(), F.struct("ordinal", "sid"))).over(by_file)["sid"]
    first_agent = F.min(F.when(F.col("agent").isNotNull(), F.struct("ordinal", "agent"))).over(by_file)["agent"]
    stem = F.regexp_replace(text.base_name(F.col("file")), r"\.[^.]*$", "")
    base = base.withColumn("sub", F.max("side").over(by_file))
    own = F.coalesce(last_id, stem)
    base = base.withColumn("session", F.when(F.col("sub"), F.concat(own, F.lit(" (subagent:"), F.coalesce(first_agent, text.base_name(F.col("file"))), F.lit(")"))).otherwise(own))
    if not subagents:
        base = base.where(~F.col("sub"))
    base = base.withColumn("started", F.min("at").over(by_file))
    # consecutive assistant lines with one message id are one turn
    assistant = F.col("kind") == "assistant"
    before = F.last(F.when(assistant, F.struct("mid")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    turn = assistant & (F.col("mid").isNull() | before.isNull() | ~F.col("mid").eqNullSafe(before["mid"]))
    cut = json.is_truthy(json.at(v, "$.isCompactSummary")) | (F.col("kind") == "summary") | (json.string_at(v, "$.subtype") == "compact_boundary")
    base = windows.residency(base.withColumn("turn", turn), "file", "ordinal", F.col("turn"), F.coalesce(cut, F.lit(False)))
    blocks = base.where("kind <> 'attachment'").select("session", "started", "file", "ordinal", "residency", "at", "day", F.posexplode("blocks").alias("block", "b")).withColumn("type", json.string_at(F.col("b"), "$.type"))
    calls = blocks.where("type = 'tool_use'").select("file", json.string_at(F.col("b"), "$.id").alias("id"), F.struct("ordinal", "block").alias("o"), json.string_at(F.col("b"), "$.name").alias("name"), json.string_at(F.col("b"), "$.input.file_path").alias("path"))
    calls = calls.where("id is not null").groupBy("file", "id").agg(F.max(F.struct("o", "name", "path")).alias("c")).select("file", "id", F.struct(F.coalesce("c.name", F.lit("")).alias("name"), F.col("c.path").alias("path")).alias("call"))
    results = blocks.where("type in ('tool_result', 'image')").withColumns({"id": json.string_at(F.col("b"), "$.tool_use_id"), "content": json.at(F.col("b"), "$.content")}).join(calls, ["file", "id"], "left")
    is_result, name = F.col("type") == "tool_result", F.col("call.name")
    found = results.select(
        "session", "started", "file", "ordinal", "block", "residency", "at", "day",
        F.when(is_result, F.when(F.col("call").isNull(), "other_tools").otherwise(tool_category(name, F.col("call.path")))).alias("category"),
        text.token_estimate(json.content_text(F.col("content"))).alias("tokens"), F.when(is_result, json.content_images(F.col("content"))).otherwise(F.lit(1).cast("long")).alias("images"), F.col("call.path").alias("path"),
    )
    att = json.at(v, "$.attachment")
    name = json.string_at(att, "$.filename")
    attached = base.where("kind = 'attachment'").select(
        "session", "started", "file", "ordinal", F.lit(0).alias("block"), "residency", "at", "day", F.when(text.is_memory_path(name), "memory_notes").otherwise("harness_attachments").alias("category"),
        text.token_estimate(F.coalesce(json.attachment_text(att), F.lit("{}"))).alias("tokens"), F.lit(0).cast("long").alias("images"), name.alias("path"),
    )
    return _with_images(found.unionByName(attached))


def call_entries(lines: DataFrame, file_day: Column) -> DataFrame:
    """As ``entries`` for the second kind, whose lines hold a ``payload``: calls and outputs, searches, tool servers, messages."""
    v = F.col("value")
    p = json.at(v, "$.payload")
    base = _timed(lines, file_day).withColumns({"p": F.when(json.kind(p) == "OBJECT", p), "kind": F.coalesce(json.string_at(p, "$.type"), F.lit(""))})
    by_file = Window.partitionBy("file")
    meta = json.string_at(v, "$.type") == "session_meta"
    first = F.min(F.when(meta, F.struct("ordinal", F.coalesce(json.string_at(p, "$.id"), json.string_at(p, "$.session_id")).alias("id")))).over(by_file)["id"]
    base = base.withColumn("session", F.coalesce(first, F.regexp_replace(text.base_name(F.col("file")), r"\.[^.]*$", ""))).withColumn("started", F.min("at").over(by_file))
    calls_of = ("function_call", "custom_tool_call", "local_shell_call")
    base = windows.residency(base, "file", "ordinal", F.col("kind").isin(*calls_of, "agent_message"), F.col("kind") == "context_compacted")
    p = F.col("p")
    named = F.coalesce(json.string_at(p, "$.name"), F.when(F.col("kind") == "local_shell_call", "local_shell"))
    calls = base.where(F.col("kind").isin(*calls_of)).select("file", json.string_at(p, "$.call_id").alias("call_id"), "ordinal", named.alias("name")).where("call_id is not null")
    calls = calls.groupBy("file", "call_id").agg(F.max(F.struct("ordinal", "name"))["name"].alias("name"))
    rows = base.withColumn("call_id", json.string_at(p, "$.call_id")).join(calls, ["file", "call_id"], "left")
    kind, role = F.col("kind"), json.string_at(p, "$.role")
    output = kind.isin(*(f"{c}_output" for c in calls_of))
    server, message = kind == "mcp_tool_call_end", (kind == "message") & role.isin("developer", "user")
    result = json.at(p, "$.result")
    inner = F.when(json.kind(json.at(result, "$.Ok")) == "OBJECT", json.at(result, "$.Ok")).otherwise(result)
    content = F.when(output, json.at(p, "$.output")).when(server, json.at(inner, "$.content")).when(message, json.at(p, "$.content"))
    bare = server & (json.kind(result) == "OBJECT") & content.isNull()
    said = F.when(kind == "web_search_end", json.spaced_json(p)).when(bare, json.spaced_json(result)).otherwise(json.content_text(content))
    category = (
        F.when(output, call_category(F.coalesce("name", F.lit(""))))
        .when(kind == "web_search_end", "web_fetch_search")
        .when(server, server_category(json.string_at(p, "$.invocation.server"), json.string_at(p, "$.invocation.tool")))
        .when(message & (role == "developer"), "harness_attachments")
    )
    found = rows.where(output | server | message | (kind == "web_search_end")).select(
        "session", "started", "file", "ordinal", F.lit(0).alias("block"), "residency", "at", "day", category.alias("category"), text.token_estimate(said).alias("tokens"),
        json.content_images(content).alias("images"), F.lit(None).cast("string").alias("path"),
    )
    return _with_images(found)


def in_window(rows: DataFrame, today: Column, days: int = 92) -> DataFrame:
    """Entries of the ``days`` UTC days that end with today."""
    return rows.where(F.col("day").between(F.date_sub(today, days - 1), today))


def daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "category").agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("residency")).alias("resident_tokens"), F.sum("images").alias("images"))


def top_files(rows: DataFrame, workspace: Column, most: int = 100) -> DataFrame:
    """The files with most tokens: relative names, the category of the last entry, the newest access."""
    order = F.struct("file", "ordinal", "block", "part", "category")
    per = rows.where("path is not null").groupBy("path").agg(F.max(order)["category"].alias("category"), F.count("*").alias("events"), F.sum("tokens").alias("tokens"), F.max("at").alias("last_access"))
    named = per.withColumn("name", text.relative_or_name(workspace, F.col("path"))).where("name is not null")
    return named.orderBy(F.desc("tokens"), "name", "path").limit(most).select("name", "category", "events", "tokens", "last_access")


def top_sessions(rows: DataFrame, most: int = 200) -> DataFrame:
    """The sessions with most tokens, by hash: total, start, and the category with most tokens (the first in order of equals)."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    per = rows.groupBy("session", "category").agg(F.sum("tokens").alias("t"), F.min("started").alias("started"))
    best = F.max(F.struct(F.col("t"), (-place).alias("p"), F.col("category").alias("c")))["c"]
    whole = per.groupBy("session").agg(F.sum("t").alias("tokens"), F.min("started").alias("started"), best.alias("top_category")).where("tokens > 0")
    hashed = whole.select(F.concat(F.lit("sha256:"), digests.ended(F.col("session"))).alias("session"), "started", "tokens", "top_category")
    return hashed.orderBy(F.desc("tokens"), "session").limit(most)
