"""Text functions: token estimates, names, slugs, paths, templates and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for regular expressions of Java and RE2 alike.
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Names of known plans; words that begin with a slash but name no skill; marks of private prompts.
PLANS = {
    "pro": "Pro", "team": "Team", "team_standard": "Team Standard", "team_premium": "Team Premium", "plus": "Plus",
    "enterprise": "Enterprise", "business": "Business", "max": "Max", "free": "Free",
}
RESERVED_SKILLS = ("compact", "help", "login", "logout", "model", "review", "status")
PRIVATE_MARKS = ("<instructions>", "<environment_context>", "agents.md instructions", "knowledge cutoff:", "current date:")
#: Texts that hold one of these name a path or a secret. Callers add prefixes of their own tokens.
UNSAFE_MARKS = ("/users/", "\\users\\", "/home/", "\\home\\", "file://", "transcript_path", "workspace_path", "authorization:", "bearer ")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up; 0 for an empty text, null for null."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def tokens(text: Column) -> Column:
    """The runs between white space; an empty array for a blank text."""
    return F.filter(F.split(text, f"{WHITE}+"), lambda t: t != "")


def one_line(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def has_any(text: Column, marks: Sequence[str]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | text.contains(mark)
    return found


def slug(name: Column, most: int = 64, refused: Sequence[str] = ("__all__",)) -> Column:
    """Lower-case name of ``a-z 0-9 . _ -``; others become ``-``. Null unless it starts with a letter or digit."""
    low = ascii_lower(trimmed(name))
    made = F.left(F.regexp_replace(low, "[^a-z0-9._-]", "-"), F.lit(most))
    return F.when(made.rlike("^[a-z0-9]") & ~low.isin(*refused), made)


def closed_map(name: Column, known: dict[str, str], other: str = "other") -> Column:
    """The value of a name, whatever its case and surrounding blanks; ``other`` for unknown names and null."""
    pairs = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k.upper(), v)])
    return F.coalesce(F.try_element_at(pairs, F.upper(F.trim(name))), F.lit(other))


def plan_label(name: Column) -> Column:
    """The name of a known plan; else words at white space, each with its first letter in upper case, the rest unchanged."""
    known = F.create_map(*[F.lit(x) for pair in PLANS.items() for x in pair])
    words = F.transform(tokens(name), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    return F.coalesce(F.try_element_at(known, ascii_lower(trimmed(name))), F.array_join(words, " "))


def is_memory_path(path: Column) -> Column:
    """A file of notes: named ``MEMORY.md``, or inside a folder of notes; either separator."""
    return path.rlike(r"(^|[/\\])MEMORY\.md$") | has_any(path, ("AutoMem/", "AutoMem\\", "/memory/", "\\memory\\"))


def path_class(path: Column) -> Column:
    """``memory_notes``, ``doc_reads_md``, ``doc_reads_html`` or else ``code_reads``; null counts as empty."""
    p = F.coalesce(path, F.lit(""))
    low = ascii_lower(p)
    md, html = low.endswith(".md") | low.endswith(".markdown"), low.endswith(".html") | low.endswith(".htm")
    return F.when(is_memory_path(p), "memory_notes").when(md, "doc_reads_md").when(html, "doc_reads_html").otherwise("code_reads")


def base_name(path: Column) -> Column:
    """The last part of a path with slashes, trailing ones left out; null if there is none."""
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when((last != "") & ~last.isin(".", ".."), last)


def safe_text(text: Column, most: int, marks: Sequence[str] = UNSAFE_MARKS) -> Column:
    """Text on one line cut to ``most`` characters; null if it is blank or names a path or a secret."""
    flat = one_line(text)
    return F.when((flat != "") & ~has_any(ascii_lower(flat), marks), F.left(flat, F.lit(most)))


def relative_or_name(workspace: Column, path: Column, marks: Sequence[str] = UNSAFE_MARKS) -> Column:
    """The path below ``workspace`` (whole parts), else its last part; null if even that could tell a place or a secret."""
    root = F.regexp_replace(workspace, "/+$", "")
    below = F.replace(F.substr(path, F.char_length(root) + 2), F.lit("\\"), F.lit("/"))
    inside = F.startswith(path, F.concat(root, F.lit("/"))) & (below != "")
    made = F.when(inside, below).otherwise(base_name(path))
    bad = made.rlike(r"^[/~\\]") | has_any(made, ("..", ":/", ":\\"))
    return F.when(~bad, safe_text(made, 512, marks))


def without_scaffolding(text: Column) -> Column:
    """A prompt without the blocks that tools put before it, as many as there are; others only lose their leading blanks."""
    bare = F.regexp_replace(text, f"^{WHITE}+", "")

    def end(low: Column, close: str) -> Column:
        at = F.instr(low, close)
        return F.when(at > 0, at + len(close) - 1).otherwise(0)

    def once(value: Column) -> Column:
        v = F.regexp_replace(value, f"^{WHITE}+", "")
        low = ascii_lower(v)
        plugins = end(low, "</recommended_plugins>")
        start = F.instr(low, "<instructions>")
        inside = F.instr(F.substr(low, start), "</instructions>")
        agents = F.when((start > 0) & (inside > 0), start + inside + len("</instructions>") - 2).otherwise(0)
        context = end(low, "</environment_context>")
        at = (
            F.when(low.startswith("<recommended_plugins>"), plugins)
            .when(low.startswith("# agents.md instructions for "), agents)
            .when(low.startswith("<environment_context>") & F.left(low, context).contains("<cwd>"), context)
            .otherwise(0)
        )
        return F.substr(v, at + 1)

    blocks = F.sequence(F.lit(1), F.size(F.split(text, "(?i)</(?:recommended_plugins|instructions|environment_context)>")))
    begins = bare.rlike("(?i)^(?:<recommended_plugins>|# agents\\.md instructions for |<environment_context>)")
    return F.when(begins, F.aggregate(blocks, text, lambda value, _: once(value))).otherwise(bare)


_CHANGING = r"^[^A-Za-z0-9]*(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}|[0-9]{4,}|[0-9A-Fa-f]{16,})[^A-Za-z0-9]*$)"


def template(text: Column, most: int = 4096) -> Column:
    """Lower-case prompt on one line, changing tokens as ``<dynamic>``: ids, dates, long numbers. Null if it is blank.

    At most ``most`` tokens count, and as many characters: the bound that makes templates of one prompt equal.
    """
    kept = F.transform(F.slice(tokens(without_scaffolding(text)), 1, most), lambda t: F.when(t.rlike(_CHANGING), "<dynamic>").otherwise(t))
    return F.nullif(F.left(F.lower(F.array_join(kept, " ")), F.lit(most)), F.lit(""))


def slash_skill(prompt: Column) -> Column:
    """The name after a slash that a prompt begins with, in lower case; null for reserved and odd names."""
    first = F.regexp_extract(prompt, f"^{WHITE}*([^{WHITE[1:]}+)", 1)
    name = ascii_lower(F.regexp_replace(F.substr(first, F.lit(2)), "[:,.]+$", ""))
    return F.when(first.startswith("/") & name.rlike("^[a-z0-9_.-]{1,64}$") & ~name.isin(*RESERVED_SKILLS), name)


def is_local_path(token: Column) -> Column:
    """Whether a token, but for quotes and brackets around it, names a file: any slash but a lone leading one, a drive, ``~/``."""
    bare = F.regexp_replace(token, r"""^["'()\[\]{},;]+|["'()\[\]{},;]+$""", "")
    shape = bare.rlike(r"^.:[\\/]|^/[^/][^/]*/|^[^/]+/|\\|^~/")
    return shape | has_any(ascii_lower(bare), ("/users/", "/home/", "/volumes/", "/private/", "/var/folders/", "/tmp/"))


def prompt_label(prompt: Column, most_bytes: int = 96) -> Column:
    """The first whole tokens of a prompt within ``most_bytes``, local paths as ``[path]``; null for private scaffolding."""
    said = F.when(prompt.rlike("(?i)its prompt is:"), F.regexp_extract(prompt, "(?is)its prompt is:(.*)", 1)).otherwise(prompt)
    most = most_bytes // 2 + 1
    head = F.regexp_extract(said, f"^{WHITE}*((?:[^{WHITE[1:]}+{WHITE}*){{1,{most}}})", 1)
    # every token takes two bytes at least
    safe = F.transform(F.slice(tokens(head), 1, most), lambda t: F.when(is_local_path(t), "[path]").otherwise(t))
    start = F.struct(F.lit("").alias("label"), F.lit(False).alias("full"))

    def add(now: Column, t: Column) -> Column:
        longer = F.concat(now["label"], F.when(now["label"] == "", "").otherwise(" "), t)
        full = now["full"] | (F.octet_length(longer) > most_bytes)
        return F.struct(F.when(full, now["label"]).otherwise(longer).alias("label"), full.alias("full"))

    label = F.aggregate(safe, start, add, lambda now: now["label"])
    private = prompt.rlike("(?i)" + "|".join(m.replace(".", r"\.") for m in PRIVATE_MARKS))
    return F.when(~private & (label != ""), label)


def count_text(text: Column) -> Column:
    """Whole number from a text such as ``~12.3k``, ``<1,024 tokens`` or ``**2m**``; null for other texts and below zero."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed(text), r"^\*+|\*+$", ""), "^~+", ""), "^<+", "")
    plain = trimmed(ascii_lower(F.replace(F.replace(plain, F.lit(","), F.lit("")), F.lit("tokens"), F.lit(""))))
    number = trimmed(F.regexp_replace(plain, "[kmb]$", "")).try_cast("double")
    unit = F.when(plain.endswith("k"), 1e3).when(plain.endswith("m"), 1e6).when(plain.endswith("b"), 1e9).otherwise(1.0)
    fine = (number >= 0) & (number < float("inf")) & ~F.isnan(number)
    return F.when(fine, F.floor(number * unit + 0.5)).cast("long")


def redacted(text: Column) -> Column:
    """Mail addresses, bearer tokens and long keys replaced by marks."""
    out = F.regexp_replace(text, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[mail]")
    out = F.regexp_replace(out, "([Bb]earer|[Tt]oken:?|[Pp]assword:?) +[^ \\n]+", "$1 [redacted]")
    return F.regexp_replace(out, "[A-Za-z0-9_]{32,}", "[key]")
