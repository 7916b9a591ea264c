"""Redaction of secrets, local paths, identifiers and prompts: in texts token by token, in JSON by key at any depth.

Callers add prefixes of their own tokens and labels of their own headers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmeter.functions.text import ascii_lower, has_any, tokens
from quillmeter.functions.values import bound

#: What stands for each class.
MARKS = {"secret": "[REDACTED]", "path": "[path]", "machine": "[machine_id]", "account": "[account_id]", "prompt": "[prompt]"}
#: Parts of keys that hold a secret; more of them count before an equals sign in a text.
SECRET_KEYS = ("authorization", "api_key", "apikey", "bearer", "client_secret", "cookie", "otel_exporter_otlp_headers", "password", "refresh_token", "secret", "token")
ASSIGNED_KEYS = (*SECRET_KEYS, "api-key", "passwd", "pwd", "access_token", "ingest_key", "claim_token", "setup_run_token")
#: Words after which a credential stands.
LABELS = ("bearer", "authorization", "token", "x-api-key", "apikey", "api-key", "password")
#: Whole keys of machines and accounts, and ends of keys of machines.
MACHINE_KEYS = ("machine_id", "installation_id", "account_scope", "device_id", "hardware_uuid", "serial", "serial_number", "hardware_serial")
MACHINE_ENDS = ("_uuid", "_serial", "_serial_number")
ACCOUNT_KEYS = ("account", "organization", "user_id")
#: Starts of local paths, of ids, and of tokens that vendors hand out (in lower case).
PATH_STARTS = ("/users/", "/home/", "/private/", "~/", "file:/", "c:\\users\\")
VENDOR_STARTS = ("sk-", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-")
MACHINE_ID = "^(?:machine|install|device)_[a-z0-9_-]+$"
ACCOUNT_ID = "^(?:acct|org|user)_[a-z0-9_-]+$"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Keys of two vendors, three dotted parts of a signed token, 32 hexadecimal digits.
SHAPES = (r"^AKIA[A-Z0-9]{16}$", r"^AIza[A-Za-z0-9_-]{35}$", r"^eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$", "^[0-9A-Fa-f]{32,}$")
AROUND = r"""^["',;()\[\]{}]+|["',;()\[\]{}]+$"""
#: A token without any of these is none of the classes, whatever stands before it.
NOTABLE = r"[=_/\\~-]|.{12}"
#: Escaped backslashes and quotes stand aside as control characters, which JSON has in no string: then a string ends at the next quote.
_ASIDE = (("\\\\", "\x01"), ('\\"', "\x02"))
_LEXEME = r'"[^"]*"|[\[\]{},:]|[^\[\]{},:"]+'


def key_class(key: Column) -> Column:
    """The class of what a key holds; null for other keys."""
    low = ascii_lower(key)
    machine = low.isin(*MACHINE_KEYS)
    for end in MACHINE_ENDS:
        machine = machine | low.endswith(end)
    return (
        F.when(has_any(low, SECRET_KEYS), "secret")
        .when(low.contains("path") | (low == "file") | low.endswith("_file"), "path")
        .when(machine, "machine")
        .when(has_any(low, ("account_id", "organization_id")) | low.isin(*ACCOUNT_KEYS), "account")
        .when(has_any(low, ("raw_prompt", "user_prompt")) | (low == "prompt") | low.endswith("_prompt"), "prompt")
    )


def _starts(text: Column, starts: Sequence[str]) -> Column:
    found = F.lit(False)
    for start in starts:
        found = found | text.startswith(start)
    return found


def _is_label(token: Column, labels: Sequence[str]) -> Column:
    return F.regexp_replace(ascii_lower(F.regexp_replace(token, AROUND, "")), ":$", "").isin(*labels)


def _is_random(value: Column) -> Column:
    """24 or more characters of a closed alphabet with letters, digits and a run of 20: no path, version or prose."""
    return value.rlike(r"^[A-Za-z0-9_+=.-]{24,}$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & value.rlike("[A-Za-z0-9]{20}")


def _token_class(token: Column, armed: Column, own_starts: Sequence[str]) -> Column:
    """The class of a token, null for others. After a label only credentials count."""
    bare = F.regexp_replace(token, AROUND, "")
    has_key = bare.contains("=")
    key = ascii_lower(F.substring_index(bare, "=", 1))
    value = F.when(has_key, F.substr(bare, F.instr(bare, "=") + 1)).otherwise(bare)
    low = ascii_lower(value)
    shaped = _starts(low, (*VENDOR_STARTS, *own_starts))
    for shape in SHAPES:
        shaped = shaped | value.rlike(shape)
    secret = (has_key & (value != "") & has_any(key, ASSIGNED_KEYS)) | shaped | _is_random(value)
    opaque = value.rlike("^[A-Za-z0-9_+/=.-]{12,}$") & (value.rlike("[0-9_+/=.-]") | (value.rlike("[A-Z]") & value.rlike("[a-z]")))
    machine = F.when(has_key, (value != "") & (key_class(key) == "machine")).otherwise(low.rlike(UUID) | low.rlike(MACHINE_ID))
    prompt = _starts(ascii_lower(bare), ("prompt=", "raw_prompt=", "user_prompt="))
    free = F.when(_starts(low, PATH_STARTS), "path").when(machine, "machine").when(low.rlike(ACCOUNT_ID), "account").when(prompt, "prompt").when(secret, "secret")
    return F.when(armed, F.when(secret | opaque, "secret")).otherwise(free)


def redacted(text: Column, own_starts: Sequence[str] = (), own_labels: Sequence[str] = ()) -> Column:
    """A text on one line, with marks for tokens that are local paths, ids of machines and accounts, prompts and secrets.

    A label such as ``Bearer`` stays and arms the next token that is no label: that goes if it looks like a credential,
    and stays otherwise. Whether a token is a label doesn't depend on what stands before it, so the state of the scan is
    the token before, and tokens are judged side by side. From ``prompt=`` on all goes, as a prompt has blanks.
    """
    labels = (*LABELS, *own_labels)
    marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])

    def judged(all_: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            armed = (i > 0) & _is_label(F.get(all_, i - 1), labels)
            found = F.when(t.rlike(NOTABLE) & ~_is_label(t, labels), _token_class(t, armed, own_starts))
            return F.coalesce(F.try_element_at(marks, found), t)

        return F.transform(all_, one)

    def tail_cut(all_: Column) -> Column:
        """Up to the first prompt that isn't a token's own text: the mark itself may stand in a text."""
        def cut(marked: Column) -> Column:
            at = F.array_position(F.transform(all_, lambda t, i: (F.get(marked, i) == MARKS["prompt"]) & (t != MARKS["prompt"])), True)
            return bound(at, lambda p: F.when(p > 0, F.slice(marked, F.lit(1), p.cast("int"))).otherwise(marked))

        return bound(judged(all_), cut)

    return F.array_join(bound(tokens(text), lambda w: F.when(ascii_lower(text).contains("prompt="), tail_cut(w)).otherwise(judged(w))), " ")


def redacted_json(text: Column, own_starts: Sequence[str] = (), own_labels: Sequence[str] = ()) -> Column:
    """A JSON text with marks for the values of telling keys at any depth, all other strings as ``redacted`` has them.

    Objects come with their keys in order, as VARIANT keeps them. A text that is no JSON, or of which nothing changes,
    is redacted as a text. Lexemes are scanned once: a telling key's value is one lexeme, or all up to the bracket that
    closes it.
    """

    def aside(written: Column) -> Column:
        for raw, mark in _ASIDE:
            written = F.replace(written, F.lit(raw), F.lit(mark))
        return written

    def back(lexeme: Column) -> Column:
        for raw, mark in reversed(_ASIDE):
            lexeme = F.replace(lexeme, F.lit(mark), F.lit(raw))
        return lexeme

    lexemes = F.regexp_extract_all(aside(F.to_json(F.try_parse_json(text))), F.lit(_LEXEME), F.lit(0))
    plain = lambda quoted: F.try_variant_get(F.try_parse_json(back(quoted)), "$", "string")

    def rewritten(lex: Column) -> Column:
        keys = F.transform(lex, lambda x, i: F.when(x.startswith('"') & (F.get(lex, i + 1) == ":"), F.coalesce(key_class(plain(x)), F.lit("none"))))
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("until"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("due"), F.expr("CAST(array() AS array<struct<a:int,b:int,c:string>>)").alias("cuts"))

        def step(s: Column, x: Column) -> Column:
            """``due``: the class of the value that comes next; ``until``: the depth at which a value that goes ends."""
            lexeme, key = x["x"], x["k"]
            opens, closes = lexeme.isin("{", "["), lexeme.isin("}", "]")
            depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
            inside = s["until"] >= 0
            value = ~inside & s["due"].isNotNull() & (lexeme != ":")
            ends = (inside & closes & (depth == s["until"])) | (value & ~opens)
            first = F.when(value, s["i"]).otherwise(s["at"])
            cut = F.struct(first.alias("a"), s["i"].alias("b"), s["due"].alias("c"))
            due = F.when(inside & ~ends, s["due"]).when(ends, None).when(value | (lexeme == ":"), s["due"]).otherwise(F.nullif(key, F.lit("none")))
            until = F.when(value & opens, s["depth"]).when(ends, -1).otherwise(s["until"])
            return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), until.alias("until"), first.alias("at"), due.alias("due"), F.when(ends, F.array_append(s["cuts"], cut)).otherwise(s["cuts"]).alias("cuts"))

        def put(cuts: Column, new: Column) -> Column:
            quoted = F.create_map(*[F.lit(x) for k, v in MARKS.items() for x in (k, f'"{v}"')])
            begin = lambda i: F.when(i > 0, F.get(cuts, i - 1)["b"] + 1).otherwise(0)
            parts = F.transform(cuts, lambda c, i: F.concat(F.slice(new, begin(i) + 1, c["a"] - begin(i)), F.array(F.try_element_at(quoted, c["c"]))))
            rest = begin(F.size(cuts))
            return F.array_join(F.concat(F.flatten(parts), F.slice(new, rest + 1, F.size(new) - rest)), "")

        def leaf(z: Column) -> Column:
            """A string that is no key."""
            return bound(plain(z["x"]), lambda s: bound(redacted(s, own_starts, own_labels), lambda r: F.when(r == s, z["x"]).otherwise(aside(F.to_json(r.cast("variant"))))))

        def scanned(pairs: Column) -> Column:
            goes = lambda i: F.when(i > 1, F.coalesce(F.get(pairs, i - 2)["k"], F.lit("none")) != "none").otherwise(False)
            new = F.transform(pairs, lambda z, i: F.when(z["k"].isNull() & z["x"].startswith('"') & ~goes(i), leaf(z)).otherwise(z["x"]))
            cuts = F.aggregate(pairs, start, step, lambda s: s["cuts"])
            return bound(new, lambda n: bound(cuts, lambda c: F.when((F.size(c) > 0) | (n != lex), back(put(c, n)))))

        return bound(F.arrays_zip(lex.alias("x"), keys.alias("k")), scanned)

    return F.coalesce(bound(lexemes, rewritten), redacted(text, own_starts, own_labels))
