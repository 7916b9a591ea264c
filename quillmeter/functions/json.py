"""Fields, content blocks and truth of JSON values, held as VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmeter.functions.text import trimmed

IMAGES = ("image", "input_image", "output_image")
TEXTS = ("text", "input_text", "output_text")


def kind(value: Column) -> Column:
    """``STRING``, ``BIGINT``, ``BOOLEAN``, ``ARRAY``, ``OBJECT``, ``VOID`` (JSON null) and the like; null where there is nothing.

    Only scalars and empty arrays get to the schema, which for nested values would be built as a whole.
    """
    nested = F.when(F.try_variant_get(value, "$", "struct<>").isNotNull(), "OBJECT").when(F.try_variant_get(value, "$[0]", "variant").isNotNull(), "ARRAY")
    return F.coalesce(nested, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def string(found: Column) -> Column:
    """A value's own text; null if it is no string."""
    return F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def string_at(value: Column, path: str) -> Column:
    """The text under a path; null if anything but a string is there."""
    found = at(value, path)
    return F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def long_at(value: Column, path: str) -> Column:
    """The whole number from 0 on under a path; null for anything else."""
    found = at(value, path)
    number = F.when(kind(found) == "BIGINT", F.try_variant_get(found, "$", "long"))
    return F.when(number >= 0, number)


def items_at(value: Column, path: str) -> Column:
    """The elements of the array under a path; null if there is none."""
    found = at(value, path)
    return F.when(kind(found) == "ARRAY", F.try_variant_get(found, "$", "array<variant>"))


def first_string(value: Column, keys: Sequence[str]) -> Column:
    """The text under the first of ``keys`` that holds a string; null if that is blank."""
    return F.nullif(trimmed(F.coalesce(*[string_at(value, f"$.{k}") for k in keys])), F.lit(""))


def first_items(value: Column, keys: Sequence[str]) -> Column:
    """The elements under the first of ``keys`` that holds an array."""
    return F.coalesce(*[items_at(value, f"$.{k}") for k in keys])


def is_truthy(value: Column) -> Column:
    """False for nothing, null, false, zero, an empty text, array or object."""
    text, what = F.try_variant_get(value, "$", "string"), kind(value)
    number = F.coalesce(F.try_variant_get(value, "$", "double"), F.lit(0.0))
    return F.when(what.isNull() | (what == "VOID"), False).when(what == "STRING", text != "").when(what == "BOOLEAN", text == "true").when(what.isin("ARRAY", "OBJECT"), ~text.isin("[]", "{}")).otherwise(number != 0)


def spaced_json(value: Column) -> Column:
    """JSON text with ``, `` and ``: `` between its parts, as Python's json module writes it; keys in order."""
    # between quotes that no backslash escapes, every other part is outside of strings
    marked = F.replace(F.replace(F.to_json(value), F.lit("\\\\"), F.lit("\x02")), F.lit('\\"'), F.lit("\x01"))
    spaced = F.transform(F.split(marked, '"'), lambda part, i: F.when(i % 2 == 1, part).otherwise(F.regexp_replace(part, "([,:])", "$1 ")))
    return F.replace(F.replace(F.array_join(spaced, '"'), F.lit("\x01"), F.lit('\\"')), F.lit("\x02"), F.lit("\\\\"))


def block_text(block: Column) -> Column:
    """The text that one content block brings: its own, none for an image, its JSON for other objects."""
    what, of = kind(block), string_at(block, "$.type")
    own = F.when(of.isin(*IMAGES), None).when(of.isin(*TEXTS), string_at(block, "$.text")).otherwise(spaced_json(block))
    return F.when(what == "STRING", F.try_variant_get(block, "$", "string")).when(what == "OBJECT", own).otherwise(spaced_json(block))


def content_text(content: Column) -> Column:
    """The text of a message's content: a string, one block, or blocks joined by line feeds; empty for nothing."""
    what = kind(content)
    blocks = F.when(what == "ARRAY", F.try_variant_get(content, "$", "array<variant>")).when(what == "OBJECT", F.array(content))
    joined = F.array_join(F.filter(F.transform(blocks, block_text), lambda t: t.isNotNull()), "\n")
    return F.when(what.isNull() | (what == "VOID"), "").when(what == "STRING", F.try_variant_get(content, "$", "string")).when(blocks.isNotNull(), joined).otherwise(spaced_json(content))


def content_images(content: Column) -> Column:
    """How many image blocks a content holds."""
    what = kind(content)
    blocks = F.when(what == "ARRAY", F.try_variant_get(content, "$", "array<variant>")).when(what == "OBJECT", F.array(content))
    return F.coalesce(F.size(F.filter(blocks, lambda b: string_at(b, "$.type").isin(*IMAGES))), F.lit(0)).cast("long")


#: The fields of an attachment that hold texts, then those that hold lists.
ATTACHED_TEXTS = ("content", "snippet", "banner", "prompt", "command", "blockingError")
ATTACHED_LISTS = ("addedLines", "addedBlocks", "removedLines")


def attachment_text(value: Column) -> Column:
    """What an attachment brings: its texts and list elements, a line each; its JSON if it has none."""
    one = [F.nullif(string_at(value, f"$.{k}"), F.lit("")) for k in ATTACHED_TEXTS]
    element = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(spaced_json(v))
    more = [F.transform(F.coalesce(items_at(value, f"$.{k}"), F.array().cast("array<variant>")), element) for k in ATTACHED_LISTS]
    parts = F.concat(F.array_compact(F.array(*one)), *more)
    return F.when((kind(value) == "OBJECT") & (F.size(parts) > 0), F.array_join(parts, "\n")).otherwise(spaced_json(value))
