"""Definitions in property lists, TOML and JSON files: each file becomes a VARIANT in its task, and the rules are columns."""

from __future__ import annotations

import datetime
import json as json_
import plistlib
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmeter.functions import json, text

#: Files of a folder that are read, bytes of a file by its kind, bytes of an id and of a label.
MOST_FILES, MOST_BYTES, MOST_ID, MOST_LABEL = 256, {"plist": 128 << 10, "toml": 64 << 10, "json": 64 << 10}, 128, 256
#: Parts of a calendar rule, smallest and largest; arguments of a command and their characters; characters of a signature.
CALENDAR = (("Minute", 0, 59), ("Hour", 0, 23), ("Weekday", 0, 7), ("Day", 1, 31), ("Month", 1, 12))
MOST_ARGUMENTS, ARGUMENT_CHARS, SIGNATURE_CHARS = 64, 4096, 96

_READERS = {"plist": plistlib.loads, "toml": lambda b: tomllib.loads(b.decode()), "json": json_.loads}


def read_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(file, content): the files of a kind below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").load(folder)
    return files.select(F.col("path").alias("file"), "content")


def _shown(value):
    """What JSON has no word for: times as ISO text, bytes as hexadecimal digits, not-a-number as nothing."""
    return value.isoformat() if isinstance(value, (datetime.date, datetime.time)) else value.hex() if isinstance(value, bytes) else None


def parsed(files: DataFrame, kind: str, folder: Column | None = None, whole: bool = False) -> DataFrame:
    """(file, value, fault): each file's content as VARIANT, or why there is none: ``large``, ``malformed`` or ``beyond``.

    A folder's first ``MOST_FILES`` files in order count, the others are ``beyond``; with ``whole`` all of them count. A bad
    file is a row like others, and nothing of it is read. Numbers that aren't finite have no value.
    """
    most, read = MOST_BYTES[kind], _READERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, str | None]] = []
            for content, beyond in zip(batch.column("content").to_pylist(), batch.column("beyond").to_pylist(), strict=True):
                if beyond or content is None or len(content) > most:
                    out.append((None, "beyond" if beyond else "malformed" if content is None else "large"))
                    continue
                try:
                    out.append((json_.dumps(read(content), default=_shown, allow_nan=False), None))
                except Exception:  # noqa: BLE001  any parser's refusal, one file's matter
                    out.append((None, "malformed"))
            yield pa.RecordBatch.from_arrays([batch.column("file"), *(pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else ((), ())))], ["file", "written", "fault"])

    of = folder if folder is not None else F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    placed = files.select("file", F.col("content").cast("binary").alias("content"), of.alias("_f"))
    if whole:
        # dealt out anew: parsing is the work, and few blocks of a table may hold all files
        tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = placed.repartition(tasks, "file").select("file", "content", F.lit(False).alias("beyond"))
    else:
        # names alone are ranked; contents stay where they are
        ranked = placed.select("file", F.row_number().over(Window.partitionBy("_f").orderBy("file")).alias("_n"))
        rows = placed.join(ranked, "file").select("file", "content", (F.col("_n") > MOST_FILES).alias("beyond"))
    return rows.mapInArrow(run, "file string, written string, fault string").select("file", F.try_parse_json("written").alias("value"), "fault")


def _short(value: Column, most: int) -> Column:
    return F.when((value != "") & (F.octet_length(value) <= most), value)


def launchd(files: DataFrame, whole: bool = False) -> DataFrame:
    """(file, label, command, workspace, place, minute, hour, weekday, day, month) of property lists: a row for each calendar rule.

    ``StartCalendarInterval`` is one rule or a list of them; a part that is missing, no whole number or out of range is
    null, which fits every time. Definitions without a calendar give one row with a null ``place``. Without a label of 1 to
    256 bytes a file gives none. The command is the program and the arguments that are texts.
    """
    v = F.col("value")
    texts = lambda items: F.array_compact(F.transform(items, lambda x: F.when(json.kind(x) == "STRING", F.left(F.try_variant_get(x, "$", "string"), F.lit(ARGUMENT_CHARS)))))
    program = F.array_compact(F.array(F.left(json.string_at(v, "$.Program"), F.lit(ARGUMENT_CHARS))))
    arguments = F.slice(texts(F.coalesce(json.items_at(v, "$.ProgramArguments"), F.array().cast("array<variant>"))), 1, MOST_ARGUMENTS)
    interval = json.at(v, "$.StartCalendarInterval")
    rules = F.when(json.kind(interval) == "OBJECT", F.array(interval)).otherwise(F.filter(json.items_at(v, "$.StartCalendarInterval"), lambda x: json.kind(x) == "OBJECT"))
    label = _short(text.trimmed(json.string_at(v, "$.Label")), MOST_LABEL)
    read = parsed(files, "plist", whole=whole).where("value is not null").select("file", label.alias("label"), F.array_join(F.concat(program, arguments), " ").alias("command"), json.string_at(v, "$.WorkingDirectory").alias("workspace"), F.posexplode_outer(rules).alias("place", "_r"))
    part = lambda name, lo, hi: F.when(json.kind(json.at(F.col("_r"), f"$.{name}")) == "BIGINT", F.try_variant_get("_r", f"$.{name}", "long"))
    fields = [F.when(part(n, lo, hi).between(lo, hi), part(n, lo, hi)).cast("int").alias(n.lower()) for n, lo, hi in CALENDAR]
    return read.where("label is not null").select("file", "label", "command", "workspace", "place", *fields)


def automations(files: DataFrame, whole: bool = False) -> DataFrame:
    """(file, id, signature) of TOML files with an ``id`` of 1 to 128 bytes and a ``prompt``: its template's first characters."""
    v = F.col("value")
    rows = parsed(files, "toml", whole=whole).where("value is not null").select("file", _short(json.string_at(v, "$.id"), MOST_ID).alias("id"), F.left(text.template(json.string_at(v, "$.prompt")), F.lit(SIGNATURE_CHARS)).alias("signature"))
    return rows.where("id is not null and signature is not null")


def servers(values: DataFrame, by: list[str], block: str) -> DataFrame:
    """(by, name, kind, target, disabled) of configurations whose ``block`` has a table of servers.

    A server with a ``url`` is ``http``, one with a ``command`` is ``stdio``, others are left out; ``enabled = false`` and
    ``disabled = true`` both switch it off.
    """
    table = F.try_variant_get("value", f"$.{block}", "map<string,variant>")
    rows = values.select(*by, F.explode(table).alias("name", "s"))
    s = F.col("s")
    url, command = F.nullif(json.string_at(s, "$.url"), F.lit("")), F.nullif(json.string_at(s, "$.command"), F.lit(""))
    flag = lambda name: F.when(json.kind(json.at(s, f"$.{name}")) == "BOOLEAN", F.try_variant_get(s, f"$.{name}", "boolean"))
    off = ~F.coalesce(flag("enabled"), F.lit(True)) | F.coalesce(flag("disabled"), F.lit(False))
    return rows.select(*by, "name", F.when(url.isNotNull(), "http").when(command.isNotNull(), "stdio").alias("kind"), F.coalesce(url, command).alias("target"), off.alias("disabled")).where("kind is not null")
