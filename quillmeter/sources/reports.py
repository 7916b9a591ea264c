"""Parsers of small text files, as DataFrames of their lines: crontabs and context reports in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions import text

#: Crontab fields, smallest and largest.
CRON = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


def crontab(lines: DataFrame, file: str, number: str, line: str, most: int = 256) -> DataFrame:
    """(file, number, minute, hour, day, month, weekday, command): lines of single values and ``*`` alone, 256 of a file.

    A star is null. A line with a list, a range, a step or a value out of range goes whole; so do comments and settings.
    """
    fields = F.split(text.one_line(F.col(line)), " ")
    parts = [F.try_element_at(fields, F.lit(i + 1)) for i in range(5)]
    good = F.size(fields) >= 6
    for part, (_, lo, hi) in zip(parts, CRON, strict=True):
        number_ = F.when(part.rlike("^[0-9]{1,4}$"), part.try_cast("int"))
        good = good & ((part == "*") | F.coalesce(number_.between(lo, hi), F.lit(False)))
    rows = lines.where(good & ~F.ltrim(F.col(line)).startswith("#"))
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(number))).where(F.col("_n") <= most)
    values = [F.when(p != "*", p.try_cast("int")).alias(n) for p, (n, _, _) in zip(parts, CRON, strict=True)]
    return kept.select(file, number, *values, F.array_join(F.slice(fields, 6, 100_000), " ").alias("command"))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def context_tables(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """(file, number, section, name, tokens): rows of a context report's tables, by the ``###`` heading above them.

    Heads and rules of tables are left out: a row counts if its last cell but the percent is a number of tokens.
    """
    heading = F.when(F.col(line).startswith("### "), F.trim(F.substr(F.col(line), F.lit(5))))
    by = Window.partitionBy(file).orderBy(number)
    placed = lines.withColumn("section", F.last(heading, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    cells = _cells(F.col(line))
    counts = F.filter(F.transform(F.slice(cells, 2, 100), text.count_text), lambda n: n.isNotNull())
    rows = placed.where(F.ltrim(F.col(line)).startswith("|") & F.col("section").isNotNull()).select(file, number, "section", text.safe_text(F.replace(F.element_at(cells, 1), F.lit("**"), F.lit("")), 256).alias("name"), F.try_element_at(counts, F.lit(1)).alias("tokens"))
    return rows.where("tokens is not null and name is not null")


def context_headlines(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """(file, model, used, window, percent) of context reports: the last model line, and the last tokens line that can be read.

    A tokens line is ``**Tokens:** used / window (percent%)``, its counts as in tables. Without one the numbers are null.
    """
    said = F.trim(F.col(line))
    after = lambda mark: F.when(said.startswith(mark), F.replace(F.substr(said, F.lit(len(mark) + 1)), F.lit("**"), F.lit("")))
    model = F.nullif(text.trimmed(F.regexp_replace(after("**Model:**"), "[*`]", "")), F.lit(""))
    tokens = after("**Tokens:**")
    part = lambda i: F.regexp_extract(tokens, r"^([^/]*)/([^(]*)\((.*)$", i)
    used, window = text.count_text(part(1)), text.count_text(part(2))
    percent = F.regexp_extract(F.trim(F.regexp_replace(part(3), r"\)+$", "")), r"^[~<]*\s*([0-9]+(?:\.[0-9]+)?)\s*%$", 1).try_cast("double")
    whole = used.isNotNull() & window.isNotNull() & percent.isNotNull()
    read = lines.select(file, number, model.alias("model"), F.when(whole, F.struct(used.alias("used"), window.alias("window"), percent.alias("percent"))).alias("t"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(number, c)))[c]
    return read.groupBy(file).agg(last("model").alias("model"), last("t").alias("t")).select(file, "model", "t.used", "t.window", "t.percent")
