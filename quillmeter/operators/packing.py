"""Greedy batches: rows in order fill a batch until its count or size would pass a bound."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_batches(rows: DataFrame, group: str, order: list[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Adds ``batch`` (from 0 in each group): a row that would pass ``most_rows`` or ``most_size`` starts the next one.

    A row over ``most_size`` has a batch of its own; a null size counts as 0. Groups are dealt by key, sorted and
    streamed: a task holds one Arrow batch and three numbers, whatever the size of a group. ``order`` must be total
    within a group. Rows with a null group form one group; an empty table gives an empty result.
    """
    names = [c for c in rows.columns if c != "batch"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, count, total = None, 0, 0, 0
        for part in parts:
            out = []
            keys = part["_group"].tolist()
            for key, n in zip(keys, part["_size"].tolist(), strict=True):
                if key != now:
                    now, batch, count, total = key, 0, 0, 0
                elif count >= most_rows or total + n > most_size:
                    batch, count, total = batch + 1, 0, 0
                count, total = count + 1, total + n
                out.append(batch)
            yield part[names].assign(batch=pd.array(out, "int64"))

    # the group's JSON text is never null and differs wherever groups differ
    keyed = rows.select(*names, F.to_json(F.struct(F.col(group).alias("g"))).alias("_group"), F.coalesce(F.col(size).cast("long"), F.lit(0)).cast("long").alias("_size"))
    dealt = keyed.repartition("_group").sortWithinPartitions("_group", *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema)
    return dealt.mapInPandas(run, f"{kinds}, batch long")


def day_batches(rows: DataFrame, group: str, day: str, n: str, first: Column, last: Column, most_rows: int = 1000, most_days: int = 200) -> DataFrame:
    """(group, batch, first_day, last_day, n, days): days in order fill a batch; no day is split and windows abut exactly.

    rows: one for each day of a group, with its number of rows. A day that would pass ``most_rows``, or ``most_days``
    from the batch's start, begins the next batch; the first one starts with ``first``, the last one ends with ``last``.
    A day over ``most_rows`` is an error. A group's days are folded in one task: their number is bounded by the window.
    """
    size = F.when(F.col(n) > most_rows, F.raise_error(F.concat(F.lit("more rows than a batch holds on "), F.col(day).cast("string")))).otherwise(F.col(n)).cast("long")
    days = F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), size.alias("n"))))
    new = lambda start, d: F.struct(start.alias("first_day"), d["n"].alias("n"), F.lit(1).cast("long").alias("days"))

    def add(done: Column, d: Column) -> Column:
        now = F.element_at(done, -1)
        full = (now["n"] + d["n"] > most_rows) | (F.date_diff(d["day"], now["first_day"]) + 1 > most_days)
        more = F.struct(now["first_day"].alias("first_day"), (now["n"] + d["n"]).alias("n"), (now["days"] + 1).alias("days"))
        return F.when(F.size(done) == 0, F.array(new(first, d))).when(full, F.concat(done, F.array(new(d["day"], d)))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(more)))

    none = F.array().cast("array<struct<first_day:date,n:bigint,days:bigint>>")
    folded = rows.groupBy(group).agg(days.alias("_d")).select(group, F.aggregate("_d", none, add).alias("_b"))
    each = folded.select(group, "_b", F.posexplode("_b").alias("batch", "b"))
    until = F.coalesce(F.date_sub(F.try_element_at("_b", F.col("batch") + 2)["first_day"], 1), last)
    return each.select(group, "batch", "b.first_day", until.alias("last_day"), "b.n", "b.days")
