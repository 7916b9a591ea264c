"""The reports that clients ask for: costs by bucket, pages of sessions, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def costs(rows: DataFrame, time: str, cost: str, first: str, until: str, bucket: str, zone: str) -> DataFrame:
    """(bucket, orders, cost): exact sums by hour, day, week or month of local time, from ``first`` to before ``until``."""
    t = F.col(time)
    inside = rows.where((t >= F.lit(first).cast("timestamp_ntz")) & (t < F.lit(until).cast("timestamp_ntz")))
    local = F.date_trunc(bucket, F.from_utc_timestamp(t, zone))
    return inside.groupBy(F.to_date(local).alias("bucket")).agg(F.count("*").alias("orders"), F.sum(F.col(cost).cast("decimal(18,2)")).cast("decimal(28,2)").alias("cost"))


def sessions(
    rows: DataFrame, id_: str, where: dict[str, list], sort: str, least: float | None = None, most: float | None = None, search: tuple[str, str] | None = None, descending: bool = True, after: tuple | None = None, limit: int = 50
) -> DataFrame:
    """A page of sessions: values allowed by column, a range of the sort column, a text to find, and the page after a cursor.

    after: sort value and id of the last row of the page before. Ids break ties in the direction of the sort.
    """
    found = rows
    for column, values in where.items():
        found = found.where(F.col(column).isin(*values))
    if least is not None:
        found = found.where(F.col(sort) >= least)
    if most is not None:
        found = found.where(F.col(sort) <= most)
    if search:
        found = found.where(F.lower(search[0]).contains(search[1].lower()))
    if after:
        beyond = (lambda c, v: F.col(c) < v) if descending else (lambda c, v: F.col(c) > v)
        found = found.where(beyond(sort, after[0]) | ((F.col(sort) == after[0]) & beyond(id_, after[1])))
    way = F.desc if descending else F.asc
    return found.orderBy(way(sort), way(id_)).limit(limit)


def recommended(rows: DataFrame, id_: str, rules: list[tuple[str, Column]], limit: int) -> DataFrame:
    """(id, rule, rank): what each row should look at, in the order of the rules."""
    held = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("rule"), F.lit(i).alias("rank"))) for i, (name, c) in enumerate(rules, 1)]))
    return rows.select(id_, F.inline(held)).orderBy("rank", id_).limit(limit)
