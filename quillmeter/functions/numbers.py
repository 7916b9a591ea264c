"""Numbers: sums that keep "not reported", totals that stop at the largest value, money, states and phases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 2**63 - 1


def saturating_total(*columns: Column) -> Column:
    """Sum of counters, nulls as 0; the largest long where it would overflow."""
    return reduce(lambda a, b: F.coalesce(F.try_add(a, b), F.lit(LARGEST)), [F.coalesce(c.cast("long"), F.lit(0).cast("long")) for c in columns])


def reported_sum(column: Column, cap: float) -> Column:
    """Aggregate: the sum, at most ``cap``; null if no row reports a value."""
    return F.when(F.count(column) > 0, F.least(F.sum(column), F.lit(cap)))


def quota_state(percent: Column) -> Column:
    return F.when(percent >= 100, "exhausted").when(percent >= 80, "near").when(percent.isNotNull(), "ok")


def micro_dollars(text: Column) -> Column:
    """Millionths of a dollar from decimal text, half up at the seventh digit alone; null for signs, exponents and overflow."""
    plain = F.trim(text)
    whole = F.regexp_extract(plain, r"^([0-9]+)(\.[0-9]*)?$", 1)
    digits = F.rpad(F.regexp_extract(plain, r"^[0-9]+\.([0-9]*)$", 1), 7, "0")
    micros = F.try_add(F.try_multiply(whole.try_cast("long"), F.lit(1_000_000).cast("long")), F.left(digits, F.lit(6)).cast("long"))
    return F.when((whole != "") & (F.octet_length(plain) <= 64), F.try_add(micros, F.when(F.substr(digits, F.lit(7), F.lit(1)) >= "5", 1).otherwise(0).cast("long")))


def first_counter(json: Column, keys: Sequence[str], most: int) -> Column:
    """The counter under the first of ``keys`` that an object has at all: null there if it is no number from 0 to ``most``.

    json: an object as VARIANT. A later key never stands in for an earlier one that can't be read. Fractions are cut off.
    """
    fields = F.try_variant_get(json, "$", "map<string,variant>")
    found = F.lit(None).cast("variant")
    for key in reversed(keys):
        found = F.when(F.map_contains_key(fields, F.lit(key)), F.try_element_at(fields, F.lit(key))).otherwise(found)
    kind = F.schema_of_variant(found)
    value = F.floor(F.try_variant_get(found, "$", "double"))
    exact = F.try_variant_get(found, "$", "long")
    number = F.when(kind.startswith("BIGINT"), exact).when(kind.startswith("DECIMAL") | kind.startswith("DOUBLE"), value.try_cast("long"))
    return F.when((number >= 0) & (number <= most), number)


def percent(value: Column) -> Column:
    """0 to 100, rounded half up to a whole number."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value.cast("double"))) + 0.5).cast("int")


def first_positive(*columns: Column) -> Column:
    """The first value above zero: a zero means that a source doesn't know."""
    return F.coalesce(*[F.when(c > 0, c) for c in columns])


def phase(key: Column, span: int, domain: str = "") -> Column:
    """A steady place of a key in 0 .. span - 1: the first eight digest bytes of domain and key, as a number, modulo span."""
    return (F.conv(F.left(F.sha2(F.concat(F.lit(domain), key), 256), F.lit(16)), 16, 10).cast("decimal(20,0)") % span).cast("long")


def token_cost(input_: Column, cached: Column, written: Column, output: Column) -> Column:
    """Dollars, exact: $5 a million fresh input tokens (input less cache reads), $0.50 cached, $6.25 written, $30 output."""
    units = (input_ - cached) * 500 + cached * 50 + written * 625 + output * 3000
    return units.cast("decimal(28,0)") * F.lit("0.00000001").cast("decimal(9,8)")
