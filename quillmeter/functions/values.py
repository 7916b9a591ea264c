"""Values that are computed once for a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row: inside a lambda a plain column would be computed at each step."""
    return F.element_at(F.transform(F.array(value), use), 1)
