"""Joins that no single key can burden."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds over 1/FEW of all rows is looked up by broadcast; there are fewer than FEW such keys.
FEW = 4096
#: Rows up to which a counted table is broadcast.
SMALL = 100_000


def lookup(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """left joined with right, whose keys are unique and whose `weight` says how many left rows have each, of `total`.

    Keys with more than total / FEW rows are fewer than FEW, and go to all tasks; so no task gets more of a key than that.
    """
    heavy = F.col(weight) * F.lit(FEW) > F.lit(total)
    few, rest = F.broadcast(right.filter(heavy).drop(weight)), right.filter(~heavy).drop(weight)
    return left.join(few, on).unionByName(left.join(F.broadcast(right.filter(heavy).select(*on)), on, "left_anti").join(rest, on))


def small(df: DataFrame) -> DataFrame:
    """A table to be broadcast, if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= SMALL else df
