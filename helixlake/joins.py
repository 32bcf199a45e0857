"""Joins of tables that grow with the input, and steps that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A sort-merge join, whatever size the planner expects of a side.

    Rows that are derived (a sequence of a key, guides of a sequence) are far
    larger than the planner's estimate of them from the file, by which it would
    gather a whole table in the driver and send it to all executors.
    """
    return left.join(right.hint("merge"), on, how)


def held(rows: DataFrame) -> DataFrame:
    """The same rows, computed here: later expressions and filters refer to values and don't repeat what made them."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("x")).select("x.*")
