"""Relational operators as DataFrame functions.

Each declares a plan and leaves the physical strategy to Catalyst; none runs a
job, collects rows or fixes a number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

JOINS = ("inner", "left", "right", "full")


def one_row(spark) -> DataFrame:
    """The input of a SELECT without FROM."""
    return spark.range(1).select()


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join on any condition; equalities become hash or sort-merge joins."""
    if how not in JOINS:
        raise ValueError(f"how must be one of {JOINS}")
    return left.join(right, on, how)


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows, only where a query asks for exactly that."""
    return left.crossJoin(right)


def aggregate(df: DataFrame, keys: Sequence[str | Column], **aggregates: Column) -> DataFrame:
    """Grouped, or with no keys global (one row even for no input)."""
    columns = [c.alias(n) for n, c in aggregates.items()]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def order_by(df: DataFrame, *ordinals: int) -> DataFrame:
    """Sort by output columns counted from 1, ascending, NULLs first."""
    if not all(1 <= k <= len(df.columns) for k in ordinals):
        raise ValueError("an ordinal is outside the select list")
    return df.orderBy(*(F.col(f"`{df.columns[k - 1]}`").asc_nulls_first() for k in ordinals))


def _same_row(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    names = [f"c{k}" for k in range(len(left.columns))]
    a, b = left.alias("l"), right.toDF(*names).alias("r")
    return a, b, reduce(lambda x, y: x & y, (F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.{n}")) for c, n in zip(left.columns, names, strict=True)))


def except_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """EXCEPT ALL by membership: every left row that the right side lacks, repeats included."""
    a, b, same = _same_row(left, right)
    return a.join(b, same, "left_anti")


def intersect_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """INTERSECT ALL by membership: every left row that the right side has, repeats included."""
    a, b, same = _same_row(left, right)
    return a.join(b, same, "left_semi")


def not_in(df: DataFrame, column: str, other: DataFrame) -> DataFrame:
    """``column NOT IN (SELECT …)``: nothing if the other side holds a NULL.

    An anti join on equality, which Spark may shuffle or split, and two counts
    of the other side that settle NULLs: Spark's own null-aware anti join
    always broadcasts the sub-query, whatever its size.
    """
    name, value = other.columns[0], F.col(f"`{column}`")
    counts = other.agg(F.struct(F.count(F.lit(1)).alias("all"), F.count(f"`{name}`").alias("known")).alias("c")).scalar()
    open_ = (counts["all"] == 0) | ((counts["all"] == counts["known"]) & value.isNotNull())
    a, b = df.where(open_).alias("l"), other.where(F.col(f"`{name}`").isNotNull()).alias("r")
    return a.join(b, F.col(f"l.`{column}`") == F.col(f"r.`{name}`"), "left_anti")
