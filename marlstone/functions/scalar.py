"""Scalar expressions whose meaning differs from Spark's own operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def kind(df: DataFrame, c: Column) -> T.DataType:
    """Type of an expression over ``df``: analysis only, nothing runs."""
    return df.select(c).schema[0].dataType


def divide(df: DataFrame, a: Column, b: Column) -> Column:
    """``a / b``; of two integers the quotient is cut towards zero."""
    if isinstance(kind(df, a), INTEGRAL) and isinstance(kind(df, b), INTEGRAL):
        return F.call_function("div", a, b)
    return a / b


def widen(df: DataFrame, c: Column) -> Column:
    """An operand that can't overflow 32 bits: integers become BIGINT, floats DOUBLE."""
    found = kind(df, c)
    if isinstance(found, INTEGRAL):
        return c.cast("bigint")
    return c.cast("double") if isinstance(found, T.FloatType) else c


def cast(c: Column, to: str) -> Column:
    """CAST; to an integer it rounds half away from zero instead of cutting."""
    return (F.round(c) if to.lower() in ("int", "integer", "bigint") else c).cast(to)


def same(a: Column, b: Column) -> Column:
    """``a IS b``: equality that is never NULL."""
    return a.eqNullSafe(b)


def truth(df: DataFrame, c: Column) -> Column:
    """A condition from any value: numbers are true unless they are 0."""
    return c if isinstance(kind(df, c), T.BooleanType) else c != 0


def in_list(c: Column, values: list) -> Column:
    """``IN``; the empty list holds nothing, not even for NULL."""
    return c.isin(*values) if values else F.lit(False)


def case_simple(value: Column, branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """``CASE value WHEN …``; a NULL value meets no branch."""
    (when, then), *rest = branches
    chain = F.when(value == when, then)
    for when, then in rest:
        chain = chain.when(value == when, then)
    return chain.otherwise(otherwise) if otherwise is not None else chain
