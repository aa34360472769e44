"""INSERT, DELETE and UPDATE as rewrites: new table state out of the old one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


class MultipleMatches(Exception):
    """An UPDATE … FROM found several source rows for one target row."""


def insert(target: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Append ``rows``; columns not named become NULL."""
    given = list(columns or target.columns)
    if len(given) != len(rows.columns):
        raise ValueError("as many values as columns are needed")
    at = dict(zip(given, rows.columns, strict=True))
    fields = [(F.col(f"`{at[f.name]}`") if f.name in at else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    return target.unionByName(rows.select(*fields))


def delete(target: DataFrame, where: Column) -> DataFrame:
    """Keep the rows for which ``where`` is false or NULL."""
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, on: Column) -> DataFrame:
    """Keep the rows without a partner; an anti join removes each target row once."""
    return target.join(source, on, "left_anti")


def update(target: DataFrame, set_: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    kinds = {f.name: f.dataType for f in target.schema.fields}
    return target.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(f"`{c}`")) for c, v in set_.items()})


def update_from(target: DataFrame, source: DataFrame, key: str, source_key: str, set_: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """Update by an equi-join; raises when the job meets a source key that repeats.

    The check is part of the plan, so nothing is read twice.
    """
    rows = source if where is None else source.where(where)
    values = [v.alias(f"__new_{c}") for c, v in set_.items()]
    keyed = rows.select(F.col(f"`{source_key}`").alias("__key"), *values).groupBy("__key").agg(*(F.first(f"__new_{c}").alias(f"__new_{c}") for c in set_), F.count(F.lit(1)).alias("__n"))
    joined = target.join(keyed, F.col(f"`{key}`") == F.col("__key"), "left")
    # A filter, so that the check stays whatever columns are asked for.
    joined = joined.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("a target row matches several source rows")).cast("boolean")).otherwise(F.lit(True)))
    once = F.col("__n").isNotNull()
    kinds = {f.name: f.dataType for f in target.schema.fields}
    return joined.select(*(F.when(once, F.col(f"__new_{c}").cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in set_ else F.col(f"`{c}`") for c in target.columns))
