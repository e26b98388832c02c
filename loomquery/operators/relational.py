"""Relational operators on DataFrames, for use without SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in ``order``, or any one without an order (no sort then)."""
    if not order:
        return df.dropDuplicates(keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def unnest(df: DataFrame, column: str, name: str, keep: Column | None = None, distinct: bool = False) -> DataFrame:
    """A row for each element; null and empty arrays give none. ``keep`` sees the element as ``name``.

    Equal elements of one array can be dropped before they become rows.
    """
    a = F.array_distinct(column) if distinct else F.col(column)
    out = df.select("*", F.explode(a).alias(name))
    return out.filter(keep) if keep is not None else out


def semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left with a match; the right keys are reduced before they move."""
    return left.join(right.select(*on).distinct(), on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 32, how: str = "inner") -> DataFrame:
    """A join whose hot left keys are dealt over ``salts`` tasks; each right row is sent to all of them.

    For left sides where one key holds a large share and the right side is
    small next to it; AQE splits skewed partitions of other joins by itself.
    """
    if how not in ("inner", "left"):
        raise ValueError("a salted join is inner or left")
    x = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", x).join(spread, [*on, "_salt"], how).drop("_salt")


def two_step(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], salts: int = 32) -> DataFrame:
    """sum, count, min and max by key, for inputs whose rows of one key don't fit one task even as partial sums."""
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    once = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    first = df.withColumn("_salt", (F.rand(1) * salts).cast("int")).groupBy(*keys, "_salt").agg(*(once[f](c).alias(n) for n, (f, c) in aggregates.items()))
    return first.groupBy(*keys).agg(*(again[f](n).alias(n) for n, (f, _) in aggregates.items()))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Plans as TakeOrderedAndProject: k rows a task, then k in all."""
    return df.orderBy(*order).limit(k)


def product(column: str) -> Column:
    """The exact product, which Spark's SQL has no name for."""
    return F.product(column)
