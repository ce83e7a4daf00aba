"""Joins of the ETL jobs.

No join carries a broadcast hint: Spark broadcasts a side when its estimated
or measured size is below ``spark.sql.autoBroadcastJoinThreshold``, and
adaptive execution splits skewed partitions of the others. Dates that come
from a one-row dimension are scalar subqueries, so no row pairs are formed at
all and the comparison reaches the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.windows import first_per_key


def dimension_value(dim: DataFrame, day_column: str, day: date, value: str) -> Column:
    """Value of the dimension row of ``day`` as a scalar; NULL when there is no such row."""
    return dim.where(F.col(f"`{day_column}`") == F.lit(day)).agg(F.max(F.col(f"`{value}`"))).scalar()


def filter_from(df: DataFrame, moment: Column, first: Column, last: Column | None = None) -> DataFrame:
    """Rows at or after ``first`` and, when given, at or before ``last``."""
    return df.where(moment >= first) if last is None else df.where(moment.between(first, last))


def left_chain(base: DataFrame, steps: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left outer joins one after the other, each on same-named key columns."""
    joined = base
    for other, keys in steps:
        joined = joined.join(other, list(keys), "left")
    return joined


def dimension(dim: DataFrame, key: str, take: Sequence[str]) -> DataFrame:
    """The key and the taken columns, one row per key: the first in column order."""
    return first_per_key(dim.select(key, *[c for c in take if c != key]), [key], []).withColumnRenamed(key, "__key")


def look_up_in(df: DataFrame, prepared: DataFrame, left_key: str | Column, take: Mapping[str, str]) -> DataFrame:
    """Add renamed columns of a prepared ``dimension``; it may serve several lookups."""
    key = F.col(f"`{left_key}`") if isinstance(left_key, str) else left_key
    renamed = prepared.select("__key", *[F.col(f"`{c}`").alias(out) for c, out in take.items()])
    return df.join(renamed, key == F.col("__key"), "left").drop("__key")


def lookup(
    df: DataFrame,
    dim: DataFrame,
    left_key: str | Column,
    dim_key: str,
    take: Mapping[str, str],
) -> DataFrame:
    """Add renamed dimension columns by key; never changes the number of rows.

    A dimension key that occurs twice gives its first row in column order.
    """
    prepared = dimension(dim, dim_key, list(take))
    if dim_key in take:
        prepared = prepared.withColumn(dim_key, F.col("__key"))
    return look_up_in(df, prepared, left_key, take)


def join_on_expression(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str = "inner") -> DataFrame:
    """Equality of two computed keys, for example a concatenation or a substring; still an equi join."""
    r = right.withColumn("__rk", right_key)
    l = left.withColumn("__lk", left_key)
    return l.join(r, F.col("__lk") == F.col("__rk"), how).drop("__lk", "__rk")


def chain(base: DataFrame, *links: tuple[DataFrame, str, str]) -> DataFrame:
    """Inner joins along parent keys: each link is (parent, child column, parent column)."""
    joined = base
    for parent, child_key, parent_key in links:
        joined = joined.join(parent, F.col(f"`{child_key}`") == parent[f"`{parent_key}`"])
    return joined
