"""First, latest, previous and running values per key.

A key may hold a large part of all rows. First and latest rows are therefore
limited per key in every task before the shuffle, which rows cross in place of
a key's whole history.
Previous and running values work on one layout: the rows are range-partitioned
by key, time and tie, so that a key with many rows, even at one moment, lies in
several slices, and stored with the number of their slice. The values are found
inside a slice and carried over its border by one summary row per slice and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import stored


def _names(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """One row per key: the first under ``order`` and then all columns, so the choice is deterministic."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    ranking = [c.desc() if descending else c.asc() for c in _names([*order, *rest])]
    if not ranking:
        return df.distinct()
    return first_n_per_key(df, keys, ranking, 1, "__place").drop("__place")


def dedup_exact(df: DataFrame) -> DataFrame:
    return df.distinct()


def latest_by_rank(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows with the greatest ``order`` of their key (rank 1, ties kept; NULL order counts as oldest).

    The maximum is a partial aggregate; the rows then meet it in an equi join on
    key and value, whose skewed partitions adaptive execution can split.
    """
    best = df.groupBy(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)]).agg(
        F.max(F.col(f"`{order}`")).alias("__best")
    )
    same = F.col(f"`{order}`").eqNullSafe(F.col("__best"))
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}"))
    return df.join(best, same, "left_semi")


def first_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows per key; Spark limits each group before the shuffle, so a hot key stays small."""
    window = Window.partitionBy(*_names(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def with_slices(df: DataFrame, keys: Sequence[str], moment: str, tie: str, slices: int | None = None) -> DataFrame:
    """The rows with ``__slice``, the number of their range of (keys, moment, tie); stored, because it is read twice.

    Later rows of a key are never in an earlier slice. The number of slices
    follows the size of the data unless given. Rows without a moment come first.
    """
    order = [*_names(keys), F.col(f"`{moment}`"), F.col(f"`{tie}`")]
    ranged = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    return stored(ranged.withColumn("__slice", F.spark_partition_id().cast("long")))


def join_slices(rows: DataFrame, summaries: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Bring ``columns`` of the per-slice summaries to the rows of the slice."""
    renamed = summaries.select(
        *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slice").alias("__s"), *columns
    )
    same = F.col("__slice") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    return rows.join(renamed, same, "left")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    moment: str,
    tie: str,
    columns: Sequence[str],
    slices: int | None = None,
) -> DataFrame:
    """Add ``previous_<c>`` of the row before in (moment, tie) order within the key.

    Inside a slice this is a window; the first row of a slice takes the last
    row of the nearest earlier slice of its key, found among the per-slice
    summaries.
    """
    sliced = with_slices(df, keys, moment, tie, slices)
    parts = [*_names(keys), F.col("__slice")]
    inside = Window.partitionBy(*parts).orderBy(F.col(f"`{moment}`"), F.col(f"`{tie}`"))
    values = F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
    local = sliced.withColumn("__before", F.lag(values).over(inside))
    last = sliced.groupBy(*parts).agg(
        F.max(F.struct(F.col(f"`{moment}`").alias("m"), F.col(f"`{tie}`").alias("t"), values.alias("v"))).alias("__last")
    )
    over = Window.partitionBy(*_names(keys)).orderBy("__slice")
    carried = last.withColumn("__carry", F.lag("__last.v").over(over))
    joined = join_slices(local, carried, keys, ["__carry"])
    before = F.coalesce(F.col("__before"), F.col("__carry"))
    return joined.select(*_names(df.columns), *[before[f"v{i}"].alias(f"previous_{c}") for i, c in enumerate(columns)])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    moment: str,
    tie: str,
    amount: str,
    result: str,
    slices: int | None = None,
) -> DataFrame:
    """Add the sum of ``amount`` up to and including the row in (moment, tie) order within the key."""
    sliced = with_slices(df, keys, moment, tie, slices)
    parts = [*_names(keys), F.col("__slice")]
    inside = (
        Window.partitionBy(*parts)
        .orderBy(F.col(f"`{moment}`"), F.col(f"`{tie}`"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.withColumn("__local", F.sum(F.col(f"`{amount}`")).over(inside))
    totals = sliced.groupBy(*parts).agg(F.sum(F.col(f"`{amount}`")).alias("__total"))
    earlier = Window.partitionBy(*_names(keys)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("__carry", F.sum("__total").over(earlier))
    joined = join_slices(local, carried, keys, ["__carry"])
    return joined.select(
        *_names(df.columns), (F.coalesce(F.col("__local"), F.lit(0)) + F.coalesce(F.col("__carry"), F.lit(0))).alias(result)
    )


def gap_seconds(df: DataFrame, keys: Sequence[str], moment: str, tie: str, slices: int | None = None) -> DataFrame:
    """Add ``gap_seconds`` since the previous event of the key; NULL for the first."""
    before = with_previous(df, keys, moment, tie, [moment], slices)
    gap = F.unix_micros(F.col(f"`{moment}`").cast("timestamp")) - F.unix_micros(
        F.col(f"previous_{moment}").cast("timestamp")
    )
    return before.withColumn("gap_seconds", gap / F.lit(1_000_000.0)).drop(f"previous_{moment}")
