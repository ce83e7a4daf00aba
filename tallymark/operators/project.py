"""Projections, casts, filters and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.shape import rows_from
from tallymark.operators.windows import running_sum

# Column names that may hold the business date, in order of preference.
BUSINESS_DATE_COLUMNS = ("business_date", "businessdate", "dt", "logdate")


def cast_dataframe(df: DataFrame, schema: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Exactly the listed columns with the listed types, in one projection.

    ``strict`` fails on text that does not fit; otherwise such values become NULL.
    """
    return df.select(
        *[
            (F.col(f"`{c}`").cast(t) if strict else F.col(f"`{c}`").try_cast(t)).alias(c)
            for c, t in schema.items()
        ]
    )


def cast_columns(df: DataFrame, schema: Mapping[str, str], keep_others: bool = True, strict: bool = True) -> DataFrame:
    if not keep_others:
        return cast_dataframe(df, schema, strict)
    return df.withColumns(
        {c: F.col(f"`{c}`").cast(t) if strict else F.col(f"`{c}`").try_cast(t) for c, t in schema.items()}
    )


def validate_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Missing (``FAIL``) and extra (``WARN``) columns as rows, with the number of values that an extra column holds."""
    rows = [(c, "missing", "FAIL") for c in expected if c not in df.columns]
    rows += [(c, "extra", "WARN") for c in df.columns if c not in set(expected)]
    return _column_rows(df, ("column_name", "finding", "status"), rows)


def _column_rows(df: DataFrame, names: Sequence[str], rows: Sequence[tuple[str, ...]]) -> DataFrame:
    """Rows about columns, the first entry of each, with ``filled``: how many rows hold a value, NULL without such a column. One pass."""
    if not rows:
        return df.sparkSession.createDataFrame([], ", ".join(f"{n} string" for n in names) + ", filled long")
    here = [r[0] for r in rows if r[0] in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(here)])
    filled = {c: F.col(f"__{i}") for i, c in enumerate(here)}
    return rows_from(
        counted,
        [{**{n: F.lit(x) for n, x in zip(names, r)}, "filled": filled.get(r[0], F.lit(None).cast("long"))} for r in rows],
    )


def flag_filter(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(f"`{column}`") == F.lit(value))


def not_in_or_null(column: Column, codes: Sequence[str], when_null: bool = False) -> Column:
    """``NOT IN`` with an explicit answer for NULL."""
    return F.coalesce(~column.isin(*codes), F.lit(when_null))


def filter_business_date(df: DataFrame, day: date, candidates: Sequence[str] = BUSINESS_DATE_COLUMNS) -> DataFrame:
    """Rows of one business day by the first candidate column present (any case).

    Dates and timestamps are compared in their own type, so the filter reaches
    the scan and prunes partitions; text is parsed.
    """
    present = {c.lower(): c for c in df.columns}
    for candidate in candidates:
        name = present.get(candidate.lower())
        if name is None:
            continue
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        start = F.lit(day)
        if isinstance(kind, T.DateType):
            return df.where(column == start)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return df.where((column >= start.cast(kind)) & (column < F.date_add(start, 1).cast(kind)))
        return df.where(column.try_cast("date") == start)
    return df


def copy_stage(df: DataFrame, outputs: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One input as several named outputs with their own column lists."""
    return {name: df.select(*[F.col(f"`{c}`") for c in columns]) for name, columns in outputs.items()}


def split_reject(df: DataFrame, accept: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; a NULL condition rejects, so every row lands in exactly one output."""
    kept = F.coalesce(accept, F.lit(False))
    return df.where(kept), df.where(~kept)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """By position, duplicates kept."""
    combined = frames[0]
    for df in frames[1:]:
        combined = combined.union(df)
    return combined


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """By name; columns that a frame lacks become NULL."""
    combined = frames[0]
    for df in frames[1:]:
        combined = combined.unionByName(df, allowMissingColumns=True)
    return combined


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(f"`{column}`")).distinct()


def name_difference(left: Sequence[str], right: Sequence[str]) -> tuple[list[str], list[str]]:
    """Names only on the left and names only on the right, sorted."""
    return sorted(set(left) - set(right)), sorted(set(right) - set(left))


def one_sided_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns that only one side has, as rows of ``column_name, side, filled``: how many of its rows hold a value."""
    only_left, only_right = name_difference(left.columns, right.columns)
    names = ("column_name", "side")
    return _column_rows(left, names, [(c, "only_left") for c in only_left]).union(
        _column_rows(right, names, [(c, "only_right") for c in only_right])
    )


def unpivot_pairs(df: DataFrame, ids: Sequence[str], pairs: Sequence[Sequence[str]], names: Sequence[str], drop_empty: bool = False) -> DataFrame:
    """Groups of columns to rows, one row per group; rows without any value are kept unless dropped."""
    groups = F.array(
        *[F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(pair, names)]) for pair in pairs]
    )
    long = df.select(*[F.col(f"`{c}`") for c in ids], F.explode(groups).alias("__p")).select(*ids, "__p.*")
    return long.dropna(how="all", subset=list(names)) if drop_empty else long


# --- searches --------------------------------------------------------------


def search(
    df: DataFrame,
    text: str | None = None,
    in_columns: Sequence[str] = (),
    any_of: Mapping[str, Sequence] | None = None,
    at_least: Mapping[str, object] | None = None,
    flags: Mapping[str, bool] | None = None,
) -> DataFrame:
    """Optional criteria joined by AND: text contained (any case) in one of the columns,
    allowed values, lower bounds and boolean columns."""
    condition = F.lit(True)
    if text:
        hit = F.lit(False)
        for c in in_columns:
            hit = hit | F.lower(F.col(f"`{c}`").cast("string")).contains(text.lower())
        condition = condition & hit
    for c, values in (any_of or {}).items():
        if values:
            condition = condition & F.col(f"`{c}`").isin(*values)
    for c, bound in (at_least or {}).items():
        if bound is not None:
            condition = condition & (F.col(f"`{c}`") >= F.lit(bound))
    for c, wanted in (flags or {}).items():
        condition = condition & (F.col(f"`{c}`") == F.lit(wanted))
    return df.where(condition)


# --- sort, limit, pages ----------------------------------------------------


def top_k_by_count(df: DataFrame, by: Sequence[str], k: int = 10) -> DataFrame:
    """Most frequent groups; ties go to the smaller group key."""
    columns = [F.col(f"`{c}`") for c in by]
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), *[c.asc_nulls_first() for c in columns])
        .limit(k)
    )


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) under a total order. Deep pages rescan; use ``page_after`` for those."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next ``size`` rows after key ``last``: the filter reaches the scan, so depth costs nothing."""
    rows = df if last is None else df.where(F.col(f"`{key}`") > F.lit(last))
    return rows.orderBy(F.col(f"`{key}`")).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(float(size))).cast("long").alias("pages")
    )


def recent(df: DataFrame, moment: str, key: str, n: int, status: tuple[str, str] | None = None) -> DataFrame:
    """Newest rows first, optionally of one status."""
    rows = df if status is None else flag_filter(df, *status)
    return rows.orderBy(F.desc(moment), F.asc(key)).limit(n)


def priority_order(df: DataFrame, priority: str, moment: str, key: str, place: str | None = None) -> DataFrame:
    """Most urgent first, oldest first within a priority; ``place`` names a column for the place in the queue, from 1.

    The places come from ranges of the order and one count per range, so no
    task sees the whole queue.
    """
    if place is None:
        return df.orderBy(F.asc(priority), F.asc(moment), F.asc(key))
    ranked = df.withColumn("__then", F.struct(F.col(moment), F.col(key))).withColumn("__one", F.lit(1).cast("long"))
    return running_sum(ranked, [], priority, "__then", "__one", place).drop("__then", "__one")
