"""Small reshaping helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Digits after the point that decimal sums of floating-point values have; a value that needs more stops the query.
SCALE = 9


def summable(column: Column, kind: T.DataType | None = None, scale: int = SCALE) -> Column:
    """A value as a decimal whose sums do not depend on the order of the rows.

    Whole numbers and decimals keep all their digits. Anything else is taken as
    floating point; a value that ``scale`` digits do not hold exactly stops the
    query, so no digit is lost before a sum.
    """
    if isinstance(kind, T.DecimalType):
        return column
    if isinstance(kind, T.IntegralType):
        return column.cast("decimal(20,0)")
    wide = column.try_cast(f"decimal(38,{scale})")
    lost = F.raise_error(F.concat(F.lit(f"no decimal of {scale} digits after the point holds "), column.cast("string")))
    held = wide.isNotNull() & (wide.cast("double") == column.cast("double"))
    return F.when(column.isNotNull() & ~held, lost.cast(f"decimal(38,{scale})")).otherwise(wide)


def exact_parts(column: Column) -> tuple[Column, Column]:
    """A floating-point value as two decimals: nine digits after the point, and what they leave to the 30th digit.

    What a double of the first part leaves of the value is exact. A value
    beyond 29 digits before the point stops the query.
    """
    value = column.cast("double")
    high = value.try_cast(f"decimal(38,{SCALE})")
    lost = F.raise_error(F.concat(F.lit("too large to be summed exactly: "), column.cast("string")))
    whole = F.when(value.isNotNull() & high.isNull(), lost.cast(f"decimal(38,{SCALE})")).otherwise(high)
    return whole, (value - high.cast("double")).try_cast("decimal(38,30)")


def exact_sum(column: Column) -> Column:
    """The sum of floating-point values as a double that does not depend on the order of the rows."""
    high, low = exact_parts(column)
    return F.sum(high).cast("double") + F.sum(low).cast("double")


def row_digests(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two independent 64-bit digests of a row that tell NULL from every value and every place."""
    parts = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))] or [F.lit(0)]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *reversed(parts))


def rows_from(df: DataFrame, rows: Sequence[Mapping[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Turn each row of ``df`` into one row per mapping; all mappings have the same names."""
    packed = F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])
    return df.select(*keep, F.explode(packed).alias("__row")).select(*keep, "__row.*")


def tagged_union(left: DataFrame, right: DataFrame, columns: Sequence[str], flag: str = "__left") -> DataFrame:
    """Rows of both sides with a boolean that tells the left ones."""
    named = [F.col(f"`{c}`") for c in columns]
    return left.select(*named, F.lit(True).alias(flag)).union(
        right.select(*named, F.lit(False).alias(flag))
    )


def explode_present(df: DataFrame, keep: Sequence[str], items: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One row per (condition, struct) pair whose condition holds.

    Rows without any are dropped before a struct is built, and nothing here
    leaves generated code, unlike a filter over an array.
    """
    some = F.lit(False)
    for condition, _ in items:
        some = some | F.coalesce(condition, F.lit(False))
    kept = [F.col(f"`{c}`") for c in keep]
    built = F.array(*[F.when(condition, item) for condition, item in items])
    listed = df.where(some).select(*kept, F.explode(built).alias("__item"))
    return listed.where(F.col("__item").isNotNull()).select(*kept, "__item.*")
