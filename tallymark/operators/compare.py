"""Reconciliation of two datasets: ``golden`` (left) against ``output`` (right).

All comparisons are one union of the two sides followed by one aggregation.
Map-side partial aggregation shrinks repeated keys before the shuffle, grouping
treats NULL keys as equal, and a hot key never meets its copies from the other
side row by row. Comparison by key aggregates digests of fixed width and looks
at whole rows only where those differ.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.scalars import same_value
from tallymark.operators.shape import SCALE, explode_present, row_digests, rows_from, summable, tagged_union
from tallymark.session import stored
from tallymark.sources.readers import read_dataset
from tallymark.specs import CompareSpec

MATCH = "MATCH"
MISSING = "MISSING_IN_OUTPUT"
EXTRA = "EXTRA_IN_OUTPUT"
CHANGED = "VALUE_MISMATCH"
TYPE_ERROR = "TYPE_ERROR"
DUPLICATE_GOLDEN = "DUPLICATE_KEY_GOLDEN"
DUPLICATE_OUTPUT = "DUPLICATE_KEY_OUTPUT"

def align_columns(left: DataFrame, right: DataFrame, ignore: Sequence[str] = ()) -> tuple[list[str], list[str], list[str]]:
    """Common, only-left and only-right column names after dropping the ignored ones."""
    lcols = [c for c in left.columns if c not in set(ignore)]
    rcols = [c for c in right.columns if c not in set(ignore)]
    return (
        [c for c in lcols if c in set(rcols)],
        [c for c in lcols if c not in set(rcols)],
        [c for c in rcols if c not in set(lcols)],
    )


def require_keys(keys: Sequence[str], left: DataFrame, right: DataFrame) -> None:
    for side, df in (("golden", left), ("output", right)):
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise ValueError(f"key columns missing in {side}: {missing}")


def conform(df: DataFrame, schema: T.StructType, columns: Sequence[str]) -> DataFrame:
    """Cast ``columns`` to the types of ``schema``.

    If any type differs, ``__failed`` tells the rows with a value that did not fit.
    """
    types = {f.name: f.dataType for f in schema.fields}
    drift = [c for c in columns if df.schema[c].dataType != types[c]]
    if not drift:
        return df
    failed = F.lit(False)
    for c in drift:
        failed = failed | (F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(types[c]).isNull())
    return df.withColumn("__failed", failed).withColumns({c: F.col(f"`{c}`").try_cast(types[c]) for c in drift})


def pair_by_key(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """One row per key: ``status``, both packed rows, the counts per side and a flag per differing column.

    A first pass shuffles keys and row digests only, which hash aggregation
    combines before the shuffle. Whole rows are fetched for the keys of both
    sides whose digests differ; other keys carry no rows. With duplicate keys
    the smallest row under the ordering of all value columns represents its
    side; the counts keep the duplicates visible.
    """
    require_keys(spec.keys, left, right)
    common, _, _ = align_columns(left, right, spec.ignore)
    keys = list(spec.keys)
    values = [c for c in common if c not in keys]
    types = {f.name: f.dataType for f in right.schema.fields}

    golden = conform(left, right.schema, keys + values)
    drift = "__failed" in golden.columns
    output = right.withColumn("__failed", F.lit(False)) if drift else right
    carried = [*values, "__failed"] if drift else values
    named = [F.col(f"`{k}`") for k in keys]
    side = F.col("__left")
    one, two = row_digests(carried)
    narrow = golden.select(*named, one.alias("__1"), two.alias("__2"), F.lit(True).alias("__left")).union(
        output.select(*named, one, two, F.lit(False))
    )
    counted = stored(
        narrow.groupBy(*named).agg(
            F.count_if(side).alias("golden_rows"),
            F.count_if(~side).alias("output_rows"),
            ((F.min("__1") == F.max("__1")) & (F.min("__2") == F.max("__2"))).alias("__alike"),
        )
    )
    both_there = (F.col("golden_rows") > 0) & (F.col("output_rows") > 0)
    unlike = both_there & ~F.col("__alike")
    packed = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("__none"))
    row_type = golden.select(packed.alias("r")).schema["r"].dataType

    def flags(changed: Sequence[Column]) -> Column:
        if not values:
            return F.struct(F.lit(False).alias("__none"))
        return F.struct(*[flag.alias(c) for c, flag in zip(values, changed)])

    nothing = F.lit(None).cast(row_type)
    settled = counted.where(~unlike).select(
        *named,
        F.when(F.col("output_rows") == 0, MISSING).when(F.col("golden_rows") == 0, EXTRA).otherwise(MATCH).alias("status"),
        "golden_rows",
        "output_rows",
        flags([F.lit(False)] * len(values)).alias("differs"),
        nothing.alias("golden"),
        nothing.alias("output"),
    )

    wanted = counted.where(unlike)
    listed = wanted.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)])
    same_key = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    rows = golden.select(*named, packed.alias("__row"), F.lit(True).alias("__left")).union(
        output.select(*named, packed.alias("__row"), F.lit(False))
    )
    paired = (
        rows.join(listed, same_key, "left_semi")
        .groupBy(*named)
        .agg(
            F.count_if(side).alias("golden_rows"),
            F.count_if(~side).alias("output_rows"),
            F.min(F.when(side, F.col("__row"))).alias("golden"),
            F.min(F.when(~side, F.col("__row"))).alias("output"),
        )
    )
    misfit = F.coalesce(F.col("golden")["__failed"], F.lit(False)) if drift else F.lit(False)
    changed = [~same_value(F.col("golden")[c], F.col("output")[c], types[c], spec.tolerance) for c in values]
    any_changed = reduce(lambda a, b: a | b, changed, F.lit(False))
    opened = paired.select(
        *named,
        F.when(misfit, TYPE_ERROR).when(any_changed, CHANGED).otherwise(MATCH).alias("status"),
        "golden_rows",
        "output_rows",
        flags(changed).alias("differs"),
        "golden",
        "output",
    )
    return settled.union(opened)


def diff_by_key(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """Findings per key with both values of every compared column as text."""
    paired = pair_by_key(left, right, spec)
    common, _, _ = align_columns(left, right, spec.ignore)
    values = [c for c in common if c not in spec.keys]
    shown = F.col("status").isin(CHANGED, TYPE_ERROR)

    def finding(condition: Column, kind: Column, with_values: Column) -> tuple[Column, Column]:
        sides = [
            F.when(with_values, F.col(side)[c].cast("string")).alias(f"{side}__{c}")
            for side in ("golden", "output")
            for c in values
        ]
        return condition, F.struct(kind.alias("mismatch_type"), *sides)

    return explode_present(
        paired,
        spec.keys,
        [
            finding(F.col("status") != MATCH, F.col("status"), shown),
            finding(F.col("golden_rows") > 1, F.lit(DUPLICATE_GOLDEN), F.lit(False)),
            finding(F.col("output_rows") > 1, F.lit(DUPLICATE_OUTPUT), F.lit(False)),
        ],
    )


def status_counts(paired: DataFrame) -> DataFrame:
    return paired.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def column_mismatches(paired: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of differing keys per compared column, in one pass without exploding the rows."""
    counted = paired.agg(
        *[F.count_if(F.col("differs")[c]).alias(f"__{i}") for i, c in enumerate(columns)]
    )
    return rows_from(
        counted,
        [{"column_name": F.lit(c), "mismatches": F.col(f"__{i}")} for i, c in enumerate(columns)],
    )


def diff_multiset(left: DataFrame, right: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows whose multiplicity differs, with both counts. Exact: groups on the columns, not on a hash."""
    common, _, _ = align_columns(left, right, ignore)
    if not common:
        raise ValueError("the two datasets share no column")
    return (
        tagged_union(left, right, common)
        .groupBy(*[F.col(f"`{c}`") for c in common])
        .agg(
            F.count_if(F.col("__left")).alias("golden_count"),
            F.count_if(~F.col("__left")).alias("output_count"),
        )
        .where(F.col("golden_count") != F.col("output_count"))
    )


def rows_without_partner(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key (NULL included) does not occur in ``other``."""
    require_keys(keys, df, other)
    partner = other.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[f"`{k}`"].eqNullSafe(partner[f"__{i}"])
    return df.join(partner, same, "left_anti")


def numeric_columns(df: DataFrame, among: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name in set(among) and isinstance(f.dataType, T.NumericType)]


def _summed(df: DataFrame, column: str, scale: int) -> tuple[Column, int]:
    """The column as a summable value, and the digits after the point that it has."""
    kind = df.schema[column].dataType
    digits = kind.scale if isinstance(kind, T.DecimalType) else 0 if isinstance(kind, T.IntegralType) else scale
    return summable(F.col(f"`{column}`"), kind, scale), digits


def reconcile_sums(
    left: DataFrame,
    right: DataFrame,
    columns: Sequence[str] | None = None,
    tolerance: Decimal | float = Decimal(0),
    scale: int = SCALE,
) -> DataFrame:
    """Sum of each numeric column per side, null-safe delta and verdict.

    Decimals and whole numbers are summed in their own digits, floating-point
    values with ``scale`` digits after the point; what does not fit 38 digits
    stops the query.
    """
    common, _, _ = align_columns(left, right)
    chosen = list(columns) if columns is not None else numeric_columns(left, common)
    if not chosen:
        raise ValueError("no common numeric column to sum")
    both = tagged_union(left, right, chosen)
    side = F.col("__left")
    values = [_summed(both, c, scale) for c in chosen]
    kind = f"decimal(38,{max(digits for _, digits in values)})"
    sums = both.agg(
        *[F.sum(F.when(side, v)).alias(f"__l{i}") for i, (v, _) in enumerate(values)],
        *[F.sum(F.when(~side, v)).alias(f"__r{i}") for i, (v, _) in enumerate(values)],
    )
    limit = F.lit(Decimal(str(tolerance)))
    listed = []
    for i, c in enumerate(chosen):
        lv, rv = F.col(f"__l{i}").cast(kind), F.col(f"__r{i}").cast(kind)
        delta = (lv - rv).cast(kind)
        listed.append(
            {
                "column_name": F.lit(c),
                "left_sum": lv,
                "right_sum": rv,
                "delta": delta,
                "ok": F.coalesce(F.abs(delta) <= limit, lv.isNull() & rv.isNull()),
            }
        )
    return rows_from(sums, listed)


def group_totals(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    measure: str,
    tolerance: Decimal | float = Decimal(0),
    scale: int = SCALE,
) -> DataFrame:
    """Totals of ``measure`` per group on both sides with delta and verdict; one shuffle of partial sums.

    Digits are kept as in ``reconcile_sums``.
    """
    both = tagged_union(left, right, [*by, measure])
    amount, digits = _summed(both, measure, scale)
    kind = f"decimal(38,{digits})"
    side = F.col("__left")
    grouped = both.groupBy(*[F.col(f"`{c}`") for c in by]).agg(
        F.count_if(side).alias("left_rows"),
        F.count_if(~side).alias("right_rows"),
        F.sum(F.when(side, amount)).cast(kind).alias("left_total"),
        F.sum(F.when(~side, amount)).cast(kind).alias("right_total"),
    )
    lv, rv = F.col("left_total"), F.col("right_total")
    delta = (F.coalesce(lv, F.lit(0)) - F.coalesce(rv, F.lit(0))).cast(kind)
    return grouped.withColumn("delta", delta).withColumn(
        "ok",
        (F.abs(F.col("delta")) <= F.lit(Decimal(str(tolerance)))) & (lv.isNull() == rv.isNull()),
    )


def compare_counts(left: DataFrame, right: DataFrame, relative_tolerance: float = 0.0) -> DataFrame:
    """Row counts of both sides; the verdict allows a relative difference."""
    counts = left.select(F.lit(True).alias("__left")).union(right.select(F.lit(False))).agg(
        F.count_if(F.col("__left")).alias("left_rows"),
        F.count_if(~F.col("__left")).alias("right_rows"),
    )
    gap = F.abs(F.col("left_rows") - F.col("right_rows"))
    return counts.select(
        "*",
        (gap <= F.col("left_rows") * F.lit(float(relative_tolerance))).alias("ok"),
    )


def check_counts(datasets: Mapping[str, DataFrame], expected: Mapping[str, int | None]) -> DataFrame:
    """Actual against expected count per dataset: ``OK``, ``EMPTY`` or ``MISMATCH``."""
    if not datasets:
        raise ValueError("no dataset to count")
    parts = [
        df.agg(F.count(F.lit(1)).alias("actual")).select(
            F.lit(name).alias("dataset"),
            "actual",
            F.lit(expected.get(name)).cast("long").alias("expected"),
        )
        for name, df in datasets.items()
    ]
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.union(part)
    return counted.withColumn(
        "status",
        F.when(F.col("expected").isNotNull() & (F.col("actual") != F.col("expected")), "MISMATCH")
        .when(F.col("actual") == 0, "EMPTY")
        .otherwise("OK"),
    )


def schema_diff(left: DataFrame, right: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Column-level differences of the two schemas; an empty frame means they agree."""
    common, only_left, only_right = align_columns(left, right, ignore)
    lt = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    rt = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    rows = [(c, "type_mismatch", lt[c], rt[c]) for c in common if lt[c] != rt[c]]
    rows += [(c, "only_in_left", lt[c], None) for c in sorted(only_left)]
    rows += [(c, "only_in_right", None, rt[c]) for c in sorted(only_right)]
    return left.sparkSession.createDataFrame(
        rows, "column_name string, difference string, left_type string, right_type string"
    )


def sample_mismatches(diff: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` findings in key order: a top-k, not a full sort."""
    return diff.orderBy(*[F.col(f"`{k}`") for k in keys], "mismatch_type").limit(n)


def sums_summary(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None, tolerance: Decimal | float = Decimal(0)) -> DataFrame:
    """The summary of a comparison by sums: counts, how many columns differ, the largest gap, and the verdict."""
    counts = compare_counts(left, right)
    sums = reconcile_sums(left, right, columns, tolerance).agg(
        F.count(F.lit(1)).alias("columns"), F.count_if(~F.col("ok")).alias("differing"), F.max(F.abs("delta")).cast("double").alias("largest_gap")
    )
    packed = sums.select(F.struct("columns", "differing", "largest_gap").alias("s")).scalar()
    return counts.select(F.struct("left_rows", "right_rows").alias("counts"), F.col("ok").alias("same_count"), packed.alias("sums")).select(
        F.lit("sums").alias("mode"), "counts", "sums", (F.col("same_count") & (F.col("sums.differing") == 0)).alias("passed")
    )


def compare_addresses(spark: SparkSession, left: str, right: str, spec: CompareSpec, target: str, mode: str = "rows") -> DataFrame:
    """Compare the datasets at two addresses, write the one-row summary as JSON to ``target`` and return it.

    ``mode`` is ``rows`` (by key, or as multisets without keys) or ``sums``.
    """
    golden, output = (read_dataset(spark, address) for address in (left, right))
    if mode == "sums":
        summary = sums_summary(golden, output, tolerance=spec.tolerance)
    elif mode == "rows":
        summary = compare_summary(golden, output, spec)
    else:
        raise ValueError("mode is 'rows' or 'sums'")
    summary.coalesce(1).write.mode("overwrite").json(target)
    return spark.read.schema(summary.schema).json(target)


def compare_summary(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """One row with schema, counts, findings and the overall verdict."""
    common, only_left, only_right = align_columns(left, right, spec.ignore)
    lt = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    rt = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    drift = sorted(c for c in common if lt[c] != rt[c])
    schema = F.struct(
        F.lit(len(common)).alias("common_columns"),
        _texts(sorted(only_left)).alias("only_in_left"),
        _texts(sorted(only_right)).alias("only_in_right"),
        _texts(drift).alias("type_mismatches"),
    )
    if spec.keys:
        found = pair_by_key(left, right, spec).agg(
            F.coalesce(F.sum("golden_rows"), F.lit(0)).alias("left_rows"),
            F.coalesce(F.sum("output_rows"), F.lit(0)).alias("right_rows"),
            F.count_if(F.col("status") == MISSING).alias("missing_keys"),
            F.count_if(F.col("status") == EXTRA).alias("extra_keys"),
            F.count_if(F.col("status").isin(CHANGED, TYPE_ERROR)).alias("changed_keys"),
            F.count_if((F.col("golden_rows") > 1) | (F.col("output_rows") > 1)).alias("duplicate_keys"),
        )
    else:
        shared = [F.col(f"`{c}`") for c in common]
        found = (
            tagged_union(left, right, common)
            .groupBy(*shared)
            .agg(F.count_if(F.col("__left")).alias("__l"), F.count_if(~F.col("__left")).alias("__r"))
            .agg(
                F.coalesce(F.sum("__l"), F.lit(0)).alias("left_rows"),
                F.coalesce(F.sum("__r"), F.lit(0)).alias("right_rows"),
                F.count_if(F.col("__l") > F.col("__r")).alias("missing_keys"),
                F.count_if(F.col("__r") > F.col("__l")).alias("extra_keys"),
                F.lit(0).cast("long").alias("changed_keys"),
                F.lit(0).cast("long").alias("duplicate_keys"),
            )
        )
    clean = (
        (F.col("left_rows") == F.col("right_rows"))
        & (F.col("missing_keys") + F.col("extra_keys") + F.col("changed_keys") + F.col("duplicate_keys") == 0)
        & F.lit(not (drift or only_left or only_right))
    )
    return found.select(
        F.lit("keys" if spec.keys else "multiset").alias("mode"),
        schema.alias("schema"),
        F.struct("left_rows", "right_rows").alias("counts"),
        F.struct("missing_keys", "extra_keys", "changed_keys", "duplicate_keys").alias("diff"),
        clean.alias("passed"),
    )


def audit_normalised(df: DataFrame, blank: Sequence[str] = (), to_day: Sequence[str] = ()) -> DataFrame:
    """Make audit columns comparable: blank some, cut others to the day."""
    changed = {c: F.lit(None).cast(df.schema[c].dataType) for c in blank}
    changed |= {c: F.date_trunc("day", F.col(f"`{c}`")).cast(df.schema[c].dataType) for c in to_day}
    return df.withColumns(changed) if changed else df


def quality_report(name: str, left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """The report row of one dataset: counts, schema differences, duplicates, nulls and top mismatch columns."""
    if not spec.keys:
        raise ValueError("the report needs keys")
    common, only_left, only_right = align_columns(left, right, spec.ignore)
    values = [c for c in common if c not in spec.keys]
    paired = pair_by_key(left, right, spec)
    weight = F.col("output_rows")
    summary = paired.agg(
        F.coalesce(F.sum("golden_rows"), F.lit(0)).alias("row_count_left"),
        F.coalesce(F.sum("output_rows"), F.lit(0)).alias("row_count_right"),
        F.coalesce(F.sum(F.greatest(weight - 1, F.lit(0))), F.lit(0)).alias("key_duplicate_count"),
        *[F.count_if(F.col("differs")[c]).alias(f"__d{i}") for i, c in enumerate(values)],
    )
    # Rates are over rows, so they are counted before rows of one key meet.
    rates = right.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.try_divide(F.count_if(F.col(f"`{c}`").isNull()), F.count(F.lit(1))).alias("null_rate"),
                )
                for c in values
            ]
        ).alias("rates")
    ).scalar()
    worst = F.array(
        *[
            F.struct((-F.col(f"__d{i}")).alias("order"), F.lit(c).alias("column_name"), F.col(f"__d{i}").alias("mismatches"))
            for i, c in enumerate(values)
        ]
    )
    top = F.transform(
        F.filter(F.sort_array(worst), lambda x: x["mismatches"] > 0),
        lambda x: F.struct(x["column_name"].alias("column_name"), x["mismatches"].alias("mismatches")),
    )
    return summary.select(
        F.lit(name).alias("dataset_name"),
        "row_count_left",
        "row_count_right",
        F.struct(
            _texts(sorted(only_left)).alias("only_in_left"), _texts(sorted(only_right)).alias("only_in_right")
        ).alias("schema_diff"),
        "key_duplicate_count",
        rates.alias("null_rate_summary"),
        top.alias("top_mismatch_columns"),
    )


def _texts(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")

