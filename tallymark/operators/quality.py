"""Data-quality checks.

Column checks are measured together in one aggregation pass; frequency based
checks are one grouped count each. Nothing is sampled unless sampling is the
check itself, and a sample is chosen by a hash of the key, not by partition
order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal, localcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.shape import SCALE, explode_present, rows_from, tagged_union
from tallymark.session import stored
from tallymark.specs import PENALTIES, Rule

# --- profiles --------------------------------------------------------------


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls and null share of every column, from one pass."""
    chosen = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__{i}") for i, c in enumerate(chosen)],
    )
    return rows_from(
        counted,
        [
            {
                "column_name": F.lit(c),
                "row_count": F.col("__rows"),
                "nulls": F.col(f"__{i}"),
                "null_pct": F.try_divide(F.col(f"__{i}") * F.lit(100.0), F.col("__rows")),
            }
            for i, c in enumerate(chosen)
        ],
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    counted = df.agg(*[count(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(columns)])
    return rows_from(
        counted,
        [{"column_name": F.lit(c), "distinct_values": F.col(f"__{i}")} for i, c in enumerate(columns)],
    )


def top_frequencies(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values with their share of all rows; ties go to the smaller value."""
    counted = df.groupBy(F.col(f"`{key}`").alias("key_value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    top = counted.orderBy(F.desc("n"), F.asc_nulls_first("key_value")).limit(n)
    return top.select("key_value", "n", F.try_divide(F.col("n").cast("double"), total.scalar()).alias("share"))


def key_skew(df: DataFrame, key: str, n: int = 5, ratio: float = 0.5) -> DataFrame:
    """Top frequencies with a warning flag for values above ``ratio`` of the rows."""
    return top_frequencies(df, key, n).withColumn("skewed", F.col("share") > F.lit(float(ratio)))


def quantile_sketches(df: DataFrame, column: str, by: Sequence[str] = (), size: int = 4096) -> DataFrame:
    """One mergeable quantile sketch of a numeric column per group (NULL and NaN left out); store it with the group's partition."""
    v = F.col(f"`{column}`").cast("double")
    kept = df.where(v.isNotNull() & ~F.isnan(v))
    groups = [F.col(f"`{c}`") for c in by]
    return kept.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, size).alias("sketch"))


def sketch_percentiles(sketches: DataFrame, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Approximate percentiles of merged sketches, for example of a month from those of its days."""
    merged = sketches.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return rows_from(
        merged,
        [
            {"fraction": F.lit(float(f)), "value": F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))), "n": F.col("n")}
            for f in fractions
        ],
        keep=list(by),
    )


def exact_percentiles(df: DataFrame, column: str, fractions: Sequence[float], bins: int = 4096) -> DataFrame:
    """Exact interpolated percentiles of a numeric column (NULL and NaN left out), however large it is.

    A first pass makes a quantile sketch of size ``bins``, which brackets every
    wanted rank by two values. A second pass counts the values inside the
    brackets one by one and all others by the gap they lie in. The few inside
    are range-partitioned, and one slice of them is ordered per wanted rank. A
    rank that its bracket does not hold, which the counts tell, is searched for
    among all values. No task orders or holds the column.

    Floating-point columns give doubles; whole numbers and decimals are compared
    in their own type and give decimals.
    """
    kind = df.schema[column].dataType
    floating = not isinstance(kind, (T.IntegralType, T.DecimalType))
    v = F.col("v")
    if floating:
        values = df.select(F.col(f"`{column}`").cast("double").alias("v")).where(v.isNotNull() & ~F.isnan("v"))
    else:
        own = "decimal(20,0)" if isinstance(kind, T.IntegralType) else kind
        values = df.select(F.col(f"`{column}`").cast(own).alias("v")).where(v.isNotNull())
    values = stored(values)
    sketched = stored(quantile_sketches(values, "v", size=bins))
    n = sketched.first()["n"]
    positions = [f * (n - 1) for f in fractions] if n else []
    ranks = sorted({r for p in positions for r in (math.floor(p), math.ceil(p))})
    # Three times the sketch's usual error of rank, and the neighbours.
    off = 3 * 2.296 / bins**0.9021 + 2 / max(n, 1)
    at: dict[int, object] = {}
    if ranks:
        ends = [(max(0.0, r / n - off), min(1.0, (r + 1) / n + off)) for r in ranks]
        asked = [F.kll_sketch_get_quantile_double("sketch", F.lit(e)) for pair in ends for e in pair]
        found = list(sketched.select(*[c.alias(f"q{i}") for i, c in enumerate(asked)]).first())
        at = _at_ranks(values, {r: (found[2 * i], found[2 * i + 1]) for i, r in enumerate(ranks)})
        missed = [r for r in ranks if r not in at]
        if missed:
            at |= _at_ranks(values, {r: (-math.inf, math.inf) for r in missed})
    rows = []
    for f, p in zip(fractions, positions):
        lower, upper = at[math.floor(p)], at[math.ceil(p)]
        part = p - math.floor(p)
        rows.append((float(f), lower + (part if floating else Decimal(str(round(part, 9)))) * (upper - lower)))
    rows += [(float(f), None) for f in fractions] if not n else []
    if floating:
        return df.sparkSession.createDataFrame(rows, "fraction double, value double")
    scale = min(38, max(SCALE, kind.scale if isinstance(kind, T.DecimalType) else 0))
    with localcontext() as exact:
        exact.prec = 60
        rows = [(f, None if x is None else x.quantize(Decimal(1).scaleb(-scale))) for f, x in rows]
    return df.sparkSession.createDataFrame(rows, f"fraction double, value decimal(38,{scale})")


def _at_ranks(values: DataFrame, brackets: Mapping[int, tuple[float, float]]) -> dict:
    """The value ``v`` at each rank whose bracket holds it; one scan, and one sorted slice of the bracketed values per rank."""
    ranges: list[list[float]] = []
    for low, high in sorted(brackets.values()):
        if ranges and low <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], high)
        else:
            ranges.append([low, high])
    d = F.col("v").cast("double")
    # Gaps have even places, ranges odd ones, in the order of the values.
    place = F.lit(0)
    for low, high in ranges:
        place = place + F.when(d >= low, 1).otherwise(0) + F.when(d > high, 1).otherwise(0)
    inside = place % 2 == 1
    counted = values.select(place.alias("place"), F.when(inside, F.col("v")).alias("v")).groupBy("place", "v").agg(F.count(F.lit(1)).alias("n"))
    slices = stored(counted.repartitionByRange("place", "v").withColumn("slice", F.spark_partition_id()))
    # One row per slice and place.
    sums = slices.groupBy("place", "slice").agg(F.sum("n").alias("n")).orderBy("place", "slice").collect()
    wanted, before = {}, 0
    for s in sums:
        for r in brackets:
            if s.place % 2 and before <= r < before + s.n:
                wanted[r] = (s.place, s.slice, r - before)
        before += s.n
    if not wanted:
        return {}
    some = reduce(lambda a, b: a | b, [(F.col("place") == p) & (F.col("slice") == s) for p, s, _ in set(wanted.values())])
    order = Window.partitionBy("place", "slice").orderBy("v")
    ranked = slices.where(some).withColumn("upto", F.sum("n").over(order))
    hit = reduce(
        lambda a, b: a | b,
        [(F.col("place") == p) & (F.col("slice") == s) & (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k) for p, s, k in set(wanted.values())],
    )
    rows = ranked.where(hit).select("place", "slice", "upto", "n", "v").collect()
    return {
        r: next(x.v for x in rows if (x.place, x.slice) == (p, s) and x.upto - x.n <= k < x.upto) for r, (p, s, k) in wanted.items()
    }


def approximate_percentiles(df: DataFrame, column: str, fractions: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    found = df.agg(F.percentile_approx(F.col(f"`{column}`").cast("double"), list(fractions), accuracy).alias("q"))
    return rows_from(
        found, [{"fraction": F.lit(float(f)), "value": F.col("q")[i]} for i, f in enumerate(fractions)]
    )


def frequency_drift(left: DataFrame, right: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Shares of the values that are among the ``n`` most frequent on either side, with the share change.

    ``distance`` is the total-variation distance over all values, repeated on each row.
    Both sides are read once; totals, distance and tops read the stored counts.
    """
    side = F.col("__left")
    counted = stored(
        tagged_union(left, right, [column])
        .groupBy(F.col(f"`{column}`").alias("key_value"))
        .agg(F.count_if(side).alias("left_n"), F.count_if(~side).alias("right_n"))
    )
    totals = counted.agg(F.struct(F.sum("left_n").alias("l"), F.sum("right_n").alias("r")).alias("t"))
    shares = counted.withColumn("t", totals.scalar()).select(
        "key_value",
        "left_n",
        "right_n",
        F.coalesce(F.try_divide(F.col("left_n").cast("double"), F.col("t.l")), F.lit(0.0)).alias("left_share"),
        F.coalesce(F.try_divide(F.col("right_n").cast("double"), F.col("t.r")), F.lit(0.0)).alias("right_share"),
    )
    distance = shares.agg((F.sum(F.abs(F.col("left_share") - F.col("right_share"))) / 2).alias("d"))

    def top(rank_by: str) -> DataFrame:
        return shares.where(F.col(rank_by) > 0).orderBy(F.desc(rank_by), F.asc_nulls_first("key_value")).limit(n)

    return (
        top("left_n")
        .unionAll(top("right_n"))
        .distinct()
        .withColumn("drift", F.col("right_share") - F.col("left_share"))
        .withColumn("distance", distance.scalar())
    )


# --- keys ------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def key_nulls(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(f"`{k}`").isNull()
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(any_null).alias("null_keys"))


def latest_flag_check(df: DataFrame, keys: Sequence[str], flag: str, value: str = "Y") -> DataFrame:
    """Keys that do not have exactly one row flagged as latest."""
    return (
        df.groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(F.count_if(F.col(f"`{flag}`") == value).alias("latest_rows"))
        .where(F.col("latest_rows") != 1)
    )


# --- column checks ---------------------------------------------------------


@dataclass(frozen=True)
class ColumnCheck:
    """A named condition on one column that is true for bad rows."""

    check: str
    column: str
    bad: Column


def not_null(column: str) -> ColumnCheck:
    return ColumnCheck("not_null", column, F.col(f"`{column}`").isNull())


def in_range(column: str, low=None, high=None) -> ColumnCheck:
    value, bad = F.col(f"`{column}`"), F.lit(False)
    if low is not None:
        bad = bad | (value < F.lit(low))
    if high is not None:
        bad = bad | (value > F.lit(high))
    return ColumnCheck("range", column, F.coalesce(bad, F.lit(False)))


def one_of(column: str, allowed: Sequence) -> ColumnCheck:
    value = F.col(f"`{column}`")
    return ColumnCheck("allowed", column, value.isNotNull() & ~value.isin(*allowed))


def not_after(column: str, as_of: date | datetime) -> ColumnCheck:
    return ColumnCheck("future_date", column, F.coalesce(F.col(f"`{column}`") > F.lit(as_of), F.lit(False)))


def matches(column: str, pattern: str) -> ColumnCheck:
    value = F.col(f"`{column}`")
    return ColumnCheck("format", column, value.isNotNull() & ~value.cast("string").rlike(pattern))


def run_checks(df: DataFrame, checks: Sequence[ColumnCheck]) -> DataFrame:
    """Violations of all checks from one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(c.bad).alias(f"__{i}") for i, c in enumerate(checks)]
    )
    return rows_from(
        counted,
        [
            {
                "check_name": F.lit(c.check),
                "column_name": F.lit(c.column),
                "row_count": F.col("__rows"),
                "violations": F.col(f"__{i}"),
                "passed": F.col(f"__{i}") == 0,
            }
            for i, c in enumerate(checks)
        ],
    )


def not_in_reference(df: DataFrame, column: str, reference: DataFrame, reference_column: str) -> DataFrame:
    """Non-null values that a reference table does not hold, with their number of rows."""
    used = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("key_value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = reference.select(F.col(f"`{reference_column}`").alias("key_value")).distinct()
    return used.join(known, "key_value", "left_anti")


# --- rules -----------------------------------------------------------------

# Counter that a broken rule of each kind adds to.
_ERROR_OF = {
    "exact-match": "value_mismatch",
    "range": "value_mismatch",
    "custom": "value_mismatch",
    "format": "format_error",
    "null-check": "null_violation",
    "type-check": "type_error",
}


def broken(rule: Rule) -> Column:
    """True for rows that break the rule; nulls break a rule only if it forbids them."""
    value = F.col(f"`{rule.column}`")
    if rule.kind == "null-check":
        return value.isNull()
    if rule.kind == "custom":
        return ~F.coalesce(F.expr(f"({rule.expression})"), F.lit(rule.allow_null))
    if rule.kind == "exact-match":
        return ~value.eqNullSafe(F.col(f"`{rule.target}`"))
    if rule.kind == "type-check":
        bad = value.isNotNull() & value.try_cast(rule.type_name).isNull()
    elif rule.kind == "format":
        bad = ~value.cast("string").rlike(rule.pattern)
    elif rule.target is not None:
        gap = F.abs(F.try_subtract(value, F.col(f"`{rule.target}`")))
        bad = gap > F.lit(Decimal(str(rule.tolerance or 0)))
    else:
        bad = F.lit(False)
        if rule.minimum is not None:
            bad = bad | (value < F.lit(rule.minimum))
        if rule.maximum is not None:
            bad = bad | (value > F.lit(rule.maximum))
    bad = F.coalesce(bad, F.lit(False))
    return bad if rule.allow_null else bad | value.isNull()


def rule_flags(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """One boolean per enabled rule, true where the row breaks it."""
    return df.select(
        *[F.col(f"`{c}`") for c in keep], *[broken(r).alias(r.name) for r in rules if r.enabled]
    )


def rule_errors(df: DataFrame, rules: Sequence[Rule], key: Sequence[str]) -> DataFrame:
    """One row per broken rule: row key, field, error type, values, rule and severity. A narrow projection."""
    row_key = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("<null>")) for k in key])
    found = [
        (
            broken(r),
            F.struct(
                F.lit(r.column).alias("field_name"),
                F.lit(_ERROR_OF[r.kind]).alias("error_type"),
                F.col(f"`{r.column}`").cast("string").alias("source_value"),
                (F.col(f"`{r.target}`").cast("string") if r.target else F.lit(None).cast("string")).alias(
                    "target_value"
                ),
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
            ),
        )
        for r in rules
        if r.enabled
    ]
    return explode_present(df.withColumn("row_key", row_key), ["row_key"], found)


def rule_counters(df: DataFrame, rules: Sequence[Rule], missing_rows: int = 0, extra_rows: int = 0) -> DataFrame:
    """Totals of a validation run: rows, passed, failed and the number of errors by type."""
    active = [r for r in rules if r.enabled]
    flags = [broken(r) for r in active]
    any_bad = F.lit(False)
    for flag in flags:
        any_bad = any_bad | flag

    def errors(kind: str) -> Column:
        total = F.lit(0).cast("long")
        for rule, flag in zip(active, flags):
            if _ERROR_OF[rule.kind] == kind:
                total = total + F.count_if(flag)
        return total.alias(kind)

    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~any_bad).alias("passed_rows"),
        F.count_if(any_bad).alias("failed_rows"),
        errors("value_mismatch"),
        errors("format_error"),
        errors("null_violation"),
        errors("type_error"),
        F.lit(missing_rows).cast("long").alias("missing_row"),
        F.lit(extra_rows).cast("long").alias("extra_row"),
    )


# --- strategies ------------------------------------------------------------


def hash_sample(df: DataFrame, key: Sequence[str], per_ten_thousand: int, seed: int = 0) -> DataFrame:
    """Deterministic sample by key: the same keys are chosen on both sides and on every run.

    The bucket comes from MD5 so that any engine can repeat the choice.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10_000
    return df.where(bucket < per_ten_thousand)


def select_rows(
    df: DataFrame,
    strategy: str,
    key: Sequence[str] = (),
    per_ten_thousand: int = 100,
    seed: int = 0,
    water_column: str | None = None,
    high_water=None,
) -> DataFrame:
    """Rows (and columns) that a validation strategy looks at."""
    if strategy == "full":
        return df
    if strategy == "sampling":
        return hash_sample(df, key, per_ten_thousand, seed)
    if strategy == "key-fields":
        return df.select(*[F.col(f"`{k}`") for k in key])
    if strategy == "incremental":
        return df.where(F.col(f"`{water_column}`") > F.lit(high_water))
    raise ValueError(f"unknown strategy: {strategy}")


# --- schema and score ------------------------------------------------------


def schema_drift(datasets: Mapping[str, DataFrame | None], expected: Mapping[str, Sequence[str]], spark: SparkSession) -> DataFrame:
    """Findings ``table_missing`` (no frame) and ``schema_drift`` from column names only."""
    rows = []
    for name in sorted(datasets):
        df = datasets[name]
        if df is None:
            rows.append((name, "table_missing", "not accessible"))
            continue
        if name in expected:
            missing = sorted(set(expected[name]) - set(df.columns))
            extra = sorted(set(df.columns) - set(expected[name]))
            if missing or extra:
                rows.append((name, "schema_drift", f"missing={missing} extra={extra}"))
    if not datasets:
        rows.append(("", "no_tables", "no input table named"))
    return spark.createDataFrame(rows, "dataset string, finding string, detail string")


def schema_fit(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Expected and actual columns as rows: ``ok``, ``missing``, ``extra`` or ``type_mismatch``,
    with the number of values that do not fit the expected type. One pass over the compared columns."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    drifted = [c for c, t in expected.items() if c in actual and actual[c] != t]
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[
            F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(expected[c]).isNull()).alias(f"__{i}")
            for i, c in enumerate(drifted)
        ],
    )
    zero = F.lit(0).cast("long")

    def row(name: str, status: str, misfits: Column) -> dict[str, Column]:
        return {
            "column_name": F.lit(name),
            "status": F.lit(status),
            "expected_type": F.lit(expected.get(name)).cast("string"),
            "actual_type": F.lit(actual.get(name)).cast("string"),
            "row_count": F.col("__rows"),
            "misfits": misfits,
        }

    listed = []
    for name in expected:
        if name not in actual:
            listed.append(row(name, "missing", zero))
        elif name in drifted:
            listed.append(row(name, "type_mismatch", F.col(f"__{drifted.index(name)}")))
        else:
            listed.append(row(name, "ok", zero))
    listed += [row(name, "extra", zero) for name in actual if name not in expected]
    return rows_from(counted, listed)


def column_count_check(df: DataFrame, expected: int) -> DataFrame:
    """Number of columns against the expected one, with the rows and the columns that hold no value at all."""
    filled = [F.when(F.count(F.col(f"`{c}`")) == 0, 1).otherwise(0) for c in df.columns]
    return df.agg(
        F.lit(len(df.columns)).alias("actual"),
        F.lit(expected).alias("expected"),
        F.lit(len(df.columns) == expected).alias("ok"),
        F.count(F.lit(1)).alias("rows"),
        reduce(lambda a, b: a + b, filled, F.lit(0)).alias("empty_columns"),
    )


def profile_findings(
    name: str,
    df: DataFrame,
    key: str | None = None,
    expected_count: int | None = None,
    skew_ratio: float = 0.5,
) -> DataFrame:
    """Findings ``empty_dataset``, ``count_mismatch`` and ``key_skew`` of one dataset, from one grouped count."""
    grouping = F.col(f"`{key}`") if key else F.lit(1)
    sizes = df.groupBy(grouping.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("n").alias("top"))
    rows, top = F.col("rows"), F.col("top")
    found = [
        (rows == 0, _finding("empty_dataset", F.lit("no rows"))),
        (
            F.lit(expected_count is not None) & (rows != F.lit(expected_count or 0)),
            _finding("count_mismatch", F.concat(F.lit(f"expected={expected_count}, actual="), rows.cast("string"))),
        ),
        (
            F.lit(key is not None) & (F.try_divide(top.cast("double"), rows) > F.lit(float(skew_ratio))),
            _finding("key_skew", F.concat(F.lit("top value holds "), top.cast("string"), F.lit(" rows"))),
        ),
    ]
    return explode_present(total.withColumn("dataset", F.lit(name)), ["dataset"], found)


def _finding(kind: str, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("finding"), detail.alias("detail"))


def confidence_score(findings: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """100 minus the penalties of the findings, never below 0, for each dataset named."""
    penalty = F.create_map(*[F.lit(x) for item in PENALTIES.items() for x in item])
    lost = findings.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("findings"),
        F.sum(F.coalesce(F.try_element_at(penalty, F.col("finding")), F.lit(0))).alias("penalty"),
    )
    named = findings.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string")
    return named.join(lost, "dataset", "left").select(
        "dataset",
        F.coalesce("findings", F.lit(0)).cast("long").alias("findings"),
        F.greatest(F.lit(100) - F.coalesce("penalty", F.lit(0)), F.lit(0)).cast("long").alias("score"),
    )


# --- configuration documents -----------------------------------------------

# Required entries of a job configuration with their severity.
REQUIRED_ENTRIES = (
    ("job", "critical"),
    ("spark", "critical"),
    ("data", "critical"),
    ("data.input", "critical"),
    ("data.input.path", "critical"),
    ("data.input.format", "warning"),
    ("data.output", "warning"),
    ("data.output.catalog", "warning"),
    ("data.output.database", "warning"),
    ("data.output.table", "warning"),
)


def config_findings(configs: DataFrame, name: str = "path", document: str = "text") -> DataFrame:
    """Missing entries and doubtful paths of JSON configuration documents, one row per finding.

    An entry is only asked for when its parent exists, so a missing section is
    reported once. Each document is parsed once.
    """
    parsed = configs.select(
        F.col(f"`{name}`").alias("config"), F.try_parse_json(F.col(f"`{document}`")).alias("doc")
    )
    doc = F.col("doc")

    def present(entry: str) -> Column:
        return F.try_variant_get(doc, f"$.{entry}", "variant").isNotNull()

    def text_at(entry: str) -> Column:
        return F.coalesce(F.try_variant_get(doc, f"$.{entry}", "string"), F.lit(""))

    def finding(kind: str, entry: Column | str, severity: str) -> Column:
        return F.struct(
            F.lit(kind).alias("rule"),
            (F.lit(entry) if isinstance(entry, str) else entry).alias("entry"),
            F.lit(severity).alias("severity"),
        )

    valid = doc.isNotNull()
    found = [(~valid, finding("invalid_json", "", "critical"))]
    for entry, severity in REQUIRED_ENTRIES:
        parent = entry.rpartition(".")[0]
        asked = valid & (present(parent) if parent else F.lit(True))
        found.append((asked & ~present(entry), finding("missing_entry", entry, severity)))

    path = text_at("data.input.path")
    on_s3 = path.startswith("s3://") | path.startswith("s3a://")
    local = path.startswith("file://") | path.startswith("/")
    for entry, severity in (("access_key", "critical"), ("secret_key", "critical"), ("endpoint", "warning")):
        full = f"spark.s3.{entry}"
        found.append((on_s3 & ~present(full), finding("missing_s3_setting", full, severity)))
    found += [
        (path.startswith("s3://"), finding("s3_scheme", path, "warning")),
        (local & path.contains(" "), finding("path_with_space", path, "warning")),
        ((path != "") & ~on_s3 & ~local, finding("unknown_scheme", path, "info")),
        (
            (text_at("spark.catalog.type") == "rest") & ~present("spark.catalog.uri"),
            finding("rest_catalog_without_uri", "spark.catalog.uri", "critical"),
        ),
    ]
    return explode_present(parsed, ["config"], found)

