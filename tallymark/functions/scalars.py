"""Column functions used by the jobs, the checks and the run analytics.

Everything here is a composition of built-in functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.specs import FilterSpec

# --- dates -----------------------------------------------------------------


def yyyymmdd(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def fiscal_year_start(day: Column) -> Column:
    """1 April of the fiscal year that holds ``day`` (January to March belong to the year before)."""
    return F.make_date(
        F.year(day) - F.when(F.month(day) <= 3, 1).otherwise(0), F.lit(4), F.lit(1)
    )


def in_fiscal_scope(status: Column, last_financial: Column, bound: Column, spec: FilterSpec = FilterSpec()) -> Column:
    """Closed accounts count while their last financial date reaches ``bound``; open ones always do."""
    effective = F.when(
        status.isin(*spec.closed_statuses),
        F.coalesce(last_financial.cast("date"), F.lit(spec.min_date)),
    ).otherwise(F.lit(spec.max_date))
    return effective >= bound


def amount_in_period(amount: Column, day: Column, first: Column, last: Column) -> Column:
    return F.when(day.between(first, last), amount).otherwise(F.lit(0).cast("decimal(1,0)"))


def duration_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def duration_label(seconds: Column) -> Column:
    """``850ms`` below one second, ``2.50s`` from there on, ``-`` when unknown."""
    millis = F.floor(seconds * 1000).cast("long")
    return (
        F.when(seconds.isNull(), F.lit("-"))
        .when(millis < 1000, F.concat(millis.cast("string"), F.lit("ms")))
        .otherwise(F.concat(F.format_string("%.2f", millis / F.lit(1000.0)), F.lit("s")))
    )


def age_seconds(moment: Column, as_of: Column) -> Column:
    return duration_seconds(moment, as_of)


def is_stale(moment: Column, as_of: Column, seconds: float) -> Column:
    return age_seconds(moment, as_of) > F.lit(float(seconds))


# --- keys and text ---------------------------------------------------------


def composite_key(*parts: Column) -> Column:
    """Concatenation of the parts; null when any part is null."""
    return F.concat(*[p.cast("string") for p in parts])


def row_fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 over the JSON of the row, so neither separators nor null markers can collide."""
    packed = F.struct(*[F.col(c) for c in columns])
    return F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)


def request_key(path: Column, commit: Column) -> Column:
    """Sixteen hex digits that name a (path, commit) request; no commit counts as ``latest``."""
    named = F.when(F.coalesce(commit, F.lit("")) == "", F.lit("latest")).otherwise(commit)
    return F.substring(F.sha2(F.concat(path, F.lit(":"), named), 256), 1, 16)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def job_name(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.py$", "")


def domain_of(path: Column) -> Column:
    """The word after ``domain`` in the path, else the first directory-like part with a marker, else ``Unknown``."""
    word = F.regexp_extract(path, r"(?i)domain[-_]?(\w+)", 1)
    part = F.filter(F.split(path, "/"), lambda p: p.startswith("domain") | p.contains("_"))
    spaced = F.regexp_replace(F.get(part, F.lit(0)), r"[-_]", " ")
    return (
        F.when(word != "", F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2))))
        .when(spaced.isNotNull(), F.initcap(spaced))
        .otherwise(F.lit("Unknown"))
    )


def safe_name(text: Column) -> Column:
    """Last path part with unusual characters replaced, at most 120 characters, never empty."""
    name = F.element_at(F.split(F.trim(text), r"[/\\\\]", -1), -1)
    plain = F.regexp_replace(name, r"[^\w.-]+", "_")
    # The longest name, and the name of nothing.
    return F.coalesce(F.nullif(F.substring(plain, 1, 120), F.lit("")), F.lit("output"))


def strip_export_escapes(text: Column) -> Column:
    """Remove the ``(n)`` escape markers of exported property values."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\(\d+\)", ""))


def csv_list(text: Column) -> Column:
    """Comma-separated text as an array of trimmed, non-empty items."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def has_all(array: Column, wanted: Sequence[str]) -> Column:
    """True when every wanted item is in the array."""
    if not wanted:
        return F.lit(True)
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), array)) == 0


def append_if_absent(array: Column, item: Column) -> Column:
    return F.when(F.array_contains(array, item), array).otherwise(F.array_append(array, item))


# Spellings that count as true.
TRUE_WORDS = ("1", "true", "yes", "y", "on")


def lenient_bool(text: Column, default: bool = False) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*TRUE_WORDS), F.lit(default))


def default_for_key(name: Column) -> Column:
    """Default value of an unset parameter, guessed from its name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(low.contains("date"), "1970-01-01")
        .when(low.contains("time"), "00:00:00")
        .when(low.contains("flag"), "N")
        .when(low.contains("count") | low.contains("num"), "0")
        .otherwise("")
    )


def fill_template(template: Column, values: Column) -> Column:
    """Put the entries of a string map into ``{name}``, ``#name#`` and ``${name:-default}`` places.

    A ``${name}`` without value and default is left in the text, and so is an
    unknown ``{name}`` or ``#name#``.
    """

    def put(text: Column, entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        text = F.replace(text, F.concat(F.lit("${"), key, F.lit("}")), value)
        with_default = F.concat(F.lit(r"\$\{\Q"), key, F.lit(r"\E:-[^}]*\}"))
        quoted = F.regexp_replace(value, r"([\\$])", r"\\$1")
        text = F.regexp_replace(text, with_default, quoted)
        text = F.replace(text, F.concat(F.lit("{"), key, F.lit("}")), value)
        return F.replace(text, F.concat(F.lit("#"), key, F.lit("#")), value)

    filled = F.aggregate(F.map_entries(values), template, put)
    return F.regexp_replace(filled, r"\$\{[^}:]+:-([^}]*)\}", "$1")


# --- comparison ------------------------------------------------------------


def same_value(left: Column, right: Column, data_type: T.DataType, tolerance: Decimal = Decimal(0)) -> Column:
    """Null-safe equality; numeric values may differ by up to ``tolerance``. NaN equals NaN."""
    equal = left.eqNullSafe(right)
    if tolerance > 0 and isinstance(data_type, T.NumericType):
        if isinstance(data_type, (T.FloatType, T.DoubleType)):
            limit = F.lit(float(tolerance))
        else:
            limit = F.lit(tolerance)
        gap = F.abs(F.try_subtract(left, right))
        return equal | F.coalesce(gap <= limit, F.lit(False))
    return equal


# --- labels ----------------------------------------------------------------


def segment_unit(segment: Column, map_code: Column) -> Column:
    """Business unit of a market segment; housing products of the personal segments go to REHBU."""
    housing = [str(code) for code in range(120, 128)]
    personal = segment.isin("51", "52", "53")
    is_housing = F.coalesce(map_code.cast("string"), F.lit("99")).isin(*housing)
    return (
        F.when(segment.isin("1", "2", "4"), "SMEBU")
        .when(personal & ~is_housing, "PBBU")
        .when(personal & is_housing, "REHBU")
        .when(segment == "3", "ABU")
    )


# Priority by branch; a trailing /* means the branch starts with the text before it.
BRANCH_PRIORITIES = {"hotfix/*": 0, "release/*": 1, "main": 2, "develop": 2, "feature/*": 3}


def priority_for(source: Column, branch: Column, rules: dict[str, int] | None = None) -> Column:
    """0 critical, 1 manual, 2 continuous integration (default), 3 batch; the first matching branch rule wins."""
    chosen = F.when(source == "manual", 1).when(source == "scheduled", 3)
    for pattern, priority in (BRANCH_PRIORITIES if rules is None else rules).items():
        hit = branch.startswith(pattern[:-2]) if pattern.endswith("/*") else branch == pattern
        chosen = chosen.when(hit, priority)
    return chosen.otherwise(2)


def pressure_level(depth: Column, warning: int = 50, critical: int = 100, reject: int = 200) -> Column:
    return (
        F.when(depth >= reject, "reject")
        .when(depth >= critical, "critical")
        .when(depth >= warning, "warning")
        .otherwise("normal")
    )


def complexity_level(score: Column, low: int = 30, medium: int = 70) -> Column:
    return F.when(score < low, "low").when(score < medium, "medium").otherwise("high")


def star_rating(score: Column) -> Column:
    return (
        F.when(score >= 8, "🟢 Excellent")
        .when(score >= 6, "🟡 Good")
        .when(score >= 4, "🟠 Fair")
        .otherwise("🔴 Poor")
    )


def job_status(status: Column) -> Column:
    """Displayed status: errors count as failed, processing as running, anything unknown as pending."""
    low = F.lower(status)
    return (
        F.when(low.isin("completed", "running", "validating"), low)
        .when(low.isin("failed", "error"), "failed")
        .when(low == "processing", "running")
        .otherwise("pending")
    )


def priority_label(priority: Column) -> Column:
    return F.when(priority.isin("P0", "P1"), "high").when(priority == "P2", "medium").otherwise("low")


# Displayed name of a trigger source; other names stay as they are.
SOURCE_NAMES = {
    "git_webhook": "webhook",
    "file_watcher": "file",
    "ci_cd": "ci_cd",
    "manual": "manual",
    "scheduled": "scheduled",
}


def trigger_name(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    chosen = F.when(low == "", "manual")
    for raw, shown in SOURCE_NAMES.items():
        chosen = chosen.when(low == raw, shown)
    return chosen.otherwise(low)


def source_type(code: Column, precision: Column, scale: Column) -> Column:
    """Spark type name of an exported SQL type code."""
    return (
        F.when(code == "12", "string")
        .when(code == "9", "date")
        .when(
            code == "3",
            F.concat(
                F.lit("decimal("),
                F.coalesce(F.nullif(precision, F.lit("")), F.lit("38")),
                F.lit(","),
                F.coalesce(F.nullif(scale, F.lit("")), F.lit("0")),
                F.lit(")"),
            ),
        )
        .otherwise("unknown")
    )


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Time left at the average pace so far; null before the first item is done."""
    return F.try_divide(elapsed, done) * (total - done)


def estimate_error_pct(actual: Column, estimate: Column) -> Column:
    return F.try_divide(actual - estimate, estimate) * 100
