"""Named functions of the migrated jobs.

Each exists as a column function and, after ``register_functions``, as a
temporary SQL function whose body is a SQL expression: no Python runs per row.

Two functions are called by the jobs without any published definition. Their
meaning here is an assumption, kept in one place so that it can be replaced:
``check_digit`` is the Luhn mod-10 digit and ``decimal_text`` drops
superfluous zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast("int")


def clean_string(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def left_text(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def right_text(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def to_moment(text: Column, pattern: str | None = None) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def to_decimal(text: Column, precision: int = 38, scale: int = 18) -> Column:
    return F.trim(text.cast("string")).try_cast(f"decimal({precision},{scale})")


def check_digit(text: Column) -> Column:
    """Luhn mod-10 digit of the digits in ``text``; null for text without digits."""
    digits = F.reverse(F.split(F.regexp_replace(text, r"[^0-9]", ""), ""))
    numbers = F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.cast("int"))

    def weigh(d: Column, i: Column) -> Column:
        doubled = d * 2
        return F.when(i % 2 == 0, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(d)

    total = F.aggregate(F.transform(numbers, weigh), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(numbers) > 0, ((F.lit(10) - total % 10) % 10).cast("string"))


def decimal_text(amount: Column) -> Column:
    """Decimal as text without leading zeros and without trailing zeros after the point; zero is ``0``."""
    plain = amount.cast("string")
    no_tail = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    no_head = F.regexp_replace(no_tail, r"^(-?)0+(?=[0-9])", "$1")
    return no_head


# Name, parameters and SQL body of the registered functions.
_SQL_FUNCTIONS = {
    "udf_to_number": ("x STRING", "INT", "try_cast(trim(x) AS INT)"),
    "udf_clean_string": ("x STRING", "STRING", "nullif(trim(x), '')"),
    "udf_safe_divide": ("a DOUBLE, b DOUBLE", "DOUBLE", "try_divide(a, b)"),
    "udf_left": ("x STRING, n INT", "STRING", "left(x, n)"),
    "udf_right": ("x STRING, n INT", "STRING", "right(x, n)"),
    "udf_timestamp": ("x STRING", "TIMESTAMP", "try_cast(x AS TIMESTAMP)"),
    "udf_decimal": ("x STRING", "DECIMAL(38,18)", "try_cast(trim(x) AS DECIMAL(38,18))"),
    "CheckDigit": (
        "x STRING",
        "STRING",
        "CASE WHEN x RLIKE '[0-9]' THEN cast((10 - aggregate("
        "transform(filter(reverse(split(regexp_replace(x, '[^0-9]', ''), '')), d -> d != ''),"
        " (d, i) -> CASE WHEN i % 2 = 0 THEN"
        " CASE WHEN cast(d AS INT) * 2 > 9 THEN cast(d AS INT) * 2 - 9 ELSE cast(d AS INT) * 2 END"
        " ELSE cast(d AS INT) END), 0, (a, b) -> a + b) % 10) % 10 AS STRING) END",
    ),
    "UDF_DECIMALTOSTRING": (
        "x DECIMAL(38,5), mode STRING",
        "STRING",
        "CASE WHEN mode = 'suppress_zero' THEN regexp_replace(regexp_replace(regexp_replace("
        "cast(x AS STRING), '([.][0-9]*?)0+$', '$1'), '[.]$', ''), '^(-?)0+([0-9])', '$1$2')"
        " ELSE cast(x AS STRING) END",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    for name, (parameters, result, body) in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(_SQL_FUNCTIONS)
