from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark.functions import scalars as s
from tallymark.functions import udfs


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return df.select(column.alias("r")).first().r


def test_fiscal_year(spark):
    for day, start in ((date(2024, 3, 31), date(2023, 4, 1)), (date(2024, 4, 1), date(2024, 4, 1))):
        assert one(spark, s.fiscal_year_start(F.lit(day))) == start
    assert one(spark, s.yyyymmdd(F.lit(date(2024, 12, 31)))) == "20241231"


def test_fiscal_scope(spark):
    bound = F.lit(date(2024, 4, 1))
    closed = s.in_fiscal_scope(F.lit("10"), F.lit(None).cast("date"), bound)
    assert one(spark, closed) is False
    assert one(spark, s.in_fiscal_scope(F.lit("99"), F.lit(None).cast("date"), bound)) is True
    assert one(spark, s.in_fiscal_scope(F.lit("40"), F.lit(date(2024, 4, 1)), bound)) is True


def test_labels(spark):
    assert one(spark, s.duration_label(F.lit(0.85))) == "850ms"
    assert one(spark, s.duration_label(F.lit(2.5))) == "2.50s"
    assert one(spark, s.duration_label(F.lit(None).cast("double"))) == "-"
    assert one(spark, s.segment_unit(F.lit("51"), F.lit(None).cast("string"))) == "PBBU"
    assert one(spark, s.segment_unit(F.lit("51"), F.lit("127"))) == "REHBU"
    assert one(spark, s.segment_unit(F.lit("9"), F.lit("127"))) is None
    assert [one(spark, s.pressure_level(F.lit(d))) for d in (49, 50, 100, 200)] == ["normal", "warning", "critical", "reject"]
    assert [one(spark, s.complexity_level(F.lit(d))) for d in (29, 30, 70)] == ["low", "medium", "high"]
    assert one(spark, s.star_rating(F.lit(6))) == "🟡 Good"
    assert one(spark, s.job_status(F.lit("Processing"))) == "running"
    assert one(spark, s.priority_label(F.lit("P2"))) == "medium"


def test_priority(spark):
    def p(source, branch):
        return one(spark, s.priority_for(F.lit(source), F.lit(branch)))

    assert [p("manual", "hotfix/x"), p("scheduled", None), p("git", "hotfix/x"), p("git", "main"), p("git", "feature/a"), p("git", "x")] == [1, 3, 0, 2, 3, 2]


def test_paths(spark):
    assert one(spark, s.domain_of(F.lit("/x/domain-loans/a.py"))) == "Loans"
    assert one(spark, s.domain_of(F.lit("/x/my_area/a.py"))) == "My Area"
    assert one(spark, s.domain_of(F.lit("/x/a.py"))) == "Unknown"
    assert one(spark, s.job_name(F.lit("/x/a.b.py"))) == "a.b"
    assert one(spark, s.safe_name(F.lit("c:\\x\\a b?.csv"))) == "a_b_.csv"
    assert one(spark, s.safe_name(F.lit("x/"))) == "output"
    assert len(one(spark, s.safe_name(F.lit("y" * 300)))) == 120


def test_request_key_treats_empty_commit_as_latest(spark):
    a = one(spark, s.request_key(F.lit("/j.py"), F.lit(None).cast("string")))
    b = one(spark, s.request_key(F.lit("/j.py"), F.lit("")))
    c = one(spark, s.request_key(F.lit("/j.py"), F.lit("latest")))
    assert a == b == c and len(a) == 16


def test_templates(spark):
    values = F.create_map(F.lit("d"), F.lit("1$0"), F.lit("B"), F.lit("x"))
    assert one(spark, s.fill_template(F.lit("{d}|${d}|${d:-n}|#B#|${Z:-dflt}|{q}"), values)) == "1$0|1$0|1$0|x|dflt|{q}"


def test_text_helpers(spark):
    assert one(spark, s.csv_list(F.lit(" a, ,b "))) == ["a", "b"]
    assert one(spark, s.has_all(F.array(F.lit("a"), F.lit("b")), ["b"])) is True
    assert one(spark, s.append_if_absent(F.array(F.lit("a")), F.lit("a"))) == ["a"]
    assert one(spark, s.append_if_absent(F.array(F.lit("a")), F.lit("b"))) == ["a", "b"]
    assert one(spark, s.lenient_bool(F.lit(" Yes "))) is True
    assert one(spark, s.lenient_bool(F.lit(None).cast("string"), True)) is True
    assert one(spark, s.default_for_key(F.lit("RunBusinessDate"))) == "1970-01-01"
    assert one(spark, s.strip_export_escapes(F.lit("(2)(10)/out.txt "))) == "/out.txt"
    assert one(spark, s.source_type(F.lit("3"), F.lit(None).cast("string"), F.lit("2"))) == "decimal(38,2)"


def test_times(spark):
    moment = F.lit(datetime(2024, 1, 1, 0, 0, 0))
    assert one(spark, s.age_seconds(moment, F.lit(datetime(2024, 1, 1, 0, 0, 1, 500000)))) == 1.5
    assert one(spark, s.is_stale(moment, F.lit(datetime(2024, 1, 1, 1, 0, 0)), 3600)) is False
    assert one(spark, s.remaining_seconds(F.lit(10.0), F.lit(0), F.lit(5))) is None
    assert one(spark, s.remaining_seconds(F.lit(10.0), F.lit(2), F.lit(5))) == 15.0


def test_fingerprint_has_no_collisions(spark):
    df = spark.createDataFrame([("a", "b||c"), ("a||b", "c"), (None, "<NULL>"), ("<NULL>", None)], "x string, y string")
    assert df.select(s.row_fingerprint(["x", "y"])).distinct().count() == 4


@pytest.mark.parametrize("text,want", [(" 12 ", 12), ("abc", None), (None, None), ("99999999999", None)])
def test_to_number(spark, text, want):
    assert one(spark, udfs.to_number(F.lit(text).cast("string"))) == want


def test_named_functions(spark):
    assert one(spark, udfs.clean_string(F.lit("  "))) is None
    assert one(spark, udfs.safe_divide(F.lit(1), F.lit(0))) is None
    assert one(spark, udfs.check_digit(F.lit("7992739871"))) == "3"
    assert one(spark, udfs.check_digit(F.lit("abc"))) is None
    for amount, text in (("00012.50000", "12.5"), ("0.00000", "0"), ("-3.00000", "-3"), ("100.00000", "100")):
        assert one(spark, udfs.decimal_text(F.lit(Decimal(amount)))) == text
    assert one(spark, udfs.to_decimal(F.lit(" 1.5 "), 10, 2)) == Decimal("1.50")
    assert one(spark, udfs.to_moment(F.lit("2024-01-02 03:04:05"))) == datetime(2024, 1, 2, 3, 4, 5)


def test_sql_functions_agree_with_columns(spark):
    assert "CheckDigit" in udfs.register_functions(spark)
    row = spark.sql(
        "SELECT CheckDigit('7992739871') c, UDF_DECIMALTOSTRING(CAST('12.50' AS DECIMAL(20,5)), 'suppress_zero') d,"
        " udf_to_number(' 7 ') n, udf_clean_string(' ') e, udf_safe_divide(1, 0) f, udf_left('abc', 2) l,"
        " udf_right('abc', 2) r, udf_decimal('1.5') m"
    ).first()
    assert (row.c, row.d, row.n, row.e, row.f, row.l, row.r) == ("3", "12.5", 7, None, None, "ab", "bc")
