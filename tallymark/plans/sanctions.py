"""Sanctioned loans and overdrafts of the running fiscal year, with their business unit."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.scalars import composite_key, fiscal_year_start, segment_unit
from tallymark.operators.joins import join_on_expression, lookup
from tallymark.operators.project import cast_columns, cast_dataframe, flag_filter, not_in_or_null, union_all
from tallymark.operators.windows import first_per_key

# Market segments in scope, excluded statuses and output types.
SEGMENTS = ("1", "2", "4", "51", "52", "53", "3")
CLOSED_LOANS = ("10", "40", "45")
CLOSED_OVERDRAFTS = ("07", "08", "19")
INSTITUTION = "003"
OUTPUT_TYPES = {
    "ACCT_NO": "string",
    "BRANCH_CD": "string",
    "SANCTIONED_DT": "date",
    "SANCTIONED_AMT": "decimal(18,2)",
    "PRODCODE": "string",
    "CRMPRODUCTCATEGORY": "string",
    "BU": "string",
    "ACCT_OPEN_DT": "date",
}


def loans(source: DataFrame, segments: DataFrame, day: date) -> DataFrame:
    """Open loans applied for since the fiscal year began."""
    opened = F.col("APPLIC_ISSUE_DATE").cast("date")
    kept = flag_filter(source, "INST_NO", INSTITUTION).where(
        opened.between(fiscal_year_start(F.lit(day)), F.lit(day))
        & not_in_or_null(F.col("STAT"), CLOSED_LOANS)
        & (F.coalesce("LOAN_BAL", F.lit(0)) >= 0)
    )
    joined = join_on_expression(kept, _in_scope(segments), F.col("MARKET_SEG_CODE"), F.col("SEG_CODE"))
    return joined.select(
        composite_key(F.col("ACCT_NO"), F.col("ACCT_NO_CHKDGT")).alias("ACCT_NO"),
        F.col("BR_NO").alias("BRANCH_CD"),
        F.col("APPRV_DATE").alias("SANCTIONED_DT"),
        F.col("APP_AMT").alias("SANCTIONED_AMT"),
        composite_key(F.col("ACT_TYPE"), F.col("CAT")).alias("PRODCODE"),
        "SEGMENT",
        opened.alias("ACCT_OPEN_DT"),
    )


def overdrafts(source: DataFrame, segments: DataFrame, day: date) -> DataFrame:
    """Overdrawn accounts opened since the fiscal year began; the sanctioned amount adds four limits."""
    opened = F.col("ACCT_OPEN_DT").cast("date")
    kept = flag_filter(source, "SOC_NO", INSTITUTION).where(
        opened.between(fiscal_year_start(F.lit(day)), F.lit(day))
        & not_in_or_null(F.col("CURR_STATUS"), CLOSED_OVERDRAFTS)
        & (F.coalesce("CURR_BAL", F.lit(0)) < 0)
    )
    joined = join_on_expression(
        kept, _in_scope(segments), F.substring("GL_CLASS_CODE", 13, 4), F.col("SEG_CODE")
    )
    limits = [F.col(f"OD_LIM_AMOUNT_{i}") for i in (1, 2, 3, 4)]
    return joined.select(
        composite_key(F.col("MEMB_CUST_AC"), F.col("MEMB_CUST_AC_CHKDGT")).alias("ACCT_NO"),
        F.col("BRANCH_NO").alias("BRANCH_CD"),
        opened.alias("SANCTIONED_DT"),
        (limits[0] + limits[1] + limits[2] + limits[3]).alias("SANCTIONED_AMT"),
        composite_key(F.col("ACCT_TYPE"), F.col("INT_CAT")).alias("PRODCODE"),
        "SEGMENT",
        opened.alias("ACCT_OPEN_DT"),
    )


def with_unit(rows: DataFrame, products: DataFrame, product_map: DataFrame) -> DataFrame:
    """Product category (rows of unknown products drop out) and business unit."""
    mapped = lookup(
        rows.join(products, "PRODCODE"),
        product_map.select(composite_key(F.col("PART1"), F.col("PART2")).alias("PART"), "MAP"),
        "PRODCODE",
        "PART",
        {"MAP": "MAP"},
    )
    return cast_dataframe(mapped.withColumn("BU", segment_unit(F.col("SEGMENT"), F.col("MAP"))), OUTPUT_TYPES)


def sanctioned(
    loan_source: DataFrame,
    overdraft_source: DataFrame,
    segments: DataFrame,
    products: DataFrame,
    product_map: DataFrame,
    day: date,
) -> DataFrame:
    """One row per account; of several the first in column order remains."""
    both = union_all(
        [
            with_unit(overdrafts(overdraft_source, segments, day), products, product_map),
            with_unit(loans(loan_source, segments, day), products, product_map),
        ]
    )
    trimmed = both.withColumn("SANCTIONED_AMT", _trimmed(F.col("SANCTIONED_AMT")))
    return cast_columns(first_per_key(trimmed, ["ACCT_NO"], []), {"ACCT_OPEN_DT": "date"})


def _in_scope(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("SEGMENT").isin(*SEGMENTS)).select("SEG_CODE", "SEGMENT")


def _trimmed(amount: Column) -> Column:
    return F.trim(amount.cast("string"))
