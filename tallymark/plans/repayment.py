"""Repayment schedule: the latest schedule per customer, one row per instalment."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.udfs import check_digit, decimal_text
from tallymark.operators.project import flag_filter, unpivot_pairs
from tallymark.operators.windows import latest_by_rank

INSTALMENTS = 15


def schedule(accounts: DataFrame, relations: DataFrame, day: date, instalments: int = INSTALMENTS) -> DataFrame:
    """``accounts`` holds START_DATE_nn, PRINC_DUE_nn and PROJ_INT_nn; ``relations`` links accounts to customers."""
    numbers = [f"{i:02d}" for i in range(1, instalments + 1)]
    owners = flag_filter(relations, "ACCT_TYPE_IND", "OWN").select(
        F.col("ACCT_NBR").alias("__nbr"), F.col("CUST_NBR").cast("string").alias("CUSTOMER_NO")
    )
    wide = accounts.where(F.col("POST_DATE").cast("date") <= F.lit(day)).join(
        owners, F.col("ACCT_NO") == F.col("__nbr")
    ).select(
        F.col("ACCT_NO").cast("string").alias("Account_No"),
        "CUSTOMER_NO",
        F.col("POST_DATE").cast("date").alias("POST_DATE"),
        *[F.col(f"START_DATE_{n}").cast("date").alias(f"d{n}") for n in numbers],
        *[(F.col(f"PRINC_DUE_{n}") + F.col(f"PROJ_INT_{n}")).cast("decimal(20,5)").alias(f"a{n}") for n in numbers],
    )
    newest = latest_by_rank(wide, ["CUSTOMER_NO"], "POST_DATE")
    long = unpivot_pairs(
        newest,
        ["Account_No", "CUSTOMER_NO"],
        [(f"d{n}", f"a{n}") for n in numbers],
        ["Scheduled_Payment_Date", "Scheduled_Amount"],
    )
    return long.select(
        F.concat("CUSTOMER_NO", check_digit(F.col("CUSTOMER_NO"))).alias("CIF_NUMBER"),
        F.concat("Account_No", check_digit(F.col("Account_No"))).alias("ACCOUNT_NUMBER"),
        F.lit("").alias("Type_of_Payment"),
        "Scheduled_Payment_Date",
        decimal_text(F.col("Scheduled_Amount")).cast("decimal(20,5)").alias("Scheduled_Amount"),
    )
