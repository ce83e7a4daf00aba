"""Weekly loan agreement fact: account detail with advances, balances and branch keys."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.scalars import amount_in_period, in_fiscal_scope, yyyymmdd
from tallymark.operators.joins import dimension_value, left_chain, lookup
from tallymark.operators.project import cast_dataframe, flag_filter
from tallymark.specs import FilterSpec

# Column types of the sources and of the fact table.
ACCOUNT_TYPES = {
    "ACCT_NBR": "string",
    "NEW_CAPN_AMT": "decimal(17,3)",
    "OLD_CAPN_AMT": "decimal(17,3)",
    "ACTIVITY_CODE": "string",
    "SBSD_SCHEME_CD": "string",
    "IND_CODE": "string",
    "SUB_IND_CODE": "string",
    "SUB_SUB_IND_CODE": "string",
    "SPONSOR_ID": "string",
    "OLD_BRANCH": "string",
}
PSL_TYPES = {"ACCT_NBR": "string", "CUST_NBR": "string", "PSL_CODE": "string"}
ADVANCE_TYPES = {"ACCT_NBR": "string", "FIRST_ADV_DATE": "int", "FIRST_AMT_ADV": "decimal(25,5)"}
BALANCE_TYPES = {"CUST_NBR": "string", "CUST_TOT_BAL": "decimal(25,5)"}
BRANCH_TYPES = {"BRNCH_NBR": "string", "CRCL_CD": "smallint", "BRNCH_NBR_SKEY": "bigint"}
FACT_TYPES = (
    {"OLD_ACCT_BRNCH_CD_SKEY": "bigint", "CUST_HOME_BR_SKEY": "bigint"}
    | ACCOUNT_TYPES
    | {"CUST_NBR": "string", "PSL_CODE": "string"}
    | {"FIRST_ADV_DATE": "int", "FIRST_AMT_ADV": "decimal(25,5)", "CUST_TOT_BAL": "decimal(25,5)"}
)


@dataclass(frozen=True)
class LoanSources:
    """Input frames; ``accounts`` carries STAT and LST_FIN_DATE next to the account columns."""

    accounts: DataFrame
    psl: DataFrame
    advances: DataFrame
    account_status: DataFrame
    balances: DataFrame
    loan_balances: DataFrame
    branches: DataFrame
    dates: DataFrame


def account_detail(accounts: DataFrame, dates: DataFrame, day: date, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Accounts in the fiscal year of ``day``; empty when the date dimension lacks the day."""
    year_start = dimension_value(dates, "DT", day, "FIN_YR_STRT_DT")
    scope = in_fiscal_scope(F.col("STAT"), F.col("LST_FIN_DATE"), year_start, spec)
    return cast_dataframe(accounts.where(scope), ACCOUNT_TYPES)


def advance_detail(advances: DataFrame, status: DataFrame, dates: DataFrame, day: date, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Advance per account: latest date as yyyymmdd and the amount that falls into the month of ``day``."""
    year_start = dimension_value(dates, "DT", day, "FIN_YR_STRT_DT")
    month_start = dimension_value(dates, "DT", day, "MTH_STRT_DT")
    scope = in_fiscal_scope(F.col("STAT"), F.col("LST_FIN_DATE"), year_start, spec)
    live = status.where(scope).select(F.col("ACCT_NBR").alias("__nbr"))
    post = F.col("POST_DATE").cast("date")
    rows = advances.join(live, F.col("ACCT_NO") == F.col("__nbr")).select(
        F.col("ACCT_NO").cast("string").alias("ACCT_NBR"),
        amount_in_period(F.col("FIRST_AMT_ADV"), post, month_start, F.lit(day)).cast("decimal(25,5)").alias("FIRST_AMT_ADV"),
        yyyymmdd(post).cast("int").alias("FIRST_ADV_DATE"),
    )
    summed = rows.groupBy("ACCT_NBR").agg(
        F.max("FIRST_ADV_DATE").alias("FIRST_ADV_DATE"), F.sum("FIRST_AMT_ADV").alias("FIRST_AMT_ADV")
    )
    return cast_dataframe(summed, ADVANCE_TYPES)


def customer_balance(balances: DataFrame, loan_balances: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    wanted = flag_filter(loan_balances, "TBL_ID", spec.balance_table_id).select("CUST_NBR")
    return cast_dataframe(balances.join(wanted, "CUST_NBR"), BALANCE_TYPES)


def build_fact(
    src: LoanSources,
    day: date,
    spec: FilterSpec = FilterSpec(),
    old_branch_key: str = "OLD_BRANCH",
    home_branch_key: str = "OLD_BRANCH",
) -> DataFrame:
    """The fact rows. Both branch lookups use the old branch unless another key column is named."""
    branches = cast_dataframe(flag_filter(src.branches, "LATEST_FLG", spec.latest_flag), BRANCH_TYPES)
    joined = left_chain(
        account_detail(src.accounts, src.dates, day, spec),
        [
            (cast_dataframe(src.psl, PSL_TYPES), ["ACCT_NBR"]),
            (advance_detail(src.advances, src.account_status, src.dates, day, spec), ["ACCT_NBR"]),
            (customer_balance(src.balances, src.loan_balances, spec), ["CUST_NBR"]),
        ],
    )
    with_old = lookup(joined, branches, old_branch_key, "BRNCH_NBR", {"BRNCH_NBR_SKEY": "OLD_ACCT_BRNCH_CD_SKEY"})
    with_home = lookup(with_old, branches, home_branch_key, "BRNCH_NBR", {"BRNCH_NBR_SKEY": "CUST_HOME_BR_SKEY"})
    return cast_dataframe(with_home, FACT_TYPES)
