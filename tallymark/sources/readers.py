"""Reading datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallymark.operators.project import cast_dataframe
from tallymark.specs import SourceSpec


def read_dataset(spark: SparkSession, source: SourceSpec | str, schema: T.StructType | str | None = None) -> DataFrame:
    """A dataset by address (``parquet:/path``) or spec. CSV needs a schema or is read as text columns."""
    spec = SourceSpec.parse(source) if isinstance(source, str) else source
    if spec.table:
        return spark.table(spec.table)
    reader = spark.read.format(spec.format).options(**spec.options)
    if spec.format == "csv" and "header" not in spec.options:
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(spec.path)


def read_golden_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """A golden file. Without a schema the types are inferred, which reads the file twice."""
    reader = spark.read.option("header", header)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


# Catalogs and database to try for a name that does not say.
CATALOGS = ("hive_metastore", "spark_catalog")
DATABASE = "default"


def table_candidates(name: str, catalogs: Sequence[str] = CATALOGS, default_database: str = DATABASE) -> list[str]:
    """Names to try for a table: every choice of catalog and database that the name leaves open, plain ones first."""
    given = name.strip().split(".")
    databases = [(), (default_database,)] if len(given) == 1 else [()]
    choices = product([(), *((c,) for c in catalogs)] if len(given) < 3 else [()], databases)
    # A catalog is followed by a database, given or chosen.
    return [".".join([*c, *d, *given]) for c, d in choices if not c or len(d) + len(given) > 1]


def resolve_table(spark: SparkSession, name: str, catalogs: Sequence[str] = CATALOGS, default_database: str = DATABASE) -> str:
    """The first candidate that exists; asks the catalog only, reads no data."""
    tried = table_candidates(name, catalogs, default_database)
    found = next((t for t in tried if _exists(spark, t)), None)
    if found is None:
        raise ValueError("table not found; tried: " + ", ".join(tried))
    return found


def _exists(spark: SparkSession, name: str) -> bool:
    try:
        return spark.catalog.tableExists(name)
    except AnalysisException:  # the name's catalog is not configured
        return False


def sql_source(
    spark: SparkSession,
    text: str,
    parameters: Mapping[str, Any],
    schema: Mapping[str, str],
    strict: bool = True,
    frames: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """A parameterised query cast to its declared types.

    ``:name`` are values, never pasted into the text; ``{name}`` are frames.
    """
    return cast_dataframe(spark.sql(text, args=dict(parameters), **(frames or {})), schema, strict)


# Query of each extraction stage of the loan job, over frames or tables named in braces.
STAGE_QUERIES = {
    "V138S0": (
        "SELECT ACCT_NBR, NEW_CAPN_AMT, OLD_CAPN_AMT, ACTIVITY_CODE, SBSD_SCHEME_CD, IND_CODE, SUB_IND_CODE,"
        " SUB_SUB_IND_CODE, SPONSOR_ID, OLD_BRANCH FROM {loan_master} WHERE"
        " CASE WHEN array_contains(:closed, STAT) THEN coalesce(LST_FIN_DATE, :min_date) ELSE :max_date END"
        " >= (SELECT max(FIN_YR_STRT_DT) FROM {date_dimension} WHERE DT = :business_date)"
    ),
    "V0S108": "SELECT ACCT_NBR, CUST_NBR, PSL_CODE FROM {psl_lookup}",
    "V0S126": (
        "SELECT a.ACCT_NO AS ACCT_NBR, CASE WHEN a.POST_DATE BETWEEN"
        " (SELECT max(MTH_STRT_DT) FROM {date_dimension} WHERE DT = :business_date) AND :business_date"
        " THEN a.FIRST_AMT_ADV ELSE 0 END AS FIRST_AMT_ADV,"
        " CAST(date_format(a.POST_DATE, 'yyyyMMdd') AS INT) AS FIRST_ADV_DATE"
        " FROM {advance_detail} a JOIN {loan_account_detail} b ON a.ACCT_NO = b.ACCT_NBR WHERE"
        " CASE WHEN array_contains(:closed, b.STAT) THEN coalesce(b.LST_FIN_DATE, :min_date) ELSE :max_date END"
        " >= (SELECT max(FIN_YR_STRT_DT) FROM {date_dimension} WHERE DT = :business_date)"
    ),
    "V0S132": (
        "SELECT a.CUST_NBR, a.CUST_TOT_BAL FROM {customer_balance} a JOIN {loan_customer_balance} b"
        " ON a.CUST_NBR = b.CUST_NBR WHERE b.TBL_ID = :table_id"
    ),
    "V154S0": "SELECT BRNCH_NBR, CRCL_CD, BRNCH_NBR_SKEY FROM {branch_master} WHERE LATEST_FLG = :latest_flag",
}


def stage_query(stage: str) -> str:
    if stage not in STAGE_QUERIES:
        raise ValueError(f"unknown stage {stage!r}; known: {sorted(STAGE_QUERIES)}")
    return STAGE_QUERIES[stage]
