"""Frames derived from the given tables.

Each is one portable SQL text: Spark runs it over the parquet files, and the
oracle puts the same text into a ``WITH`` clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


FIXTURES = {
    "golden": """
        SELECT o_orderkey AS id, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
               CAST(o_orderdate AS DATE) AS order_date, o_orderpriority
        FROM orders WHERE o_orderkey % 101 <> 0""",
    "output": """
        SELECT o_orderkey AS id, o_custkey,
               CASE WHEN o_orderkey % 53 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 89 = 0 THEN 0.01
                    WHEN o_orderkey % 83 = 0 THEN 5.00 ELSE 0.00 END AS DECIMAL(18,2)) AS amount,
               CAST(o_orderdate AS DATE) AS order_date,
               CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders WHERE o_orderkey % 97 <> 0""",
    "lines_golden": """
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, l_returnflag
        FROM lineitem""",
    "lines_output": """
        SELECT l_orderkey, l_linenumber, l_partkey,
               CAST(CAST(l_quantity AS DECIMAL(18,2)) + CASE WHEN l_orderkey % 41 = 0 THEN 1 ELSE 0 END
                    AS DECIMAL(18,2)) AS quantity,
               l_returnflag
        FROM lineitem WHERE l_orderkey % 103 <> 0
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DECIMAL(18,2)), l_returnflag
        FROM lineitem WHERE l_orderkey % 107 = 0""",
    "runs": """
        SELECT event_id AS request_id, concat('/jobs/domain-', CAST(user_id AS VARCHAR(20)), '.py') AS job_path,
               CASE event_type WHEN 'click' THEN 'manual' WHEN 'view' THEN 'ci_cd' WHEN 'purchase' THEN 'scheduled'
                    ELSE 'git_webhook' END AS trigger_source,
               CAST(event_id % 4 AS INT) AS priority,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'failed' ELSE 'completed' END AS status,
               CAST(FLOOR(event_id / 50.0) AS BIGINT) AS batch_id, ts AS created_at,
               value AS duration_seconds,
               CAST(event_id % 8 AS INT) AS worker_id
        FROM events""",
    "issues": """
        SELECT l_orderkey AS request_id,
               CASE l_returnflag WHEN 'A' THEN 'syntax' WHEN 'N' THEN 'logic' ELSE 'data' END AS stage,
               CASE WHEN l_linenumber = 1 THEN 'critical' WHEN l_linenumber = 2 THEN 'error'
                    WHEN l_linenumber IN (3, 4) THEN 'warning' ELSE 'info' END AS severity,
               concat('R', CAST(l_linenumber AS VARCHAR(10))) AS rule_id,
               concat('check ', l_linestatus) AS message,
               l_partkey AS part_key
        FROM lineitem""",
    "categories": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'domain' AS type, r_name AS name
        FROM region
        UNION ALL
        SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), 'module', n_name FROM nation
        UNION ALL
        SELECT CAST(1000 + s_suppkey AS BIGINT), CAST(100 + s_nationkey AS BIGINT), 'job_group', s_name FROM supplier""",
    "edges": """
        SELECT p_partkey AS job_id, CAST(FLOOR(p_partkey / 2.0) AS BIGINT) AS depends_on
        FROM part WHERE p_partkey > 0""",
    "customers": """
        SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(18,2)) END AS c_acctbal,
               c_nationkey
        FROM customer""",
    "schedule": """
        SELECT o_orderkey AS account_no, o_custkey AS customer_no, CAST(o_orderdate AS DATE) AS d1,
               CAST(o_totalprice AS DECIMAL(20,5)) AS a1,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS d2,
               CAST(o_totalprice AS DECIMAL(20,5)) AS a2,
               CAST(NULL AS DATE) AS d3, CAST(NULL AS DECIMAL(20,5)) AS a3
        FROM orders""",
    "loan_accounts": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS ACCT_NBR, CAST(o_totalprice AS DECIMAL(18,2)) AS NEW_CAPN_AMT,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 1.25 AS DECIMAL(18,2)) AS OLD_CAPN_AMT, o_orderpriority AS ACTIVITY_CODE,
               'S1' AS SBSD_SCHEME_CD, 'I1' AS IND_CODE, 'I2' AS SUB_IND_CODE, 'I3' AS SUB_SUB_IND_CODE,
               concat('SP', CAST(o_custkey % 10 AS VARCHAR(20))) AS SPONSOR_ID,
               CAST(o_custkey % 30 AS VARCHAR(20)) AS OLD_BRANCH,
               CASE o_orderstatus WHEN 'F' THEN '10' WHEN 'P' THEN '40' ELSE '20' END AS STAT,
               CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS LST_FIN_DATE
        FROM orders""",
    "loan_psl": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS ACCT_NBR, CAST(o_custkey AS VARCHAR(20)) AS CUST_NBR,
               o_orderpriority AS PSL_CODE
        FROM orders WHERE o_orderkey % 4 <> 0""",
    "loan_advances": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) AS ACCT_NO, CAST(l_shipdate AS DATE) AS POST_DATE,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS FIRST_AMT_ADV
        FROM lineitem""",
    "loan_balances": """
        SELECT CAST(c_custkey AS VARCHAR(20)) AS CUST_NBR, CAST(c_acctbal AS DECIMAL(18,2)) AS CUST_TOT_BAL
        FROM customer""",
    "loan_balance_tables": """
        SELECT CAST(c_custkey AS VARCHAR(20)) AS CUST_NBR, CAST(c_custkey % 3 AS INT) AS TBL_ID FROM customer""",
    "loan_branches": """
        SELECT CAST(n_nationkey AS VARCHAR(20)) AS BRNCH_NBR, n_regionkey AS CRCL_CD,
               CAST(1000 + n_nationkey AS BIGINT) AS BRNCH_NBR_SKEY,
               CASE WHEN n_nationkey = 7 THEN 'N' ELSE 'Y' END AS LATEST_FLG
        FROM nation""",
    "loan_dates": """
        SELECT DATE '1998-06-15' AS DT, DATE '1998-06-01' AS MTH_STRT_DT, DATE '1998-04-01' AS FIN_YR_STRT_DT
        FROM region WHERE r_regionkey = 0""",
    "sanction_loans": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS ACCT_NO, CAST(o_orderkey % 10 AS VARCHAR(20)) AS ACCT_NO_CHKDGT,
               CAST(o_custkey % 25 AS VARCHAR(20)) AS BR_NO, CAST(o_orderdate AS DATE) AS APPRV_DATE,
               CAST(o_totalprice AS DECIMAL(18,2)) AS APP_AMT, o_orderstatus AS ACT_TYPE,
               substr(o_orderpriority, 1, 1) AS CAT, CAST(o_orderdate AS DATE) AS APPLIC_ISSUE_DATE,
               CASE WHEN o_orderkey % 9 = 0 THEN '001' ELSE '003' END AS INST_NO,
               CASE WHEN o_orderkey % 7 = 0 THEN '40' ELSE '01' END AS STAT,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN -1 ELSE 1 END AS LOAN_BAL,
               concat('SG', CAST(o_custkey % 12 AS VARCHAR(20))) AS MARKET_SEG_CODE
        FROM orders""",
    "sanction_overdrafts": """
        SELECT CAST(o_orderkey + o_orderkey % 2 AS VARCHAR(20)) AS MEMB_CUST_AC,
               CAST(o_orderkey % 10 AS VARCHAR(20)) AS MEMB_CUST_AC_CHKDGT,
               CAST(o_custkey % 25 AS VARCHAR(20)) AS BRANCH_NO, CAST(o_orderdate AS DATE) AS ACCT_OPEN_DT,
               CAST(o_totalprice AS DECIMAL(18,2)) AS OD_LIM_AMOUNT_1, CAST(10 AS DECIMAL(18,2)) AS OD_LIM_AMOUNT_2,
               CAST(20 AS DECIMAL(18,2)) AS OD_LIM_AMOUNT_3, CAST(o_custkey AS DECIMAL(18,2)) AS OD_LIM_AMOUNT_4,
               o_orderstatus AS ACCT_TYPE, substr(o_orderpriority, 1, 1) AS INT_CAT, '003' AS SOC_NO,
               CASE WHEN o_orderkey % 7 = 0 THEN '08' ELSE '01' END AS CURR_STATUS,
               CASE WHEN o_orderkey % 2 = 0 THEN -5 ELSE 5 END AS CURR_BAL,
               concat('GGGGGGGGGGGGSG', CAST(o_custkey % 10 AS VARCHAR(20))) AS GL_CLASS_CODE
        FROM orders""",
    "sanction_segments": """
        SELECT concat('SG', CAST(n_nationkey AS VARCHAR(20))) AS SEG_CODE,
               CASE n_nationkey % 9 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '4' WHEN 3 THEN '51' WHEN 4 THEN '52'
                    WHEN 5 THEN '53' WHEN 6 THEN '3' WHEN 7 THEN '9' ELSE NULL END AS SEGMENT
        FROM nation""",
    "sanction_products": """
        SELECT DISTINCT concat(o_orderstatus, substr(o_orderpriority, 1, 1)) AS PRODCODE,
               concat('category ', o_orderstatus) AS CRMPRODUCTCATEGORY
        FROM orders WHERE o_orderpriority NOT LIKE '4%'""",
    "sanction_map": """
        SELECT DISTINCT o_orderstatus AS PART1, substr(o_orderpriority, 1, 1) AS PART2,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '121' WHEN '2' THEN '99' ELSE NULL END AS MAP
        FROM orders WHERE o_orderpriority NOT LIKE '5%'""",
    "pay_accounts": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS ACCT_NO, CAST(o_orderdate AS DATE) AS POST_DATE, """ + ", ".join(
        f"CASE WHEN {i} <= 1 + o_orderkey % 15 THEN CAST(o_orderdate AS DATE) END AS START_DATE_{i:02d},"
        f" CASE WHEN {i} <= 1 + o_orderkey % 15 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) + {i} AS DECIMAL(18,4)) END AS PRINC_DUE_{i:02d},"
        f" CAST({i}.50 AS DECIMAL(18,4)) AS PROJ_INT_{i:02d}"
        for i in range(1, 16)
    ) + """ FROM orders""",
    "pay_relations": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS ACCT_NBR, o_custkey AS CUST_NBR,
               CASE WHEN o_orderkey % 6 = 0 THEN 'JNT' ELSE 'OWN' END AS ACCT_TYPE_IND
        FROM orders""",
    "logs": """
        SELECT event_id AS log_id, user_id AS job_id, ts,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('stage', CAST(event_id % 3 AS VARCHAR(10))) END AS stage,
               CASE event_id % 4 WHEN 1 THEN 'passed' WHEN 2 THEN 'failed' WHEN 3 THEN 'running' END AS stage_status,
               CASE WHEN event_id % 2 = 0 THEN value END AS duration_seconds,
               event_type AS category, props AS message
        FROM events""",
    "classified": """
        SELECT p_partkey AS job_id, CAST(p_partkey % 6 AS BIGINT) AS domain_id,
               CAST(100 + p_partkey % 27 AS BIGINT) AS module_id, CAST(1000 + p_partkey % 37 AS BIGINT) AS group_id,
               CASE WHEN p_size < 15 THEN 'low' WHEN p_size < 35 THEN 'medium' ELSE 'high' END AS complexity,
               CAST(p_size / 50.0 AS DECIMAL(9,6)) AS confidence
        FROM part""",
    "components": """
        SELECT event_id, concat('component', CAST(user_id AS VARCHAR(20))) AS component, user_id % 10 AS grp,
               CASE WHEN event_type = 'error' AND user_id % 10 = 3 THEN 'unhealthy'
                    WHEN event_type = 'signup' AND user_id % 10 > 4 THEN 'degraded' ELSE 'healthy' END AS health,
               ts AS checked_at
        FROM events""",
    "waiting": """
        SELECT event_id AS request_id, CAST(event_id % 4 AS INT) AS priority,
               CASE WHEN event_type IN ('view', 'click') THEN 'pending' ELSE 'completed' END AS status, ts AS created_at
        FROM events""",
    "tagged": """
        SELECT o_orderkey AS job_id, o_orderpriority AS tag1, concat('cust', CAST(o_custkey % 5 AS VARCHAR(10))) AS tag2,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status
        FROM orders""",
    "proposals": """
        SELECT CASE WHEN p_partkey % 2 = 0 THEN 'module' ELSE 'domain' END AS type,
               CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS name,
               concat('/jobs/', CAST(p_partkey % 50 AS VARCHAR(10)), '.py') AS job_path, p_size AS suggested_at
        FROM part""",
    "names": """
        SELECT 'module' AS type, CASE s_suppkey % 5 WHEN 0 THEN concat('the ', lower(n_name), ' team')
                   WHEN 1 THEN substr(n_name, 2, 4) WHEN 2 THEN n_name WHEN 3 THEN concat('none', n_name)
                   ELSE 'Unknown' END AS name
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "slots": """
        SELECT event_id AS slot_id, 'acquire' AS action, ts, user_id FROM events
        UNION ALL
        SELECT event_id, 'release', ts, user_id FROM events WHERE event_type <> 'error'""",
    "arrivals": """
        SELECT event_id, ts, CAST(user_id % 3 AS BIGINT) AS queue, CAST(event_id % 4 AS INT) AS priority,
               CAST(CASE WHEN event_type IN ('error', 'signup') THEN -1 ELSE 1 END AS BIGINT) AS change
        FROM events""",
    "code": '''
        SELECT concat('/jobs/domain-', CAST(p_partkey AS VARCHAR(20)),
                      CASE WHEN p_partkey % 10 = 0 THEN '_debug.py' ELSE '.py' END) AS path,
               concat('# job ', p_name, chr(10),
                      'from pyspark.sql.functions import *', chr(10),
                      CASE WHEN p_partkey % 4 = 0 THEN concat('import pyspark.mllib', chr(10), 'import os', chr(10), 'import os', chr(10)) ELSE '' END,
                      chr(10),
                      'a_df = spark.sql("SELECT * FROM db.', p_brand, '")', chr(10),
                      'b_df = spark.read.parquet("s3', CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE '' END, '://bucket/', p_type, '")', chr(10),
                      'c_df = a_df.join(b_df, "id").select("id")', chr(10),
                      CASE WHEN p_partkey % 5 = 0 THEN concat('password="', p_name, '"', chr(10)) ELSE '' END,
                      CASE WHEN p_partkey % 5 = 1 THEN concat('token=os.environ["T"]', chr(10)) ELSE '' END,
                      CASE WHEN p_partkey % 6 = 0 THEN concat('rows = c_df.collect()', chr(10)) ELSE concat('rows = c_df.limit(5).collect()', chr(10)) END,
                      CASE WHEN p_partkey % 7 = 0 THEN concat('try:', chr(10), '    pass', chr(10), 'except:', chr(10), '    pass', chr(10)) ELSE '' END,
                      'print(rows)', chr(10),
                      CASE WHEN p_size % 2 = 0 THEN concat('a_df.count()', chr(10)) ELSE concat('a_df.cache()', chr(10)) END,
                      'spark.sql(', chr(39), 'DELETE FROM t_', CAST(p_size AS VARCHAR(10)), chr(39), ')', chr(10),
                      'spark.sql("""', chr(10), 'SELECT a, b, sum(c) AS s FROM x', CAST(p_size AS VARCHAR(10)), ' JOIN y', chr(10),
                      'ON x.i = y.i GROUP BY a', CASE WHEN p_size % 3 = 0 THEN ', b' ELSE '' END, '""")', chr(10),
                      'z = spark.sql(f"""SELECT 1 FROM {t}""")', chr(10),
                      'm = f"hello {z}"', chr(10),
                      'v = RunParameterSet["BusinessDate"] + LoadParamSet["K', CAST(p_size % 3 AS VARCHAR(10)), '"]', chr(10),
                      'c_df.writeTo("db.out', CAST(p_size AS VARCHAR(10)), '").createOrReplace()', chr(10),
                      CASE WHEN p_partkey % 9 = 0 THEN concat('spark.sql("INSERT INTO db.out', CAST(p_size AS VARCHAR(10)), ' SELECT 1")', chr(10)) ELSE '' END,
                      CASE WHEN p_partkey % 8 = 0 THEN 'CASE WHEN STAT IN (''10'', ''40'') THEN 1 END' ELSE '# end' END) AS text
        FROM part''',
    "scripts": """
        SELECT concat('ddl_', CAST(s_suppkey AS VARCHAR(20)), '.sql') AS path,
               concat('-- table of ', s_name, '; not a statement', chr(10),
                      'CREATE TABLE t', CAST(s_suppkey AS VARCHAR(20)), ' (a INT', CASE WHEN s_suppkey % 2 = 0 THEN ', b FLOAT' ELSE '' END, ');', chr(10),
                      '/* drop', chr(10), 'later; */', chr(10),
                      CASE WHEN s_suppkey % 3 = 0 THEN 'drop table old; ;' ELSE '' END,
                      'GRANT SELECT ON t', CAST(s_suppkey AS VARCHAR(20)), ' TO PUBLIC') AS text
        FROM supplier""",
    "exports": """
        SELECT concat('export_', CAST(s_suppkey AS VARCHAR(20)), '.xml') AS path,
               concat('This file has no style information', chr(10), '<?xml version="1.0"?><DSExport><Job Identifier="', s_name, '">',
                      '<?xml version="1.0"?>',
                      '<Collection Name="Parameters"><SubRecord><Property Name="Name">RunDate', CAST(s_nationkey AS VARCHAR(10)), '</Property>',
                      '<Property Name="Default">a & b</Property><Property Name="Prompt">x <> y</Property></SubRecord></Collection>',
                      '<SubRecord Name="OutputColumn"><Property Name="Name">KEY_', CAST(s_suppkey AS VARCHAR(20)), '</Property><Property Name="SqlType">12</Property>',
                      '<Property Name="Nullable">0</Property></SubRecord>',
                      '<SubRecord Name="OutputColumn"><Property Name="Name">AMOUNT</Property><Property Name="SqlType">3</Property>',
                      '<Property Name="Precision">', CAST(10 + s_suppkey % 5 AS VARCHAR(10)), '</Property><Property Name="Scale">2</Property></SubRecord>',
                      CASE WHEN s_suppkey % 2 = 0 THEN '<SubRecord Name="OutputColumn"><Property Name="Name">DAY</Property><Property Name="SqlType">9</Property></SubRecord>' ELSE '' END,
                      '<Record Identifier="V1S', CAST(s_suppkey AS VARCHAR(20)), '" Type="CustomStage"><Property Name="Name">file_out</Property>',
                      '<Property Name="StageType">PxSequentialFile</Property><Property Name="InputPins">P', CAST(s_suppkey AS VARCHAR(20)), '</Property></Record>',
                      '<Record Identifier="P', CAST(s_suppkey AS VARCHAR(20)), '" Type="CustomInput"><SubRecord><Property Name="Name">file</Property>',
                      '<Property Name="Value">(2)/out/', s_name, '(10).txt</Property></SubRecord><SubRecord><Property Name="Owner">APT</Property>',
                      '<Property Name="Name">Schema</Property><Property Name="Value">record (a:int)</Property></SubRecord></Record>',
                      '</Job></DSExport> trailing') AS text
        FROM supplier""",
}


def _mentioned(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, for work that is far larger than the file: a small file is read by few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def run_sql(spark: SparkSession, sf_dir: str, sql: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a text that names the given tables, as they are or prepared; every mention becomes a parameter of the call."""
    names = _mentioned(sql, TABLES)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in names:
        sql = re.sub(rf"(\b(?:FROM|JOIN)\s+){name}\b", rf"\1{{{name}}}", sql)
    tables = {n: read(spark, sf_dir, n) for n in names}
    return spark.sql(sql, **{n: prepare(t) if prepare else t for n, t in tables.items()})


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, FIXTURES[name])


def with_fixtures(body: str, *more: str, recursive: bool = False) -> str:
    """Oracle text: the fixtures that ``body`` mentions, ``more`` ready-made clauses, then ``body``."""
    text = " ".join([body, *more])
    clauses = [f"{n} AS ({FIXTURES[n]})" for n in FIXTURES if re.search(rf"(?:FROM|JOIN)\s+{n}\b", text)]
    clauses += list(more)
    if not clauses:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(clauses)} {body}"
