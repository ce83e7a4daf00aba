"""Registered ETL queries: whole jobs and their building blocks."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tallymark.functions import scalars as s
from tallymark.functions import udfs
from tallymark.operators import joins, project, windows
from tallymark.plans import loan_fact, repayment, sanctions
from tallymark.plans.fixtures import fixture, read, with_fixtures
from tallymark.plans.registry import query

DAY = date(1998, 6, 15)

_SCOPE = (
    "CASE WHEN STAT IN ('10', '40', '45') THEN coalesce(LST_FIN_DATE, DATE '1899-12-31')"
    " ELSE DATE '2999-12-31' END >= d.FIN_YR_STRT_DT"
)


@query(
    "etl_fact_build",
    with_fixtures(
        """
        SELECT ob.BRNCH_NBR_SKEY AS OLD_ACCT_BRNCH_CD_SKEY, ob.BRNCH_NBR_SKEY AS CUST_HOME_BR_SKEY, a.ACCT_NBR,
               CAST(a.NEW_CAPN_AMT AS DECIMAL(17,3)) AS NEW_CAPN_AMT, CAST(a.OLD_CAPN_AMT AS DECIMAL(17,3)) AS OLD_CAPN_AMT,
               a.ACTIVITY_CODE, a.SBSD_SCHEME_CD, a.IND_CODE, a.SUB_IND_CODE, a.SUB_SUB_IND_CODE, a.SPONSOR_ID,
               a.OLD_BRANCH, p.CUST_NBR, p.PSL_CODE, v.FIRST_ADV_DATE, v.FIRST_AMT_ADV, b.CUST_TOT_BAL
        FROM acct a LEFT JOIN loan_psl p ON p.ACCT_NBR = a.ACCT_NBR
        LEFT JOIN adv v ON v.ACCT_NBR = a.ACCT_NBR
        LEFT JOIN bal b ON b.CUST_NBR = p.CUST_NBR
        LEFT JOIN (SELECT * FROM loan_branches WHERE LATEST_FLG = 'Y') ob ON ob.BRNCH_NBR = a.OLD_BRANCH""",
        f"acct AS (SELECT a.* FROM loan_accounts a JOIN loan_dates d ON d.DT = DATE '1998-06-15' WHERE {_SCOPE})",
        f"""adv AS (
            SELECT ACCT_NO AS ACCT_NBR, max(CAST(strftime(POST_DATE, '%Y%m%d') AS INT)) AS FIRST_ADV_DATE,
                   CAST(sum(CASE WHEN POST_DATE BETWEEN d.MTH_STRT_DT AND d.DT THEN FIRST_AMT_ADV ELSE 0 END)
                        AS DECIMAL(25,5)) AS FIRST_AMT_ADV
            FROM loan_advances x JOIN loan_accounts a ON a.ACCT_NBR = x.ACCT_NO
            JOIN loan_dates d ON d.DT = DATE '1998-06-15' WHERE {_SCOPE} GROUP BY ACCT_NO)""",
        """bal AS (SELECT x.CUST_NBR, CAST(x.CUST_TOT_BAL AS DECIMAL(25,5)) AS CUST_TOT_BAL FROM loan_balances x
            JOIN loan_balance_tables t ON t.CUST_NBR = x.CUST_NBR WHERE t.TBL_ID = 2)""",
    ),
)
def etl_fact_build(spark, sf_dir):
    def f(name):
        return fixture(spark, sf_dir, name)

    accounts = f("loan_accounts")
    sources = loan_fact.LoanSources(
        accounts=accounts,
        psl=f("loan_psl"),
        advances=f("loan_advances"),
        account_status=accounts.select("ACCT_NBR", "STAT", "LST_FIN_DATE"),
        balances=f("loan_balances"),
        loan_balances=f("loan_balance_tables"),
        branches=f("loan_branches"),
        dates=f("loan_dates"),
    )
    return loan_fact.build_fact(sources, DAY)


_BU = """CASE WHEN SEGMENT IN ('1','2','4') THEN 'SMEBU'
              WHEN SEGMENT IN ('51','52','53') AND coalesce(MAP, '99') NOT IN
                   ('120','121','122','123','124','125','126','127') THEN 'PBBU'
              WHEN SEGMENT IN ('51','52','53') THEN 'REHBU' WHEN SEGMENT = '3' THEN 'ABU' END"""


@query(
    "etl_sanctions",
    with_fixtures(
        f"""
        SELECT ACCT_NO, min(r).BRANCH_CD AS BRANCH_CD, min(r).SANCTIONED_DT AS SANCTIONED_DT,
               min(r).SANCTIONED_AMT AS SANCTIONED_AMT, min(r).PRODCODE AS PRODCODE,
               min(r).CRMPRODUCTCATEGORY AS CRMPRODUCTCATEGORY, min(r).BU AS BU, min(r).ACCT_OPEN_DT AS ACCT_OPEN_DT
        FROM (SELECT ACCT_NO, {{'BRANCH_CD': BRANCH_CD, 'SANCTIONED_DT': SANCTIONED_DT,
                     'SANCTIONED_AMT': CAST(CAST(SANCTIONED_AMT AS DECIMAL(18,2)) AS VARCHAR), 'PRODCODE': u.PRODCODE,
                     'CRMPRODUCTCATEGORY': CRMPRODUCTCATEGORY, 'BU': {_BU}, 'ACCT_OPEN_DT': ACCT_OPEN_DT}} AS r
              FROM both_sides u JOIN sanction_products p ON p.PRODCODE = u.PRODCODE
              LEFT JOIN sanction_map m ON u.PRODCODE = m.PART1 || m.PART2) x
        GROUP BY ACCT_NO""",
        "seg AS (SELECT * FROM sanction_segments WHERE SEGMENT IN ('1','2','4','51','52','53','3'))",
        """both_sides AS (
            SELECT ACCT_NO || ACCT_NO_CHKDGT AS ACCT_NO, BR_NO AS BRANCH_CD, APPRV_DATE AS SANCTIONED_DT,
                   APP_AMT AS SANCTIONED_AMT, ACT_TYPE || CAT AS PRODCODE, SEGMENT, APPLIC_ISSUE_DATE AS ACCT_OPEN_DT
            FROM sanction_loans JOIN seg ON MARKET_SEG_CODE = SEG_CODE
            WHERE APPLIC_ISSUE_DATE BETWEEN DATE '1997-04-01' AND DATE '1998-02-15' AND INST_NO = '003'
              AND STAT NOT IN ('10', '40', '45') AND coalesce(LOAN_BAL, 0) >= 0
            UNION ALL
            SELECT MEMB_CUST_AC || MEMB_CUST_AC_CHKDGT, BRANCH_NO, ACCT_OPEN_DT,
                   OD_LIM_AMOUNT_1 + OD_LIM_AMOUNT_2 + OD_LIM_AMOUNT_3 + OD_LIM_AMOUNT_4, ACCT_TYPE || INT_CAT,
                   SEGMENT, ACCT_OPEN_DT
            FROM sanction_overdrafts JOIN seg ON substr(GL_CLASS_CODE, 13, 4) = SEG_CODE
            WHERE ACCT_OPEN_DT BETWEEN DATE '1997-04-01' AND DATE '1998-02-15' AND SOC_NO = '003'
              AND CURR_STATUS NOT IN ('07', '08', '19') AND coalesce(CURR_BAL, 0) < 0)""",
    ),
)
def etl_sanctions(spark, sf_dir):
    names = ("sanction_loans", "sanction_overdrafts", "sanction_segments", "sanction_products", "sanction_map")
    return sanctions.sanctioned(*[fixture(spark, sf_dir, n) for n in names], date(1998, 2, 15))


_LUHN = (
    "CAST((10 - list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN"
    " CASE WHEN CAST({x}[length({x}) - i + 1] AS INT) * 2 > 9 THEN CAST({x}[length({x}) - i + 1] AS INT) * 2 - 9"
    " ELSE CAST({x}[length({x}) - i + 1] AS INT) * 2 END"
    " ELSE CAST({x}[length({x}) - i + 1] AS INT) END)) % 10) % 10 AS BIGINT)"
)


@query(
    "etl_repayment",
    with_fixtures(
        f"""
        SELECT CUSTOMER_NO || CAST({_LUHN.format(x='CUSTOMER_NO')} AS VARCHAR) AS CIF_NUMBER,
               ACCT_NO || CAST({_LUHN.format(x='ACCT_NO')} AS VARCHAR) AS ACCOUNT_NUMBER,
               '' AS Type_of_Payment, d AS Scheduled_Payment_Date, CAST(a AS DECIMAL(20,5)) AS Scheduled_Amount
        FROM ("""
        + " UNION ALL ".join(
            f"SELECT CUSTOMER_NO, ACCT_NO, START_DATE_{i:02d} AS d,"
            f" CAST(PRINC_DUE_{i:02d} + PROJ_INT_{i:02d} AS DECIMAL(20,5)) AS a FROM newest"
            for i in range(1, 16)
        )
        + ") u",
        """newest AS (
            SELECT * FROM (
                SELECT CAST(r.CUST_NBR AS VARCHAR) AS CUSTOMER_NO, p.*,
                       rank() OVER (PARTITION BY r.CUST_NBR ORDER BY POST_DATE DESC) AS rnk
                FROM pay_accounts p JOIN pay_relations r ON p.ACCT_NO = r.ACCT_NBR
                WHERE p.POST_DATE <= DATE '1998-06-15' AND r.ACCT_TYPE_IND = 'OWN') x WHERE rnk = 1)""",
    ),
)
def etl_repayment(spark, sf_dir):
    return repayment.schedule(fixture(spark, sf_dir, "pay_accounts"), fixture(spark, sf_dir, "pay_relations"), DAY)


@query(
    "etl_lookup_twice",
    "SELECT o.o_orderkey, n1.n_name AS own_nation, n2.n_name AS next_nation"
    " FROM orders o LEFT JOIN nation n1 ON n1.n_nationkey = o.o_custkey % 30"
    " LEFT JOIN nation n2 ON n2.n_nationkey = (o.o_custkey + 1) % 30",
)
def etl_lookup_twice(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    orders = read(spark, sf_dir, "orders")
    once = joins.lookup(orders, nation, F.col("o_custkey") % 30, "n_nationkey", {"n_name": "own_nation"})
    twice = joins.lookup(once, nation, (F.col("o_custkey") + 1) % 30, "n_nationkey", {"n_name": "next_nation"})
    return twice.select("o_orderkey", "own_nation", "next_nation")


@query(
    "etl_range_join",
    with_fixtures(
        "SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS order_date FROM orders o JOIN loan_dates d"
        " ON d.DT = DATE '1998-06-15' WHERE CAST(o.o_orderdate AS DATE) BETWEEN d.FIN_YR_STRT_DT AND d.DT"
    ),
)
def etl_range_join(spark, sf_dir):
    dates = fixture(spark, sf_dir, "loan_dates")
    first = joins.dimension_value(dates, "DT", DAY, "FIN_YR_STRT_DT")
    last = joins.dimension_value(dates, "DT", DAY, "DT")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    return joins.filter_from(orders, F.col("order_date"), first, last)


@query(
    "etl_three_way_join",
    "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND l_shipdate >= o_orderdate"
    " GROUP BY l_orderkey",
)
def etl_three_way_join(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    joined = joins.chain(
        lines,
        (read(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey"),
        (project.flag_filter(read(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING"), "o_custkey", "c_custkey"),
    )
    return joined.where("l_shipdate >= o_orderdate").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "etl_expression_join",
    "SELECT p_partkey, s_suppkey FROM part JOIN supplier"
    " ON concat(CAST(p_partkey AS VARCHAR), '-', CAST(p_size AS VARCHAR))"
    " = concat(CAST(s_suppkey AS VARCHAR), '-', CAST(s_nationkey AS VARCHAR))",
)
def etl_expression_join(spark, sf_dir):
    dash = F.lit("-")
    joined = joins.join_on_expression(
        read(spark, sf_dir, "part"),
        read(spark, sf_dir, "supplier"),
        s.composite_key(F.col("p_partkey"), dash, F.col("p_size")),
        s.composite_key(F.col("s_suppkey"), dash, F.col("s_nationkey")),
    )
    return joined.select("p_partkey", "s_suppkey")


@query(
    "etl_fiscal_year",
    "SELECT o_orderkey, make_date(CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 3 THEN 1 ELSE 0 END AS INT), 4, 1)"
    " AS fiscal_start, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS day_number FROM orders",
)
def etl_fiscal_year(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        s.fiscal_year_start(day).alias("fiscal_start"),
        udfs.to_number(s.yyyymmdd(day)).alias("day_number"),
    )


@query(
    "etl_segment_case",
    with_fixtures(
        f"SELECT ACCT_NO, SEGMENT, MAP, {_BU} AS BU FROM sanction_loans"
        " JOIN sanction_segments ON MARKET_SEG_CODE = SEG_CODE"
        " LEFT JOIN sanction_map ON ACT_TYPE || CAT = PART1 || PART2"
    ),
)
def etl_segment_case(spark, sf_dir):
    loans = fixture(spark, sf_dir, "sanction_loans").withColumn(
        "PRODCODE", s.composite_key(F.col("ACT_TYPE"), F.col("CAT"))
    )
    segments = fixture(spark, sf_dir, "sanction_segments")
    mapped = fixture(spark, sf_dir, "sanction_map").withColumn("PART", s.composite_key(F.col("PART1"), F.col("PART2")))
    joined = joins.lookup(
        joins.join_on_expression(loans, segments, F.col("MARKET_SEG_CODE"), F.col("SEG_CODE")),
        mapped, "PRODCODE", "PART", {"MAP": "MAP"},
    )
    return joined.select("ACCT_NO", "SEGMENT", "MAP", s.segment_unit(F.col("SEGMENT"), F.col("MAP")).alias("BU"))


@query(
    "etl_reject_split",
    with_fixtures(
        "SELECT CASE WHEN c_acctbal > 0 THEN 'accepted' ELSE 'rejected' END AS pin, count(*) AS n,"
        " CAST(sum(c_custkey) AS BIGINT) AS keys FROM customers GROUP BY pin"
    ),
)
def etl_reject_split(spark, sf_dir):
    accepted, rejected = project.split_reject(fixture(spark, sf_dir, "customers"), F.col("c_acctbal") > 0)
    both = accepted.withColumn("pin", F.lit("accepted")).unionByName(rejected.withColumn("pin", F.lit("rejected")))
    return both.groupBy("pin").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query(
    "etl_latest_rank",
    "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM ("
    " SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC) AS r FROM orders) x WHERE r = 1",
)
def etl_latest_rank(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("order_date")
    )
    return windows.latest_by_rank(orders, ["o_custkey"], "order_date")


@query(
    "etl_dedup",
    "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER"
    " (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem) x WHERE rn = 1",
)
def etl_dedup(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return windows.first_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query(
    "etl_unpivot_pairs",
    with_fixtures(
        " UNION ALL ".join(
            f"SELECT account_no, d{i} AS payment_date, a{i} AS amount FROM schedule" for i in (1, 2, 3)
        )
    ),
)
def etl_unpivot_pairs(spark, sf_dir):
    return project.unpivot_pairs(
        fixture(spark, sf_dir, "schedule"),
        ["account_no"],
        [("d1", "a1"), ("d2", "a2"), ("d3", "a3")],
        ["payment_date", "amount"],
    )


@query(
    "etl_cast",
    "SELECT try_cast(p_brand AS INT) AS p_brand, CAST(p_size AS VARCHAR) AS p_size,"
    " CAST(p_retailprice AS DECIMAL(12,1)) AS p_retailprice FROM part",
)
def etl_cast(spark, sf_dir):
    return project.cast_dataframe(
        read(spark, sf_dir, "part"),
        {"p_brand": "int", "p_size": "string", "p_retailprice": "decimal(12,1)"},
        strict=False,
    )


@query(
    "etl_union_cast",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_acctbal AS DECIMAL(18,2)) AS balance, c_mktsegment FROM customer"
    " UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CAST(s_acctbal AS DECIMAL(18,2)), NULL FROM supplier",
)
def etl_union_cast(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "id", "c_acctbal": "balance"})
    suppliers = read(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "id", "s_acctbal": "balance"})
    types = {"id": "string", "balance": "decimal(18,2)"}
    return project.union_by_name(
        [
            project.cast_dataframe(customers, types | {"c_mktsegment": "string"}),
            project.cast_dataframe(suppliers, types),
        ]
    )


@query(
    "etl_business_date",
    "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1997-03-04'",
)
def etl_business_date(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "DT")
    return project.filter_business_date(orders, date(1997, 3, 4)).select("o_orderkey")


@query(
    "etl_search",
    "SELECT p_partkey FROM part WHERE (lower(p_name) LIKE '%ma%' OR lower(p_brand) LIKE '%ma%')"
    " AND p_size >= 10",
)
def etl_search(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return project.search(part, "MA", ["p_name", "p_brand"], at_least={"p_size": 10}).select("p_partkey")


@query(
    "etl_event_gap",
    "SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))"
    " / 1000000.0::DOUBLE AS gap_seconds FROM events",
)
def etl_event_gap(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return windows.gap_seconds(events, ["user_id"], "ts", "event_id").select("event_id", "gap_seconds")


@query(
    "etl_page",
    "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40",
)
def etl_page(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return project.page(customers, [F.asc("c_custkey")], 3, 20)


@query(
    "etl_page_after",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 39 ORDER BY c_custkey LIMIT 20",
)
def etl_page_after(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return project.page_after(customers, "c_custkey", 39, 20)


@query(
    "etl_page_count",
    "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM customer",
)
def etl_page_count(spark, sf_dir):
    return project.page_count(read(spark, sf_dir, "customer"), 20)


_RUN_LABELS = with_fixtures(
    """
    SELECT request_id, upper(regexp_extract(job_path, 'domain[-_]?(\\w+)', 1)) AS domain,
           regexp_replace(regexp_extract(job_path, '([^/]*)$', 1), '\\.py$', '') AS job,
           substr(sha256(job_path || ':' || CASE WHEN request_id % 3 = 0 THEN 'latest'
                  ELSE CAST(request_id AS VARCHAR) END), 1, 16) AS request_key,
           CASE WHEN duration_seconds < 1 THEN concat(CAST(floor(duration_seconds * 1000) AS BIGINT), 'ms')
                ELSE concat(printf('%.2f', floor(duration_seconds * 1000) / 1000.0), 's') END AS duration,
           CASE WHEN trigger_source = 'manual' THEN 1 WHEN trigger_source = 'scheduled' THEN 3
                WHEN request_id % 5 = 0 THEN 0 WHEN request_id % 5 = 1 THEN 1 WHEN request_id % 5 = 2 THEN 2
                WHEN request_id % 5 = 3 THEN 3 ELSE 2 END AS priority,
           CASE WHEN request_id % 250 >= 200 THEN 'reject' WHEN request_id % 250 >= 100 THEN 'critical'
                WHEN request_id % 250 >= 50 THEN 'warning' ELSE 'normal' END AS pressure,
           CASE WHEN request_id % 101 < 30 THEN 'low' WHEN request_id % 101 < 70 THEN 'medium' ELSE 'high' END AS complexity,
           CASE WHEN status IN ('failed', 'error') THEN 'failed' ELSE status END AS shown_status,
           CASE trigger_source WHEN 'git_webhook' THEN 'webhook' ELSE trigger_source END AS shown_source
    FROM runs"""
)


@query("etl_run_labels", _RUN_LABELS)
def etl_run_labels(spark, sf_dir):
    runs = fixture(spark, sf_dir, "runs")
    request = F.col("request_id")
    branch = (
        F.when(request % 5 == 0, "hotfix/a").when(request % 5 == 1, "release/b").when(request % 5 == 2, "main")
        .when(request % 5 == 3, "feature/c").otherwise("other")
    )
    commit = F.when(request % 3 != 0, request.cast("string"))
    return runs.select(
        "request_id",
        F.upper(s.domain_of(F.col("job_path"))).alias("domain"),
        s.job_name(F.col("job_path")).alias("job"),
        s.request_key(F.col("job_path"), commit).alias("request_key"),
        s.duration_label(F.col("duration_seconds")).alias("duration"),
        s.priority_for(F.col("trigger_source"), branch).alias("priority"),
        s.pressure_level(request % 250).alias("pressure"),
        s.complexity_level(request % 101).alias("complexity"),
        s.job_status(F.col("status")).alias("shown_status"),
        s.trigger_name(F.col("trigger_source")).alias("shown_source"),
    )


@query(
    "etl_text_functions",
    """
    SELECT p_partkey,
           regexp_replace(regexp_extract(p_type, '([^/]*)$', 1), '[^a-zA-Z0-9_.-]+', '_', 'g') AS safe,
           len(list_filter(list_transform(string_split(p_type, ','), lambda x: trim(x)), lambda x: x <> '')) AS items,
           try_cast(trim(p_name) AS INT) AS number, nullif(trim(p_name), '') AS clean,
           CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice / (p_size % 4) END AS ratio,
           left(p_name, 3) AS head, right(p_name, 3) AS tail,
           concat('/out/1998-06-15/', p_brand, '_ok.csv') AS target,
           concat(p_type, p_name) AS part_key
    FROM part""",
)
def etl_text_functions(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    name, kind = F.col("p_name"), F.col("p_type")
    values = F.create_map(F.lit("business_date"), F.lit("1998-06-15"), F.lit("Brand"), F.col("p_brand"))
    return part.select(
        "p_partkey",
        s.safe_name(kind).alias("safe"),
        F.size(s.csv_list(kind)).cast("long").alias("items"),
        udfs.to_number(name).alias("number"),
        udfs.clean_string(name).alias("clean"),
        udfs.safe_divide(F.col("p_retailprice"), F.col("p_size") % 4).alias("ratio"),
        udfs.left_text(name, 3).alias("head"),
        udfs.right_text(name, 3).alias("tail"),
        s.fill_template(F.lit("/out/{business_date}/#Brand#_${STATE:-ok}.csv"), values).alias("target"),
        s.composite_key(kind, name).alias("part_key"),
    )


@query(
    "etl_sql_functions",
    f"SELECT s_suppkey, {_LUHN.format(x='CAST(s_suppkey AS VARCHAR)')} AS check_digit,"
    " CAST(s_suppkey AS INT) AS number, left(s_name, 4) AS head FROM supplier",
)
def etl_sql_functions(spark, sf_dir):
    udfs.register_functions(spark)
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        "CAST(CheckDigit(CAST(s_suppkey AS STRING)) AS BIGINT) AS check_digit",
        "udf_to_number(CAST(s_suppkey AS STRING)) AS number",
        "udf_left(s_name, 4) AS head",
    )


@query(
    "etl_sql_source",
    "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(17,3)) AS amount FROM orders"
    " WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1999-01-01 00:00:00'",
)
def etl_sql_source(spark, sf_dir):
    from tallymark.sources.readers import sql_source

    return sql_source(
        spark,
        "SELECT o_orderkey, o_totalprice AS amount FROM {orders}"
        " WHERE o_orderstatus = :status AND o_orderdate >= :since",
        {"status": "F", "since": date(1999, 1, 1)},
        {"o_orderkey": "bigint", "amount": "decimal(17,3)"},
        frames={"orders": read(spark, sf_dir, "orders")},
    )




@query(
    "etl_union_position",
    "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier"
    " UNION ALL SELECT s_suppkey, s_name FROM supplier",
)
def etl_union_position(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return project.union_all([customer, supplier, supplier])


@query("etl_distinct_values", "SELECT DISTINCT l_partkey FROM lineitem")
def etl_distinct_values(spark, sf_dir):
    return project.distinct_values(read(spark, sf_dir, "lineitem"), "l_partkey")


@query(
    "etl_copy_outputs",
    "SELECT 'keys' AS output, count(DISTINCT o_custkey) AS n FROM orders UNION ALL"
    " SELECT 'dates', count(DISTINCT o_orderdate) FROM orders",
)
def etl_copy_outputs(spark, sf_dir):
    outputs = project.copy_stage(read(spark, sf_dir, "orders"), {"keys": ["o_custkey"], "dates": ["o_orderdate"]})
    counted = [
        df.agg(F.count_distinct(df.columns[0]).alias("n")).select(F.lit(name).alias("output"), "n")
        for name, df in outputs.items()
    ]
    return project.union_all(counted)


@query(
    "etl_fingerprint",
    "SELECT c_custkey, sha256(CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': CASE WHEN c_custkey % 7 <> 0"
    " THEN c_mktsegment END}) AS VARCHAR)) AS fingerprint FROM customer",
)
def etl_fingerprint(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))
    )
    return customer.select("c_custkey", s.row_fingerprint(["c_custkey", "c_name", "c_mktsegment"]).alias("fingerprint"))


@query(
    "etl_event_functions",
    """
    SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 1000000.0::DOUBLE AS age,
           (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 1000000.0::DOUBLE > 1000000 AS stale,
           CASE WHEN event_id % 11 >= 8 THEN '🟢 Excellent' WHEN event_id % 11 >= 6 THEN '🟡 Good'
                WHEN event_id % 11 >= 4 THEN '🟠 Fair' ELSE '🔴 Poor' END AS rating,
           event_type IN ('click', 'view') AS wanted,
           CASE event_type WHEN 'view' THEN '1970-01-01' WHEN 'click' THEN 'N' ELSE '' END AS default_value,
           concat('/out/', event_type, '.txt') AS cleaned,
           CAST(json_extract_string(props, '$.k') AS INT) AS k,
           CASE WHEN event_type = 'error' THEN 2 ELSE 3 END AS tags,
           CAST(value AS DECIMAL(20,5)) AS amount,
           event_type AS original
    FROM events""",
)
def etl_event_functions(spark, sf_dir):
    kind, as_of = F.col("event_type"), F.lit(datetime(2024, 2, 1)).cast("timestamp")
    flag = F.when(kind == "click", " Yes").when(kind == "view", "TRUE").otherwise("off")
    name = F.when(kind == "view", "RunBusinessDate").when(kind == "click", "run_FLAG").otherwise("other")
    tags = s.append_if_absent(F.array(F.lit("error"), F.lit("x")), kind)
    return read(spark, sf_dir, "events").select(
        "event_id",
        s.age_seconds(F.col("ts"), as_of).alias("age"),
        s.is_stale(F.col("ts"), as_of, 1_000_000).alias("stale"),
        s.star_rating(F.col("event_id") % 11).alias("rating"),
        s.lenient_bool(flag).alias("wanted"),
        s.default_for_key(name).alias("default_value"),
        s.strip_export_escapes(F.concat(F.lit("(2)(2)/out/"), kind, F.lit("(10).txt "))).alias("cleaned"),
        F.from_json("props", "k int")["k"].alias("k"),
        F.size(tags).alias("tags"),
        udfs.to_decimal(udfs.decimal_text(F.col("value").cast("decimal(20,5)")), 20, 5).alias("amount"),
        F.from_json(F.to_json(F.struct(kind)), "event_type string")["event_type"].alias("original"),
    )
