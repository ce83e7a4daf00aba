from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallymark.operators import compare as c
from tallymark.sources import corpora, readers, sinks
from tallymark.specs import CompareSpec, SourceSpec


@pytest.fixture
def database(spark, tmp_path):
    name = f"db_{abs(hash(str(tmp_path))) % 10**8}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_addresses():
    assert SourceSpec.parse("CSV:/a:b") == SourceSpec(format="csv", path="/a:b")
    assert SourceSpec.parse("table:x.y").table == "x.y"
    for bad in ("nothing", "xls:/a"):
        with pytest.raises(ValueError):
            SourceSpec.parse(bad)


def test_read_and_golden_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    sinks.write_parquet(df, f"{tmp_path}/p")
    assert readers.read_dataset(spark, f"parquet:{tmp_path}/p").count() == 2
    df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/c")
    typed = readers.read_golden_csv(spark, f"{tmp_path}/c", "id int, v string")
    assert sorted(map(tuple, typed.collect())) == [(1, "a"), (2, None)]
    assert readers.read_golden_csv(spark, f"{tmp_path}/c").schema["id"].dataType.simpleString() == "int"
    assert readers.read_dataset(spark, f"csv:{tmp_path}/c").columns == ["id", "v"]


def test_resolve_table(spark, database):
    spark.range(3).write.saveAsTable(f"{database}.t")
    assert readers.resolve_table(spark, f"{database}.t") == f"{database}.t"
    assert readers.resolve_table(spark, "t", default_database=database) == f"{database}.t"
    with pytest.raises(ValueError, match="spark_catalog.default.none"):
        readers.resolve_table(spark, "none")
    assert readers.table_candidates("a.b.c") == ["a.b.c"]


def test_parameters_are_values_not_text(spark):
    df = spark.createDataFrame([("x' OR '1'='1",), ("y",)], "v string")
    out = readers.sql_source(spark, "SELECT v FROM {t} WHERE v = :v", {"v": "x' OR '1'='1"}, {"v": "string"}, frames={"t": df})
    assert out.count() == 1


def test_stage_queries_agree_with_the_job(spark):
    from tallymark.plans import loan_fact
    from tallymark.plans.fixtures import fixture

    sf = "/root/testdata/sf0.001"
    day = date(1998, 6, 15)
    accounts, dates = fixture(spark, sf, "loan_accounts"), fixture(spark, sf, "loan_dates")
    values = {
        "closed": ["10", "40", "45"], "min_date": date(1899, 12, 31), "max_date": date(2999, 12, 31),
        "business_date": day,
    }
    out = readers.sql_source(
        spark, readers.stage_query("V138S0"), values, loan_fact.ACCOUNT_TYPES,
        frames={"loan_master": accounts, "date_dimension": dates},
    )
    assert c.diff_multiset(out, loan_fact.account_detail(accounts, dates, day)).count() == 0
    advances = fixture(spark, sf, "loan_advances")
    raw = readers.sql_source(
        spark, readers.stage_query("V0S126"), values, loan_fact.ADVANCE_TYPES,
        frames={"advance_detail": advances, "loan_account_detail": accounts, "date_dimension": dates},
    )
    summed = raw.groupBy("ACCT_NBR").agg(F.max("FIRST_ADV_DATE").alias("FIRST_ADV_DATE"), F.sum("FIRST_AMT_ADV").alias("FIRST_AMT_ADV"))
    want = loan_fact.advance_detail(advances, accounts, dates, day)
    assert c.diff_by_key(summed, want, CompareSpec(keys=("ACCT_NBR",))).count() == 0
    with pytest.raises(ValueError):
        readers.stage_query("V0")


def test_tables(spark, database):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    sinks.replace_table(df, f"{database}.t")
    sinks.append_table(df.select("v", "id"), f"{database}.t")
    assert sorted(map(tuple, spark.table(f"{database}.t").collect())) == [(1, "a"), (1, "a")]
    sinks.replace_table(df, f"{database}.t")
    assert spark.table(f"{database}.t").count() == 1
    sinks.append_table(df, f"{database}.fresh")
    assert spark.table(f"{database}.fresh").count() == 1


def test_run_log(spark, database):
    runs = spark.createDataFrame([("r1", 0), ("r2", 3)], "job_id string, findings int")
    for _ in range(2):
        sinks.append_runs(runs, f"{database}.runs", findings_column="findings")
    log = spark.table(f"{database}.runs")
    assert dict(log.dtypes) == sinks.RUN_COLUMNS
    assert sorted((r.job_id, r.status, r.passed) for r in log.collect()) == [
        ("r1", "PASSED", True), ("r1", "PASSED", True), ("r2", "FAILED", False), ("r2", "FAILED", False),
    ]


def test_diff_report_and_summary(spark, tmp_path):
    left = spark.range(10).selectExpr("id AS k", "id AS v")
    right = spark.range(5).selectExpr("id AS k", "id + 1 AS v")
    spec = CompareSpec(keys=("k",))
    folder = sinks.write_diff_report(c.diff_by_key(left, right, spec), ["k"], f"{tmp_path}/r", 3)
    shown = spark.read.option("header", True).csv(f"{folder}/mismatches")
    assert [r.k for r in shown.collect()] == ["0", "1", "2"]
    metrics = {r.metric: r.value for r in spark.read.option("header", True).csv(f"{folder}/summary").collect()}
    assert metrics == {"mismatch_count": "10", "sample_limit": "3"}
    sinks.write_summary(c.compare_summary(left, right, spec), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first().diff.missing_keys == 5


def test_tee(spark, tmp_path):
    df = spark.range(4)
    capture = sinks.capture_folder(f"{tmp_path}/cap", "/jobs/load.v2.py", "r1")
    assert capture.endswith("/cap/load.v2/r1")
    assert sinks.capture_folder("x", "/j/a.py", "r", "job_only") == "x/a"
    assert sinks.capture_folder("x", "/j/a.py", "r", "flat") == "x"
    assert sinks.tee_write(df, f"{tmp_path}/out data", capture)
    assert spark.read.parquet(f"{capture}/{sinks.capture_name(f'{tmp_path}/out data')}").count() == 4
    assert sinks.tee_write(df, f"{tmp_path}/other/out data", capture)
    assert sinks.tee_write(spark.range(2), f"{tmp_path}/out data", capture, mode="append")
    assert spark.read.parquet(f"{tmp_path}/out data").count() == 6
    assert spark.read.parquet(f"{capture}/{sinks.capture_name(f'{tmp_path}/out data')}").count() == 2
    assert spark.read.parquet(f"{capture}/{sinks.capture_name(f'{tmp_path}/other/out data')}").count() == 4
    assert not sinks.tee_write(df, f"{tmp_path}/out2", "nosuchscheme://x")
    assert spark.read.parquet(f"{tmp_path}/out2").count() == 4


def test_logs_and_retention(spark, database, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 4, 5)) for i in range(20)] + [(99, None)]
    logs = spark.createDataFrame(rows, "id int, timestamp timestamp")
    sinks.write_logs(logs.where("timestamp IS NOT NULL"), f"{tmp_path}/logs")
    stored = spark.read.parquet(f"{tmp_path}/logs")
    assert stored.where("log_date = DATE '2024-01-02'").count() == 5
    kept, removed = sinks.split_expired(logs, "timestamp", date(2024, 1, 10), 7)
    assert (kept.count(), removed.count()) == (11, 10)
    sinks.replace_table(stored, f"{database}.logs", partition_by=["log_date"])
    assert sinks.drop_expired_partitions(spark, f"{database}.logs", "log_date", date(2024, 1, 10), 7) == ["2024-01-01", "2024-01-02"]
    assert spark.table(f"{database}.logs").count() == 10


def test_corpus_files(spark, tmp_path):
    for name in ("a.py", "sub/b.py", "sub/test_c.py", "sub/__init__.py", "d.txt", "sub/e_test.py", "skip/f.py", "sub/[g.py"):
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"# {name}\nx = 1\n")
    found = corpora.read_corpus(spark, [str(tmp_path / "src")], ["*.py"], ["*/skip/*"])
    assert sorted(r.path.split("/src/")[1] for r in found.collect()) == ["a.py", "sub/%5Bg.py", "sub/b.py"]
    assert found.where("path LIKE '%/a.py'").first().text == "# a.py\nx = 1\n"


def test_exports_survive_broken_markup(spark):
    text = (
        "junk<DSExport><Job Identifier='J&amp;1'>\x01<SubRecord Name='OutputColumn'>"
        "<Property Name=\"Name\">A & B</Property><Property Name='SqlType'>9</Property></SubRecord>"
        "<SubRecord Name='OutputColumn'><Property Name='SqlType'>9</Property></SubRecord>"
    )
    df = spark.createDataFrame([("p", text), ("q", "no markup")], "path string, text string")
    assert {r.path: r.job_name for r in corpora.export_jobs(df).collect()} == {"p": "J&1", "q": "unknown_job"}
    assert [(r.name, r.sql_type) for r in corpora.export_columns(df).collect()] == [("A & B", "9")]
    assert corpora.export_outputs(df).count() == 0
    cleaned = df.select(corpora.clean_markup(F.col("text")).alias("t")).first().t
    assert "A &amp; B" in cleaned and "\x01" not in cleaned and cleaned.startswith("<DSExport")
    whole = spark.createDataFrame([("<DSExport><P>a <> b <none></P></DSExport> tail",)], "t string")
    assert whole.select(corpora.clean_markup(F.col("t")).alias("t")).first().t == "<DSExport><P>a &lt;> b &lt;none&gt;</P></DSExport>"
