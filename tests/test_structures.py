"""Trees, graphs, names, corpus rules and windows on hand-made input."""

import re
import datetime as dt

from pyspark.sql import functions as F

from tallymark.operators import corpus as x
from tallymark.operators import hierarchy as g
from tallymark.operators import history as h
from tallymark.operators import joins, project, windows
from tallymark.specs import TextRule

CATEGORIES = "id long, parent_id long, type string, name string"


def test_tree_ignores_cycles_and_orphans(spark):
    rows = [(1, None, "d", "A"), (2, 1, "m", "B"), (3, 4, "m", "C"), (4, 3, "m", "D"), (5, 99, "m", "E"), (6, 6, "m", "F")]
    tree = g.category_tree(spark.createDataFrame(rows, CATEGORIES))
    assert sorted((r.id, r.level, r.path) for r in tree.collect()) == [(1, 1, "A"), (2, 2, "A > B")]


def test_tree_of_great_depth_takes_few_rounds(spark, monkeypatch):
    depth, rounds = 4096, []
    monkeypatch.setattr(g, "stored", lambda df, keep=g.stored: rounds.append(1) or keep(df))
    rows = [(i, i - 1 if i else None, "m", str(i)) for i in range(depth)] + [(depth + i, depth + (i + 1) % 5, "m", "loop") for i in range(5)]
    tree = g.category_tree(spark.createDataFrame([*rows, (9000, depth, "m", "below the loop")], CATEGORIES))
    found = {r.id: (r.level, r.path_ids[0], r.path_ids[-1], len(set(r.path_ids))) for r in tree.select("id", "level", "path_ids").where("id % 1000 = 5 OR id > 4090").collect()}
    assert found == {i: (i + 1, 0, i, i + 1) for i in range(depth) if i % 1000 == 5 or i > 4090}
    assert tree.count() == depth and len(rounds) <= 1 + 13


def test_tree_keeps_every_path_of_a_repeated_id(spark):
    rows = [(1, None, "d", "A"), (2, None, "d", "B"), (3, 1, "m", "C"), (3, 2, "m", "C"), (4, 3, "g", "D")]
    tree = g.category_tree(spark.createDataFrame(rows, CATEGORIES))
    assert sorted(r.path for r in tree.where("id = 4").collect()) == ["A > C > D", "B > C > D"]


def test_tree_approved_only(spark):
    rows = [(1, None, "d", "A", True), (2, 1, "m", "B", False), (3, 2, "m", "C", True)]
    tree = g.category_tree(spark.createDataFrame(rows, CATEGORIES + ", approved boolean"), approved_only=True)
    assert [r.id for r in tree.collect()] == [1]


def test_tree_search_shows_subtree_of_lowest_match(spark):
    rows = [(1, None, "d", "Loans"), (2, 1, "m", "Cards"), (3, 2, "g", "x"), (4, 1, "m", "Home loans"), (5, 4, "g", "y"), (6, None, "d", "Other")]
    tree = g.category_tree(spark.createDataFrame(rows, CATEGORIES))

    def found(text):
        return sorted(r.id for r in g.tree_search(tree, text).collect())

    assert found("loans") == [1, 4, 5]
    assert found("cards") == [1, 2, 3]
    assert found("x") == [1, 2, 3]
    assert found("nothing") == []


def layers(spark, jobs, edges):
    j = spark.createDataFrame([(i,) for i in jobs], "job_id long")
    e = spark.createDataFrame(edges, "job_id long, depends_on long")
    return {r.job_id: r.layer for r in g.execution_layers(j, e).collect()}


def test_layers_with_cycle_and_unknown_dependency(spark):
    assert layers(spark, [1, 2, 3, 4, 5, 6], [(2, 1), (3, 2), (3, 1), (4, 5), (5, 4), (6, 77)]) == {1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 3}
    assert layers(spark, [1, 2], [(2, 1), (2, 1)]) == {1: 0, 2: 1}
    assert layers(spark, [], []) == {}
    assert layers(spark, [1, 2], [(1, 2), (2, 1)]) == {1: 0, 2: 0}


def test_blocked_by_unknown_dependency(spark):
    jobs = spark.createDataFrame([(1, "completed"), (2, "pending"), (3, "pending")], "job_id long, status string")
    edges = spark.createDataFrame([(2, 1), (3, 1), (3, 9)], "job_id long, depends_on long")
    assert {r.job_id: r.blocked for r in g.blocked_jobs(jobs, edges).collect()} == {1: False, 2: False, 3: True}


def test_name_matching_order(spark):
    categories = spark.createDataFrame(
        [(1, "module", "Loan"), (2, "module", "Loans and cards"), (3, "module", "an"), (4, "domain", "Loan"), (5, "module", "Zx")],
        "id long, type string, name string",
    )
    names = spark.createDataFrame(
        [("module", " LOAN "), ("module", "loans"), ("module", "banana"), ("module", "zx"), ("module", "lo"), ("module", "N/A"), ("module", "qqq")],
        "type string, name string",
    )
    got = {r.name: (r.category_id, r.exact) for r in g.match_categories(names, categories).collect()}
    assert got == {"loan": (1, True), "loans": (2, False), "banana": (3, False), "zx": (5, True), "lo": (None, None), "qqq": (None, None)}


def test_name_matching_of_long_texts_and_common_words(spark):
    categories = spark.range(100_000).selectExpr("id", "'module' AS type", "concat('Area ', id) AS name").union(
        spark.createDataFrame([(200_000, "module", "x" * 4000), (200_001, "module", "Ä€"), (200_002, "module", "zz")], "id long, type string, name string")
    )
    names = spark.createDataFrame([("module", n) for n in ("area", "y" * 6000 + "x" * 4000, "kitchen ä€ sink", "a 77777 b", "pizzza")], "type string, name string")
    got = {r.name[:4]: r.category_id for r in g.match_categories(names, categories).collect()}
    assert got == {"area": 10000, "yyyy": 200_000, "kitc": 200_001, "a 77": None, "pizz": 200_002}


def test_name_matching_agrees_with_all_pairs(spark):
    import random

    draw = random.Random(5)
    words = ["".join(draw.choice("abc") for _ in range(draw.randrange(1, 7))) for _ in range(160)]
    known, wanted = list(enumerate(words[:80])), sorted(set(words[80:]))
    categories = spark.createDataFrame([(i, "t", w) for i, w in known], "id long, type string, name string")
    got = {r.name: r.category_id for r in g.match_categories(spark.createDataFrame([("t", w) for w in wanted], "type string, name string"), categories).collect()}
    for w in wanted:
        fit = [(k != w, -len(k), k, i) for i, k in known if k == w or (len(w) >= 3 and (k in w or w in k))]
        assert got[w] == (min(fit)[3] if fit else None), w


def test_upsert_newest_wins_and_changes_win_ties(spark):
    schema = "id int, v string, at int"
    now = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], schema)
    new = spark.createDataFrame([(1, "x", 5), (2, "old", 4), (3, "n", 1)], schema)
    assert sorted((r.id, r.v) for r in g.upsert(now, new, ["id"], "at").collect()) == [(1, "x"), (2, "b"), (3, "n")]


def test_lookup_keeps_rows(spark):
    fact = spark.createDataFrame([(1,), (1,), (None,), (9,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "id int, name string")
    out = joins.lookup(fact, dim, "k", "id", {"name": "label"})
    assert sorted((r.k or 0, r.label or "") for r in out.collect()) == [(0, ""), (1, "a"), (1, "a"), (9, "")]


def test_latest_keeps_ties_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 2, "c"), (1, 2, "d"), (1, None, "e"), (2, None, "f")], "k int, o int, v string")
    assert sorted(r.v for r in windows.latest_by_rank(df, ["k"], "o").collect()) == ["b", "c", "d", "f"]


def test_previous_and_running_across_slices(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, i, start + dt.timedelta(minutes=17 * i), i + 1) for k in ("a", None) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, i int, ts timestamp, v long")
    for slices in (None, 2, 9):
        out = windows.with_previous(df, ["k"], "ts", "i", ["v"], slices)
        assert {(r.k, r.i): r.previous_v for r in out.collect()} == {(k, i): i or None for k in ("a", None) for i in range(12)}
        total = windows.running_sum(df, ["k"], "ts", "i", "v", "s", slices)
        assert {(r.k, r.i): r.s for r in total.collect()} == {(k, i): (i + 1) * (i + 2) // 2 for k in ("a", None) for i in range(12)}


def test_reject_split_is_a_partition(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "v int")
    ok, bad = project.split_reject(df, F.col("v") > 0)
    assert (ok.count(), bad.count()) == (1, 2)


def test_projection_helpers(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    assert project.cast_columns(df, {"a": "int"}).dtypes == [("a", "int"), ("b", "string")]
    assert project.cast_dataframe(df, {"b": "int"}, strict=False).first().b is None
    assert {(r.column_name, r.status) for r in project.validate_columns(df, ["a", "c"]).collect()} == {("c", "FAIL"), ("b", "WARN")}
    parts = project.copy_stage(df, {"p": ["a"], "q": ["b", "a"]})
    assert parts["q"].columns == ["b", "a"]
    assert project.name_difference(["a", "b"], ["b", "c"]) == (["a"], ["c"])
    dates = spark.createDataFrame([("2024-01-01", 1), ("x", 2)], "LogDate string, id int")
    assert [r.id for r in project.filter_business_date(dates, dt.date(2024, 1, 1)).collect()] == [1]


def test_statement_lines_and_repeats(spark):
    text = 'a = 1\nspark.sql("SELECT 1")\nx\nspark.sql("SELECT 1")\nspark.sql("""\nSELECT 2\n""")\nspark.sql("")\nspark.sql(f"""SELECT {c}""")'
    df = spark.createDataFrame([("p", text)], "path string, text string")
    got = sorted((r.line, r.statement, r.templated) for r in x.sql_statements(df).collect())
    assert got == [(2, "SELECT 1", False), (4, "SELECT 1", False), (5, "SELECT 2", False), (9, "SELECT {c}", True)]


def test_sql_rules(spark):
    rows = ["DELETE FROM t", "update t set a = 1 where b = 2", "SELECT a FROM t WHERE  = 3", "SELECT a FROM t WHERE >= 3", "select  * from t"]
    text = "\n".join(f'spark.sql("{r}")' for r in rows)
    df = spark.createDataFrame([("p", text)], "path string, text string")
    got = sorted((r.line, r.rule) for r in x.sql_findings(x.sql_statements(df)).collect())
    assert got == [(1, "missing_where"), (3, "where_without_column"), (4, "where_operator_without_column"), (5, "select_star")]


def test_group_by_with_nested_calls(spark):
    q = "SELECT a, coalesce(sum(f(b, c)), 0) AS s, date_trunc('x', d) AS d, 'k', 3 FROM t GROUP BY a, date_trunc('x', d) ORDER BY a"
    bad = "SELECT `a`, max(b), c FROM t GROUP BY a HAVING max(b) > 1"
    df = spark.createDataFrame([("p", f'spark.sql("""{q}""")\nspark.sql("{bad}")')], "path string, text string")
    assert [r.message for r in x.group_by_findings(x.sql_statements(df)).collect()] == ["Not aggregated and not grouped: c"]


def test_credentials(spark):
    lines = ["PASSWORD='x'", "password=value", "token=os.getenv('A')", "# secret='x'", "api_key = 'abcd'"]
    df = spark.createDataFrame([("p", "\n".join(lines))], "path string, text string")
    assert [(r.line, r.rule) for r in x.line_findings(df).collect()] == [(1, "hardcoded_credentials")]
    got = sorted((r.line, r.rule) for r in x.credential_findings(df).collect())
    assert got == [(1, "credential_assignment"), (4, "credential_assignment"), (5, "credential_assignment"), (5, "literal_credential")]
    placeholder = spark.createDataFrame([("p", "password='${PW}'\nsecret = '<set>'")], "path string, text string")
    assert {r.rule for r in x.credential_findings(placeholder).collect()} == {"literal_credential"}


def test_select_expr_and_duplicate_writes(spark):
    text = "\n".join(["d.selectExpr('a')"] * 6 + ['d.writeTo("x.y").append()', 'spark.sql("INSERT INTO x.y SELECT 1")'])
    df = spark.createDataFrame([("p", text)], "path string, text string")
    assert [(r.line, r.rule) for r in x.usage_findings(df).collect()] == [(1, "excessive_select_expr")]
    assert [(r.table_name, r.writes, r.line) for r in x.duplicate_writes(df).collect()] == [("x.y", 2, 7)]


def test_rule_table_reports_invalid_pattern(spark):
    df = spark.createDataFrame([("p", "a\nDROP  table t"), ("q", "x")], "path string, text string")
    out = x.rule_table_findings(df, [TextRule("drop", "^drop\\s+table"), TextRule("bad", "(")])
    assert sorted((r.path, r.rule) for r in out.collect()) == [("p", "bad"), ("p", "drop"), ("q", "bad")]


def test_rates_of_empty_periods(spark):
    runs = spark.createDataFrame([], "request_id long, job_path string, status string, created_at timestamp, duration_seconds double")
    row = h.period_stats(runs).first()
    assert (row.total, row.success_rate, row.avg_duration) == (0, 0.0, None)


def test_net_rate_can_be_negative(spark):
    at = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, "a", "failed", at, 1.0), (2, "a", "error", at, None)], "request_id long, job_path string, status string, created_at timestamp, duration_seconds double")
    row = h.period_stats(runs).first()
    assert (row.success_rate, row.net_success_rate) == (0.0, -50.0)


def test_small_changes_are_no_trend(spark):
    at = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [(i, "a", "completed", at + dt.timedelta(hours=i), d) for i, d in enumerate([0.0, 10.0, 10.05, 20.0])],
        "request_id long, job_path string, status string, created_at timestamp, duration_seconds double",
    )
    got = {r.request_id: r.change_pct for r in h.run_trend(runs).collect()}
    assert got[0] is None and got[1] is None and got[2] is None and round(got[3], 1) == 99.0


def test_dashboard_gauges(spark):
    runs = spark.createDataFrame([], "status string, duration_seconds double")
    at = dt.datetime(2024, 1, 1)
    points = spark.createDataFrame([("q", at, 1.0), ("q", at + dt.timedelta(1), 5.0), ("w", at, 2.0)], "name string, ts timestamp, value double")
    assert h.dashboard(runs, points).first().gauges == {"q": 5.0, "w": 2.0}


def test_health_states(spark):
    now = dt.datetime(2024, 1, 1, 1)
    rows = [("a", "healthy", now), ("b", "degraded", now), ("c", "healthy", now - dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "component string, health string, checked_at timestamp")
    assert h.health(df, now, 60).first().health == "degraded"
    assert h.health(df.where("component = 'a'"), now, 60).first().health == "healthy"
    assert h.health(df.where("component = 'c'"), now, 60).first().stale == 1
    assert h.health(df.where("false"), now, 60).first().health == "unknown"


def test_dashboard_rows_hold_every_gauge(spark):
    runs = spark.createDataFrame([("completed", 1.0), ("failed", 3.0)], "status string, duration_seconds double")
    points = spark.createDataFrame([(f"g{i % 500}", dt.datetime(2024, 1, 1 + i % 3), float(i)) for i in range(1500)], "name string, ts timestamp, value double")
    rows = h.dashboard_rows(runs, points).collect()
    assert sum(r.kind == "gauge" for r in rows) == 500
    assert {r.name: r.value for r in rows if r.kind == "counter"}["success_rate"] == 50.0


def test_rules_with_broken_patterns_are_found_by_the_engine(spark):
    rules = [TextRule(name=f"r{i}", pattern="(" if i in (3, 8) else f"word{i}", severity="error") for i in range(12)]
    good, bad = x.usable_rules(spark.createDataFrame([], "path string, text string"), rules)
    assert [r.name for r in bad] == ["r3", "r8"] and len(good) == 10


def test_a_round_of_layers_joins_the_edges_and_no_other_table(spark, monkeypatch, capsys):
    plans, real = [], g.stored

    def record(df):
        capsys.readouterr()
        df.explain()
        if "free" in df.columns:
            plans.append(capsys.readouterr().out)
        return real(df)

    monkeypatch.setattr(g, "stored", record)
    jobs = spark.createDataFrame([(i,) for i in range(1, 16)], "job_id long")
    edges = spark.createDataFrame([(i, i // 2) for i in range(2, 16)], "job_id long, depends_on long")
    placed = dict(g.execution_layers(jobs, edges).collect())
    assert placed == {i: i.bit_length() - 1 for i in range(1, 16)}
    assert len(plans) == 4 and all(len(re.findall(r"(?:BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)", p)) == 1 for p in plans)
