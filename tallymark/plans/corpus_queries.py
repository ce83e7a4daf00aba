"""Registered corpus scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import corpus as c
from tallymark.plans.fixtures import FIXTURES, fixture, read, run_sql, spread, with_fixtures
from tallymark.plans.registry import query
from tallymark.sources import corpora
from tallymark.specs import TextRule

_LINES = """lines AS (SELECT path, unnest(string_split(text, chr(10))) AS content,
                         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM code)"""


def _code(spark, sf_dir):
    # Rows of parts cross, not the texts that are made of them.
    return run_sql(spark, sf_dir, FIXTURES["code"], spread)


@query(
    "corpus_line_rules",
    with_fixtures(
        """
        SELECT path, CAST(line AS INT) AS line, rule, severity FROM (
            SELECT path, line, 'bare_except' AS rule, 'WARNING' AS severity FROM lines WHERE trim(content) = 'except:'
            UNION ALL SELECT path, line, 'collect_without_limit', 'WARNING' FROM lines
                WHERE contains(content, '.collect()') AND NOT contains(content, '.limit(')
            UNION ALL SELECT path, line, 'hardcoded_credentials', 'ERROR' FROM lines
                WHERE contains(lower(content), 'password=') AND contains(content, '"')
            UNION ALL SELECT path, line, 's3a_protocol', 'ERROR' FROM lines WHERE contains(content, 's3a://')
            UNION ALL SELECT path, line, 'print_statements', 'INFO' FROM lines
                WHERE starts_with(content, 'print(') AND NOT contains(path, 'debug')
        ) f""",
        _LINES,
    ),
)
def corpus_line_rules(spark, sf_dir):
    return c.line_findings(_code(spark, sf_dir)).select("path", "line", "rule", "severity")


@query(
    "corpus_credentials",
    with_fixtures(
        "SELECT path, CAST(line AS INT) AS line, 'Hardcoded password' AS message FROM lines"
        """ WHERE regexp_matches(content, 'password\\s*=\\s*["''][^"'']{3,}["'']', 'i')"""
        " UNION ALL SELECT path, CAST(line AS INT), 'Credential assigned in code' FROM lines"
        """ WHERE regexp_matches(content, 'password\\s*=\\s*["''][^<{$]', 'i')""",
        _LINES,
    ),
)
def corpus_credentials(spark, sf_dir):
    return c.credential_findings(_code(spark, sf_dir)).select("path", "line", "message")


@query(
    "corpus_imports",
    with_fixtures(
        """
        SELECT path, CAST(line AS INT) AS line, rule FROM (
            SELECT path, line, 'wildcard_import' AS rule FROM lines WHERE regexp_matches(content, '^\\s*from\\s+\\S+\\s+import\\s+\\*')
            UNION ALL SELECT path, line, 'duplicate_import' FROM (
                SELECT *, row_number() OVER (PARTITION BY path, m ORDER BY line) AS rn FROM (
                    SELECT *, regexp_extract(content, '^\\s*(?:from|import)\\s+(\\S+)', 1) AS m FROM lines) a WHERE m <> '') b WHERE rn > 1
            UNION ALL SELECT path, line, 'deprecated_module' FROM lines
                WHERE contains(regexp_extract(content, '^\\s*(?:from|import)\\s+(\\S+)', 1), 'pyspark.mllib')
        ) f""",
        _LINES,
    ),
)
def corpus_imports(spark, sf_dir):
    return c.import_findings(_code(spark, sf_dir)).select("path", "line", "rule")


@query(
    "corpus_usage",
    with_fixtures(
        """
        SELECT path, CAST(line AS INT) AS line, rule FROM (
            SELECT path, line, 'sql_fstring' AS rule FROM lines WHERE contains(content, 'f"') AND contains(content, 'spark.sql')
            UNION ALL SELECT path, line, 'status_literals' FROM lines WHERE contains(content, 'STAT IN')) f""",
        _LINES,
    ),
)
def corpus_usage(spark, sf_dir):
    return c.usage_findings(_code(spark, sf_dir)).select("path", "line", "rule")


@query(
    "corpus_uncached_reuse",
    with_fixtures(
        """
        SELECT path, name, CAST(min(line) AS INT) AS line, count(*) AS uses FROM (
            SELECT l.path, l.line, l.content, v.name FROM lines l
            JOIN (SELECT path, name, min(line) AS born FROM (
                    SELECT path, line, regexp_extract(content, '^\\s*(\\w+)\\s*=.*(?:spark\\.sql|spark\\.read|\\.join|\\.select)', 1) AS name
                    FROM lines) x WHERE name <> '' GROUP BY path, name) v ON v.path = l.path
            WHERE l.line >= v.born AND list_contains(regexp_extract_all(l.content, '\\w+'), v.name)) u
        GROUP BY path, name
        HAVING count(*) >= 3 AND NOT bool_or(contains(content, name || '.cache('))""",
        _LINES,
    ),
)
def corpus_uncached_reuse(spark, sf_dir):
    return c.uncached_reuse(_code(spark, sf_dir))


_EXPECTED_SQL = """
    SELECT concat('/jobs/domain-', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 10 = 0 THEN '_debug.py' ELSE '.py' END) AS path, q AS statement, templated
    FROM (SELECT p_partkey, concat('SELECT * FROM db.', p_brand) AS q, false AS templated FROM part
          UNION ALL SELECT p_partkey, concat('DELETE FROM t_', CAST(p_size AS VARCHAR)), false FROM part
          UNION ALL SELECT p_partkey, concat('SELECT a, b, sum(c) AS s FROM x', CAST(p_size AS VARCHAR), ' JOIN y', chr(10),
                           'ON x.i = y.i GROUP BY a', CASE WHEN p_size % 3 = 0 THEN ', b' ELSE '' END), false FROM part
          UNION ALL SELECT p_partkey, 'SELECT 1 FROM {t}', true FROM part
          UNION ALL SELECT p_partkey, concat('INSERT INTO db.out', CAST(p_size AS VARCHAR), ' SELECT 1'), false FROM part WHERE p_partkey % 9 = 0) s"""


@query(
    "corpus_sql_statements",
    with_fixtures(
        f"""
        SELECT e.path, e.statement, e.templated,
               CAST(length(split_part(text, e.statement, 1)) - length(replace(split_part(text, e.statement, 1), chr(10), '')) + 1
                    - CASE WHEN starts_with(e.statement, 'SELECT a, b') THEN 1 ELSE 0 END AS INT) AS line
        FROM ({_EXPECTED_SQL}) e JOIN code c ON c.path = e.path"""
    ),
)
def corpus_sql_statements(spark, sf_dir):
    return c.sql_statements(_code(spark, sf_dir))


@query(
    "corpus_sql_rules",
    f"""
    SELECT path, CASE WHEN starts_with(statement, 'DELETE') THEN 'missing_where' ELSE 'select_star' END AS rule
    FROM ({_EXPECTED_SQL}) e WHERE starts_with(statement, 'DELETE') OR starts_with(statement, 'SELECT *')""",
)
def corpus_sql_rules(spark, sf_dir):
    statements = c.sql_statements(_code(spark, sf_dir))
    return c.sql_findings(statements).select("path", "rule")


@query(
    "corpus_lineage",
    f"""
    SELECT DISTINCT path, unnest(regexp_extract_all(statement, '(?:FROM|JOIN)\\s+([a-zA-Z0-9_\\.]+)', 1)) AS table_name
    FROM ({_EXPECTED_SQL}) e""",
)
def corpus_lineage(spark, sf_dir):
    return c.table_lineage(c.sql_statements(_code(spark, sf_dir)))


@query(
    "corpus_group_by",
    f"SELECT path, 'Not aggregated and not grouped: b' AS message FROM ({_EXPECTED_SQL}) e"
    " WHERE starts_with(statement, 'SELECT a, b') AND ends_with(statement, 'GROUP BY a')",
)
def corpus_group_by(spark, sf_dir):
    return c.group_by_findings(c.sql_statements(_code(spark, sf_dir))).select("path", "message")


@query(
    "corpus_duplicate_writes",
    with_fixtures(
        "SELECT path, concat('db.out', regexp_extract(text, 'writeTo\\(\"db.out([0-9]+)', 1)) AS table_name,"
        " CAST(2 AS BIGINT) AS writes FROM code WHERE contains(text, 'INSERT INTO')"
    ),
)
def corpus_duplicate_writes(spark, sf_dir):
    return c.duplicate_writes(_code(spark, sf_dir)).select("path", "table_name", "writes")


@query(
    "corpus_parameter_keys",
    with_fixtures(
        "SELECT path, 'RunParameterSet' AS parameter_set, 'BusinessDate' AS key FROM code UNION ALL"
        " SELECT path, 'LoadParamSet', regexp_extract(text, 'LoadParamSet\\[\"(K[0-9])', 1) FROM code"
    ),
)
def corpus_parameter_keys(spark, sf_dir):
    return c.parameter_keys(_code(spark, sf_dir))


_METRICS = """
    SELECT path, CAST(len(l) AS INT) AS total_lines,
           CAST(len(list_filter(l, lambda x: x <> '' AND NOT starts_with(x, '#'))) AS INT) AS code_lines,
           CAST(len(list_filter(l, lambda x: starts_with(x, '#'))) AS INT) AS comment_lines,
           CAST(len(list_filter(l, lambda x: x = '')) AS INT) AS blank_lines,
           CAST(len(regexp_extract_all(text, 'spark\\.sql\\s*\\(')) AS INT) AS sql_queries,
           CAST(len(regexp_extract_all(text, '\\.join\\s*\\(')) AS INT) AS joins,
           CAST(len(regexp_extract_all(text, '\\.(groupBy|agg)\\s*\\(')) AS INT) AS aggregations,
           CAST(len(regexp_extract_all(text, '\\.(select|withColumn|filter|where)\\s*\\(')) AS INT) AS transformations,
           CAST(len(list_distinct(regexp_extract_all(text, '\\b\\w+_df\\b|\\bDataFrame\\b'))) AS INT) AS dataframes,
           CAST(len(list_distinct(regexp_extract_all(text, '(?i)FROM\\s+([A-Za-z_][A-Za-z0-9_\\.]*)', 1))) AS INT) AS source_tables,
           CAST(len(regexp_extract_all(text, 'register_udfs|udf\\s*\\(|@udf')) AS INT) AS udfs
    FROM (SELECT path, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS l
          FROM files) f"""
_DOCUMENTS = "SELECT concat('doc_', CAST(doc_id AS VARCHAR(20))) AS path, text FROM documents"
_FILES = f"files AS (SELECT path, text FROM code UNION ALL {_DOCUMENTS})"


def _files(spark, sf_dir):
    return _code(spark, sf_dir).union(run_sql(spark, sf_dir, _DOCUMENTS))


@query("corpus_metrics", with_fixtures(_METRICS, _FILES))
def corpus_metrics(spark, sf_dir):
    return c.code_metrics(_files(spark, sf_dir))


@query(
    "corpus_complexity",
    with_fixtures(
        """
        SELECT path, s AS complexity_score, CASE WHEN s < 30 THEN 'low' WHEN s < 70 THEN 'medium' ELSE 'high' END AS complexity
        FROM (SELECT path, CAST(least(greatest(floor(code_lines / 100.0::DOUBLE * 0.1 + sql_queries * 5 + joins * 10 + aggregations * 8
                     + transformations * 3 + dataframes * 2 + source_tables * 5 + udfs * 7), 0), 100) AS INT) AS s FROM m) x""",
        _FILES,
        f"m AS ({_METRICS})",
    ),
)
def corpus_complexity(spark, sf_dir):
    return c.complexity(c.code_metrics(_files(spark, sf_dir)))


@query(
    "corpus_ddl_statements",
    """
    SELECT concat('ddl_', CAST(s_suppkey AS VARCHAR), '.sql') AS path, CAST(n AS INT) AS statement_number, st AS statement
    FROM (SELECT s_suppkey, 1 AS n, concat('CREATE TABLE t', CAST(s_suppkey AS VARCHAR), ' (a INT', CASE WHEN s_suppkey % 2 = 0 THEN ', b FLOAT' ELSE '' END, ')') AS st FROM supplier
          UNION ALL SELECT s_suppkey, 2, 'drop table old' FROM supplier WHERE s_suppkey % 3 = 0
          UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 2 END, concat('GRANT SELECT ON t', CAST(s_suppkey AS VARCHAR), ' TO PUBLIC') FROM supplier) d""",
)
def corpus_ddl_statements(spark, sf_dir):
    return c.ddl_statements(fixture(spark, sf_dir, "scripts"))


DDL_RULES = (
    TextRule("no_drop", r"drop\s+table", "ERROR", "DROP TABLE found"),
    TextRule("no_float", r"\bfloat\b"),
    TextRule("broken", "([unclosed", "ERROR"),
)


@query(
    "corpus_rule_table",
    with_fixtures(
        r"""
        SELECT path, 'no_drop' AS rule, 'ERROR' AS severity, 'DROP TABLE found' AS message FROM scripts WHERE regexp_matches(text, 'drop\s+table', 'i')
        UNION ALL SELECT path, 'no_float', 'WARNING', 'Matched pattern: \bfloat\b' FROM scripts WHERE regexp_matches(text, '\bfloat\b', 'i')
        UNION ALL SELECT path, 'broken', 'WARNING', 'Invalid regex in rule ''broken'': ([unclosed' FROM scripts"""
    ),
)
def corpus_rule_table(spark, sf_dir):
    return c.rule_table_findings(fixture(spark, sf_dir, "scripts"), DDL_RULES)


@query(
    "corpus_missing_assets",
    "SELECT concat('/metadata/out/', c_custkey, '_metadata.json') AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def corpus_missing_assets(spark, sf_dir):
    def asset(key):
        return F.concat(F.lit("/metadata/out/"), F.col(key).cast("string"), F.lit("_metadata.json")).alias("path")

    expected = read(spark, sf_dir, "customer").select(asset("c_custkey"))
    return corpora.missing_assets(expected, read(spark, sf_dir, "orders").select(asset("o_custkey")))


_EXPORT = "concat('export_', CAST(s_suppkey AS VARCHAR), '.xml') AS path"


@query("markup_jobs", f"SELECT {_EXPORT}, s_name AS job_name FROM supplier")
def markup_jobs(spark, sf_dir):
    return corpora.export_jobs(fixture(spark, sf_dir, "exports"))


@query(
    "markup_columns",
    f"""
    SELECT {_EXPORT}, 0 AS position, concat('KEY_', CAST(s_suppkey AS VARCHAR)) AS name, '12' AS sql_type, NULL AS precision, NULL AS scale, '0' AS nullable FROM supplier
    UNION ALL SELECT {_EXPORT}, 1, 'AMOUNT', '3', CAST(10 + s_suppkey % 5 AS VARCHAR), '2', NULL FROM supplier
    UNION ALL SELECT {_EXPORT}, 2, 'DAY', '9', NULL, NULL, NULL FROM supplier WHERE s_suppkey % 2 = 0""",
)
def markup_columns(spark, sf_dir):
    return corpora.export_columns(fixture(spark, sf_dir, "exports"))


@query(
    "markup_expected_schema",
    f"""
    SELECT {_EXPORT}, concat('KEY_', CAST(s_suppkey AS VARCHAR)) AS name, 'string' AS type, false AS nullable FROM supplier
    UNION ALL SELECT {_EXPORT}, 'AMOUNT', concat('decimal(', CAST(10 + s_suppkey % 5 AS VARCHAR), ',2)'), true FROM supplier
    UNION ALL SELECT {_EXPORT}, 'DAY', 'date', true FROM supplier WHERE s_suppkey % 2 = 0""",
)
def markup_expected_schema(spark, sf_dir):
    return corpora.expected_schema(corpora.export_columns(fixture(spark, sf_dir, "exports"))).drop("position")


@query(
    "markup_parameters",
    f"SELECT {_EXPORT}, concat('RunDate', CAST(s_nationkey AS VARCHAR)) AS name, 'a & b' AS default_value, 'x <> y' AS prompt FROM supplier",
)
def markup_parameters(spark, sf_dir):
    return corpora.export_parameters(fixture(spark, sf_dir, "exports"))


@query(
    "markup_outputs",
    f"SELECT {_EXPORT}, 'file_out' AS stage_name, concat('P', CAST(s_suppkey AS VARCHAR)) AS pin_id,"
    " concat('/out/', s_name, '.txt') AS file_template, 'record (a:int)' AS record_schema FROM supplier",
)
def markup_outputs(spark, sf_dir):
    return corpora.export_outputs(fixture(spark, sf_dir, "exports"))


_UNESCAPED = "x"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_char}')"


@query(
    "markup_extract",
    f"""
    SELECT path, CAST(position AS INT) AS position, trim({_UNESCAPED}) AS value
    FROM (SELECT path, position, regexp_replace(b, '<[^>]*>', '', 'g') AS x
          FROM (SELECT CAST(page_id AS VARCHAR) AS path, unnest(m) AS b, unnest(range(0, len(m))) AS position
                FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS m FROM pages) p) q) r""",
)
def markup_extract(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return corpora.element_texts(pages, "li")


# --- the same rules on the given texts -------------------------------------

_DOC_LINES = f"""lines AS (SELECT path, unnest(string_split(text, chr(10))) AS content,
                         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM ({_DOCUMENTS}) d)"""


def _documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), "text"
    )


@query(
    "corpus_documents_line_rules",
    f"""
    WITH {_DOC_LINES}, plain AS (SELECT * FROM lines WHERE NOT starts_with(trim(content), '#'))
    SELECT path, CAST(line AS INT) AS line, rule FROM (
        SELECT path, line, 'bare_except' AS rule FROM plain WHERE trim(content) = 'except:' OR starts_with(trim(content), 'except: ')
        UNION ALL SELECT path, line, 'collect_without_limit' FROM plain
            WHERE contains(content, '.collect()') AND NOT contains(content, '.limit(') AND NOT contains(content, '.take(')
        UNION ALL SELECT path, line, 'hardcoded_credentials' FROM plain
            WHERE regexp_matches(lower(content), '(password|secret|api_key|token|apikey)=') AND regexp_matches(content, '["'']')
                  AND NOT contains(content, 'os.environ') AND NOT contains(content, 'os.getenv')
        UNION ALL SELECT path, line, 's3a_protocol' FROM plain WHERE contains(content, 's3a://')
        UNION ALL SELECT path, line, 'print_statements' FROM plain WHERE starts_with(trim(content), 'print(')
    ) f""",
)
def corpus_documents_line_rules(spark, sf_dir):
    return c.line_findings(_documents(spark, sf_dir)).select("path", "line", "rule")


@query(
    "corpus_documents_credentials",
    f"""
    WITH {_DOC_LINES}
    SELECT path, CAST(line AS INT) AS line, message FROM (
        SELECT path, line, 'Hardcoded password' AS message FROM lines WHERE regexp_matches(content, 'password\\s*=\\s*["''][^"'']{{3,}}["'']', 'i')
        UNION ALL SELECT path, line, 'Hardcoded secret' FROM lines WHERE regexp_matches(content, 'secret\\s*=\\s*["''][^"'']{{3,}}["'']', 'i')
        UNION ALL SELECT path, line, 'Hardcoded API key' FROM lines WHERE regexp_matches(content, 'api[_-]?key\\s*=\\s*["''][^"'']{{3,}}["'']', 'i')
        UNION ALL SELECT path, line, 'Hardcoded access key' FROM lines WHERE regexp_matches(content, 'access[_-]?key\\s*=\\s*["''][^"'']{{10,}}["'']', 'i')
        UNION ALL SELECT path, line, 'Credential assigned in code' FROM lines
            WHERE regexp_matches(content, '(password|api[_-]?key|secret)\\s*=\\s*["'']([^<{{$]|$)', 'i')
    ) f""",
)
def corpus_documents_credentials(spark, sf_dir):
    return c.credential_findings(_documents(spark, sf_dir)).select("path", "line", "message")


@query(
    "corpus_documents_imports",
    f"""
    WITH {_DOC_LINES}, m AS (
        SELECT *, regexp_extract(content, '^\\s*(?:from|import)\\s+(\\S+)', 1) AS module FROM lines)
    SELECT path, CAST(line AS INT) AS line, 'duplicate_import' AS rule
    FROM (SELECT *, row_number() OVER (PARTITION BY path, module ORDER BY line) AS rn FROM m WHERE module <> '') x WHERE rn > 1""",
)
def corpus_documents_imports(spark, sf_dir):
    found = c.import_findings(_documents(spark, sf_dir))
    return found.where("rule = 'duplicate_import'").select("path", "line", "rule")


@query(
    "corpus_documents_usage",
    f"""
    WITH {_DOC_LINES}
    SELECT path, CAST(line AS INT) AS line, rule FROM (
        SELECT path, line, 'sql_fstring' AS rule FROM lines WHERE contains(content, 'spark.sql') AND regexp_matches(content, '\\bf("|\'\'\'\'\'\')')
        UNION ALL SELECT path, line, 'status_literals' FROM lines
            WHERE regexp_matches(content, 'STAT(US)? IN') AND regexp_matches(content, '\'\'[0-9]+\'\'')) f""",
)
def corpus_documents_usage(spark, sf_dir):
    return c.usage_findings(_documents(spark, sf_dir)).select("path", "line", "rule")


@query(
    "corpus_documents_sql",
    f"""
    SELECT path, CAST(count(*) AS BIGINT) AS statements FROM (
        SELECT path, unnest(regexp_extract_all(text, 'spark\\.sql\\s*\\(\\s*"([^"]+)"', 1)) AS s FROM ({_DOCUMENTS}) d) x
    WHERE trim(s) <> '' GROUP BY path""",
)
def corpus_documents_sql(spark, sf_dir):
    found = c.sql_statements(_documents(spark, sf_dir))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("statements"))
