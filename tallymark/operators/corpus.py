"""Text rules over a corpus ``(path, text)`` as distributed scans.

Line rules look at exploded lines, statement rules at the SQL texts found in
the files. Whole texts are read; nothing is cut. Each rule set is a list of
column conditions inside one projection, so a corpus is scanned once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.scalars import complexity_level
from tallymark.operators.shape import explode_present
from tallymark.specs import TextRule

FINDING_COLUMNS = ("path", "line", "rule", "severity", "message", "suggestion")


def lines(corpus: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return corpus.select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "content")).select(
        "path", (F.col("line") + 1).alias("line"), "content"
    )


def stripped(text: Column) -> Column:
    """Text without white space at both ends."""
    return F.trim(text, F.lit(" \t\n\r\f\x0b"))


def _finding(rule: str, severity: str, message: Column | str, suggestion: str) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        F.lit(suggestion).alias("suggestion"),
    )


def _findings(rows: DataFrame, checks: Sequence[tuple[Column, Column]]) -> DataFrame:
    return explode_present(rows, ["path", "line"], checks)


# --- line rules ------------------------------------------------------------

# Texts that announce a credential on a line.
CREDENTIAL_MARKS = ("password=", "secret=", "api_key=", "token=", "apikey=")


def line_findings(corpus: DataFrame) -> DataFrame:
    """Bare except, collect without limit, credentials, forbidden protocol and print; comment lines are skipped."""
    line, text = F.col("content"), stripped(F.col("content"))
    low = F.lower(line)
    rows = lines(corpus).where(~text.startswith("#"))
    quoted = line.contains('"') | line.contains("'")
    from_environment = line.contains("os.environ") | line.contains("os.getenv")
    mark = F.coalesce(*[F.when(low.contains(m), F.lit(m)) for m in CREDENTIAL_MARKS])
    helper = F.lower("path").rlike("debug|test")
    return _findings(
        rows,
        [
            (
                (text == "except:") | text.startswith("except: "),
                _finding("bare_except", "WARNING", "Bare except clause catches every exception", "Catch specific exceptions"),
            ),
            (
                text.contains(".collect()") & ~text.contains(".limit(") & ~text.contains(".take("),
                _finding("collect_without_limit", "WARNING", "collect() without a limit", "Limit the rows or write them"),
            ),
            (
                mark.isNotNull() & quoted & ~from_environment,
                _finding(
                    "hardcoded_credentials",
                    "ERROR",
                    F.concat(F.lit("Possible hardcoded credential: "), mark),
                    "Read it from the environment or a secret store",
                ),
            ),
            (
                line.contains("s3a://"),
                _finding("s3a_protocol", "ERROR", "s3a:// is not allowed", "Use s3://"),
            ),
            (
                text.startswith("print(") & ~helper,
                _finding("print_statements", "INFO", "print() in production code", "Use logging"),
            ),
        ],
    )


# Patterns of literal credentials and their message.
CREDENTIAL_PATTERNS = (
    (r"""(?i)password\s*=\s*["'][^"']{3,}["']""", "Hardcoded password"),
    (r"""(?i)secret\s*=\s*["'][^"']{3,}["']""", "Hardcoded secret"),
    (r"""(?i)api[_-]?key\s*=\s*["'][^"']{3,}["']""", "Hardcoded API key"),
    (r"""(?i)access[_-]?key\s*=\s*["'][^"']{10,}["']""", "Hardcoded access key"),
)


# Fixed value: assignment of a credential whose text does not start like a placeholder.
CREDENTIAL_ASSIGNMENT = r"""(?i)(password|api[_-]?key|secret)\s*=\s*["'](?!<|\{|\$)"""


def credential_findings(corpus: DataFrame) -> DataFrame:
    """Literal credentials by pattern, and assignments of anything but a placeholder; one finding per line and rule."""
    content = F.col("content")
    assigned = _finding("credential_assignment", "CRITICAL", "Credential assigned in code", "Use a secret store")
    return _findings(
        lines(corpus),
        [
            (content.rlike(p), _finding("literal_credential", "CRITICAL", m, "Use a secret store"))
            for p, m in CREDENTIAL_PATTERNS
        ]
        + [(content.rlike(CREDENTIAL_ASSIGNMENT), assigned)],
    )


# Deprecated modules and the advice for each.
DEPRECATED_MODULES = {
    "pyspark.mllib": "Use pyspark.ml instead of pyspark.mllib",
    "pandas.core.common": "This module is deprecated",
}


def import_findings(corpus: DataFrame, deprecated: dict[str, str] | None = None) -> DataFrame:
    """Wildcard, duplicate and deprecated imports."""
    module = F.regexp_extract("content", r"^\s*(?:from|import)\s+(\S+)", 1)
    rows = lines(corpus).select("*", module.alias("module")).where(F.col("module") != "")
    # The window holds the import lines of one module in one file.
    first = F.min("line").over(Window.partitionBy("path", "module"))
    rows = rows.withColumn("first_line", first)
    checks = [
        (
            F.col("content").rlike(r"^\s*from\s+\S+\s+import\s+\*"),
            _finding("wildcard_import", "WARNING", "Wildcard import", "Import names explicitly"),
        ),
        (
            F.col("line") > F.col("first_line"),
            _finding(
                "duplicate_import",
                "INFO",
                F.concat(F.lit("Duplicate import of "), F.col("module"), F.lit(", first at line "), F.col("first_line").cast("string")),
                "Remove the duplicate",
            ),
        ),
    ]
    for name, advice in (DEPRECATED_MODULES if deprecated is None else deprecated).items():
        checks.append(
            (
                F.col("module").contains(name),
                _finding("deprecated_module", "WARNING", F.concat(F.lit("Deprecated module: "), F.col("module")), advice),
            )
        )
    return _findings(rows, checks)


def usage_findings(corpus: DataFrame) -> DataFrame:
    """f-string SQL, status code literals, and more than five selectExpr calls per file."""
    line = F.col("content")
    codes = F.regexp_extract_all(line, F.lit(r"'(\d+)'"), F.lit(1))
    per_line = _findings(
        lines(corpus),
        [
            (
                line.contains("spark.sql") & line.rlike("""\\bf("|''')"""),
                _finding("sql_fstring", "WARNING", "f-string in spark.sql()", "Use query parameters"),
            ),
            (
                (line.contains("STAT IN") | line.contains("STATUS IN")) & (F.size(codes) > 0),
                _finding(
                    "status_literals",
                    "INFO",
                    F.concat(F.lit("Status code literals: "), F.array_join(codes, ",")),
                    "Name the status codes",
                ),
            ),
        ],
    )
    excessive = (
        lines(corpus)
        .where(line.contains(".selectExpr("))
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
        .where(F.col("n") > 5)
        .select(
            "path",
            "line",
            F.lit("excessive_select_expr").alias("rule"),
            F.lit("WARNING").alias("severity"),
            F.concat(F.lit("selectExpr used "), F.col("n").cast("string"), F.lit(" times")).alias("message"),
            F.lit("Cast in one projection").alias("suggestion"),
        )
    )
    return per_line.unionByName(excessive)


def uncached_reuse(corpus: DataFrame, least: int = 3) -> DataFrame:
    """Assigned frames that at least ``least`` lines use without any cache or persist.

    The names assigned in a file travel with the file's lines, and only lines
    that mention one of them are counted.
    """
    assigned = r"(?m)^[ \t]*(\w+)[ \t]*=.*(?:spark\.sql|spark\.read|\.join|\.select)"
    names = corpus.select(
        "path", "text", F.array_distinct(F.regexp_extract_all("text", F.lit(assigned), F.lit(1))).alias("names")
    ).where(F.size("names") > 0)
    numbered = names.select(
        "path", "names", F.posexplode(F.split("text", "\n", -1)).alias("line", "content")
    ).withColumn("line", F.col("line") + 1)
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\w+)"), F.lit(1)))
    used = numbered.select("path", "line", "content", F.explode(F.array_intersect(words, "names")).alias("name"))
    target = F.regexp_extract("content", r"^\s*(\w+)\s*=.*(?:spark\.sql|spark\.read|\.join|\.select)", 1)
    cached = F.regexp_extract_all("content", F.lit(r"(\w+)\.(?:cache|persist)\("), F.lit(1))
    marked = used.select(
        "path",
        "name",
        "line",
        (target == F.col("name")).alias("assigns"),
        F.array_contains(cached, F.col("name")).alias("caches"),
    )
    # Uses before the first assignment do not count; the window holds one name in one file.
    born = F.min(F.when(F.col("assigns"), F.col("line"))).over(Window.partitionBy("path", "name"))
    return (
        marked.withColumn("born", born)
        .where(F.col("line") >= F.col("born"))
        .groupBy("path", "name")
        .agg(
            F.count(F.lit(1)).alias("uses"),
            F.min("line").alias("line"),
            F.bool_or("caches").alias("cached"),
        )
        .where((F.col("uses") >= least) & ~F.col("cached"))
        .select("path", "line", "name", "uses")
    )


# --- embedded SQL ----------------------------------------------------------

# The six ways a SQL text is passed are a call with a text in three double or single quotes, plain or
# formatted, or in one double or single quote.
_SQL_CALL = (
    r'(?s)spark\.sql\s*\(\s*(?:f?"""(.*?)"""|f?\'\'\'(.*?)\'\'\'|"([^"]*)"|\'([^\']*)\')'
)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def sql_statements(corpus: DataFrame) -> DataFrame:
    """SQL texts passed to ``spark.sql`` with the line of the call; ``templated`` marks texts with braces.

    A file is cut at its calls; the lines before a call are added up over the
    pieces, so each part of a text is looked at once.
    """
    text = F.col("text")
    cut = corpus.where(text.contains("spark.sql")).select(
        "path", F.regexp_extract_all(text, F.lit(_SQL_CALL), F.lit(0)).alias("calls"), F.split(text, _SQL_CALL, -1).alias("between")
    )
    breaks = F.zip_with("between", "calls", lambda gap, call: F.struct(_newlines(gap).alias("gap"), _newlines(call).alias("call"), call.alias("whole")))
    first = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line:int,whole:string>>").alias("found"))

    def place(so_far: Column, piece: Column) -> Column:
        line = so_far["line"] + piece["gap"]
        entry = F.struct(line.alias("line"), piece["whole"].alias("whole"))
        return F.struct((line + piece["call"]).alias("line"), F.array_append(so_far["found"], entry).alias("found"))

    with_calls = F.filter(breaks, lambda piece: piece["whole"].isNotNull())
    calls = cut.select("path", F.explode(F.aggregate(with_calls, first, place)["found"]).alias("call"))
    body = F.concat(*[F.regexp_extract("call.whole", _SQL_CALL, i) for i in (1, 2, 3, 4)])
    return (
        calls.select("path", "call.line", stripped(body).alias("statement"))
        .where(F.col("statement") != "")
        .withColumn("templated", F.col("statement").contains("{") & F.col("statement").contains("}"))
    )


def sql_findings(statements: DataFrame) -> DataFrame:
    """SELECT *, DELETE or UPDATE without WHERE, and a WHERE without a column; templated texts are skipped."""
    upper = F.upper("statement")
    return _findings(
        statements.where(~F.col("templated")),
        [
            (
                upper.contains("SELECT *") | upper.contains("SELECT  *"),
                _finding("select_star", "WARNING", "SELECT * used", "List the columns"),
            ),
            (
                (upper.contains("DELETE FROM") | upper.contains("UPDATE ")) & ~upper.contains("WHERE"),
                _finding("missing_where", "WARNING", "DELETE or UPDATE without WHERE", "Add a WHERE clause"),
            ),
            (
                upper.rlike(r"WHERE\s+=\s+"),
                _finding("where_without_column", "CRITICAL", "WHERE without a column name", "Name the column"),
            ),
            (
                upper.rlike(r"WHERE\s+(<|>|!=|<=|>=)"),
                _finding("where_operator_without_column", "CRITICAL", "WHERE starts with an operator", "Name the column"),
            ),
        ],
    )


def table_lineage(statements: DataFrame) -> DataFrame:
    """Distinct (path, table) pairs read by FROM and JOIN clauses."""
    found = F.regexp_extract_all("statement", F.lit(r"(?i)\b(?:from|join)\s+([a-zA-Z0-9_\.]+)"), F.lit(1))
    return statements.select("path", F.explode(found).alias("table_name")).distinct()


# Functions whose call makes an expression an aggregate, and what a literal starts with.
_AGGREGATES = r"(?i)(sum|count|avg|min|max|collect_list|collect_set|stddev|variance)\("
_LITERAL = r"""^(\d+(\.\d+)?$|'|")"""
# The selected list and the grouped list of a statement; a grouped list ends at the next clause.
_GROUPED_QUERY = r"(?is)select\s+(.*?)\s+from\s.*?\sgroup\s+by\s+(.*?)(?:\s+(?:having|order\s+by|limit|qualify)\s.*)?$"


def _listed(text: Column) -> Column:
    """Entries of a comma-separated list. A piece between commas belongs to the entry before it while that has open brackets."""
    none = F.struct(F.array().cast("array<string>").alias("entries"), F.lit(0).alias("open"))

    def add(so_far: Column, piece: Column) -> Column:
        entries = so_far["entries"]
        joined = F.concat(
            F.slice(entries, F.lit(1), F.size(entries) - 1), F.array(F.concat_ws(",", F.element_at(entries, -1), piece))
        )
        brackets = F.regexp_count(piece, F.lit(r"\(")) - F.regexp_count(piece, F.lit(r"\)"))
        return F.struct(
            F.when(so_far["open"] > 0, joined).otherwise(F.array_append(entries, piece)).alias("entries"),
            F.greatest(so_far["open"] + brackets, F.lit(0)).alias("open"),
        )

    entries = F.transform(F.aggregate(F.split(text, ","), none, add)["entries"], lambda x: F.trim(x))
    return F.filter(entries, lambda x: x != "")


def group_by_findings(statements: DataFrame) -> DataFrame:
    """Selected expressions that are neither aggregated, nor literals, nor grouped."""

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.trim(F.trim(x), F.lit("`")), r"\s+", " ")

    def clause(i: int) -> Column:
        return F.regexp_replace(F.regexp_extract(F.trim("statement"), _GROUPED_QUERY, i), r"\s+", " ")

    lists = statements.where(F.trim("statement").rlike(_GROUPED_QUERY)).select(
        "path", "line", F.xxhash64("statement").alias("which"), _listed(clause(1)).alias("selected"), F.transform(_listed(clause(2)), plain).alias("grouped")
    )
    entries = lists.select("path", "line", "which", "grouped", F.explode("selected").alias("entry")).where(
        ~F.col("entry").rlike(_AGGREGATES) & ~F.col("entry").rlike(_LITERAL)
    )
    name = plain(F.regexp_replace("entry", r"(?i)\s+as\s.*$", ""))
    loose = entries.withColumn("name", name).where(~F.array_contains("grouped", F.col("name")))
    per_statement = loose.groupBy("path", "line", "which").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return per_statement.select(
        "path",
        "line",
        F.lit("group_by_mismatch").alias("rule"),
        F.lit("ERROR").alias("severity"),
        F.concat(F.lit("Not aggregated and not grouped: "), F.array_join("names", ", ")).alias("message"),
        F.lit("Group by the columns or aggregate them").alias("suggestion"),
    )


def duplicate_writes(corpus: DataFrame) -> DataFrame:
    """Tables that a file writes more than once by INSERT INTO, writeTo or saveAsTable."""
    call = r"""(?i)(?:INSERT\s+INTO\s+|writeTo\(\s*["']|saveAsTable\(\s*["'])([A-Za-z0-9_.]+)"""
    targets = lines(corpus).select(
        "path", "line", F.explode(F.regexp_extract_all("content", F.lit(call), F.lit(1))).alias("table_name")
    )
    return (
        targets.groupBy("path", "table_name")
        .agg(F.count(F.lit(1)).alias("writes"), F.min("line").alias("line"))
        .where(F.col("writes") > 1)
    )


def parameter_keys(corpus: DataFrame) -> DataFrame:
    """Keys looked up in parameter sets, distinct per file and set."""
    pattern = r"""(\w*Param(?:eter)?Set\w*)\[["']([^"']+)["']\]"""
    sets = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    keys = F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
    pairs = corpus.select("path", F.explode(F.arrays_zip(sets.alias("s"), keys.alias("k"))).alias("p"))
    return pairs.select("path", F.col("p.s").alias("parameter_set"), F.col("p.k").alias("key")).distinct()


# --- metrics ---------------------------------------------------------------


def code_metrics(corpus: DataFrame) -> DataFrame:
    """Line counts and counts of calls, frames and source tables per file, without exploding the text."""
    # The patterns that are counted.
    text = F.col("text")
    trimmed = F.transform(F.split(text, "\n", -1), stripped)

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    def distinct(pattern: str) -> Column:
        return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))

    per_file = corpus.select("path", "text", trimmed.alias("lines"))
    return per_file.select(
        "path",
        F.size("lines").alias("total_lines"),
        F.size(F.filter("lines", lambda x: (x != "") & ~x.startswith("#"))).alias("code_lines"),
        F.size(F.filter("lines", lambda x: x.startswith("#"))).alias("comment_lines"),
        F.size(F.filter("lines", lambda x: x == "")).alias("blank_lines"),
        count(r"spark\.sql\s*\(").alias("sql_queries"),
        count(r"\.join\s*\(").alias("joins"),
        count(r"\.(groupBy|agg)\s*\(").alias("aggregations"),
        count(r"\.(select|withColumn|filter|where)\s*\(").alias("transformations"),
        distinct(r"(\b\w+_df\b|\bDataFrame\b)").alias("dataframes"),
        distinct(r"(?i)FROM\s+([A-Za-z_][A-Za-z0-9_\.]*)").alias("source_tables"),
        count(r"register_udfs|udf\s*\(|@udf").alias("udfs"),
    )


# Weight of each metric in the complexity score; code lines count per hundred.
COMPLEXITY_WEIGHTS = {
    "sql_queries": 5,
    "joins": 10,
    "aggregations": 8,
    "transformations": 3,
    "dataframes": 2,
    "source_tables": 5,
    "udfs": 7,
}
LINE_WEIGHT = 0.1


def complexity(metrics: DataFrame) -> DataFrame:
    """Weighted score, cut to whole numbers between 0 and 100, and its level."""
    score = F.col("code_lines") / F.lit(100.0) * F.lit(LINE_WEIGHT)
    for name, weight in COMPLEXITY_WEIGHTS.items():
        score = score + F.col(name) * F.lit(weight)
    whole = F.least(F.greatest(F.floor(score), F.lit(0)), F.lit(100)).cast("int")
    return metrics.select("path", whole.alias("complexity_score")).withColumn(
        "complexity", complexity_level(F.col("complexity_score"))
    )


# --- rule tables -----------------------------------------------------------


def ddl_statements(corpus: DataFrame) -> DataFrame:
    """Statements of DDL scripts: comments removed, split at semicolons, numbered from 1."""
    bare = F.regexp_replace(F.regexp_replace("text", r"--[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    trimmed = F.transform(F.split(bare, ";"), stripped)
    return corpus.select(
        "path", F.posexplode(F.filter(trimmed, lambda s: s != "")).alias("n", "statement")
    ).select("path", (F.col("n") + 1).alias("statement_number"), "statement")


def usable_rules(corpus: DataFrame, rules: Sequence[TextRule]) -> tuple[list[TextRule], list[TextRule]]:
    """Rules whose pattern the engine's regular expressions accept, and the others.

    The engine itself is asked, over one empty text: all patterns at once, and
    halves of them only where one is refused.
    """
    spark, bad = corpus.sparkSession, set()

    def accepted(places: list[int]) -> bool:
        try:
            spark.sql("SELECT '' AS text").select(*[F.col("text").rlike(rules[i].pattern) for i in places]).collect()
        except Exception as refused:  # its class differs between kinds of sessions
            if "PATTERN" not in str(refused).upper():
                raise
            return False
        return True

    open_ = [list(range(len(rules)))]
    while open_:
        places = open_.pop()
        if places and not accepted(places):
            half = len(places) // 2
            if half:
                open_ += [places[:half], places[half:]]
            else:
                bad.update(places)
    return [r for i, r in enumerate(rules) if i not in bad], [r for i, r in enumerate(rules) if i in bad]


def rule_table_findings(corpus: DataFrame, rules: Sequence[TextRule], text: str = "text") -> DataFrame:
    """Named regex rules (any case, multi-line) over whole texts; an invalid pattern is one finding per file."""
    good, bad = usable_rules(corpus, rules)
    content = F.col(f"`{text}`")

    def entry(rule: TextRule, severity: str, message: str) -> Column:
        return F.struct(
            F.lit(rule.name).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message")
        )

    found = [
        (content.rlike(f"(?im){r.pattern}"), entry(r, r.severity.upper(), r.message or f"Matched pattern: {r.pattern}"))
        for r in good
    ]
    found += [(F.lit(True), entry(r, "WARNING", f"Invalid regex in rule '{r.name}': {r.pattern}")) for r in bad]
    return explode_present(corpus, ["path"], found)
