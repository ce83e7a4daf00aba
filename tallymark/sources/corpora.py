"""Corpora of text files and exported job descriptions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.scalars import source_type, strip_export_escapes

# --- files -----------------------------------------------------------------


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell pattern with ``*``, ``?`` and ``[...]``; ``*`` also crosses folders."""
    out = []
    i = 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def wanted_file(path: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Include patterns first, then exclude patterns; tests and package markers never count."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)

    def any_match(patterns: Sequence[str]) -> Column:
        hit = F.lit(False)
        for p in patterns:
            regex = glob_pattern(p)
            hit = hit | name.rlike(regex) | path.rlike(regex)
        return hit

    marker = (
        name.startswith("test_")
        | name.contains("_test.py")
        | (name == "__init__.py")
        | path.contains("__pycache__")
    )
    return any_match(include) & ~any_match(exclude) & ~marker


def read_corpus(spark: SparkSession, folders: Sequence[str], include: Sequence[str] = ("*.py",), exclude: Sequence[str] = ()) -> DataFrame:
    """``(path, text)`` of every wanted file below the folders, one row per file.

    Only names decide, so files that are filtered out are not read for their text.
    """
    files = spark.read.option("recursiveFileLookup", True).text(list(folders), wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(
        wanted_file(F.col("path"), include, exclude)
    )


def missing_assets(expected: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Expected paths that the listing lacks."""
    return expected.join(listing.select(path).distinct(), path, "left_anti")


# --- exported job descriptions ---------------------------------------------


# What makes an export ill-formed.
_DECLARATION = r"(?i)<\?xml[^>]*\?>"
_BARE_AMPERSAND = r"&(?!amp;|lt;|gt;|apos;|quot;)"
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_STRAY_BRACKET = r"<(?=[^A-Za-z!/\\?])"


def clean_markup(text: Column) -> Column:
    """Make an exported description well-formed: payload only, one document, escaped stray characters."""
    body = F.regexp_replace(text, r"^\x{FEFF}", "")
    payload = F.regexp_extract(body, r"(?is)(<DSExport.*</DSExport>)", 1)
    open_end = F.regexp_extract(body, r"(?is)(<DSExport.*)$", 1)
    body = F.when(payload != "", payload).when(open_end != "", open_end).otherwise(body)
    body = F.regexp_replace(body, _DECLARATION, "")
    body = F.replace(body, F.lit("<none>"), F.lit("&lt;none&gt;"))
    body = F.regexp_replace(body, _BARE_AMPERSAND, "&amp;")
    body = F.regexp_replace(body, _CONTROL, "")
    return F.regexp_replace(body, _STRAY_BRACKET, "&lt;")


def unescape_markup(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _property(block: Column, name: str) -> Column:
    found = F.regexp_extract(block, rf"(?is)<Property[^>]*\bName=['\"]{name}['\"][^>]*>(.*?)</Property>", 1)
    return F.nullif(unescape_markup(F.trim(found)), F.lit(""))


def _blocks(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


_COLUMN_BLOCK = r"""(?is)<SubRecord[^>]*\bName=['"]OutputColumn['"][^>]*>(.*?)</SubRecord>"""
_PARAMETERS = r"""(?is)<Collection[^>]*\bName=['"]Parameters['"][^>]*>(.*?)</Collection>"""
_SUBRECORD = r"(?is)<SubRecord[^>]*>(.*?)</SubRecord>"
_RECORD = r"""(?is)(<Record[^>]*>.*?</Record>)"""


def export_jobs(corpus: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Job name of each description."""
    cleaned = corpus.select(F.col(f"`{path}`").alias("path"), clean_markup(F.col(f"`{text}`")).alias("t"))
    name = F.regexp_extract("t", r"""(?is)<Job\b[^>]*\bIdentifier=['"]([^'"]*)['"]""", 1)
    return cleaned.select("path", F.when(name == "", "unknown_job").otherwise(unescape_markup(name)).alias("job_name"))


def export_columns(corpus: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Output columns of each description, also of descriptions that no XML parser accepts."""
    blocks = corpus.select(
        F.col(f"`{path}`").alias("path"),
        F.posexplode(_blocks(clean_markup(F.col(f"`{text}`")), _COLUMN_BLOCK)).alias("position", "b"),
    )
    block = F.col("b")
    return blocks.select(
        "path",
        "position",
        _property(block, "Name").alias("name"),
        _property(block, "SqlType").alias("sql_type"),
        _property(block, "Precision").alias("precision"),
        _property(block, "Scale").alias("scale"),
        _property(block, "Nullable").alias("nullable"),
    ).where(F.col("name").isNotNull())


def export_parameters(corpus: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Job parameters with default and prompt."""
    collections = corpus.select(
        F.col(f"`{path}`").alias("path"),
        F.explode(_blocks(clean_markup(F.col(f"`{text}`")), _PARAMETERS)).alias("c"),
    )
    block = F.col("b")
    return (
        collections.select("path", F.explode(_blocks(F.col("c"), _SUBRECORD)).alias("b"))
        .select(
            "path",
            _property(block, "Name").alias("name"),
            F.coalesce(_property(block, "Default"), F.lit("")).alias("default_value"),
            F.coalesce(_property(block, "Prompt"), F.lit("")).alias("prompt"),
        )
        .where(F.col("name").isNotNull())
    )


def export_outputs(corpus: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Sequential file stages with the file template and record schema of their input pin."""
    records = corpus.select(
        F.col(f"`{path}`").alias("path"),
        F.explode(_blocks(clean_markup(F.col(f"`{text}`")), _RECORD)).alias("r"),
    )
    record = F.col("r")
    stages = (
        records.where(record.rlike(r"""(?is)^<Record[^>]*\bType=['"]CustomStage['"]"""))
        .select(
            "path",
            _property(record, "StageType").alias("stage_type"),
            F.coalesce(_property(record, "Name"), F.lit("")).alias("stage_name"),
            _property(record, "InputPins").alias("pin_id"),
        )
        .where((F.col("stage_type") == "PxSequentialFile") & F.col("pin_id").isNotNull())
    )

    def entry(key: str, value: str) -> Column:
        subrecords = F.filter(
            _blocks(record, _SUBRECORD), lambda b: F.coalesce(_property(b, "Name"), F.lit("")) == key
        )
        return F.coalesce(_property(F.get(subrecords, F.lit(0)), value), F.lit(""))

    pins = records.select(
        "path",
        F.regexp_extract(record, r"""(?is)^<Record[^>]*\bIdentifier=['"]([^'"]*)['"]""", 1).alias("pin_id"),
        strip_export_escapes(entry("file", "Value")).alias("file_template"),
        entry("Schema", "Value").alias("record_schema"),
    ).where(F.col("pin_id") != "")
    return stages.join(pins, ["path", "pin_id"]).select(
        "path", "stage_name", "pin_id", "file_template", "record_schema"
    )


def expected_schema(columns: DataFrame) -> DataFrame:
    """Column specs: name, Spark type and nullability (nullable unless it says 0, false or no)."""
    return columns.select(
        "path",
        "position",
        "name",
        source_type(F.col("sql_type"), F.col("precision"), F.col("scale")).alias("type"),
        (~F.lower(F.coalesce("nullable", F.lit("1"))).isin("0", "false", "no")).alias("nullable"),
    )


def element_texts(corpus: DataFrame, element: str, path: str = "path", text: str = "text") -> DataFrame:
    """Text of every ``element`` of marked-up documents, tags inside removed."""
    found = _blocks(F.col(f"`{text}`"), rf"(?is)<{element}\b[^>]*>(.*?)</{element}>")
    rows = corpus.select(F.col(f"`{path}`").alias("path"), F.posexplode(found).alias("position", "b"))
    return rows.select(
        "path", "position", F.trim(unescape_markup(F.regexp_replace("b", r"<[^>]*>", ""))).alias("value")
    )
