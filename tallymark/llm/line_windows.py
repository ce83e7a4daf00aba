"""Line deduplication by overlapping windows of three lines.

Each run of three consecutive lines is hashed (two 64-bit hashes), windows that
occur more than once in the corpus are found by counting, and all but the first
occurrence, by identifier and place, are removed; covered lines are merged.

Defined cases: lines are cut at line feeds only, without trimming.  A null text
is one empty line, and texts of fewer than three lines have no window.  Rows
with equal identifier and text are one document and get equal answers.  A null
identifier comes first.  An empty table gives an empty result.  Columns other
than the two named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import stored

LINES = 3


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, version, line``: the lines (from 0) that a later occurrence of a window covers."""
    lines = F.split(F.col("text"), "\n", -1)
    rows = _rows(docs, id_col, text_col)
    windows = (
        rows.select("id", "version", lines.alias("l"))
        .where(F.size("l") >= LINES)
        .select(
            "id",
            "version",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.size("l") - LINES),
                    lambda i: F.struct(
                        i.alias("at"),
                        F.xxhash64(F.get("l", i), F.get("l", i + 1), F.get("l", i + 2)).alias("a"),
                        F.xxhash64(F.get("l", i + 2), F.get("l", i + 1), F.get("l", i)).alias("b"),
                    ),
                )
            ).alias("w"),
        )
        .select("id", "version", "w.at", "w.a", "w.b")
    )
    windows = stored(windows)
    common = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    hits = windows.join(common, ["a", "b"], "left_semi")
    first = hits.groupBy("a", "b").agg(F.min(F.struct("id", "version", "at")).alias("first"))
    later = hits.join(first, ["a", "b"]).where(~F.struct("id", "version", "at").eqNullSafe(F.col("first")))
    covered = F.explode(F.sequence(F.col("at"), F.col("at") + LINES - 1))
    return later.select("id", "version", covered.alias("line")).distinct()


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, n_lines, removed``: what is left of each text and the removed line numbers."""
    removed = (
        repeated_lines(docs, id_col, text_col)
        .groupBy("id", "version")
        .agg(F.sort_array(F.collect_list("line")).alias("removed"))
        .select(F.col("id").alias("r_id"), F.col("version").alias("r_version"), "removed")
    )
    rows = _rows(docs, id_col, text_col).withColumn("l", F.split("text", "\n", -1))
    joined = rows.join(removed, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("version") == F.col("r_version")), "left")
    gone = F.coalesce(F.col("removed"), F.array().cast("array<int>"))
    # The lines between two removed ones are taken together, so the work follows the lines and not their square.
    before, after = F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size("l")))
    runs = F.zip_with(before, after, lambda b, a: F.slice(F.col("l"), b + 2, a - b - 1))
    left = F.when(F.col("removed").isNotNull(), F.array_join(F.flatten(runs), "\n")).otherwise(F.col("text"))
    return joined.select("id", left.alias("text"), F.size("l").cast("long").alias("n_lines"), gone.alias("removed"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("version"))
