"""Exact deduplication by sorting normalised content.

Sampled splitters range-partition the rows by their content, the external sort
puts equal texts next to each other, and each row is compared in full with the
row before it.  A group of copies that holds a large share of all rows is cut
by a salt of its identifiers, so that the sort spreads it over several ranges;
only one row per cut is brought together again.

Defined cases: a null text counts as empty and empty texts equal each other.
Only A-Z are folded.  A null identifier loses against any other.  Of rows that
share identifier and text exactly one stays.  An empty table gives an empty
result.  Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters of each end of a text that the splitters see; they bound what the sampling gathers.
KEY_CHARS = 32
#: Parts into which copies of one text are cut.
SALTS = 32


def fold_ascii(text):
    """Lower-case A-Z only. The built-in ``lower`` does the same for pure ASCII and is much faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, largest: bool, salts: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows in content order: ``id, sha256, salt, lead, repeat`` and a struct ``row`` of the carried columns.

    ``lead`` marks the first row of each run of equal texts, ``repeat`` a row whose identifier equals the one before.
    """
    text = F.col(text_col)
    raw = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(text, F.lit("")).alias("raw"),
        F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry if c != text_col), text.isNull().alias("_null")).alias("row"),
    )
    keyed = raw.select(
        "*",
        fold_ascii(F.substring("raw", 1, KEY_CHARS)).alias("head"),
        F.octet_length("raw").alias("n_bytes"),
        fold_ascii(F.substring("raw", -KEY_CHARS, KEY_CHARS)).alias("tail"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"),
    )
    place = ["head", "n_bytes", "tail", "salt"]
    ranged = keyed.repartitionByRange(*place).withColumn("norm", fold_ascii(F.col("raw")))
    order = F.desc_nulls_last("id") if largest else F.asc_nulls_last("id")
    beside = Window.partitionBy(*place).orderBy("norm", order)
    so_far = beside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    compared = ranged.withColumn("same", F.coalesce(F.col("norm") == F.lag("norm").over(beside), F.lit(False))).withColumn(
        "repeat", F.col("same") & F.col("id").eqNullSafe(F.lag("id").over(beside))
    )
    # The digest is taken once per run of equal texts and handed to the rows that follow.
    return compared.withColumn("digest", F.when(~F.col("same"), F.sha2(F.col("norm"), 256))).select(
        "id",
        "raw",
        "row",
        "salt",
        "repeat",
        (~F.col("same")).alias("lead"),
        F.last("digest", ignorenulls=True).over(so_far).alias("sha256"),
    )


def _order(keep: str) -> bool:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return keep == "largest"


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", salts: int = SALTS
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, sha256`` of its group of equal normalised texts.

    ``keep`` is "smallest" or "largest": which identifier of a group stays.
    """
    largest = _order(keep)
    light = stored(_sorted_runs(docs, id_col, text_col, largest, salts).select("id", "salt", "repeat", "sha256"))
    pick = F.max if largest else F.min
    # A row finds its group by digest and salt, so that the copies of one text meet their answer in several tasks.
    cuts = stored(light.groupBy("sha256", "salt").agg(pick("id").alias("best"), F.count(F.lit(1)).alias("n")))
    groups = cuts.groupBy("sha256").agg(pick("best").alias("keep_id"), F.sum("n").alias("group_size"))
    # Stored, so that the join below deals by digest and salt and not by the digest alone.
    answers = stored(cuts.select("sha256", "salt").join(groups, "sha256"))
    return light.join(answers, ["sha256", "salt"]).select(
        "id",
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("repeat")).alias("kept"),
        "sha256",
    )


def exact_distinct(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", salts: int = SALTS
) -> DataFrame:
    """The rows that stay, with all their columns: one of each group of equal normalised texts."""
    largest = _order(keep)
    pick = F.max if largest else F.min
    leads = stored(_sorted_runs(docs, id_col, text_col, largest, salts, tuple(docs.columns)).where("lead").drop("lead", "repeat"))
    best = leads.groupBy("sha256").agg(pick("id").alias("keep_id"), F.max("salt").alias("any"))
    kept = leads.join(best, "sha256").where(
        F.col("id").eqNullSafe(F.col("keep_id")) | (F.col("keep_id").isNull() & (F.col("salt") == F.col("any")))
    )
    text = F.when(~F.col("row._null"), F.col("raw")).alias(text_col)
    return kept.select(*(text if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
