"""A corpus pipeline: from raw documents to token ids.

Each stage takes the documents that the stage before it kept and returns those
that it keeps, with the columns of ``documents``; the last one returns the ids.

Defined cases: a null or empty text, and one without letters, is rejected by
the first stage.  Texts of any length are read whole.  Ties and repeated rows
are settled as the operators state.  Rows without an identifier take no part in
near duplicates and stay.  Further columns pass through under any name.  Empty
tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import byte_bpe, language_id
from tallymark.llm.content_sort import exact_distinct
from tallymark.llm.decontaminate import find_leaks
from tallymark.llm.minhash import near_groups
from tallymark.session import stored

#: Documents whose language is less certain than this are rejected.
LEAST_CERTAINTY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; goes: no letters, or no language of at least the certainty."""
    model = language_id.fit(docs)
    labelled = language_id.predict(_carried(docs), model, keep=("doc_id", "text", "carried"))
    certain = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_CERTAINTY)
    return _unpacked(labelled.where(certain), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the one with the largest identifier stays."""
    return _unpacked(exact_distinct(_carried(docs), keep="largest"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on runs of five words the one with the smallest identifier stays."""
    kept = near_groups(docs).where("kept").select(F.col("id").alias("k_id"), F.col("version").alias("k_version"))
    return _unpacked(_carried(docs).join(kept, _same("k_id", "k_version"), "left_semi"), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_version"), "text")
    leaks = find_leaks(named, items, keep=("k_id", "k_version")).select("k_id", "k_version").distinct()
    return _unpacked(_carried(docs).join(leaks, _same("k_id", "k_version"), "left_anti"), docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``; decoding gives the text's bytes back."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(coded, ranks), keep=("ids",)).withColumnRenamed("id", "doc_id")


def _carried(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all other columns in one struct by position, so that no name of a column can clash."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("c"), *others).alias("carried"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"carried.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _same(id_col: str, version_col: str):
    return F.col("doc_id").eqNullSafe(F.col(id_col)) & F.xxhash64("text").eqNullSafe(F.col(version_col))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode_and_decode),
]

#: The language model, MinHash and BPE have no SQL form; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
