"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import byte_bpe, hard_negatives, language_id, packing, spelling, suffix_tree_lm
from tallymark.llm.bwt_dedup import remove_repeats
from tallymark.llm.content_sort import exact_groups
from tallymark.llm.decontaminate import find_leaks
from tallymark.llm.histogram_shard import shard_by_bytes
from tallymark.llm.line_windows import drop_repeated_lines
from tallymark.llm.minhash import near_groups
from tallymark.llm.warc import archive_and_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = shard_by_bytes(docs.select("doc_id", "text", F.crc32(text).alias("crc")), 16, carry=("crc",))
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), k=2).drop("version").withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pages carry no time of capture; a page is taken to be captured a minute after the one before it.
    captured = F.timestamp_seconds(F.coalesce(F.col("id"), F.lit(0)) * 60 + 1_700_000_000)
    index = archive_and_index(table(spark, sf_dir, "pages"), captured)
    return index.select(
        F.col("id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        "url_key",
        "captured",
        "intact",
    )


def fold_of(folds: int):
    """Fold of a document by its identifier; null identifiers are in the fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds))


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold_of(7) == 2
    found = suffix_tree_lm.score_corpus(table(spark, sf_dir, "documents"), ~held)
    return found.rows.withColumnRenamed("id", "doc_id").select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(found.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of(4) == 2
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(coded, ranks)).withColumnRenamed("id", "doc_id")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, noisy)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bwt_dedup": op1_bwt_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_minhash": op4_minhash,
    "op5_warc": op5_warc,
    "op6_suffix_tree_scores": op6_suffix_tree_scores,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_packing": op11_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256({_FOLD}) AS text_sha256, {_FOLD} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, text_sha256
        FROM n
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, coalesce(url, '') AS url FROM pages),
        f AS (SELECT *, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY body) AS first,
                     lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host,
                     regexp_replace(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', '') AS rest FROM p)
        SELECT page_id, payload_bytes, sha256(body) AS payload_digest,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to,
               array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE rest WHEN '' THEN '/' ELSE rest END AS url_key,
               strftime(make_timestamp((page_id * 60 + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured,
               true AS intact
        FROM f
    """,
    "op9_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        w AS (SELECT doc_id, i AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w
              FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)),
        r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM w),
        gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM r WHERE nth > 1),
        lines AS (SELECT doc_id, unnest(l) AS line_text, generate_subscripts(l, 1) AS line FROM d),
        k AS (SELECT x.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
                     coalesce(string_agg(CASE WHEN g.line IS NULL THEN x.line_text END, chr(10) ORDER BY x.line), '') AS kept
              FROM lines x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.line = x.line GROUP BY x.doc_id)
        SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
    """,
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
            FROM e a JOIN e ON a.vec_id % 100 = 0 AND e.vec_id <> a.vec_id),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
             AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op13_spelling_variants": """
        WITH RECURSIVE crc_table AS MATERIALIZED (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c
                FROM range(256) r(i))),
        runs AS (
            SELECT CAST(doc_id AS VARCHAR) AS name, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
        r AS (
            SELECT coalesce(name, '') AS name, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
        h AS (
            SELECT run, n, xor(list_reduce(
                       flatten(list_transform(string_split(name || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + ord(x) // 64 AS BIGINT), CAST(128 + ord(x) % 64 AS BIGINT)] END)),
                       lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h
            FROM r, crc_table),
        w AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT n, CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM h) d
            WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        gap AS MATERIALIZED (
            SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w) u),
        near AS MATERIALIZED (
            SELECT a.word, b.word AS other, b.n FROM gap a JOIN gap b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT g.word, w.word, w.n FROM gap g JOIN w ON g.rest = w.word
            UNION SELECT w.word, g.word, g.n FROM gap g JOIN w ON g.rest = w.word),
        best AS (
            SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, n AS other_n FROM near
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) = 1),
        f AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
                   CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
        walk AS (
            SELECT word, word AS at, form AS next FROM f
            UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next)
        SELECT f.word, form, walk.at AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
    """,
}
