"""One query per operator over the driver's tables, and the SQL that checks it where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfolio.llm import (
    decontamination, exact_dedup, hard_negatives, jaccard, language, licenses, lm, mixing, sharding, suffix_dedup, token_alignment, token_files,
    toxicity,
)
from wayfolio.llm.common import remainder, table

SHARDS = 40


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 1)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.learn_languages(docs.filter(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc.doc_id", (remainder(F.col("doc.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.scratch_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.token_digests(files)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("mark")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return plan.select("doc.doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 4) != 2)
    model = toxicity.learn_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc.doc_id", (remainder(F.col("doc.doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), leaves=SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), relabel=7)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level, ranks, pieces = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    pattern = public_tokenizers.PATTERN
    return token_alignment.align_tokens(
        table(spark, sf_dir, "documents"), lambda: token_alignment.ByteLevel(byte_level, ranks, pattern), lambda: token_alignment.Pieces(pieces)
    )


QUERIES = {"op1_lm_scores": op1_lm_scores, "op2_exact_dedup": op2_exact_dedup, "op3_license_scan": op3_license_scan, "op4_language_id": op4_language_id, "op5_decontamination": op5_decontamination, "op6_token_files": op6_token_files, "op7_jaccard": op7_jaccard, "op8_mixing": op8_mixing, "op9_toxicity": op9_toxicity, "op10_kd_shards": op10_kd_shards, "op11_hard_negatives": op11_hard_negatives, "op12_suffix_dedup": op12_suffix_dedup, "op13_token_alignment": op13_token_alignment}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_INDEX_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op3_license_scan": rf"""
        WITH given(license, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.TEMPLATES.items())}),
        g AS (SELECT license, regexp_extract_all({_LOWER}, {_INDEX_WORD}) AS w FROM given),
        t AS (SELECT DISTINCT license, array_to_string(w[s + 1:s + 5], ' ') AS gram
              FROM (SELECT license, w, unnest(range(0, len(w) - 4)) AS s FROM g)),
        k AS (SELECT license, gram, n, CAST(power(2, ceil(log2(n))) AS BIGINT) AS span
              FROM (SELECT license, gram, count(*) OVER (PARTITION BY license) AS n FROM t)),
        d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_INDEX_WORD}) AS w FROM documents),
        h AS (
          SELECT doc_id, license, n, pos, gram, unnest([pos // span - 1, pos // span]) AS win
          FROM (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS gram
                FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS pos FROM d)) JOIN k USING (gram)),
        v AS (
          SELECT doc_id, license, n, win, count(DISTINCT gram) AS matched, min(pos) AS first, max(pos) AS last
          FROM h GROUP BY doc_id, license, n, win HAVING count(DISTINCT gram) >= 0.8 * n)
        SELECT doc_id, license, n AS n_shingles, max(matched) AS matched, max(matched)::DOUBLE / n AS containment,
               min(first) AS first_word, max(last) + 4 AS last_word
        FROM v GROUP BY doc_id, license, n""",
    "op5_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_INDEX_WORD}) AS w FROM documents),
        i AS (SELECT item_id, w, least(10, len(w)) AS n
              FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_INDEX_WORD}) AS w FROM benchmark) WHERE len(w) > 0),
        windows AS (
          SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS gram
          FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
        grams AS (
          SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
                FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, s, n FROM grams JOIN windows USING (n, gram)),
        spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
        named AS (
          SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op8_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 15) AS BIGINT) AS key
          FROM documents),
        s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
          FROM d GROUP BY source),
        levels AS (
          SELECT (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight,
                    source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                 / (sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s),
        t AS (
          SELECT source, source_size, least(2.0::DOUBLE * source_size,
                 weight * (SELECT max(level) FROM levels)) AS target FROM s),
        p AS (
          SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
                 CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE CAST((budget // source_size) * size
                 + least(size, greatest(0, budget - (budget // source_size) * source_size - start)) AS BIGINT) END AS taken
        FROM p""",
    "op11_hard_negatives": """
        WITH e AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
                 CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
          FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
        p AS (
          SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
          AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10""",
}
