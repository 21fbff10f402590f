"""The registered queries over whole tables, thin layers on the operators, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeplane.llm import bpe, exact_dedup, html_text, language, media, mixing, near_dedup, quality, substrings, toxicity
from lodeplane.llm.common import crc_mod, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, crc_mod("doc_id", 4) != 2)
    return language.predict(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> bpe.Vocabulary:
    return bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), words), words)


#: Shares of all tokens that documents of either quality should have.
TARGETS = {"high": 0.95, "low": 0.05}


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of the mix: the quality that labels give."""
    return table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rated(table(spark, sf_dir, "documents"), domains(spark, sf_dir), TARGETS)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = table(spark, sf_dir, "documents"), quality.Settings()
    sample = quality.sample_statistics(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0, F.col("quality").cast("double"), settings)
    return quality.score(docs, quality.fit(sample, settings)).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max", fold_case=True)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_substrings(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return toxicity.score(docs, lexicon).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_hits")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_media": op6_media,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
}

SQL = {
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op8_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
        s AS (SELECT r, i, md5(b[i:i + 199]) AS k FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
        t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM s) WHERE n > 1),
        edges AS (SELECT r, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY r ORDER BY i)),
        spans AS (SELECT r, span, min(i) AS a, max(i) + 199 AS z FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM edges) GROUP BY r, span),
        gone AS (SELECT r, sum(z - a + 1) AS removed, count(*) AS n FROM spans GROUP BY r),
        starts AS (SELECT r, a, z FROM spans UNION ALL SELECT r, octet_length(b) + 1, octet_length(b) FROM d),
        kept AS (SELECT r, string_agg(hex(b[coalesce(before, 0) + 1:a - 1]), '' ORDER BY a) AS h FROM (SELECT r, a, lag(z) OVER (PARTITION BY r ORDER BY a) AS before FROM starts) JOIN d USING (r) GROUP BY r)
        SELECT doc_id, octet_length(b) AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
        FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)""",
}
