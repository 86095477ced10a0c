"""The queries of this package, with production parameters over whole tables, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddone.llm import ann, exact_dedup, langid, licenses, merkle, ngram_join, packing, phrases, pieces, secret_scan, token_counts, toxicity, wavelet
from oddone.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), ["quality", "toxic"]))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_in_batches(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op11_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.documents(spark, wavelet.write(table(spark, sf_dir, "documents")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.FIELDS, {"text": merkle.lower_text_of_fifths(docs)})


OP7_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_language_id": (op1_language_id, None),
    "op2_toxicity": (op2_toxicity, None),
    "op3_secret_scan": (op3_secret_scan, None),
    "op4_license_scan": (op4_license_scan, licenses.sql()),
    "op5_nearest": (op5_nearest, None),
    "op6_ngram_join": (op6_ngram_join, None),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_pieces": (op8_pieces, None),
    "op9_packing": (op9_packing, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_token_shards": (op11_token_shards, None),
    "op12_phrases": (op12_phrases, phrases.sql()),
    "op13_merkle": (op13_merkle, merkle.sql()),
}
