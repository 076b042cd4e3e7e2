"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import bpe, collocations, embedding_dedup, exact_dedup, html_extract, license_scan, line_dedup, merkle, near_dedup, packing, secret_scan, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), license_scan.known_licenses(spark))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), merkle.lowered(5))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=100, top=2000)


def queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_line_dedup": op2_line_dedup,
        "op3_html_extract": op3_html_extract,
        "op4_packing": op4_packing,
        "op5_toxicity": op5_toxicity,
        "op6_license_scan": op6_license_scan,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_warc": op8_warc,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_secret_scan": op12_secret_scan,
        "op13_collocations": op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": """
            WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
            each AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs),
            keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
            often AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
            told AS (SELECT r, doc_id, line, i, last_doc IS NOT NULL AND doc_id <> last_doc AS lost FROM keyed LEFT JOIN often USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
            FROM told GROUP BY r, doc_id""",
        "op6_license_scan": license_scan.oracle(),
        "op11_merkle_manifest": merkle.oracle(),
        "op13_collocations": collocations.oracle(),
        "op8_warc": """
            WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
            sized AS (SELECT *, octet_length(encode(html)) AS size, min(page_id) OVER (PARTITION BY digest) AS first_id FROM rows)
            SELECT page_id, size AS payload_bytes, digest AS payload_digest,
                   CASE WHEN size >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN size >= 100 AND first_id < page_id THEN first_id END AS refers_to
            FROM sized""",
        "op7_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    }
