"""The registered queries of this subpackage and their DuckDB SQL.

Each takes (spark, sf_dir), applies one operator with production parameters
to its whole table and derives the digest columns from the operator's rows.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, fingerprints, jaccard_join, license_scan, packing, quality
from . import sentencepiece_fst, token_counts, toxicity, url_filter, warc, whitening

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Fixed values of op1: phrases and labels.
BASE_PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: Fixed values of op7: rules and verdicts.
BASE_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
              ("net/es/", "block"), ("net/fr/", "block"))
#: Rules of our own for urls that no base rule fits.
SPAM_GLOBS = ("**spam**", "**cheap-pills**", "**casino**", "**viagra**", "**free-money**")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = [license_scan.phrase(*x) for x in BASE_PHRASES] + list(license_scan.NOTICES)
    found = license_scan.scan(table(spark, sf_dir, "documents"), templates)
    base = F.filter("matches", lambda m: m["kind"] == "phrase")

    def names(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(of["label"])), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.col("matches")["share"]), F.lit(0.0)).alias("score"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.rate(docs, quality.train(docs, labels, quality.graded(labels)))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number and CRC-32 of the ids, and whether decoding gives the
    text back (marks in a text come back as spaces).  Texts are told apart by
    their SHA-256, so they don't move through the decoding workers beside their ids."""
    path = public_tokenizers.path(PIECES)
    encoded = sentencepiece_fst.encode_documents(table(spark, sf_dir, "documents"), path)
    text_sha256 = F.sha2(F.translate("text", sentencepiece_fst.MARK, " "), 256)
    found = sentencepiece_fst.decode_ids(encoded.select("doc_id", "ids", text_sha256.alias("text_sha256")), path)
    decoded_sha256 = F.sha2("decoded", 256)
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                        decoded_sha256.alias("decoded_sha256"), (decoded_sha256 == F.col("text_sha256")).alias("round_trip"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85).select(
        "doc_id", "n_shingles", "component_id")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.site_rule(verdict, name) for name, verdict in BASE_RULES]
    more = [url_filter.Rule(g, "block", (g,)) for g in SPAM_GLOBS]
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules, more)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality, op3_sentencepiece, op4_jaccard_join, op5_fingerprints, op6_packing, op7_url_filter,
                                    op8_exact_dedup, op9_toxicity, op10_token_counts, op11_alignment, op12_whitening, op13_warc)}

ORACLE = {
    "op7_url_filter": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, 'spam|cheap-pills|casino|viagra|free-money') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled""",
    "op8_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op13_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p""",
}
