"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_quality, fingerprints, jaccard_join, mixing, packing, rule_lists, sharding, suffix_dedup, token_counts, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), capacity=1024)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = jaccard_join.Likeness(size=4, percent=85, lower=True)
    return jaccard_join.join(_documents(spark, sf_dir), how)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_documents(spark, sf_dir).select("doc_id", "text"), limit=256 << 10)
    return out.select("doc_id", "n_bytes", "shard", "depth", "page")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(_documents(spark, sf_dir), length=400)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(_documents(spark, sf_dir), radius=fingerprints.RADIUS)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "n_bytes", "rank", "block", "phase", "slot")


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    unseen = compression_quality.held_out()
    model = compression_quality.train_from(docs, _labels(spark, sf_dir).where(~unseen))
    return compression_quality.score(docs, model, threshold=0.3).select("doc_id", unseen.alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    rules = rule_lists.learn_from(docs, _labels(spark, sf_dir))
    return rule_lists.apply_rules(docs, rules).select("doc_id", *rule_lists.BASE, "base_failed", "kept")


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_jaccard_join, op3_sharding, op4_warc, op5_token_counts, op6_suffix_dedup, op7_fingerprints, op8_mixing, op9_compression_quality, op10_quality_rules)}


#: SHA-1 as base32: four times 40 bits as eight digits of base 32, in the alphabet of RFC 4648.
_BASE32 = " || ".join(f"lpad(to_base(CAST('0x' || substr(h, {1 + 10 * k}, 10) AS BIGINT), 32), 8, '0')" for k in range(4))
_OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last IS NULL OR page_id = last THEN NULL ELSE last END AS refers_to FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": _OP4}
