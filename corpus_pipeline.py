"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Each stage works on all rows that the one before it kept. All but the last
return the columns of `documents`:

1. quality_rules: documents that the base test or the learned rules reject go.
2. jaccard_join: of each component of near copies (five-word shingles,
   similarity 0.8 or more) the document with the smallest doc_id stays.
3. suffix_dedup: passages of `PASSAGE_BYTES` bytes that also start anywhere else
   are cut out of the texts (about 35 words; a run of over 50 repeated words is longer).
4. mixing: rows are written in the order of the Pfair schedule of their sources.
5. packing: pieces of sequences of at most 1024 tokens. A row's slot depends on the rows alone, so it is
   worked out again from stage 4's rows; sequences follow it by ranges of slots.

Defined results: null and empty texts fail the base test and go in stage 1; null doc_id stay in all stages; rows
with equal doc_id and text are one from stage 2 on; ties are broken by doc_id, then by the text's hash; an empty table
gives no pieces; stages 1 to 4 keep extra columns as they are, whatever their names (names that begin with an
underscore belong to the operators).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import jaccard_join, mixing, packing, rule_lists, suffix_dedup
from scriptorium.llm.common import free_prefix, stash
from scriptorium.llm.queries import tokenizer_path

PASSAGE_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = rule_lists.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_lists.keep(docs, rules)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, jaccard_join.Likeness(size=5, percent=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(docs, length=PASSAGE_BYTES)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free = free_prefix(docs.columns, "mix")
    at = (f"{free}slot", f"{free}rank")
    return mixing.mix(docs, prefix=free).repartitionByRange(*at).sortWithinPartitions(*at).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free = free_prefix(docs.columns, "mix")
    return packing.pack(mixing.mix(docs, prefix=free), tokenizer_path("byte_bpe_50k.json"), capacity=1024, order=f"{free}slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_copies),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packed),
]
#: Learned rules and tokenizers can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
