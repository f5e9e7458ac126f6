"""Reading and writing: captured pages, files, envelopes, Markdown; and bounded-parallel calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import decode_bytes, file_name

#: A fetched record as it is kept: what was asked for, and what was found.
ENVELOPE = (
    "doi string, source string, content_kind string, has_fulltext boolean, warnings array<string>, source_trail array<string>, "
    "markdown string, article string, metadata string, revision int, "
    "request struct<modes:array<string>,strategy:string,refs:string,tokens:string>"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files as rows: path, name, kind (by extension), bytes, modified, content."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    name = F.substring_index("path", "/", -1)
    ext = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext == "md", "markdown").when(ext.isin("pdf", "xml", "html"), "primary").when(ext == "json", "sidecar").otherwise("asset")
    return reader.load(path).select("path", name.alias("name"), kind.alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files decoded as UTF-8 or else Latin-1: url (the path), html."""
    return read_files(spark, path, "*.html").select(F.col("path").alias("url"), decode_bytes(F.col("content")).alias("html"))


def read_pdfs(spark: SparkSession, path: str, to_text: Callable[[bytes], str]) -> DataFrame:
    """PDF files with the text a given extractor finds; files that are no PDF or empty get a null."""

    @F.pandas_udf("string")
    def extract(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: to_text(b) if b and bytes(b[:5]) == b"%PDF-" else None)

    return read_files(spark, path, "*.pdf").select("path", "bytes", extract("content").alias("text"))


def read_envelopes(spark: SparkSession, path: str, revision: int | None = None) -> DataFrame:
    out = spark.read.schema(ENVELOPE).json(path)
    return out if revision is None else out.where(F.col("revision") == revision)


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """Envelopes as JSON lines, by source; sources that are written again are replaced."""
    envelopes.withColumn("part", F.coalesce("source", F.lit("none"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").json(path)


def write_markdown(envelopes: DataFrame, path: str) -> DataFrame:
    """Markdown of full texts under their file names; gives the rows skipped, with a mark in their trail."""
    full = F.col("content_kind") == "fulltext"
    envelopes.where(full).select(file_name(F.col("doi")).alias("name"), "markdown").write.mode("overwrite").parquet(path)
    return envelopes.where(~full).withColumn("source_trail", F.concat("source_trail", F.array(F.lit("download:markdown_skipped_no_fulltext"))))


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Raw payloads (provider, doi, content_type, content) as Parquet by provider; the committer makes the write atomic."""
    payloads.write.mode("overwrite").partitionBy("provider").parquet(path)


def serialize(envelopes: DataFrame, form: str = "json") -> DataFrame:
    """Envelopes as one text each: markdown, json, or both."""
    parts = {"markdown": F.coalesce("markdown", F.lit("")), "json": F.to_json(F.struct(*envelopes.columns))}
    parts["both"] = F.to_json(F.struct(parts["markdown"].alias("markdown"), F.struct(*envelopes.columns).alias("envelope")))
    return envelopes.select("doi", parts[form].alias("output"))


def map_in_parallel(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, concurrency: int, order: str = "pos") -> DataFrame:
    """Calls over at most `concurrency` partitions at a time, results in the input's order.

    `call` gets a batch and gives its results with the order column. Once a batch reports `rate_limited` in a
    column of that name, the partition's later batches aren't started: their rows come back with the order column,
    a null elsewhere, and the reason in the columns `not_run` (if the schema has it) and `rate_limited`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, stopped = None, False
        for batch in batches:
            if stopped:
                out = pd.DataFrame({order: batch[order].values}).reindex(columns=columns)
                if "not_run" in columns:
                    out["not_run"] = "rate_limited"
                out["rate_limited"] = True
                yield out
                continue
            out = call(batch)
            yield out
            columns = list(out.columns)
            stopped = "rate_limited" in columns and bool(out["rate_limited"].any())

    return rows.repartitionByRange(concurrency, order).mapInPandas(run, schema).orderBy(order)
