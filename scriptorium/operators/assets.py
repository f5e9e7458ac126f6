"""Figures, tables and files of articles: which are shown, and where they go in the text.

Assets match images by keys of their URLs (equi-joins on exploded keys, first match in order), so
no document's assets are compared pair by pair with its images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as T


def in_body() -> Column:
    return ~F.lower(F.coalesce("section", F.lit(""))).isin("appendix", "supplementary")


def selected(assets: DataFrame, profile: str = "body", supplementary: bool = False) -> DataFrame:
    """Assets that a profile (none, body, all) shows: figures and tables, supplementary files if asked for."""
    if profile == "none":
        return assets.where(F.lit(False))
    shown = F.col("kind").isin("figure", "table") & (in_body() if profile == "body" else F.lit(True))
    files = (F.col("kind") == "supplementary") & F.lit(supplementary or profile == "all")
    return assets.where(shown | files)


def split_supplementary(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(body assets, supplementary assets)."""
    other = (F.col("kind") == "supplementary") | ~in_body()
    return assets.where(~other), assets.where(other)


def accepted_previews(assets: DataFrame) -> DataFrame:
    """Assets that are no preview, or a preview marked as accepted or large enough."""
    preview = F.lower(F.coalesce("download_tier", F.lit(""))) == "preview"
    return assets.where(~preview | F.coalesce("preview_accepted", F.lit(False)) | I.acceptable_preview(F.col("width"), F.col("height")))


def notes(assets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the marks its downloads leave: partial, previews, failures."""
    failed, preview = F.coalesce("failed", F.lit(False)), F.lower(F.coalesce("download_tier", F.lit(""))) == "preview"
    counted = assets.groupBy(key).agg(F.count_if(failed).alias("failed"), F.count_if(preview & ~failed).alias("previews"), F.count("*").alias("assets"))
    marks = F.array_compact(
        F.array(
            F.when(F.col("failed") > 0, F.when(F.col("failed") == F.col("assets"), "download:asset_failures").otherwise("download:assets_partial")),
            F.when(F.col("previews") > 0, "download:assets_preview_fallback"),
        )
    )
    return counted.withColumn("marks", marks)


def images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Markdown images in order: key, pos, alt, url."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(!\\[[^\\]]*\\]\\([^)\\s]+\\))"), F.lit(1))
    out = docs.select(key, F.posexplode(found).alias("pos", "image"))
    return out.select(key, "pos", F.regexp_extract("image", "!\\[([^\\]]*)\\]", 1).alias("alt"), F.regexp_extract("image", "\\]\\(([^)\\s]+)\\)", 1).alias("url"))


def match_images(found: DataFrame, assets: DataFrame, key: str = "doc_id", asset_url: str = "url", target: str = "path") -> DataFrame:
    """Images with the `target` of the first asset (by pos) that shares a URL key or, failing that, a file name."""
    name = lambda c: F.substring_index(F.split(c, "[?#]").getItem(0), "/", -1)
    keys = lambda c: F.concat(F.transform(I.url_keys(c), lambda k: F.struct(F.lit(0).alias("rank"), k.alias("k"))), F.array(F.struct(F.lit(1).alias("rank"), name(c).alias("k"))))
    left = found.select(key, "pos", F.explode(keys(F.col("url"))).alias("x")).select(key, "pos", "x.*").where("k <> ''")
    right = assets.select(key, F.col("pos").alias("_pos"), F.col(target).alias("target"), F.explode(keys(F.col(asset_url))).alias("x")).select(key, "_pos", "target", "x.*").where("k <> ''")
    best = left.join(right, [key, "rank", "k"]).groupBy(key, "pos").agg(F.min(F.struct("rank", "_pos", "target"))["target"].alias("target"))
    return found.join(best, [key, "pos"], "left")


def rewrite_links(docs: DataFrame, assets: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Markdown with its images' URLs replaced by the paths of matching assets: a fold over each document's images."""
    matched = match_images(images(docs, key, text), assets, key).where(F.col("target").isNotNull())
    swaps = matched.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("url", "target"))).alias("_swaps"))
    none = F.array().cast("array<struct<url:string,target:string>>")
    swap = lambda t, s: F.replace(t, F.concat(F.lit("]("), s["url"], F.lit(")")), F.concat(F.lit("]("), s["target"], F.lit(")")))
    out = docs.join(swaps, key, "left").withColumn(text, F.aggregate(F.coalesce("_swaps", none), F.coalesce(text, F.lit("")), swap))
    return out.drop("_swaps")


def inject_figures(blocks: DataFrame, assets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (key, pos, block) with an image line before each figure caption that has an asset of its label.

    The n-th caption of a label takes the label's n-th asset; each asset is used once.
    """
    label = T.figure_label(F.regexp_extract("block", "^\\*\\*([^*]+)\\*\\*", 1))
    caps = blocks.withColumn("label", label).withColumn("n", F.row_number().over(Window.partitionBy(key, "label").orderBy("pos")))
    figs = assets.where(F.col("kind") == "figure").select(key, T.figure_label(F.col("heading")).alias("label"), "url", "pos").where(F.col("label").isNotNull())
    figs = figs.withColumn("n", F.row_number().over(Window.partitionBy(key, "label").orderBy("pos"))).drop("pos")
    joined = caps.join(figs, [key, "label", "n"], "left")
    line = F.concat(F.lit("!["), F.initcap("label"), F.lit("]("), F.col("url"), F.lit(")\n\n"), F.col("block"))
    return joined.select(key, "pos", F.when(F.col("url").isNotNull(), line).otherwise(F.col("block")).alias("block"))


def inject_tables(blocks: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with placeholders (tables: key, placeholder, markdown) replaced by their tables."""
    t = tables.select(key, F.col("placeholder").alias("_p"), "markdown").dropDuplicates([key, "_p"])
    out = blocks.withColumn("_p", F.trim("block")).join(t, [key, "_p"], "left")
    return out.select(key, "pos", F.coalesce("markdown", "block").alias("block"))


def mentions(paragraphs: DataFrame, figures: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, paragraph, label) of the figures or tables that paragraphs (key, pos, text) cite; an equi-join on the label."""
    cited = F.regexp_extract_all(F.lower("text"), F.lit("\\b((?:fig(?:ure)?s?|tables?)\\.?\\s*[0-9]+[a-z]?)"), F.lit(1))
    tidy = lambda x: F.concat(F.when(x.startswith("fig"), "figure ").otherwise("table "), F.regexp_extract(x, "([0-9]+)", 1))
    found = paragraphs.select(key, F.col("pos").alias("paragraph"), F.explode(F.array_distinct(F.transform(cited, tidy))).alias("label"))
    return found.join(figures.select(key, F.lower("label").alias("label")).distinct(), [key, "label"])


def pdf_candidates(records: DataFrame, columns: list[str], at: int | None = None, extra: str | None = None) -> DataFrame:
    """Ordered distinct PDF URLs from array columns; a single extra one goes to position `at` (from 0)."""
    none = F.array().cast("array<string>")
    urls = F.concat(*(F.coalesce(c, none) for c in columns))
    if extra is not None:
        urls = F.when(F.col(extra).isNull(), urls).otherwise(F.array_insert(urls, F.least(F.lit((at or 0) + 1), F.size(urls) + 1), F.col(extra)))
    return records.withColumn("pdf_urls", F.array_distinct(F.array_compact(urls)))


def first_in_order(assets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Download candidates per asset: full size, then from its page, then preview, each URL once."""
    urls = F.array_distinct(F.array_compact(F.array("full_size_url", "page_url", "preview_url")))
    return assets.withColumn("candidates", urls)
