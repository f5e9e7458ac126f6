"""Composite plans: from a captured page or a Markdown text to an article and its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import headings as H
from ..functions import once
from ..functions import html as W
from ..functions import text as T
from ..operators import quality, sections


def pages_to_articles(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each page parsed once, whatever is done with the result: title, metadata, blocks, references, assets and Markdown as columns."""
    parsed = pages.select(key, url, once(W.parse_page(F.col(html), F.col(url))).alias("page"))
    return parsed.select(key, url, "page.*")


def page_verdicts(articles: DataFrame, key: str = "page_id") -> DataFrame:
    """Verdict on each parsed page from its Markdown and its access signals."""
    signals = T.access_signals(F.col("title"), F.col("markdown"), F.lit(None).cast("int"))
    texts = articles.select(key, F.col("markdown").alias("text"), once(signals).alias("signals"))
    out = quality.assess_text(texts, key, carry=("signals",))
    gated = F.size("signals") > 0
    out = out.withColumn("accepted", F.col("accepted") & ~gated).withColumn("kind", quality.content_kind(F.col("accepted"), F.col("has_abstract")))
    flags = F.array_union("flags", F.when(gated, F.array(F.lit("access_gate_detected"))).otherwise(F.array().cast("array<string>")))
    return out.withColumn("flags", flags).withColumn("confidence", quality.confidence(F.col("kind"), F.col("flags")))


def article_from_markdown(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections, abstract, token counts and verdict of Markdown documents as one nested row each."""
    found = sections.sections(docs, key, text)
    nested = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section", "heading", "level", "kind", "text"))).alias("sections"))
    nested = nested.withColumn("section_abstract", sections.abstract_of(F.col("sections")))
    return quality.assess_text(docs, key, text).join(nested, key, "left")


def metadata_only(records: DataFrame) -> DataFrame:
    """Records without a body as articles with empty parts."""
    none = F.array().cast("array<string>")
    return records.withColumns({"sections": none, "references": none, "assets": none, "kind": F.when(T.normalize_text(F.col("abstract")) != "", "abstract_only").otherwise("metadata_only")})


def envelope(articles: DataFrame, modes: list[str], key: str = "doc_id") -> DataFrame:
    """Only the parts of articles that were asked for; what isn't is pruned from the plan."""
    parts: list[Column] = [F.col(key), F.col("kind"), F.col("confidence"), F.col("tokens")]
    if "markdown" in modes:
        parts.append(F.col("body").alias("markdown"))
    if "article" in modes:
        parts.append(F.to_json(F.col("sections")).alias("article"))
    if "metadata" in modes:
        parts.append(F.col("abstract").alias("metadata"))
    return articles.select(*parts)


def probe(records: DataFrame) -> DataFrame:
    """Whether a full text is likely, from a record alone: licence, links, a PDF in the page's metadata."""
    none = F.array().cast("array<string>")
    evidence = F.array_compact(
        F.array(
            F.when(F.size(F.coalesce("licences", none)) > 0, "licence"),
            F.when(F.size(F.coalesce("links", none)) > 0, "fulltext_link"),
            F.when(F.coalesce("pdf_url", F.lit("")) != "", "citation_pdf_url"),
        )
    )
    out = records.withColumn("evidence", evidence)
    return out.withColumn("state", F.when(F.size("evidence") > 0, "likely_yes").otherwise("unknown"))


def minimum_slice(pages: DataFrame) -> DataFrame:
    """For every page: title, paragraphs, words of the visible article, tokens and kind, without Python."""
    text = W.visible_text(F.regexp_extract("html", "(?is)<article[^>]*>(.*)</article>", 1))
    out = pages.select("page_id", W.page_title(F.col("html")).alias("title"), F.regexp_count("html", F.lit("(?i)<p[\\s>]")).cast("long").alias("paragraphs"), text.alias("text"))
    out = out.withColumns({"words": T.count_words(F.col("text")), "chars": F.char_length("text").cast("long"), "tokens": T.estimate_tokens(F.col("text"))})
    enough = (F.col("chars") >= rules.SHORT_BODY_CHARS) & (F.col("words") >= rules.SHORT_BODY_WORDS) & (F.col("paragraphs") >= 2)
    return out.withColumn("kind", F.when(enough, "fulltext").otherwise("metadata_only")).drop("text")


def heading_table(spark, extra: tuple[str, ...] = ()) -> DataFrame:
    """All headings of the rule tables and some of none, with their classes in both scopes."""
    names = dict.fromkeys([*rules.ABSTRACT_HEADINGS, *rules.FRONT_MATTER_HEADINGS, *rules.DATA_HEADINGS, *rules.CODE_HEADINGS, *rules.BACK_MATTER_HEADINGS, *rules.ANCILLARY_HEADINGS, *rules.MARKDOWN_AUXILIARY_HEADINGS, *extra])
    out = spark.createDataFrame([(n,) for n in names], "heading string")
    return out.select("heading", H.heading_category(F.lit("h2"), F.col("heading")).alias("page_class"), H.markdown_heading_category(F.col("heading")).alias("markdown_class"), H.section_kind(F.col("heading")).alias("kind"), H.section_priority(F.col("heading")).cast("long").alias("priority"))
