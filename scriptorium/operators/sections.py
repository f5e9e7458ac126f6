"""Sections and body structure of Markdown documents, as windows over their lines or blocks.

All windows are partitioned by document, so one document's lines are together
and documents spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import headings as H
from ..functions import once
from ..functions import text as T


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: key, pos (from 0), line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), empty: bool = False) -> DataFrame:
    """One row per block between blank lines that has text: key, pos, block (normalised), and the columns to carry.

    With `empty`, a document's first block stays even if it has no text, so that each document has a row.
    """
    parts = F.split(F.coalesce(F.col(text), F.lit("")), f"\\n{T.SPACE}*\\n")
    out = docs.select(key, *carry, F.posexplode(parts).alias("pos", "raw")).withColumn("block", T.normalize_text(F.col("raw")))
    return out.where((F.col("block") != "") | (F.lit(empty) & (F.col("pos") == 0))).select(key, *carry, "pos", "block")


def _is_heading(line: Column) -> Column:
    return F.startswith(T.strip(line), F.lit("#"))


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", fallback: str = "Full Text") -> DataFrame:
    """Lines split at headings: key, section (from 0), heading, level, kind, text.

    A section without text is left out, except a body heading whose next heading is deeper.
    """
    of_doc = Window.partitionBy(key).orderBy("pos")
    numbered = lines(docs, key, text).withColumn("heading_line", _is_heading(F.col("line")))
    numbered = numbered.withColumn("part", F.sum(F.col("heading_line").cast("int")).over(of_doc))
    grouped = numbered.groupBy(key, "part").agg(
        F.max(F.when(F.col("heading_line"), F.col("line"))).alias("head"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("heading_line"), F.struct("pos", "line")))), lambda x: F.regexp_replace(x["line"], f"{T.SPACE}+$", "")), "\n").alias("raw"),
    )
    level = F.when(F.col("head").isNull(), 2).otherwise(H.heading_level(F.col("head")))
    title = T.strip(F.regexp_replace(T.strip(F.col("head")), "^#+", ""))
    own = F.when(F.col("head").isNull() | (title == ""), F.lit(fallback)).otherwise(title)
    found = grouped.select(key, "part", own.alias("heading"), level.alias("level"), T.strip_markdown_images(F.col("raw")).alias("text"), (T.strip(F.col("raw")) == "").alias("blank"))
    found = found.withColumn("_lower", once(F.lower(T.normalize_text(F.col("heading"))))).withColumn("_h", once(H.normalize_heading(F.col("heading"))))
    found = found.withColumn("kind", once(H.kind_of(F.col("_lower"), F.col("_h")))).drop("_lower", "_h")
    by_part = Window.partitionBy(key).orderBy("part")
    found = found.withColumn("next_level", F.lead("level").over(by_part))
    keeps = (F.col("text") != "") | (F.col("blank") & (F.col("kind") == "body") & (F.col("next_level") > F.col("level")))
    found = found.where(F.coalesce(keeps, F.lit(False)))
    return found.withColumn("section", F.row_number().over(by_part) - 1).select(key, "section", "heading", "level", "kind", "text")


def body_sections(found: DataFrame) -> DataFrame:
    return found.where((T.strip_markdown_images(F.col("text")) != "") & ~F.col("kind").isin(*rules.NON_BODY_KINDS))


def abstract_sections(found: DataFrame) -> DataFrame:
    return found.where((T.strip_markdown_images(F.col("text")) != "") & (F.col("kind") == "abstract"))


def renderable_sections(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Body sections, and empty body headings whose next section with body text is deeper."""
    outside = F.col("kind").isin(*rules.NON_BODY_KINDS)
    filled = T.strip_markdown_images(F.col("text")) != ""
    after = Window.partitionBy(key).orderBy("section").rowsBetween(1, Window.unboundedFollowing)
    next_level = F.first(F.when(filled & ~outside, F.col("level")), ignorenulls=True).over(after)
    out = found.withColumn("_next", next_level)
    parent = ~filled & (F.col("kind") == "body") & (F.col("heading") != "") & (F.col("_next") > F.col("level"))
    return out.where(~outside & (filled | F.coalesce(parent, F.lit(False)))).drop("_next")


def leading_context(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add `leading`: whether a section is in the document's run of significance sections at its start."""
    of_doc = Window.partitionBy(key)
    other = F.min(F.when(~F.lower(T.normalize_text(F.col("heading"))).isin(*rules.LEADING_CONTEXT_HEADINGS), F.col("section"))).over(of_doc)
    return found.withColumn("leading", F.col("section") < F.coalesce(other, F.lit(1 << 30)))


def level_shift(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add `shift`: how far headings move so that the body starts at level two."""
    return found.withColumn("shift", F.greatest(F.lit(0), F.min("level").over(Window.partitionBy(key)) - 2))


def combined_abstract(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Different abstracts of a document (by canonical text, the first of each), joined by blank lines."""
    texts = abstract_sections(found).withColumn("text", T.strip_markdown_images(F.col("text"))).withColumn("_key", T.canonical(F.col("text")))
    first = Window.partitionBy(key, "_key").orderBy("section")
    kept = texts.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("section", "text"))), lambda x: x["text"])
    return kept.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("abstract"))


def abstract_of(nested: Column) -> Column:
    """The same over a document's array of sections; null without an abstract."""
    texts = F.filter(F.transform(nested, lambda x: F.when(x["kind"] == "abstract", T.strip_markdown_images(x["text"]))), lambda t: F.coalesce(t != "", F.lit(False)))
    keyed = F.transform(texts, lambda t: F.struct(T.canonical(t).alias("key"), t.alias("text")))
    first = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return F.when(F.size(texts) > 0, F.array_join(F.transform(first, lambda x: x["text"]), "\n\n"))


def _runs(found: DataFrame, key: str, title: str | None = None) -> DataFrame:
    """Blocks (key, pos, block) with `kind`, `turned` and the `island` of body paragraphs they are in.

    A heading sets a state that lasts until the next one
    (front matter only until the first paragraph); what is in no such state and is prose is
    body. Headings of the body don't break a run, all else does: gaps and islands.
    """
    named = F.col(title) if title else None
    of_doc = Window.partitionBy(key).orderBy("pos")
    before = of_doc.rowsBetween(Window.unboundedPreceding, -1)
    heading = _is_heading(F.col("block"))
    level = F.least(H.heading_level(F.col("block")), F.lit(6))
    found = found.withColumn("_h", once(F.when(heading, H.normalize_heading(H.heading_text(F.col("block"))))))
    category = H.category_of(F.col("_h"), level == 1, named)
    if named is not None:
        category = F.when((T.normalize_text(named) != "") & (F.col("_h") == H.normalize_heading(named)), "title").otherwise(category)
    marked = found.withColumn("heading", once(heading)).withColumn("category", once(F.when(F.col("heading"), category)))
    heading = F.col("heading")
    # what a paragraph would be if no state holds
    own = F.when(T.has_access_gate(F.col("block")), "ancillary").when(T.is_substantial_prose(F.col("block")), "body_paragraph").otherwise("front_matter")
    marked = marked.withColumn("own", once(F.when(~heading, own)))
    # paragraphs end front matter and, unless a lasting state holds, every state
    lasting = F.col("category").isin("abstract", "references_or_back_matter", "data_availability", "code_availability")
    marked = marked.withColumn("state", F.last(F.when(heading & (F.col("category") != "ancillary"), F.col("category")), ignorenulls=True).over(before))
    marked = marked.withColumn("since", F.last(F.when(heading & (F.col("category") != "ancillary"), F.col("pos")), ignorenulls=True).over(before))
    marked = marked.withColumn("ancillary_since", F.last(F.when(heading & (F.col("category") == "ancillary"), F.col("pos")), ignorenulls=True).over(before))
    of_state = Window.partitionBy(key, "since").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("paragraphs", F.coalesce(F.sum(F.when(~heading, 1)).over(of_state), F.lit(0)))
    cleared = F.coalesce(F.col("ancillary_since") > F.col("since"), F.lit(False))
    held = (
        F.when(F.col("state").isin("abstract", "references_or_back_matter"), F.col("state"))
        .when(F.col("state").isin("data_availability", "code_availability") & ~cleared, F.lit("data_availability"))
        .when((F.col("state") == "front_matter") & (F.col("paragraphs") == 0) & ~cleared, F.lit("front_matter"))
    )
    marked = marked.withColumn("kind", F.when(heading, F.col("category")).otherwise(F.coalesce(held, F.col("own"))))
    barrier = ~F.col("kind").isin("body_paragraph", "body_heading")
    marked = marked.withColumn("island", F.sum(barrier.cast("int")).over(of_doc))
    marked = marked.withColumn("abstract_seen", F.coalesce(F.max((F.col("kind") == "abstract").cast("int")).over(before), F.lit(0)))
    return marked.withColumn("turned", F.coalesce(F.max(((F.col("kind") == "body_heading") & (F.col("abstract_seen") == 1)).cast("int")).over(before), F.lit(0)))


def _of_island() -> list[Column]:
    body = F.col("kind") == "body_paragraph"
    return [
        F.sum(body.cast("int")).alias("paragraphs"),
        F.sum(F.when(body, F.char_length("block")).otherwise(0)).alias("chars"),
        F.max((body & (F.col("turned") == 1)).cast("int")).alias("post"),
    ]


def _of_islands() -> list[Column]:
    return [
        F.sum("paragraphs").cast("long").alias("body_paragraphs"),
        F.max("paragraphs").cast("long").alias("run_paragraphs"),
        F.max("chars").cast("long").alias("run_chars"),
        (F.max("post") == 1).alias("post_abstract_run"),
    ]


def structure(found: DataFrame, key: str = "doc_id", title: str | None = None) -> DataFrame:
    """Per document: body paragraphs, its longest run of them and its characters, and whether one follows a
    body heading after an abstract. `found` has key, pos, block."""
    return _runs(found, key, title).groupBy(key, "island").agg(*_of_island()).groupBy(key).agg(*_of_islands())


def accepts_fulltext() -> Column:
    """The rule over the columns of `structure` that makes a text a full text."""
    return F.col("post_abstract_run") | (F.col("run_paragraphs") >= 3)


def _metric_rows(found: DataFrame, key: str) -> DataFrame:
    """Blocks with `in_body`, `in_abstract`, `is_heading` and `abstract_heading`."""
    of_doc = Window.partitionBy(key).orderBy("pos")
    found = found.withColumn("is_heading", _is_heading(F.col("block")))
    found = found.withColumn("_h", once(F.when(F.col("is_heading"), H.normalize_heading(H.heading_text(F.col("block"))))))
    found = found.withColumn("_category", once(F.when(F.col("is_heading"), H.markdown_category_of(F.col("_h")))))
    state = F.coalesce(F.last("_category", ignorenulls=True).over(of_doc), F.lit("body_heading"))
    fence = F.col("block") == "$$"
    found = found.withColumn("_state", state).withColumn("_formula", F.sum(fence.cast("int")).over(of_doc) % 2 == 1)
    found = found.withColumn("_gate", once(T.has_access_gate(F.col("block")) | F.col("block").rlike("^!\\[[^\\]]*\\]\\([^)]*\\)$")))
    filled = F.col("block") != ""
    in_body = filled & (F.col("_state") == "body_heading") & (F.col("is_heading") | (~F.col("_formula") & ~fence & ~F.col("_gate")))
    in_abstract = filled & (F.col("_state") == "abstract") & ~F.col("is_heading") & ~fence
    found = found.withColumns({"in_body": in_body, "in_abstract": in_abstract, "abstract_heading": (F.col("_category") == "abstract").cast("int")})
    return found.drop("_h", "_category", "_state", "_formula", "_gate")


def _of_blocks() -> list[Column]:
    listed = lambda c: F.collect_list(F.when(F.col(c), F.struct("pos", "block"))).alias(f"_{c}")
    return [
        listed("in_body"),
        listed("in_abstract"),
        F.sum((F.col("in_body") & ~F.col("is_heading")).cast("long")).alias("body_blocks"),
        F.sum((F.col("in_body") & F.col("is_heading")).cast("long")).alias("body_headings"),
        F.max("abstract_heading").alias("abstract_heading"),
    ]


def _of_parts() -> list[Column]:
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list(c))), lambda x: x["block"]), "\n\n")
    return [joined("_in_body").alias("body"), joined("_in_abstract").alias("abstract"), F.sum("body_blocks").alias("body_blocks"), F.sum("body_headings").alias("body_headings"), F.max("abstract_heading").alias("_abstract_heading")]


def _counted(out: DataFrame) -> DataFrame:
    words, abstract_words = T.count_words(F.col("body")), T.count_words(F.col("abstract"))
    out = out.withColumns(
        {
            "chars": F.char_length("body").cast("long"),
            "words": words,
            "cjk": T.count_cjk(F.col("body")),
            "abstract_words": abstract_words,
            "has_abstract": (F.coalesce("_abstract_heading", F.lit(0)) == 1) | (F.col("abstract") != ""),
            "body_to_abstract": words / F.greatest(abstract_words, F.lit(1)),
        }
    )
    return out.drop("_abstract_heading")


def body_metrics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Characters, words, CJK share, blocks and headings of each document's body, and of its abstract.

    A heading's class lasts until the next one; what stands under a body heading or under none is
    body, under an abstract heading is abstract. Display formulas between $$ lines are left out.
    """
    found = _metric_rows(blocks(docs, key, text), key)
    return _counted(found.groupBy(key).agg(*_of_blocks()).groupBy(key).agg(*_of_parts()))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `body_metrics` and `structure` of every document, and any value of the columns to carry.

    Blocks are dealt by document once; all windows and sums then work on that one partitioning.
    """
    found = _runs(_metric_rows(blocks(docs, key, text, carry, empty=True), key), key)
    kept = [F.first(c).alias(c) for c in carry]
    by_island = found.groupBy(key, "island").agg(*_of_island(), *_of_blocks(), *kept)
    return _counted(by_island.groupBy(key).agg(*_of_islands(), *_of_parts(), *kept))


def sufficient_body() -> Column:
    """Whether the columns of `body_metrics` make an article's body."""
    shaped = (F.col("body_blocks") >= 2) | (F.col("body_headings") >= 1)
    lone = (F.col("body_blocks") == 1) & (~F.col("has_abstract") | (F.col("body_to_abstract") >= 1.5))
    cjk = (F.col("cjk") >= rules.CJK_CHARS) & (F.col("cjk") / F.greatest("chars", F.lit(1)) >= rules.CJK_SHARE)
    return (
        F.when(F.col("chars") < rules.SHORT_BODY_CHARS, False)
        .when(cjk, shaped | (lone & (F.col("cjk") >= rules.SINGLE_BLOCK_CJK)))
        .when(F.col("words") < rules.SHORT_BODY_WORDS, False)
        .otherwise(shaped | (lone & (F.col("words") >= rules.SINGLE_BLOCK_WORDS)))
    )


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", profile: str = "generic") -> DataFrame:
    """Markdown without navigation and promotion lines: key, text.

    Sections under a chrome heading go until the next heading of the same or a smaller level.
    """
    of_doc = Window.partitionBy(key).orderBy("pos")
    found = lines(docs, key, text).withColumn("level", F.when(_is_heading(F.col("line")), H.heading_level(F.col("line"))))
    name = F.regexp_replace(F.lower(H.heading_text(F.col("line"))), "^[ :]+|[ :]+$", "")
    chrome = F.col("level").isNotNull() & name.isin(*rules.CHROME_HEADINGS)
    # the levels of the open chrome heading: a fold over the document's headings
    heads = Window.partitionBy(key).orderBy("pos")
    found = found.withColumn("_events", F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", chrome.alias("chrome")))).over(heads))
    skip = F.aggregate(
        F.col("_events"),
        F.lit(99),
        lambda s, x: F.when(x["chrome"], x["level"]).when(x["level"] <= s, F.lit(99)).otherwise(s).cast("int"),
    )
    found = found.withColumn("_skip", skip).where(F.col("_skip") == 99)
    line = F.regexp_replace(F.regexp_replace(F.col("line"), "(?i)\\(\\s*refs?\\.\\s*\\)", ""), f"{T.SPACE}+$", "")
    plain = F.lower(T.normalize_text(F.regexp_replace(line, "^#+\\s*", "")))
    short = T.contains_any(plain, rules.LINE_SHORT_NOISE) & (T.count_words(plain) <= 16)
    noise = plain.isin(*rules.LINE_EXACT_NOISE) | T.starts_with_any(plain, rules.LINE_PREFIX_NOISE) | T.contains_any(plain, rules.PROMO_PHRASES.get(profile, ())) | short
    kept = found.withColumn("line", line).where(~noise)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return kept.groupBy(key).agg(T.normalize_markdown(F.array_join(ordered, "\n")).alias("text"))


def match_hints(headings: DataFrame, hints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headings (key, pos, heading) with the kind of the next hint of the same name; hints (key, order, heading, kind).

    Hints are only looked for after the last one used, so this is a fold over a document's headings.
    """
    heads = headings.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", H.normalize_heading(F.col("heading")).alias("name")))).alias("heads"))
    given = hints.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("order"), H.normalize_heading(F.col("heading")).alias("name"), "kind"))).alias("hints"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,kind:string>>").alias("out"))

    def step(state: Column, head: Column) -> Column:
        ahead = F.filter(F.transform(F.col("hints"), lambda h, i: F.struct(i.alias("i"), h["name"].alias("name"), h["kind"].alias("kind"))), lambda h: (h["i"] >= state["at"]) & (h["name"] == head["name"]))
        hit = F.get(ahead, F.lit(0))
        return F.struct(
            F.coalesce(hit["i"] + 1, state["at"]).alias("at"),
            F.concat(state["out"], F.array(F.struct(head["pos"].cast("int").alias("pos"), hit["kind"].alias("kind")))).alias("out"),
        )

    folded = heads.join(given, key, "left").withColumn("hints", F.coalesce("hints", F.array().cast("array<struct<order:int,name:string,kind:string>>")))
    pairs = folded.select(key, F.explode(F.aggregate("heads", start, step)["out"]).alias("x")).select(key, "x.pos", F.col("x.kind").alias("hint_kind"))
    return headings.join(pairs, [key, "pos"], "left")


def without_leading_abstract(found: DataFrame, abstracts: DataFrame, key: str = "doc_id", ratio: float = rules.NEAR_PARAGRAPH_RATIO, band: int = rules.NEAR_DUPLICATE_LENGTHS) -> DataFrame:
    """Body sections without their first paragraphs that repeat one of the document's abstracts (key, abstract); what is left empty goes.

    Only paragraphs whose length is near an abstract paragraph's are compared, and only within a document.
    """
    from .matching import matcher_ratio_from

    split = lambda c: F.split(c, f"\\n{T.SPACE}*\\n")
    known = abstracts.select(key, F.explode(split(F.col("abstract"))).alias("a")).withColumn("a", T.normalize_text(F.col("a"))).where("a <> ''")
    paragraphs = found.where(F.col("kind") == "body").select(key, "section", F.posexplode(split(F.col("text"))).alias("at", "raw")).withColumn("p", T.normalize_text(T.strip_markdown_images(F.col("raw")))).where("p <> ''")
    close = paragraphs.join(known, key).where(F.abs(F.char_length("p") - F.char_length("a")) <= band)
    same = (T.canonical(F.col("p")) == T.canonical(F.col("a"))) | (matcher_ratio_from("p", "a", F.lit(ratio)) >= ratio)
    repeats = close.where(same).select(key, "section", "at").distinct().withColumn("repeat", F.lit(True))
    marked = paragraphs.join(repeats, [key, "section", "at"], "left")
    first_own = F.min(F.when(F.col("repeat").isNull(), F.col("at"))).over(Window.partitionBy(key, "section"))
    kept = marked.withColumn("_first", first_own).where(F.col("at") >= F.col("_first"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.col("raw").alias("v")))), lambda x: T.strip(x["v"])), "\n\n")
    rest = kept.groupBy(key, "section").agg(text.alias("_rest"))
    out = found.join(rest, [key, "section"], "left")
    gone = (F.col("kind") == "body") & F.col("_rest").isNull() & (F.col("text") != "")
    return out.where(~gone).withColumn("text", F.when((F.col("kind") == "body") & F.col("_rest").isNotNull(), F.col("_rest")).otherwise(F.col("text"))).drop("_rest")


def first_prose(found: DataFrame, key: str = "doc_id", n: int = 6) -> DataFrame:
    """The first n substantial blocks of each document (key, pos, block)."""
    prose = found.where(~_is_heading(F.col("block")) & T.is_substantial_prose(F.col("block")))
    return prose.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= n).drop("_n")
