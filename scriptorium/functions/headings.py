"""Classes of headings, sections and page elements, as ordered native conditions."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import contains_any, normalize_text, starts_with_any, strip


def normalize_heading(value: Column) -> Column:
    return F.regexp_replace(F.lower(normalize_text(value)), "[.: ]+$", "")


def heading_level(line: Column) -> Column:
    """Number of leading # of a Markdown heading; 0 if it is none."""
    return F.char_length(F.regexp_extract(strip(line), "^(#*)", 1))


def heading_text(line: Column) -> Column:
    return normalize_text(F.regexp_replace(strip(line), "^#+", ""))


def heading_category(tag: Column, text: Column, title: Column | None = None) -> Column:
    """Class of a page's heading: the first rule that holds decides."""
    return category_of(normalize_heading(text), F.lower(normalize_text(tag)) == "h1", title)


def category_of(h: Column, first_level: Column, title: Column | None = None) -> Column:
    """The same of a normalised heading; give it as a column of its own, as every rule reads it."""
    out = F.when(first_level, "front_matter").when(h == "", "body_heading")
    if title is not None:
        out = out.when((normalize_text(title) != "") & (h == normalize_heading(title)), "front_matter")
    return (
        out.when(contains_any(h, rules.ACCESS_GATE_PHRASES), "ancillary")
        .when(h.isin(*rules.ABSTRACT_HEADINGS) | h.startswith("abstract"), "abstract")
        .when(starts_with_any(h, rules.DATA_HEADINGS), "data_availability")
        .when(starts_with_any(h, rules.CODE_HEADINGS), "code_availability")
        .when(starts_with_any(h, rules.BACK_MATTER_HEADINGS), "references_or_back_matter")
        .when(starts_with_any(h, rules.ANCILLARY_HEADINGS), "ancillary")
        .when(h.isin(*rules.FRONT_MATTER_HEADINGS), "front_matter")
        .otherwise("body_heading")
    )


def markdown_heading_category(text: Column, title: Column | None = None, hint: Column | None = None) -> Column:
    """Class of a Markdown heading; a section hint overrides the rules."""
    return markdown_category_of(normalize_heading(text), title, hint)


def markdown_category_of(h: Column, title: Column | None = None, hint: Column | None = None) -> Column:
    """The same of a normalised heading."""
    page = category_of(h, F.lit(False), title)
    page = F.when(page == "ancillary", "auxiliary").otherwise(page)
    out = F.when(h == "", "body_heading")
    if title is not None:
        out = out.when((normalize_text(title) != "") & (h == normalize_heading(title)), "front_matter")
    out = (
        out.when(h.isin(*rules.MARKDOWN_ABSTRACT_HEADINGS) | h.startswith("abstract"), "abstract")
        .when(h.isin(*rules.MARKDOWN_AUXILIARY_HEADINGS), "auxiliary")
        .when(h.isin(*rules.MARKDOWN_FRONT_MATTER_HEADINGS), "front_matter")
        .when(starts_with_any(h, rules.DATA_HEADINGS), "data_availability")
        .when(starts_with_any(h, rules.CODE_HEADINGS), "code_availability")
        .when(starts_with_any(h, rules.BACK_MATTER_HEADINGS), "references_or_back_matter")
        .otherwise(page)
    )
    if hint is None:
        return out
    by_hint = F.when(hint.isin("data_availability", "code_availability"), hint).when(hint == "references", "references_or_back_matter").otherwise("body_heading")
    return F.when(F.coalesce(hint, F.lit("")) != "", by_hint).otherwise(out)


def section_kind(heading: Column) -> Column:
    return kind_of(F.lower(normalize_text(heading)), normalize_heading(heading))


def kind_of(lower: Column, h: Column) -> Column:
    """Kind of a section from its lower-case and its normalised heading."""
    category = category_of(h, F.lit(False))
    return (
        F.when(lower == "", "body")
        .when(lower.isin("references", "bibliography"), "references")
        .when(lower.isin("supplementary materials", "supplementary information"), "supplementary")
        .when(lower == "conversion notes", "diagnostics")
        .otherwise(
            F.element_at(
                F.create_map(*(F.lit(x) for x in ("data_availability", "data_availability", "code_availability", "code_availability", "abstract", "abstract", "references_or_back_matter", "references", "ancillary", "diagnostics", "front_matter", "body", "body_heading", "body"))),
                category,
            )
        )
    )


def section_priority(heading: Column) -> Column:
    """Order in which sections are packed: an equal heading decides, else the first one contained."""
    h = F.lower(normalize_text(heading))
    known = F.create_map(*(F.lit(x) for pair in dict(reversed(rules.SECTION_PRIORITY)).items() for x in pair))
    inside = None  # neighbours of equal priority are one condition
    for value, group in groupby(rules.SECTION_PRIORITY, key=lambda x: x[1]):
        found = contains_any(h, [k for k, _ in group])
        inside = F.when(found, value) if inside is None else inside.when(found, value)
    return F.coalesce(F.try_element_at(known, h), inside.otherwise(rules.DEFAULT_PRIORITY))


def identity_category(identity: Column) -> Column:
    """Class of an element from its id, class and role text; empty if none fits."""
    text = F.lower(normalize_text(identity))
    out = F.when(text == "", "")
    for name, tokens in rules.IDENTITY_TOKENS.items():
        out = out.when(contains_any(text, tokens), name)
    return out.otherwise("")
