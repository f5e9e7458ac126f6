"""Signals in pages' sources: marks of full text, and the access data that publishers embed as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, normalize_text, text_or_empty

#: Marks in the source that stand for a full text, and for its structure (fixed values).
FULLTEXT_MARKS = ("articlebody", "article-body", "article_body", "bodymatter", "fulltext-view", 'property="articlebody"')
STRUCTURE_MARKS = ("section-title", "article-section", "article__section", "data-article-body")


def positive(page: Column) -> Column:
    """Struct of strong and soft signals."""
    low = F.lower(text_or_empty(page))
    strong = F.array_compact(F.array(F.when(contains_any(low, FULLTEXT_MARKS), "article_body_marker")))
    soft = F.array_compact(F.array(F.when(contains_any(low, STRUCTURE_MARKS), "article_body_structure_marker"), F.when(F.contains(low, F.lit("<article")), "article_tag_present")))
    return F.struct(strong.alias("strong"), soft.alias("soft"))


def data_layer(page: Column, variable: str) -> Column:
    """JSON text that a script assigns to a variable or pushes onto it; null if there is none that parses."""
    found = F.regexp_extract(text_or_empty(page), "(?s)" + variable + "\\s*(?:=|\\.push\\()\\s*(\\{.*?\\})\\s*\\)?\\s*;", 1)
    return F.when(F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull(), found)


def _at(layer: Column, path: str) -> Column:
    return F.lower(normalize_text(F.get_json_object(layer, path)))


def science_blocking(layer: Column) -> Column:
    """Signals of denied or abstract pages from page and user data."""
    kind = _at(layer, "$.page.pageInfo.pageType")
    return F.array_compact(
        F.array(
            F.when(kind == "journal-article-denial", "aaas_page_type_denial"),
            F.when(kind == "journal-article-abstract", "aaas_page_type_abstract"),
            F.when(_at(layer, "$.page.pageInfo.viewType") == "abs", "aaas_view_abs"),
            F.when((_at(layer, "$.user.entitled") == "false") & (_at(layer, "$.user.access") != "yes"), "aaas_entitlement_denied"),
        )
    )


def pnas_blocking(layer: Column) -> Column:
    """A paywall counts only with no free and no own access."""
    shut = (_at(layer, "$.page.attributes.accessType") == "paywall") & (_at(layer, "$.page.attributes.freeAccess") == "no") & (_at(layer, "$.user.access") == "no")
    return F.array_compact(F.array(F.when(shut, "pnas_paywall_no_access")))


def wiley_blocking(layer: Column) -> Column:
    either = lambda a, b: F.when(_at(layer, a) != "", _at(layer, a)).otherwise(_at(layer, b))
    return F.array_compact(
        F.array(
            F.when(_at(layer, "$.content.item.access") == "no", "wiley_access_no"),
            F.when(either("$.content.item['format-viewed']", "$.content.item.format_viewed") == "abstract", "wiley_format_viewed_abstract"),
            F.when(either("$.page['tertiary-section']", "$.page.tertiary_section") == "abs", "wiley_page_tertiary_abs"),
        )
    )


def urls_in_json(value: Column) -> Column:
    """Absolute URLs under link keys anywhere in a JSON text, in order, each once."""
    found = F.regexp_extract_all(text_or_empty(value), F.lit('"(?:@?href|url|URL|@?value)"\\s*:\\s*"(https?://[^"\\s]+)"'), F.lit(1))
    return F.array_distinct(found)
