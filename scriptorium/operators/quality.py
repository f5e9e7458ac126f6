"""Verdicts over articles: kind of content, flags, downgrade and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from .sections import accepts_fulltext, measured, sufficient_body


def content_kind(has_body: Column, has_abstract: Column) -> Column:
    return F.when(has_body, "fulltext").when(has_abstract, "abstract_only").otherwise("metadata_only")


def weak_structure() -> Column:
    """Over words, chars, body_blocks, body_headings, explicit_container, post_abstract_run: a body without an article's shape."""
    empty = (F.col("words") <= 0) & (F.col("chars") <= 0)
    shaped = F.col("explicit_container") | F.col("post_abstract_run") | ((F.col("body_blocks") >= 2) & (F.col("body_headings") >= 1))
    return ~empty & ~shaped


def access_gate_detected(reason: Column, blocking: Column, hard_negative: Column, soft_positive: Column, accepted: Column) -> Column:
    none = F.array().cast("array<string>")
    signals = F.concat(F.array(F.coalesce(reason, F.lit(""))), F.coalesce(blocking, none), F.coalesce(hard_negative, none), F.when(accepted, none).otherwise(F.coalesce(soft_positive, none)))
    return (F.size(F.coalesce(blocking, none)) > 0) | F.exists(signals, lambda s: T.contains_any(F.lower(s), rules.ACCESS_SIGNAL_TOKENS))


def requires_downgrade(reason: Column, blocking: Column, gate: Column, accepted: Column, words: Column) -> Column:
    refused = ~F.coalesce(accepted, F.lit(True))
    plain = F.lower(T.normalize_text(reason))
    return (F.size(F.coalesce(blocking, F.array().cast("array<string>"))) > 0) | (refused & (plain.isin(*rules.DOWNGRADE_REASONS) | gate | ((plain == "insufficient_body") & (words <= 40))))


def confidence(kind: Column, flags: Column, losses: Column | int = 0, hard_negative: Column | bool = False) -> Column:
    """high, medium or low from content kind, flags, number of tables and formulas that were lost, and negative signals."""
    hard = F.lit(hard_negative) if isinstance(hard_negative, bool) else hard_negative
    lost = F.lit(losses) if isinstance(losses, int) else losses
    low = (kind != "fulltext") | hard | F.array_contains(flags, "access_gate_detected") | F.array_contains(flags, "insufficient_body")
    return F.when(low, "low").when(F.array_contains(flags, "weak_body_structure") | (lost > 0), "medium").otherwise("high")


def loss_warnings(losses: Column) -> Column:
    """Messages for the counters that are not zero, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(losses["table_fallback"] > 0, "Some tables are only kept as their original files."),
            F.when((losses["table_semantic"] > 0) | (losses["table_lossy"] > 0), "Some tables lost content on their way to Markdown."),
            F.when(losses["table_layout"] > 0, "Some tables were flattened; merged cells are not kept exactly."),
            F.when(losses["formula_fallback"] > 0, "Some formulas are shown in a reduced form."),
            F.when(losses["formula_missing"] > 0, "Some formulas are placeholders."),
        )
    )


def assess_text(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Verdict on Markdown alone: metrics, run structure, content kind, flags, confidence, tokens; one row per key."""
    out = measured(docs, key, text, carry)
    out = out.withColumn("explicit_container", F.lit(False)).withColumn("sufficient", sufficient_body())
    accepted = F.col("sufficient") & (accepts_fulltext() | (F.col("body_blocks") >= 1))
    out = out.withColumn("accepted", accepted).withColumn("kind", content_kind(F.col("accepted"), F.col("has_abstract")))
    flags = F.array_compact(F.array(F.when(~F.col("sufficient"), "insufficient_body"), F.when(weak_structure(), "weak_body_structure")))
    out = out.withColumn("flags", flags).withColumn("confidence", confidence(F.col("kind"), F.col("flags")))
    return out.withColumn("tokens", T.estimate_tokens(F.col("abstract")) + T.estimate_tokens(F.col("body")))


def issue_flags(articles: DataFrame, expected_sources: dict[str, list[str]]) -> Column:
    """Sorted issue flags of rows with provider, status, source, abstract, body, authors, warnings, reference_dois, briefing."""
    from ..functions.identifiers import doi_needs_cleaning

    full = F.col("status") == "fulltext"
    tokens = T.estimate_tokens(T.normalize_markdown(F.col("abstract")))
    overlap = T.abstract_body_overlap(F.col("abstract"), F.col("body"))
    known = F.lit(False)
    for provider, sources in expected_sources.items():
        known = known | ((F.col("provider") == provider) & F.col("source").isin(*sources))
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(full & (F.col("abstract") != "") & T.inflated_abstract(F.col("abstract"), tokens, overlap), "abstract_inflated"),
                F.when(full & (F.col("abstract") != "") & overlap, "abstract_body_overlap"),
                F.when(F.exists("reference_dois", doi_needs_cleaning), "refs_doi_not_normalized"),
                F.when(full & ~known, "unexpected_source_path"),
                F.when((F.size("authors") == 0) & ~F.col("briefing"), "empty_authors"),
                F.when(F.size("warnings") >= 3, "high_warning_count"),
            )
        )
    )


def is_briefing(headings: Column) -> Column:
    return F.size(F.array_except(F.array(*(F.lit(h) for h in rules.BRIEFING_HEADINGS)), F.transform(headings, lambda h: F.lower(T.normalize_text(h))))) == 0


def result_status(provider: Column, trail: Column, has_fulltext: Column) -> Column:
    """fulltext, abstract_only or blocked from the marks of a record's trail."""
    return (
        F.when(has_fulltext, "fulltext")
        .when(F.array_contains(trail, F.concat(F.lit("fulltext:"), provider, F.lit("_abstract_only"))), "abstract_only")
        .otherwise("blocked")
    )


def review_status(status: Column, issues: Column) -> Column:
    return F.when(status == "unsupported_provider", "skipped").when(status != "fulltext", "blocked").when(F.size(issues) > 0, "issue").otherwise("ok")


def capability_status(checks: DataFrame, key: str = "provider") -> DataFrame:
    """One status per provider from its checks: error, rate_limited, ready, partial or not_configured."""
    any_of = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    status = (
        F.when(any_of("error"), "error")
        .when(any_of("rate_limited") & ~any_of("ok"), "rate_limited")
        .when(F.bool_and(F.col("status") == "ok"), "ready")
        .when(any_of("ok"), "partial")
        .otherwise("not_configured")
    )
    return checks.groupBy(key).agg(status.alias("status"))


def combine_failures(failures: DataFrame, key: str, priority: dict[str, int]) -> DataFrame:
    """Per key the code of the highest priority, all messages in order, and united lists."""
    table = F.create_map(*(F.lit(x) for pair in priority.items() for x in pair))
    rank = F.coalesce(F.try_element_at(table, F.col("code")), F.lit(len(priority)))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(c).alias("v")))), lambda x: x["v"])
    return failures.groupBy(key).agg(
        F.min(F.struct(rank.alias("r"), F.col("pos"), F.col("code").alias("c")))["c"].alias("code"),
        F.array_join(F.array_distinct(ordered("message")), "; ").alias("message"),
        F.array_distinct(F.flatten(ordered("warnings"))).alias("warnings"),
    )
