"""Grouped reports over results, and the trail of marks that results carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_values(rows: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """The first n values of each key as an array; ranks come from a window, so no long list is collected."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= n)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col(value).alias("v")))), lambda x: x["v"]).alias("samples"))


def success_path(trail: Column) -> Column:
    return F.array_join(F.filter(trail, lambda m: F.endswith(m, F.lit("_ok"))), " -> ")


def by_provider(results: DataFrame, statuses: list[str], provider: str = "provider", order: str = "pos", sample: str = "doi") -> DataFrame:
    """Per provider: attempts, a column per status, distinct sources of successes, the first three samples."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    sources = F.array_sort(F.collect_set(F.when((F.col("status") == "fulltext") & (F.col("source") != ""), F.col("source"))))
    grouped = results.groupBy(provider).agg(F.count("*").alias("attempted"), *counts, sources.alias("sources"))
    return grouped.join(first_values(results, provider, sample, order, 3), provider)


def by_issue(results: DataFrame, flags: str = "flags", order: str = "pos", sample: str = "doi", n: int = 5) -> DataFrame:
    """Per flag: results that have it, and the first n samples."""
    rows = results.select(F.explode(F.array_distinct(flags)).alias("flag"), order, sample)
    return rows.groupBy("flag").agg(F.count("*").alias("rows")).join(first_values(rows, "flag", sample, order, n), "flag")


def recommendations(results: DataFrame, categories: DataFrame, flags: str = "flags", order: str = "pos", sample: str = "doi") -> DataFrame:
    """Issues in the order of a table of categories (category, position, advice), numbered without gaps."""
    found = by_issue(results, flags, order, sample, 10).withColumnRenamed("flag", "category").join(F.broadcast(categories), "category")
    return found.withColumn("priority", F.row_number().over(Window.orderBy("position")))  # a few rows: one per category


def totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("status") == "fulltext").alias("fulltext"),
        F.count_if(F.size("flags") > 0).alias("with_issues"),
        F.count_distinct("provider").alias("providers"),
    )


def path_notes(results: DataFrame, provider: str = "provider") -> DataFrame:
    """Per provider: how many different paths led to success, and how many results have issues."""
    return results.groupBy(provider).agg(
        F.count_distinct(F.when(F.col("status") == "fulltext", success_path(F.col("trail")))).alias("paths"),
        F.count_if(F.size("flags") > 0).alias("with_issues"),
    )


def with_issues(results: DataFrame, wanted: list[str], limit: int | None = None, order: str = "pos") -> DataFrame:
    """Results that have a wanted flag; the first `limit` of them in order if a limit is given."""
    found = results.where(F.arrays_overlap("flags", F.array(*(F.lit(w) for w in wanted))))
    return found if limit is None else found.orderBy(order).limit(limit)


def mark(stage: Column, component: Column, outcome: Column) -> Column:
    return F.concat(stage, F.lit(":"), component, F.lit("_"), outcome)


def parse_mark(value: Column, outcomes: list[str]) -> Column:
    """stage, component and outcome of a mark; an unknown outcome is part of the component."""
    stage, rest = F.split_part(value, F.lit(":"), F.lit(1)), F.substring_index(value, ":", -1)
    last = F.substring_index(rest, "_", -1)
    known = last.isin(*outcomes)
    component = F.when(known, F.regexp_replace(rest, "_[^_]*$", "")).otherwise(rest)
    return F.struct(stage.alias("stage"), component.alias("component"), F.when(known, last).alias("outcome"))


def merge_traces(*traces: Column) -> Column:
    return F.array_distinct(F.concat(*traces))


def trail(trace: Column) -> Column:
    return F.array_distinct(F.transform(trace, lambda e: mark(e["stage"], e["component"], e["outcome"])))
