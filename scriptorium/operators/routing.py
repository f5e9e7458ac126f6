"""Routing of records to providers, by joins with the small provider catalogue (a fixed table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import identifiers as I
from ..functions import text as T


def catalogue(spark: SparkSession) -> DataFrame:
    """provider, position (catalogue order), official."""
    return spark.createDataFrame([(p[0], k, p[1]) for k, p in enumerate(rules.PROVIDERS)], "provider string, position int, official boolean")


def _signals(spark: SparkSession, column: int, name: str) -> DataFrame:
    rows = [(p[0], k, at, x) for k, p in enumerate(rules.PROVIDERS) for at, x in enumerate(p[column])]
    return F.broadcast(spark.createDataFrame(rows, f"provider string, position int, place int, {name} string"))  # some dozens of rows, fixed


def provider_of_doi(doi: Column) -> Column:
    """The first provider in catalogue order one of whose prefixes starts the DOI."""
    out = F.lit(None).cast("string")
    for name, _, _, prefixes, _ in reversed(rules.PROVIDERS):
        for prefix in reversed(prefixes):
            out = F.when(F.startswith(doi, F.lit(prefix)), name).otherwise(out)
    return out


def provider_of_url(url: Column) -> Column:
    """The first provider one of whose domains is in the URL's host."""
    h = I.host(url)
    out = F.lit(None).cast("string")
    for name, _, domains, _, _ in reversed(rules.PROVIDERS):
        if domains:
            out = F.when(T.contains_any(h, domains), name).otherwise(out)
    return out


def provider_of_publisher(publisher: Column) -> Column:
    """The provider that has the normalised name among its aliases."""
    known = {a: p[0] for p in rules.PROVIDERS for a in p[4]}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.try_element_at(table, I.journal_key(publisher))


def route(records: DataFrame, key: str = "query_id", urls: str = "urls", publishers: str = "publishers", doi: str = "doi") -> DataFrame:
    """Candidates in order, each provider once: key, provider, signal, rank.

    A landing page's domain counts before a publisher's name, and that before the DOI's prefix.
    """
    none = F.array().cast("array<string>")
    tagged = lambda values, f, signal, order: F.transform(values, lambda v, i: F.struct(F.lit(order).alias("order"), i.alias("i"), f(v).alias("provider"), F.lit(signal).alias("signal")))
    found = F.concat(
        tagged(F.coalesce(urls, none), provider_of_url, "domain", 0),
        tagged(F.coalesce(publishers, none), provider_of_publisher, "publisher", 1),
        tagged(F.array(I.clean_doi(F.coalesce(doi, F.lit("")))), provider_of_doi, "doi", 2),
    )
    rows = records.select(key, F.explode(found).alias("x")).where(F.col("x.provider").isNotNull()).select(key, "x.*")
    first = Window.partitionBy(key, "provider").orderBy("order", "i")
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("order", "i"))).select(key, "provider", "signal", "rank")


def official_candidates(candidates: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Candidates that are official providers and, if a list is given, on it."""
    official = [p[0] for p in rules.PROVIDERS if p[1]]
    out = candidates.where(F.col("provider").isin(*official))
    return out if allowed is None else out.where(F.col("provider").isin(*allowed))


def query_kind(query: Column) -> Column:
    """url, doi or title."""
    q = T.normalize_text(query)
    return F.when(I.is_http_url(q), "url").when(I.extract_doi(q).isNotNull(), "doi").otherwise("title")


def resolve(queries: DataFrame, works: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Queries (query_id, query) with kind, doi, landing_url, provider.

    `works` (doi, title, landing_url, publisher) answers DOIs and titles, `pages` (url, doi) captured landing pages.
    """
    from .matching import confident, score_candidates, title_candidates

    asked = queries.withColumn("kind", query_kind(F.col("query"))).withColumn("_doi", I.extract_doi(F.col("query")))
    if pages is not None:
        by_page = pages.select(F.col("url").alias("query"), F.col("doi").alias("_page_doi")).dropDuplicates(["query"])
        asked = asked.join(by_page, "query", "left").withColumn("_doi", F.coalesce("_doi", "_page_doi")).drop("_page_doi")
    titles = asked.where(F.col("kind") == "title").select("query_id", F.col("query").alias("title"))
    own = works.select(F.col("doi").alias("work_id"), F.col("title").alias("title")).dropDuplicates(["work_id"])
    # a pair below this Jaccard similarity can neither be sure nor take the margin from a sure one
    least = (rules.CONFIDENT_SCORE - rules.CONFIDENT_MARGIN - 0.3) / 0.7 - 1e-6
    ranked = title_candidates(titles, own, top=5, least=least).join(titles.withColumnRenamed("title", "query_title"), "query_id").join(own, "work_id")
    scored = score_candidates(ranked.select("query_id", "query_title", "work_id", "title", F.col("rank").alias("pos")))
    sure = confident(scored).where("confident").select("query_id", F.col("work_id").alias("_title_doi"))
    asked = asked.join(sure, "query_id", "left").withColumn("doi", F.coalesce("_doi", "_title_doi")).drop("_doi", "_title_doi")
    known = works.select("doi", "landing_url", "publisher").dropDuplicates(["doi"])
    out = asked.join(known, "doi", "left").withColumn("landing_url", F.coalesce(F.when(F.col("kind") == "url", F.col("query")), F.col("landing_url")))
    provider = F.coalesce(provider_of_url(F.col("landing_url")), provider_of_publisher(F.col("publisher")), provider_of_doi(F.col("doi")))
    return out.select("query_id", "query", "kind", "doi", "landing_url", provider.alias("provider"))


def best_probe(probes: DataFrame, key: str = "query_id") -> DataFrame:
    """The first probe of each key by state: positive, then unknown, then negative."""
    order = F.when(F.col("state") == "positive", 0).when(F.col("state") == "unknown", 1).otherwise(2)
    first = Window.partitionBy(key).orderBy(order, "pos")
    return probes.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def waterfall(attempts: DataFrame, key: str = "query_id") -> DataFrame:
    """The first success of each key's attempts (pos, outcome) before any failure that stops the rest.

    outcome: success, failed (goes on) or stop. Keys without a success get a null winner.
    """
    stop = F.min(F.when(F.col("outcome") == "stop", F.col("pos")))
    first = F.min(F.when(F.col("outcome") == "success", F.col("pos")))
    out = attempts.groupBy(key).agg(first.alias("first"), stop.alias("stop"), F.count("*").alias("attempts"))
    won = F.col("stop").isNull() | (F.col("first") < F.col("stop"))
    return out.select(key, F.when(won, F.col("first")).alias("winner"), "attempts")


def page_urls(records: DataFrame, hosts: list[str], templates: list[str], key: str = "doi", first: str | None = None) -> DataFrame:
    """Candidate URLs in order, each once: the page given in column `first`, then hosts x templates (`{doi}` is filled in)."""
    made = [F.concat(F.lit(f"https://{h}"), F.replace(F.lit(t), F.lit("{doi}"), F.col(key))) for h in hosts for t in templates]
    start = [F.col(first)] if first else []
    return records.withColumn("urls", F.array_distinct(F.array_compact(F.array(*start, *made))))
