"""Merging, deduplicating and refreshing of bibliographic records, assets and cache entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import identifiers as I
from ..functions import text as T


def _blank_to_null(value: Column) -> Column:
    return F.when(T.normalize_text(value) != "", T.normalize_text(value))


def merge_metadata(primary: DataFrame, secondary: DataFrame, key: str = "doi", scalars: tuple[str, ...] = ("title",), lists: tuple[str, ...] = (), authors: str | None = None) -> DataFrame:
    """Full outer merge: the primary's scalars win where the record has them, even blank (then null); lists are united in order.

    A null scalar of the primary leaves the secondary's.
    """
    p = primary.select(key, *(F.col(c).alias(f"_p_{c}") for c in (*scalars, *lists, *([authors] if authors else []))))
    s = secondary.select(key, *(F.col(c).alias(f"_s_{c}") for c in (*scalars, *lists, *([authors] if authors else []))))
    both = p.join(s, key, "full_outer")
    none = F.array().cast("array<string>")
    columns = [F.when(F.col(f"_p_{c}").isNotNull(), _blank_to_null(F.col(f"_p_{c}"))).otherwise(_blank_to_null(F.col(f"_s_{c}"))).alias(c) for c in scalars]
    columns += [T.ordered_distinct(F.concat(F.coalesce(f"_p_{c}", none), F.coalesce(f"_s_{c}", none))).alias(c) for c in lists]
    if authors:
        columns.append(T.dedupe_authors(F.concat(F.coalesce(f"_p_{authors}", none), F.coalesce(f"_s_{authors}", none))).alias(authors))
    return both.select(key, *columns)


def overlay_page_metadata(base: DataFrame, page: DataFrame, key: str, scalars: tuple[str, ...], page_first: tuple[str, ...] = ("abstract",), lists: tuple[str, ...] = ()) -> DataFrame:
    """Base records filled up from page metadata; for `page_first` columns the page wins."""
    q = page.select(key, *(F.col(c).alias(f"_q_{c}") for c in (*scalars, *page_first, *lists)))
    out = base.join(q, key, "left")
    none = F.array().cast("array<string>")
    for c in scalars:
        out = out.withColumn(c, F.coalesce(_blank_to_null(F.col(c)), _blank_to_null(F.col(f"_q_{c}"))))
    for c in page_first:
        out = out.withColumn(c, F.coalesce(_blank_to_null(F.col(f"_q_{c}")), _blank_to_null(F.col(c))))
    for c in lists:
        out = out.withColumn(c, T.ordered_distinct(F.concat(F.coalesce(c, none), F.coalesce(f"_q_{c}", none))))
    return out.drop(*(f"_q_{c}" for c in (*scalars, *page_first, *lists)))


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_n_per_key(rows: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def short_groups(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Keys that have fewer than n rows, for callers that must refuse them."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") < n)


def interleave(rows: DataFrame, key: str, order: list[Column | str], rank: Column | None = None) -> DataFrame:
    """Add `turn` and `place`: one row of each key per turn, keys by `rank` (their smallest `order` column if not given)."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    out = rows.withColumn("turn", turn)
    seen = rank if rank is not None else F.min(order[0] if isinstance(order[0], Column) else F.col(order[0])).over(Window.partitionBy(key))
    return out.withColumn("place", seen)


def merge_by_identity(assets: DataFrame, keys: list[str], fields: list[str], order: str = "pos") -> DataFrame:
    """One row per identity with the first non-empty value of each field; rows without identity stay as they are."""
    named = assets.where(F.col(keys[0]).isNotNull())
    firsts = [F.min(F.when(T.normalize_text(F.col(c)) != "", F.struct(order, F.col(c).alias("v"))))["v"].alias(c) for c in fields]
    merged = named.groupBy(*keys).agg(F.min(order).alias(order), *firsts)
    return merged.unionByName(assets.where(F.col(keys[0]).isNull()).select(*keys, order, *fields))


def merge_by_priority(assets: DataFrame, key: str, fields: list[str], priority: Column, order: str = "pos") -> DataFrame:
    """One row per key: each field from the record of the highest priority that has it, earlier ones first."""
    ranked = assets.withColumn("_p", -priority)
    firsts = [F.min(F.when(T.normalize_text(F.col(c)) != "", F.struct("_p", order, F.col(c).alias("v"))))["v"].alias(c) for c in fields]
    return ranked.groupBy(key).agg(F.min(order).alias(order), *firsts)


def anti_inline(assets: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Body figures that are not among the document's inline images (by file name)."""
    name = lambda c: F.substring_index(F.split(F.col(c), "[?#]").getItem(0), "/", -1)
    seen = images.select(key, name("url").alias("_name")).where(F.col("_name") != "").distinct()
    return assets.withColumn("_name", name("url")).join(seen, [key, "_name"], "left_anti").drop("_name")


def unambiguous_files(assets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, file name, path) of file names that stand for one path only."""
    named = assets.select(key, F.substring_index("path", "/", -1).alias("file_name"), "path").where(F.col("file_name") != "")
    return named.groupBy(key, "file_name").agg(F.min("path").alias("path"), F.max("path").alias("_last")).where(F.col("path") == F.col("_last")).drop("_last")


def unique_paths(files: DataFrame, folder: str = "folder", name: str = "name", order: str = "pos") -> DataFrame:
    """Add `file`: the name, with _2, _3, ... before the extension for later files of the same name in a folder."""
    n = F.row_number().over(Window.partitionBy(folder, F.lower(name)).orderBy(order))
    stem, ext = F.regexp_extract(name, "^(.*?)(\\.[^.]*)?$", 1), F.regexp_extract(name, "^(.*?)(\\.[^.]*)?$", 2)
    return files.withColumn("file", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))


def latest_per_kind(entries: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """The value of the newest entry of each key; the largest value of equally new ones."""
    return entries.groupBy(*keys).agg(F.max(F.struct(at, value))[value].alias(value), F.max(at).alias(at))


def refresh(existing: DataFrame, fresh: DataFrame, key: str = "doi") -> DataFrame:
    """The table with all rows of the fresh rows' keys replaced."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def evict(entries: DataFrame, now: Column, oldest: Column, most_entries: int, most_bytes: int, at: str = "stored_at", size: str = "bytes", key: str = "entry_id", pool: str | None = None) -> DataFrame:
    """The entries a cache keeps: not too old, then the newest up to a number and a sum of bytes.

    With `pool`, each value of that column is a cache of its own and is dealt to its own
    task; without it the newest `most_entries` rows are found first, so the window sees no more than these.
    """
    live = entries.where(F.col(at) >= now - oldest)
    order = [F.desc(at), F.col(key)]
    if pool is None:
        live = live.orderBy(*order).limit(most_entries)
        running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return live.withColumn("_sum", F.sum(size).over(running)).where(F.col("_sum") <= most_bytes).drop("_sum")
    of_pool = Window.partitionBy(pool).orderBy(*order)
    live = live.withColumn("_n", F.row_number().over(of_pool)).where(F.col("_n") <= most_entries)
    live = live.withColumn("_sum", F.sum(size).over(of_pool.rowsBetween(Window.unboundedPreceding, 0)))
    return live.where(F.col("_sum") <= most_bytes).drop("_n", "_sum")


def counter_delta(before: Column, after: Column) -> Column:
    """Key-wise difference of two counter maps; keys without a change are left out."""
    return F.map_filter(F.map_zip_with(after, before, lambda k, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))), lambda k, v: v != 0)


def normalize_works(raw: DataFrame, message: str = "message") -> DataFrame:
    """Nested bibliographic messages (JSON text) as flat records."""
    schema = (
        "DOI string, title array<string>, `container-title` array<string>, publisher string, abstract string, URL string, "
        "author array<struct<given:string,family:string,name:string>>, license array<struct<URL:string>>, "
        "link array<struct<URL:string,`content-type`:string>>, subject array<string>, "
        "issued struct<`date-parts`:array<array<int>>>, reference array<struct<key:string,DOI:string,unstructured:string,`article-title`:string,year:string>>"
    )
    x = raw.withColumn("_m", F.from_json(message, schema))
    none = F.array().cast("array<string>")
    names = F.transform(F.coalesce("_m.author", F.array().cast("array<struct<given:string,family:string,name:string>>")), lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"])))
    return x.select(
        *raw.columns,
        I.clean_doi(F.coalesce("_m.DOI", F.lit(""))).alias("doi"),
        T.normalize_text(F.get("_m.title", F.lit(0))).alias("title"),
        F.get("_m.container-title", F.lit(0)).alias("journal"),
        F.col("_m.publisher").alias("publisher"),
        T.strip_tags(F.col("_m.abstract")).alias("abstract"),
        F.col("_m.URL").alias("landing_url"),
        T.dedupe_authors(names).alias("authors"),
        I.date_parts(F.col("_m.issued.date-parts")).alias("published"),
        T.ordered_distinct(F.coalesce(F.transform("_m.license", lambda v: v["URL"]), none)).alias("licences"),
        T.ordered_distinct(F.coalesce(F.transform("_m.link", lambda v: v["URL"]), none)).alias("links"),
        T.ordered_distinct(F.coalesce("_m.subject", none)).alias("keywords"),
        F.col("_m.reference").alias("references"),
    )


def reference_text(authors: Column, title: Column, raw: Column, label: Column) -> Column:
    """A citation from its parts, or its raw text: label, up to six authors, title."""
    none = F.array().cast("array<string>")
    made = F.concat_ws(". ", F.array_join(F.slice(F.coalesce(authors, none), 1, 6), ", "), title)
    body = F.when(T.normalize_text(raw) != "", T.normalize_text(raw)).otherwise(T.normalize_text(made))
    return F.when(T.normalize_text(label) != "", F.concat_ws(" ", label, body)).otherwise(body)


def reference_limit(include: Column, total: Column) -> Column:
    """How many references a limit of none, all or topN shows."""
    top = F.regexp_extract(F.lower(include), "^top([0-9]+)$", 1)
    return F.when(include == "none", 0).when(top != "", F.least(top.try_cast("int"), total)).otherwise(total).cast("int")


def cached_request_matches(cached: Column, request: Column) -> Column:
    """Whether a cached request (struct of modes, strategy, refs, tokens) answers another."""
    modes = F.size(F.array_except(request["modes"], cached["modes"])) == 0
    same = cached["strategy"].eqNullSafe(request["strategy"]) & cached["refs"].eqNullSafe(request["refs"]) & cached["tokens"].eqNullSafe(request["tokens"])
    return modes & same


def near_duplicate_thresholds() -> tuple[float, float, int]:
    return rules.NEAR_DUPLICATE_RATIO, rules.NEAR_PARAGRAPH_RATIO, rules.NEAR_DUPLICATE_LENGTHS
