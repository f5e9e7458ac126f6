"""One query per operator family over the driver's tables, with the same result in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import identifiers as I
from ..functions import once
from ..functions import text as T
from ..operators import budgets, matching, quality, records, reports, routing, sections
from ..session import ship_package
from ..sources import read_table
from . import articles

#: In SQL: white space as the text functions see it, and a quoted list.
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(replace({0}, chr(160), ' '), '[ \t\r\f\x0b]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g'))"


def _normal(column: str) -> str:
    return _NORMAL.format(f"coalesce({column}, '')")


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _any(column: str, phrases, how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


def _starts(column: str, phrases) -> str:
    return _any(column, phrases, "starts_with")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


_ARTICLE = r"regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)"
_VISIBLE = f"regexp_replace({_ARTICLE}, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in ("script", "style", "nav", "footer", "aside"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
_VISIBLE = rf"trim(regexp_replace(regexp_replace({_VISIBLE}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_WORDS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'))"
_PAGE_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"


@query(rf"""
WITH t AS (SELECT page_id, {_PAGE_TITLE} AS title, len(regexp_extract_all(html, '(?i)<p[\s>]')) AS paragraphs, {_VISIBLE} AS text FROM pages)
SELECT page_id, title, paragraphs, {_WORDS.format('text')} AS words, length(text) AS chars, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
  CASE WHEN length(text) >= 300 AND {_WORDS.format('text')} >= 60 AND paragraphs >= 2 THEN 'fulltext' ELSE 'metadata_only' END AS kind FROM t""")
def page_title_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, paragraphs, words, tokens and kind of every page."""
    return articles.minimum_slice(read_table(spark, sf_dir, "pages"))


@query(rf"""
WITH t AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path FROM pages)
SELECT page_id, scheme, host, path, scheme IN ('http', 'https') AND host <> '' AS is_http,
  host <> '' AND (host IN ({_quoted(rules.API_HOSTS)}) OR starts_with(host, 'api.') OR {_any('lower(path)', rules.API_PATHS)}) AS is_api, {_any('lower(url)', rules.ACCESS_URL_TOKENS)} AS is_access FROM t""")
def page_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each page's URL and what kind it is."""
    u = F.col("url")
    return read_table(spark, sf_dir, "pages").select("page_id", I.scheme(u).alias("scheme"), I.host(u).alias("host"), I.path(u).alias("path"), I.is_http_url(u).alias("is_http"), I.is_api_like_url(u).alias("is_api"), I.is_access_page(u).alias("is_access"))


@query(r"""
WITH s AS (SELECT page_id, lower(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g')) AS x, url FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS slug FROM pages)
SELECT page_id, CASE WHEN slug = '' THEN 'fulltext_' || substr(sha1(url), 1, 8) WHEN length(slug) <= 24 THEN slug
  ELSE regexp_replace(substr(regexp_replace(substr(slug, 1, 24), '[._-]+$', ''), 1, 15), '[._-]+$', '') || '_' || substr(sha1(url), 1, 8) END AS file_name FROM t""")
def doc_filename_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe file names of URLs, at most 24 characters."""
    return read_table(spark, sf_dir, "pages").select("page_id", I.file_name(F.col("url"), 24).alias("file_name"))


@query(rf"""
WITH t AS (SELECT page_id, lower({_normal("concat_ws(' ', " + _PAGE_TITLE + ", " + _VISIBLE + ")")}) AS page FROM pages)
SELECT page_id, {_any('page', rules.CHALLENGE_PHRASES)} AS challenge, {_any('page', rules.NOT_FOUND_PHRASES)} AS missing, {_any('page', rules.ACCESS_GATE_PHRASES)} AS paywall,
  array_to_string(list_filter([CASE WHEN {_any('page', rules.CHALLENGE_PHRASES)} THEN 'cloudflare_challenge' END, CASE WHEN {_any('page', rules.NOT_FOUND_PHRASES)} THEN 'publisher_not_found' END,
    CASE WHEN {_any('page', rules.ACCESS_GATE_PHRASES)} THEN 'publisher_paywall' END], lambda x: x IS NOT NULL), ',') AS signals FROM t""")
def access_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access signals in each page's title and visible text."""
    from ..functions import html as W

    page = read_table(spark, sf_dir, "pages").select("page_id", W.page_title(F.col("html")).alias("title"), W.visible_text(F.regexp_extract("html", "(?is)<article[^>]*>(.*)</article>", 1)).alias("text"))
    found = page.withColumn("s", T.access_signals(F.col("title"), F.col("text"), F.lit(None).cast("int")))
    has = lambda name: F.array_contains("s", name)
    return found.select("page_id", has("cloudflare_challenge").alias("challenge"), has("publisher_not_found").alias("missing"), has("publisher_paywall").alias("paywall"), F.array_join("s", ",").alias("signals"))


_MARKERS = ("<article", "citation_pdf_url", "articlebody", "class=\"ad\"", "data-")


@query(f"""SELECT page_id, {', '.join(f"contains(lower(html), '{m}') AS m{k}" for k, m in enumerate(_MARKERS))}, CAST({' + '.join(f"CAST(contains(lower(html), '{m}') AS INT)" for m in _MARKERS)} AS BIGINT) AS markers FROM pages""")
def positive_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which marks are in each page's source."""
    low = F.lower("html")
    found = [F.contains(low, F.lit(m)) for m in _MARKERS]
    return read_table(spark, sf_dir, "pages").select("page_id", *(c.alias(f"m{k}") for k, c in enumerate(found)), sum((c.cast("long") for c in found), F.lit(0).cast("long")).alias("markers"))


@query(rf"""SELECT doc_id, md5({_normal('text')}) AS digest, length({_normal('text')}) AS chars, md5(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS plain_digest FROM documents""")
def doc_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text normalised, and without tags."""
    normal = T.normalize_text(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(normal.cast("binary")).alias("digest"), F.char_length(normal).cast("long").alias("chars"), F.md5(T.strip_tags(F.col("text")).cast("binary")).alias("plain_digest"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS title_key, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS canonical FROM documents""")
def doc_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which texts count as equal."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_title(F.col("text")).cast("binary")).alias("title_key"), F.md5(T.canonical(F.col("text")).cast("binary")).alias("canonical"))


@query(rf"""SELECT doc_id, {_WORDS.format('text')} AS words, length(regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}]+', '', 'g')) AS cjk FROM documents""")
def doc_word_cjk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode words and CJK characters of every text."""
    return read_table(spark, sf_dir, "documents").select("doc_id", T.count_words(F.col("text")).alias("words"), T.count_cjk(F.col("text")).alias("cjk"))


@query(rf"""
WITH t AS (SELECT doc_id, {_normal('text')} AS x FROM documents), c AS (SELECT *, regexp_replace(substr(x, 1, 256), '[ ,;:\n]+$', '') AS cut FROM t)
SELECT doc_id, CAST(ceil(length(x) / 4.0) AS BIGINT) AS tokens, CASE WHEN ceil(length(x) / 4.0) <= 64 THEN x WHEN length(cut) < length(x) THEN cut || '...' ELSE cut END AS shown FROM c""")
def doc_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimate of every text, and its form within 64 tokens."""
    normal = T.normalize_text(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(normal).alias("tokens"), T.truncate_to_tokens(normal, 64).alias("shown"))


#: Documents have no Markdown headings: lines of one or two words count as such here.
_AS_HEADING = "^[^ ]+( [^ ]+)?$"


@query(rf"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT *, regexp_matches(line, '{_AS_HEADING}') AS head FROM l),
p AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM h),
g AS (SELECT doc_id, part, max(CASE WHEN head THEN line END) AS heading, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head) AS body FROM p GROUP BY 1, 2),
k AS (SELECT doc_id, part, coalesce(heading, 'Full Text') AS heading, coalesce(body, '') AS body FROM g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS BIGINT) AS section, heading, length(body) AS chars, md5(body) AS digest FROM k WHERE body <> ''""")
def doc_line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document gathered under headings."""
    docs = read_table(spark, sf_dir, "documents")
    marked = F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike(_AS_HEADING), F.concat(F.lit("# "), x)).otherwise(x))
    found = sections.lines(docs.select("doc_id", F.array_join(marked, "\n").alias("text"))).withColumn("head", F.col("line").rlike("^# "))
    part = F.sum(F.col("head").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    grouped = found.withColumn("part", part).groupBy("doc_id", "part").agg(F.max(F.when(F.col("head"), F.substring("line", 3, 1 << 30))).alias("heading"), body.alias("body")).where(F.col("body") != "")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return grouped.select("doc_id", number.cast("long").alias("section"), F.coalesce("heading", F.lit("Full Text")).alias("heading"), F.char_length("body").cast("long").alias("chars"), F.md5(F.col("body").cast("binary")).alias("digest"))


_H = "lower(heading)"
_PAGE_CLASS = f"""CASE WHEN {_any(_H, rules.ACCESS_GATE_PHRASES)} THEN 'ancillary' WHEN {_H} IN ({_quoted(rules.ABSTRACT_HEADINGS)}) OR starts_with({_H}, 'abstract') THEN 'abstract'
  WHEN {_starts(_H, rules.DATA_HEADINGS)} THEN 'data_availability' WHEN {_starts(_H, rules.CODE_HEADINGS)} THEN 'code_availability' WHEN {_starts(_H, rules.BACK_MATTER_HEADINGS)} THEN 'references_or_back_matter'
  WHEN {_starts(_H, rules.ANCILLARY_HEADINGS)} THEN 'ancillary' WHEN {_H} IN ({_quoted(rules.FRONT_MATTER_HEADINGS)}) THEN 'front_matter' ELSE 'body_heading' END"""
_EXTRA = ("introduction", "materials and methods", "results", "abstract of findings", "data availability and access")
_ALL_HEADINGS = list(dict.fromkeys([*rules.ABSTRACT_HEADINGS, *rules.FRONT_MATTER_HEADINGS, *rules.DATA_HEADINGS, *rules.CODE_HEADINGS, *rules.BACK_MATTER_HEADINGS, *rules.ANCILLARY_HEADINGS, *rules.MARKDOWN_AUXILIARY_HEADINGS, *_EXTRA]))


@query(f"""
WITH t AS (SELECT unnest([{_quoted(_ALL_HEADINGS)}]) AS heading), c AS (SELECT heading, {_PAGE_CLASS} AS page_class FROM t)
SELECT heading, page_class, CASE WHEN {_H} IN ({_quoted(rules.MARKDOWN_ABSTRACT_HEADINGS)}) OR starts_with({_H}, 'abstract') THEN 'abstract' WHEN {_H} IN ({_quoted(rules.MARKDOWN_AUXILIARY_HEADINGS)}) THEN 'auxiliary'
  WHEN {_H} IN ({_quoted(rules.MARKDOWN_FRONT_MATTER_HEADINGS)}) THEN 'front_matter' WHEN {_starts(_H, rules.DATA_HEADINGS)} THEN 'data_availability' WHEN {_starts(_H, rules.CODE_HEADINGS)} THEN 'code_availability'
  WHEN {_starts(_H, rules.BACK_MATTER_HEADINGS)} THEN 'references_or_back_matter' WHEN page_class = 'ancillary' THEN 'auxiliary' ELSE page_class END AS markdown_class,
  CASE WHEN {_H} IN ('references', 'bibliography') THEN 'references' WHEN {_H} IN ('supplementary materials', 'supplementary information') THEN 'supplementary'
  WHEN page_class IN ('data_availability', 'code_availability', 'abstract') THEN page_class WHEN page_class = 'references_or_back_matter' THEN 'references' WHEN page_class = 'ancillary' THEN 'diagnostics' ELSE 'body' END AS kind,
  CAST(CASE {' '.join(f"WHEN {_H} = '{k}' THEN {v}" for k, v in rules.SECTION_PRIORITY)} {' '.join(f"WHEN contains({_H}, '{k}') THEN {v}" for k, v in rules.SECTION_PRIORITY)} ELSE 4 END AS BIGINT) AS priority FROM c""")
def heading_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all headings of the rule tables."""
    return articles.heading_table(spark, _EXTRA)


@query(rf"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
b AS (SELECT doc_id, pos, {_normal('raw')} AS block FROM l),
f AS (SELECT *, {_any('lower(block)', rules.ACCESS_GATE_PHRASES)} AS gate, length(block) >= 80 AS prose FROM b WHERE block <> ''),
k AS (SELECT *, prose AND NOT gate AS body FROM f),
i AS (SELECT *, sum(CAST(NOT body AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM k),
r AS (SELECT doc_id, island, sum(CAST(body AS INT)) AS n, sum(CASE WHEN body THEN length(block) ELSE 0 END) AS chars FROM i GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS body_paragraphs, CAST(max(n) AS BIGINT) AS run_paragraphs, CAST(max(chars) AS BIGINT) AS run_chars, max(n) >= 3 AS accepted FROM r GROUP BY 1""")
def sticky_state_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of long lines of every document, by gaps and islands."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda x: T.normalize_text(x)), lambda x: x != "").alias("blocks"))
    # characters of a body paragraph, 0 for what breaks a run; a fold over each document, so nothing is dealt anew
    sizes = F.transform("blocks", lambda x: F.when((F.char_length(x) >= 80) & ~T.has_access_gate(x), F.char_length(x)).otherwise(0))
    start = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "chars", "most", "most_chars", "total")))

    def step(s: F.Column, x: F.Column) -> F.Column:
        n, chars = F.when(x > 0, s["n"] + 1).otherwise(0), F.when(x > 0, s["chars"] + x).otherwise(0)
        return F.struct(n.cast("long").alias("n"), chars.cast("long").alias("chars"), F.greatest(s["most"], n).cast("long").alias("most"), F.greatest(s["most_chars"], chars).cast("long").alias("most_chars"), F.when(x > 0, s["total"] + 1).otherwise(s["total"]).cast("long").alias("total"))

    out = docs.where(F.size("blocks") > 0).select("doc_id", F.aggregate(once(sizes), start, step).alias("x"))
    return out.select("doc_id", F.col("x.total").alias("body_paragraphs"), F.col("x.most").alias("run_paragraphs"), F.col("x.most_chars").alias("run_chars"), (F.col("x.most") >= 3).alias("accepted"))


_DOMAINS = [d for p in rules.PROVIDERS for d in p[2]]
_PREFIXES = [x for p in rules.PROVIDERS for x in p[3]]
_ALIASES = [a for p in rules.PROVIDERS for a in p[4]]


def _first_provider(condition) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{p[0]}'" for p in rules.PROVIDERS if (c := condition(p))) + " END"


@query(f"""
WITH q AS (SELECT event_id, list_value({_quoted(_DOMAINS)})[1 + event_id % {len(_DOMAINS)}] AS host, list_value({_quoted(_ALIASES)})[1 + event_id % {len(_ALIASES)}] AS publisher,
  list_value({_quoted(_PREFIXES)})[1 + event_id % {len(_PREFIXES)}] || user_id AS doi FROM events),
s AS (SELECT event_id, 0 AS o, {_first_provider(lambda p: " OR ".join(f"contains(host, '{d}')" for d in p[2]))} AS provider, 'domain' AS signal FROM q
  UNION ALL SELECT event_id, 1, {_first_provider(lambda p: " OR ".join(f"publisher = '{a}'" for a in p[4]))}, 'publisher' FROM q
  UNION ALL SELECT event_id, 2, {_first_provider(lambda p: " OR ".join(f"starts_with(doi, '{x}')" for x in p[3]))}, 'doi' FROM q),
f AS (SELECT *, row_number() OVER (PARTITION BY event_id, provider ORDER BY o) AS n FROM s WHERE provider IS NOT NULL)
SELECT event_id, provider, signal, row_number() OVER (PARTITION BY event_id ORDER BY o) AS rank FROM f WHERE n = 1""")
def provider_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered provider candidates from URL, publisher and DOI; signals are made from event ids."""
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("event_id") % len(values) + 1).cast("int"))
    asked = read_table(spark, sf_dir, "events").select(
        "event_id",
        F.array(F.concat(F.lit("https://www."), pick(_DOMAINS), F.lit("/x"))).alias("urls"),
        F.array(pick(_ALIASES)).alias("publishers"),
        F.concat(pick(_PREFIXES), F.col("user_id").cast("string")).alias("doi"),
    )
    return routing.route(asked, "event_id").withColumn("rank", F.col("rank").cast("long"))


@query("""
WITH p AS (SELECT c_custkey AS key, c_name AS title, c_mktsegment AS segment FROM customer), s AS (SELECT s_suppkey * 2 AS key, s_name AS title FROM supplier)
SELECT coalesce(p.key, s.key) AS key, CASE WHEN p.title IS NOT NULL THEN nullif(trim(p.title), '') ELSE nullif(trim(s.title), '') END AS title,
  array_to_string(list_distinct(list_filter([p.segment, s.title], lambda x: x IS NOT NULL AND x <> '')), '|') AS names FROM p FULL JOIN s ON p.key = s.key""".replace("list_distinct(", "("))
def metadata_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer merge of two record tables, the primary's values first."""
    p = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.array_compact(F.array("c_mktsegment")).alias("names"))
    s = read_table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("key"), F.col("s_name").alias("title"), F.array_compact(F.array("s_name")).alias("names"))
    return records.merge_metadata(p, s, "key", ("title",), ("names",)).select("key", "title", F.array_join("names", "|").alias("names"))


@query(r"""
WITH t AS (SELECT doc_id, source, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS k FROM documents)
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM t GROUP BY k""")
def dedupe_first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each canonical text, and how many share it."""
    keyed = read_table(spark, sf_dir, "documents").select("doc_id", F.md5(T.canonical(F.col("text")).cast("binary")).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


_TOKENS_SQL = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_TOPK_SQL = f"""
t AS (SELECT page_id, {_TOKENS_SQL.format(_PAGE_TITLE)} AS toks FROM pages), q AS (SELECT page_id AS item_id, toks FROM t WHERE page_id % 100 = 0), w AS (SELECT page_id AS doc_id, toks FROM t),
a AS (SELECT item_id, len(toks) AS n, unnest(toks) AS tok FROM q), b AS (SELECT doc_id, len(toks) AS m, unnest(toks) AS tok FROM w),
s AS (SELECT item_id, doc_id, count(*) * 1.0 / (any_value(n) + any_value(m) - count(*)) AS jaccard FROM a JOIN b USING (tok) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, CAST(floor(jaccard * 1e9 + 0.5) AS BIGINT) AS score, row_number() OVER (PARTITION BY item_id ORDER BY jaccard DESC, doc_id) AS rank FROM s)"""


def _titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Titles that are looked up (of every hundredth page), and those of all pages."""
    from ..functions import html as W

    works = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("work_id"), W.page_title(F.col("html")).alias("title"))
    return works.where(F.col("work_id") % 100 == 0).withColumnRenamed("work_id", "query_id"), works


def _ranked(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    return matching.title_candidates(*_titles(spark, sf_dir), top)


@query(f"WITH {_TOPK_SQL} SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5")
def title_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pages whose titles are most like that of every hundredth page, by token Jaccard."""
    out = _ranked(spark, sf_dir, 5)
    return out.select(F.col("query_id").alias("item_id"), F.col("work_id").alias("doc_id"), F.floor(F.col("jaccard") * 1e9 + 0.5).cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_TOPK_SQL}, p AS (SELECT item_id, max(CASE WHEN rank = 1 THEN doc_id END) AS doc_id, max(CASE WHEN rank = 1 THEN score END) AS first, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS second FROM r WHERE rank <= 2 GROUP BY 1)
SELECT item_id, doc_id, first, second, first >= 900000000 AND first - second >= 50000000 AS confident FROM p""")
def confident_top_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best candidate of every hundredth page's title is sure."""
    scored = _ranked(spark, sf_dir, 2).withColumn("score", F.floor(F.col("jaccard") * 1e9 + 0.5).cast("long"))
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    out = scored.withColumn("second", F.coalesce(F.lead("score").over(by_rank), F.lit(0)).cast("long")).where("rank = 1")
    sure = (F.col("score") >= 900_000_000) & (F.col("score") - F.col("second") >= 50_000_000)
    return out.select(F.col("query_id").alias("item_id"), F.col("work_id").alias("doc_id"), F.col("score").alias("first"), "second", sure.alias("confident"))


@query()
def near_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts of nearly equal length with a matching-block ratio of 0.995 or more."""
    return matching.near_duplicates(read_table(spark, sf_dir, "documents"))


@query(r"""
WITH i AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS chunk FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS body FROM documents)
SELECT item_id, doc_id, length(chunk) >= 240 AS long_chunk FROM i JOIN d ON contains(body, chunk) WHERE length(chunk) >= 160""")
def abstract_body_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark text of at least 160 characters whole.

    Candidates share the hash of the text's first eight words, found in every window of eight words
    of the documents, so no document is compared with all texts.
    """
    chunk = read_table(spark, sf_dir, "benchmark").select("item_id", F.lower(T.one_line(F.col("text"))).alias("chunk")).where(F.char_length("chunk") >= 160)
    start = chunk.select("item_id", "chunk", F.xxhash64(F.array_join(F.slice(F.split("chunk", " "), 1, 8), " ")).alias("key"), F.size(F.split("chunk", " ")).alias("n"))
    body = read_table(spark, sf_dir, "documents").select("doc_id", F.lower(T.one_line(F.col("text"))).alias("body")).withColumn("w", F.split("body", " "))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 7, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, F.lit(8)), " ")))
    # the first word may be the end of a longer one: the windows then start one word later
    second = chunk.select("item_id", "chunk", F.xxhash64(F.array_join(F.slice(F.split("chunk", " "), 2, 8), " ")).alias("key"))
    keys = second.unionByName(start.select("item_id", "chunk", "key")).distinct()
    found = body.select("doc_id", "body", F.explode(F.array_distinct(windows)).alias("key")).join(F.broadcast(keys) if keys.count() <= 100_000 else keys, "key").where(F.contains("body", F.col("chunk")))
    return found.select("item_id", "doc_id", (F.char_length("chunk") >= 240).alias("long_chunk")).distinct()


@query(r"""
WITH t AS (SELECT d.doc_id, length(text) AS chars, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS blocks, l.quality FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)),
k AS (SELECT *, CASE WHEN chars >= 300 AND words >= 60 AND (blocks >= 2 OR words >= 90) THEN 'fulltext' WHEN words > 0 THEN 'abstract_only' ELSE 'metadata_only' END AS kind FROM t)
SELECT doc_id, kind, CASE WHEN kind <> 'fulltext' OR quality = 0 THEN 'low' WHEN blocks < 2 THEN 'medium' ELSE 'high' END AS confidence FROM k""")
def content_kind_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and confidence of every document from its counts and its label."""
    marked = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    t = read_table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("chars"), T.count_words(F.col("text")).alias("words"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("blocks")).join(marked, "doc_id", "left")
    full = (F.col("chars") >= rules.SHORT_BODY_CHARS) & (F.col("words") >= rules.SHORT_BODY_WORDS) & ((F.col("blocks") >= 2) | (F.col("words") >= rules.SINGLE_BLOCK_WORDS))
    t = t.withColumn("kind", quality.content_kind(full, F.col("words") > 0))
    flags = F.array_compact(F.array(F.when(F.col("blocks") < 2, "weak_body_structure")))
    return t.select("doc_id", "kind", quality.confidence(F.col("kind"), flags, hard_negative=F.coalesce(F.col("quality") == 0, F.lit(False))).alias("confidence"))


_BODY = r"(SELECT page_id, {0} AS text, len(regexp_extract_all({1}, '(?i)<p[\s>]')) AS blocks, len(regexp_extract_all({1}, '(?i)<h[1-6][\s>]')) AS headings FROM pages)"


@query(rf"""
WITH t AS {_BODY.format(_VISIBLE, _ARTICLE)}, m AS (SELECT page_id, length(text) AS chars, {_WORDS.format('text')} AS words, length(regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}]+', '', 'g')) AS cjk, blocks, headings FROM t)
SELECT page_id, chars, words, cjk, blocks, CASE WHEN chars < 300 THEN false WHEN cjk >= 120 AND cjk >= 0.2 * chars THEN blocks >= 2 OR headings >= 1 OR (blocks = 1 AND cjk >= 180)
  WHEN words < 60 THEN false ELSE blocks >= 2 OR headings >= 1 OR (blocks = 1 AND words >= 90) END AS sufficient FROM m""")
def page_body_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each page's article and whether they make a body."""
    from ..functions import html as W

    inner = F.regexp_extract("html", "(?is)<article[^>]*>(.*)</article>", 1)
    t = read_table(spark, sf_dir, "pages").select("page_id", W.visible_text(inner).alias("text"), F.regexp_count(inner, F.lit("(?i)<p[\\s>]")).cast("long").alias("body_blocks"), F.regexp_count(inner, F.lit("(?i)<h[1-6][\\s>]")).cast("long").alias("body_headings"))
    t = t.withColumns({"chars": F.char_length("text").cast("long"), "words": T.count_words(F.col("text")), "cjk": T.count_cjk(F.col("text")), "has_abstract": F.lit(False), "body_to_abstract": F.lit(0.0)})
    return t.select("page_id", "chars", "words", "cjk", F.col("body_blocks").alias("blocks"), sections.sufficient_body().alias("sufficient"))


@query(r"""
WITH t AS (SELECT conv_id, turn, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations), s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM t),
f AS (SELECT *, sum(CAST(total > 200 AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS misfits, 200 - (total - tokens) AS room FROM s),
c AS (SELECT *, regexp_replace(substr(text, 1, CAST(greatest(32, 4 * greatest(room - 4, 0)) AS INT)), '[ ,;:\n]+$', '') AS cut FROM f)
SELECT conv_id, turn, total > 200 AS truncated, md5(CASE WHEN total <= 200 THEN text WHEN ceil(length(text) / 4.0) <= room - 4 THEN text WHEN length(cut) < length(text) THEN cut || '...' ELSE cut END) AS digest FROM c
WHERE (total <= 200 AND misfits = 0) OR (misfits = 1 AND total > 200 AND room > 64)""")
def budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of every conversation within 200 tokens, the first misfit cut."""
    turns = read_table(spark, sf_dir, "conversations").withColumn("tokens", T.estimate_tokens(F.col("text")))
    return budgets.pack_prefix(turns, 200, "conv_id", ["turn"]).select("conv_id", "turn", "truncated", F.md5(F.col("shown").cast("binary")).alias("digest"))


@query("SELECT source, doc_id, n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM documents) WHERE n <= least(10, total)")
def refs_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents of each source, as a limit of top10 shows them."""
    docs = read_table(spark, sf_dir, "documents").select("source", "doc_id")
    ranked = docs.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long"))
    total = docs.groupBy("source").agg(F.count("*").alias("total"))
    return ranked.where(F.col("n") <= 10).join(total, "source").where(F.col("n") <= records.reference_limit(F.lit("top10"), F.col("total").cast("int"))).drop("total")


@query("""
WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS place FROM documents)
SELECT doc_id, turn, place, row_number() OVER (PARTITION BY turn ORDER BY place) AS seat FROM t""")
def round_robin_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each source per turn, sources in order of their first document."""
    out = records.interleave(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"])
    seat = F.row_number().over(Window.partitionBy("turn").orderBy("place"))
    return out.select("doc_id", F.col("turn").cast("long").alias("turn"), "place", seat.cast("long").alias("seat"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each source."""
    return records.first_n_per_key(read_table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 3)


_RESULTS_SQL = """r AS (SELECT d.doc_id, d.source AS provider, d.lang, CASE WHEN l.quality IS NULL THEN 'skipped' WHEN l.quality = 1 THEN 'fulltext' ELSE 'blocked' END AS status,
  list_filter([CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 0 THEN 'low_quality' END, CASE WHEN d.n_chars > 5000 THEN 'long' END, CASE WHEN d.n_chars < 200 THEN 'short' END], lambda x: x IS NOT NULL) AS flags
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "skipped").when(F.col("quality") == 1, "fulltext").otherwise("blocked")
    flags = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("n_chars") > 5000, "long"), F.when(F.col("n_chars") < 200, "short")))
    return d.select("doc_id", F.col("source").alias("provider"), F.col("lang").alias("source"), status.alias("status"), flags.alias("flags"))


@query(f"""WITH {_RESULTS_SQL}, n AS (SELECT provider, doc_id, row_number() OVER (PARTITION BY provider ORDER BY doc_id) AS k FROM r)
SELECT provider, count(*) AS attempted, count(*) FILTER (status = 'fulltext') AS n_fulltext, count(*) FILTER (status = 'blocked') AS n_blocked, count(*) FILTER (status = 'skipped') AS n_skipped,
  array_to_string(list_sort(list_distinct(list(lang) FILTER (status = 'fulltext'))), ',') AS sources, (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) FROM n WHERE n.provider = r.provider AND k <= 3) AS samples FROM r GROUP BY provider""")
def provider_summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents by status, languages of the good ones, first three ids."""
    out = reports.by_provider(_results(spark, sf_dir), ["fulltext", "blocked", "skipped"], order="doc_id", sample="doc_id")
    return out.withColumn("sources", F.array_join("sources", ",")).withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query(f"""WITH {_RESULTS_SQL}, e AS (SELECT doc_id, unnest(flags) AS flag FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY doc_id) AS k FROM e)
SELECT flag, count(*) AS rows, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 5) AS samples FROM n GROUP BY flag""")
def issue_flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per flag: documents that have it, first five ids."""
    out = reports.by_issue(_results(spark, sf_dir), order="doc_id", sample="doc_id", n=5)
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query("""
WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT event_id, user_id, ts, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events, m WHERE ts >= now - INTERVAL 20 DAY),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k, sum(bytes) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS total FROM l)
SELECT event_id, user_id, bytes FROM n WHERE k <= 8 AND total <= 40000""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's cache keeps: 20 days, eight entries, 40000 bytes."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor(F.col("value") * 100).cast("long").alias("bytes"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return records.evict(e, now, F.expr("INTERVAL 20 DAYS"), 8, 40000, at="ts", size="bytes", key="event_id", pool="user_id").select("event_id", "user_id", "bytes")


@query("""
WITH t AS (SELECT user_id, event_id AS pos, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'success' WHEN (SELECT max(event_type) FROM events) THEN 'stop' ELSE 'failed' END AS outcome FROM events),
g AS (SELECT user_id, min(pos) FILTER (outcome = 'success') AS first, min(pos) FILTER (outcome = 'stop') AS stop, count(*) AS attempts FROM t GROUP BY 1)
SELECT user_id, coalesce(CASE WHEN stop IS NULL OR first < stop THEN first END, -1) AS winner, attempts FROM g""")
def waterfall_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first success before a failure that stops the rest; outcomes are made from event types."""
    e = read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), "event_type")
    low, high = e.agg(F.min("event_type"), F.max("event_type")).first()
    outcome = F.when(F.col("event_type") == low, "success").when(F.col("event_type") == high, "stop").otherwise("failed")
    return routing.waterfall(e.withColumn("outcome", outcome), "user_id").na.fill(-1, ["winner"])


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def latest_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type."""
    return records.latest_per_kind(read_table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "ts")


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs, figures and tables of every page's content, in order."""
    found = articles.pages_to_articles(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", F.col("pos").cast("long").alias("pos"), "b.kind", "b.level", "b.text")


@query()
def html_main_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of every page's content with its token estimate."""
    found = articles.pages_to_articles(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "title", "markdown", T.estimate_tokens(F.col("markdown")).alias("tokens"))


@query()
def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, confidence and flags of every page from its parsed Markdown."""
    found = articles.page_verdicts(articles.pages_to_articles(read_table(spark, sf_dir, "pages")))
    return found.select("page_id", "kind", "confidence", F.array_join("flags", ",").alias("flags"), "words", "tokens")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS rows FROM events GROUP BY 1, 2")
def event_counts_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, as the streaming form counts them."""
    from ..streaming import counts_by_window

    return counts_by_window(read_table(spark, sf_dir, "events"), "ts", "event_type")


@query(r"""
WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ', ' || c_mktsegment ELSE c_mktsegment || ' ' || c_name END AS name FROM customer),
k AS (SELECT c_custkey, trim(regexp_replace(lower(CASE WHEN contains(name, ',') THEN trim(split_part(name, ',', 2)) || ' ' || trim(split_part(name, ',', 1)) ELSE name END), '[^a-z0-9]+', ' ', 'g')) AS key FROM n)
SELECT key, count(*) AS names, min(c_custkey) AS first FROM k GROUP BY key""")
def author_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in either order under one key."""
    c = read_table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(", "), "c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" "), "c_name"))
    return c.select(T.author_key(name).alias("key"), "c_custkey").groupBy("key").agg(F.count("*").alias("names"), F.min("c_custkey").alias("first"))


@query(r"""
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://doi.org/10.1016/J.' || user_id || '–' || event_id || ').' WHEN 1 THEN 'doi: 10.1038/S' || event_id || ' ' || user_id
  WHEN 2 THEN 'see 10.1126/x.' || event_id || '; and more' ELSE 'no identifier ' || event_id END AS raw FROM events),
c AS (SELECT event_id, raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(trim(raw)), '‐‑‒–—−', '------'), '^https?://(dx\.)?doi\.org/', ''), '^doi:\s*', ''), '\s+', '', 'g'), '[).,;]+$', '') AS cleaned FROM r)
SELECT event_id, cleaned, regexp_replace(translate(lower(regexp_extract(raw, '(10\.[0-9]{4,9}/[^\s"<>]+)', 1)), '‐‑‒–—−', '------'), '[).,;]+$', '') AS found FROM c""")
def doi_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs cleaned and found in texts that are made from event ids."""
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("https://doi.org/10.1016/J."), u, F.lit("–"), e, F.lit(").")))
        .when(kind == 1, F.concat(F.lit("doi: 10.1038/S"), e, F.lit(" "), u))
        .when(kind == 2, F.concat(F.lit("see 10.1126/x."), e, F.lit("; and more")))
        .otherwise(F.concat(F.lit("no identifier "), e))
    )
    return read_table(spark, sf_dir, "events").select("event_id", I.clean_doi(raw).alias("cleaned"), F.coalesce(I.extract_doi(raw), F.lit("")).alias("found"))


_MIMES = ["application/pdf", "text/html; charset=utf-8", "image/png", "odd/type"]


@query(f"""
WITH m AS (SELECT p_partkey, list_value({_quoted(_MIMES)})[1 + p_partkey % 4] AS mime, 'http://h/a/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.tar.gz?x=1' ELSE '' END AS url FROM part)
SELECT p_partkey, CASE WHEN starts_with(mime, 'application/pdf') THEN '.pdf' WHEN starts_with(mime, 'text/html') THEN '.html' WHEN mime = 'image/png' THEN '.png' WHEN p_partkey % 3 = 0 THEN '.gz' ELSE '.bin' END AS extension FROM m""")
def file_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions from MIME types, else from URLs."""
    p = F.col("p_partkey")
    mime = F.element_at(F.array(*(F.lit(m) for m in _MIMES)), (p % 4 + 1).cast("int"))
    url = F.concat(F.lit("http://h/a/"), p.cast("string"), F.when(p % 3 == 0, ".tar.gz?x=1").otherwise(""))
    return read_table(spark, sf_dir, "part").select("p_partkey", I.extension(mime, url).alias("extension"))


@query(r"""
WITH m AS (SELECT event_id, user_id, 'fulltext:' || event_type || CASE WHEN event_id % 3 = 0 THEN '_ok' WHEN event_id % 3 = 1 THEN '_fail' ELSE '_odd' END AS mark, event_id AS pos FROM events)
SELECT user_id, string_agg(mark, ' -> ' ORDER BY pos) FILTER (mark LIKE '%\_ok' ESCAPE '\') AS path, count(DISTINCT CASE WHEN mark LIKE '%\_odd' ESCAPE '\' THEN NULL ELSE mark END) AS marks FROM m GROUP BY user_id""")
def success_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of success marks of all of each user's events, and how many different known marks there are."""
    e = read_table(spark, sf_dir, "events")
    end = F.when(F.col("event_id") % 3 == 0, "ok").when(F.col("event_id") % 3 == 1, "fail").otherwise("odd")
    marked = e.select("user_id", "event_id", reports.mark(F.lit("fulltext"), F.col("event_type"), end).alias("mark"))
    known = reports.parse_mark(F.col("mark"), ["ok", "fail"])["outcome"].isNotNull()
    trail = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "mark"))), lambda x: x["mark"])
    out = marked.groupBy("user_id").agg(reports.success_path(trail).alias("path"), F.count_distinct(F.when(known, F.col("mark"))).alias("marks"))
    return out.withColumn("path", F.nullif("path", F.lit("")))


@query("""
WITH p AS (SELECT user_id, event_id AS pos, CASE event_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'unknown' ELSE 'positive' END AS state FROM events)
SELECT user_id, arg_min(pos, (CASE state WHEN 'positive' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, pos)) AS pos FROM p GROUP BY user_id""")
def best_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first probe of the best state."""
    state = F.when(F.col("event_id") % 3 == 0, "negative").when(F.col("event_id") % 3 == 1, "unknown").otherwise("positive")
    probes = read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), state.alias("state"))
    return routing.best_probe(probes, "user_id").select("user_id", "pos")


@query("""
WITH d AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1, 2)
SELECT user_id, event_type, b - a AS delta FROM d WHERE b <> a""")
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between two counters of each user, without unchanged keys."""
    e = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_id") % 2 == 0).alias("a"), F.count_if(F.col("event_id") % 2 == 1).alias("b"))
    maps = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "a"))).alias("before"), F.map_from_entries(F.collect_list(F.struct("event_type", "b"))).alias("after"))
    return maps.select("user_id", F.explode(records.counter_delta(F.col("before"), F.col("after"))).alias("event_type", "delta"))


@query("""
WITH t AS (SELECT conv_id, turn, length(text) AS size FROM conversations WHERE length(text) <= 600), r AS (SELECT conv_id, turn, size, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM t)
SELECT conv_id, count(*) AS shown FROM r WHERE total <= 100000 GROUP BY conv_id""")
def skipping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that fit a budget one after the other; turns of over 600 characters are skipped."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.char_length("text").alias("bytes"))
    return budgets.pack_skipping(turns, 100_000, "conv_id", largest=600).groupBy("conv_id").agg(F.count("*").alias("shown"))


@query()
def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every hundredth page's title scored by tokens and characters, and whether the first is sure."""
    asked, works = _titles(spark, sf_dir)
    ranked = matching.title_candidates(asked, works, 5)
    pairs = ranked.select("query_id", "work_id", F.col("rank").alias("pos")).join(asked.withColumnRenamed("title", "query_title"), "query_id").join(works, "work_id")
    return matching.confident(matching.score_candidates(pairs)).select("query_id", "work_id", "score", "confident")


@query()
def page_references_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references, assets, abstracts and PDF links each page has."""
    found = articles.pages_to_articles(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", *(F.size(c).cast("long").alias(c) for c in ("references", "assets", "abstracts", "pdf_urls", "meta_authors")))


@query()
def document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: kind, confidence, tokens, number of sections."""
    out = articles.article_from_markdown(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "kind", "confidence", "tokens", F.size("sections").cast("long").alias("sections"))


@query()
def line_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of every document without navigation and promotion lines."""
    return sections.clean_lines(read_table(spark, sf_dir, "documents")).select("doc_id", F.char_length("text").cast("long").alias("chars"))
