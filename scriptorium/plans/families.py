"""Queries for the families of small operators, over values that are made from the ids of the driver's tables.

Each form is a pair of SQL texts: the raw value (for Spark and the operator), and what the operator must make of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import headings as H
from ..functions import identifiers as I
from ..functions import once
from ..functions import html as W
from ..functions import signals as S
from ..functions import sites
from ..functions import text as T
from ..functions import xml as X
from ..operators import assets, budgets, matching, quality, records, reports, routing, sections
from ..sources import read_table
from . import articles
from .queries import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


def _case(key: str, forms: list[str]) -> str:
    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(forms)) + " END"


def _raw(key: str, forms: list[tuple[str, str]]) -> Column:
    return F.expr(_case(key, [raw.replace("\\", "\\\\") for raw, _ in forms]))


def _want(key: str, forms: list[tuple[str, str]]) -> str:
    return _case(key, [want for _, want in forms])


def _form_query(table: str, key: str, columns: dict[str, tuple]) -> str:
    return f"SELECT {key}, " + ", ".join(f"{_want(key, forms)} AS {name}" for name, (_, forms) in columns.items()) + f" FROM {table}"


def _formed(spark: SparkSession, sf_dir: str, table: str, key: str, columns: dict[str, tuple]) -> DataFrame:
    return read_table(spark, sf_dir, table).select(key, *(of(_raw(key, forms)).alias(name) for name, (of, forms) in columns.items()))


_INLINE = {
    "cited": (T.citation_sup, [("concat('found [', event_id, ']  .')", "concat('found<sup>', event_id, '</sup>.')"), ("concat('as (refs. ', user_id, ', ', event_id, ') say')", "concat('as<sup>', user_id, ', ', event_id, '</sup> say')"), ("concat('year (x', event_id, ')')", "concat('year (x', event_id, ')')")]),
    "numeric": (T.numeric_citations, [("concat(event_id, ' ,', user_id)", "concat(event_id, ', ', user_id)"), ("concat(user_id, ' - ', event_id)", "concat(user_id, '–', event_id)"), ("concat('a', event_id)", "NULL")]),
    "cleaned": (
        lambda c: T.clean_citation_markers(c, True, True, True),
        [("concat('see [Fig ', event_id, '](#f1) , ok')", "concat('see Fig', event_id, ', ok')"), ("concat('Refs ', user_id, ' ; [x](/article/', event_id, ')')", "concat('Refs', user_id, '; x')"), ("concat('kept [y](http://h/', event_id, ')')", "concat('kept [y](http://h/', event_id, ')')")],
    ),
    "latex": (T.latex, [("concat('$x_{', event_id, '}$')", "concat('x_{', event_id, '}')"), ("concat('\\upalpha  + ', event_id)", "concat('\\alpha + ', event_id)"), ("concat('a\\mspace{', event_id, 'mu}b')", "concat('a\\mkern', event_id, 'mub')")]),
    "figure": (T.figure_label, [("concat('Fig. ', event_id, 'A')", "concat('figure ', event_id, 'a')"), ("concat('see figures ', event_id)", "concat('figure ', event_id)"), ("concat('configure ', event_id)", "NULL")]),
    "year": (T.last_year, [("concat('1987 and 20', lpad(cast(event_id % 100 AS string), 2, '0'))", "concat('20', lpad(CAST(event_id % 100 AS VARCHAR), 2, '0'))"), ("concat('in 1999. no ', 18000 + event_id % 100)", "'1999'"), ("concat('n', 300 + event_id % 100)", "NULL")]),
    "cell": (T.escape_table_cell, [("concat('a|', event_id)", "concat('a\\|', event_id)"), ("concat('b', event_id)", "concat('b', event_id)")]),
    "joined": (
        lambda c: T.join_fragments(F.split(c, "_")),
        [("concat('one_two', event_id)", "concat('one two', event_id)"), ("concat('a (_b', event_id, '_) c')", "concat('a (b', event_id, ') c')"), ("concat('x_ _y', event_id)", "concat('x y', event_id)")],
    ),
    "label": (T.strip_abstract_label, [("concat('Abstract: text ', event_id)", "concat('text ', event_id)"), ("concat('SUMMARY  of ', event_id)", "concat('of ', event_id)"), ("concat('Abstraction ', event_id)", "concat('Abstraction ', event_id)")]),
    "untitled": (
        lambda c: T.strip_title_heading(c, F.lit("A title")),
        [("concat('# A  Title!\n\nbody ', event_id)", "concat('body ', event_id)"), ("concat('# Other\n\nbody ', event_id)", "concat('# Other', chr(10), chr(10), 'body ', event_id)")],
    ),
}


@query(_form_query("events", "event_id", _INLINE))
def inline_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations, formulas, labels, years, cells, fragments and headings in their tidy forms."""
    return _formed(spark, sf_dir, "events", "event_id", _INLINE)


def _texts(values: Column) -> Column:
    return F.array_join(values, "|")


_NAMES = {
    "authors": (lambda c: _texts(T.dedupe_authors(T.split_authors(c))), [("concat('Ann B', c_custkey, '; ann b', c_custkey, '; C. D')", "concat('Ann B', c_custkey, '|C. D')"), ("concat('x', c_custkey, ' ,  y')", "concat('x', c_custkey, '|y')"), ("''", "''")]),
    "extended": (lambda c: _texts(T.extend_unique(F.array(F.lit("a"), F.lit("b")), F.split(c, ";"))), [("concat('b; c', c_custkey)", "concat('a|b|c', c_custkey)"), ("' ;a'", "'a|b'")]),
    "language": (T.language, [("'en_US'", "'en'"), ("'DE'", "'de'"), ("'x'", "NULL")]),
    "lookup": (T.is_lookup_title, [("concat('Deep rivers ', c_custkey)", "true"), ("'Redirecting'", "false"), ("' '", "false")]),
    "prose": (T.is_substantial_prose, [("concat(repeat('word ', 20), c_custkey)", "true"), ("concat('One. Two ', c_custkey)", "true"), ("concat('short ', c_custkey)", "false")]),
    "composed": (
        lambda c: T.compose_query(c, F.array(F.lit("A B"), F.lit("C"), F.lit("D"), F.lit("E")), F.lit(2020), F.lit("raw  text")),
        [("concat('Title ', c_custkey)", "concat('Title ', c_custkey, ' A B C D 2020')"), ("' '", "'raw text'")],
    ),
    "same": (lambda c: T.semantic_match(c, F.concat(F.lit("A long common start of words, then "), F.col("c_nationkey").cast("string"))), [("concat('a LONG common start of words: then ', c_nationkey)", "true"), ("concat('a long common start of other things ', c_custkey)", "true"), ("concat('nothing alike ', c_custkey)", "false")]),
    "dirty": (I.doi_needs_cleaning, [("concat('10.1234/a', c_custkey)", "false"), ("concat('https://doi.org/10.1234/A', c_custkey)", "true")]),
    "kind": (routing.query_kind, [("concat('https://h/', c_custkey)", "'url'"), ("concat('doi 10.1234/x', c_custkey)", "'doi'"), ("concat('a title ', c_custkey)", "'title'")]),
    "reference": (
        lambda c: records.reference_text(F.array(F.lit("A"), F.lit("B")), c, F.lit(None).cast("string"), F.lit("[1]")),
        [("concat('On soils ', c_custkey)", "concat('[1] A, B. On soils ', c_custkey)")],
    ),
    "gated": (lambda c: _texts(T.access_gate_phrases(c)), [(f"'Please {rules.ACCESS_GATE_PHRASES[0]} now'", f"'{rules.ACCESS_GATE_PHRASES[0]}'"), ("concat('open text ', c_custkey)", "''")]),
}

@query(_form_query("customer", "c_custkey", _NAMES))
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors, languages, titles, references and queries in their tidy forms, and what they count as."""
    return _formed(spark, sf_dir, "customer", "c_custkey", _NAMES)


_IMAGES = {
    "mime": (lambda c: I.image_type(F.unhex(c)), [("'89504E470D0A1A0A0000'", "'image/png'"), ("'FFD8FFE000'", "'image/jpeg'"), ("'474946383961'", "'image/gif'"), ("'524946460000000057454250'", "'image/webp'"), ("'49492A00'", "'image/tiff'"), ("'424D00'", "'image/bmp'"), ("'00'", "''")]),
    "width": (lambda c: F.coalesce(I.image_dimensions(F.unhex(c))["width"].cast("long"), F.lit(-1)), [("concat('89504E470D0A1A0A0000000D49484452', lpad(hex(p_partkey), 8, '0'), '0000000700')", "p_partkey"), ("concat('474946383961', '0A000500', '00')", "10"), ("'00'", "-1")]),
    "from_srcset": (I.image_url_from_srcset, [("concat('a.png 1x, b', p_partkey, '.png 2x')", "concat('b', p_partkey, '.png')"), ("concat('c', p_partkey, '.png 640w, d.png 320w')", "concat('c', p_partkey, '.png')"), ("''", "''")]),
    "full_size": (I.is_full_size_image, [(f"concat('http://h/', p_partkey, '{rules.FULL_SIZE_URLS[0]}')", "true"), (f"concat('http://h/', p_partkey, '{rules.FULL_SIZE_URLS[0]}{rules.PREVIEW_URLS[0]}')", "false"), ("concat('http://h/', p_partkey)", "false")]),
    "decoded": (lambda c: I.decode_bytes(F.unhex(c)), [("'63616665CC81'", "'cafe' || chr(769)"), ("'636166E9'", "'café'"), ("''", "''")]),
    "dated": (lambda c: I.date_parts(F.array(F.transform(F.split(c, "/"), lambda x: x.cast("int")))), [("concat('2001/2/', 1 + p_partkey % 28)", "concat('2001-2-', 1 + p_partkey % 28)"), ("'1999'", "'1999'")]),
    "urls": (lambda c: _texts(S.urls_in_json(c)), [("concat('{\"url\": \"http://h/', p_partkey, '\", \"x\": [{\"@href\": \"https://k/\"}, {\"URL\": \"http://h/', p_partkey, '\"}], \"note\": \"http://no\"}')", "concat('http://h/', p_partkey, '|https://k/')"), ("'[]'", "''")]),
    "science": (
        lambda c: _texts(S.science_blocking(c)),
        [("'{\"page\":{\"pageInfo\":{\"pageType\":\"journal-article-denial\",\"viewType\":\"abs\"}},\"user\":{\"entitled\":\"false\"}}'", "'aaas_page_type_denial|aaas_view_abs|aaas_entitlement_denied'"), ("'{\"user\":{\"entitled\":\"false\",\"access\":\"yes\"}}'", "''")],
    ),
    "pnas": (
        lambda c: _texts(S.pnas_blocking(c)),
        [("'{\"page\":{\"attributes\":{\"accessType\":\"paywall\",\"freeAccess\":\"no\"}},\"user\":{\"access\":\"no\"}}'", "'pnas_paywall_no_access'"), ("'{\"page\":{\"attributes\":{\"accessType\":\"paywall\",\"freeAccess\":\"yes\"}},\"user\":{\"access\":\"no\"}}'", "''")],
    ),
    "wiley": (
        lambda c: _texts(S.wiley_blocking(c)),
        [("'{\"content\":{\"item\":{\"access\":\"no\",\"format-viewed\":\"abstract\"}},\"page\":{\"tertiary_section\":\"abs\"}}'", "'wiley_access_no|wiley_format_viewed_abstract|wiley_page_tertiary_abs'"), ("'{}'", "''")],
    ),
}


@query(_form_query("part", "p_partkey", _IMAGES))
def image_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, sizes and URLs of images, decoded bytes, dates, links and blocking signals in JSON."""
    return _formed(spark, sf_dir, "part", "p_partkey", _IMAGES)


#: Assets made from events: a document is a user, a position an event.
_ASSETS_SQL = f"""SELECT user_id AS doc_id, event_id AS pos, {_case('event_id', ["'figure'", "'table'", "'supplementary'", "'formula'"])} AS kind,
  CASE WHEN event_id % 5 = 0 THEN 'Appendix' WHEN event_id % 5 = 1 THEN NULL ELSE 'body' END AS section, CASE WHEN event_id % 3 = 0 THEN 'preview' ELSE 'full' END AS download_tier,
  CAST(event_id % 700 AS INT) AS width, CAST(event_id % 600 AS INT) AS height, event_id % 11 = 0 AS failed, event_id % 33 = 3 AS preview_accepted,
  concat('http://h/a/f', event_id % 50, '.png') AS url, concat('/files/', event_id % 3, '/f', event_id % 50, '.png') AS path, concat('Figure ', event_id % 9) AS heading FROM events"""


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    return e.selectExpr(*(x.strip() for x in _split_select(_ASSETS_SQL)))


def _split_select(sql: str) -> list[str]:
    """The expressions of SELECT ... FROM events, cut at commas outside parentheses."""
    out, depth, at = [], 0, 0
    body = sql[len("SELECT ") : sql.rindex(" FROM events")]
    for k, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(body[at:k])
            at = k + 1
    return [*out, body[at:]]


_BODY_ASSET = "coalesce(lower(section), '') NOT IN ('appendix', 'supplementary')"


@query(f"""
WITH a AS ({_ASSETS_SQL})
SELECT doc_id, count(*) FILTER (kind IN ('figure', 'table') AND {_BODY_ASSET}) AS body, count(*) FILTER (kind IN ('figure', 'table', 'supplementary')) AS whole, count(*) FILTER (kind <> 'supplementary' AND {_BODY_ASSET}) AS inside,
  count(*) FILTER (kind = 'supplementary' OR NOT ({_BODY_ASSET})) AS outside, count(*) FILTER (download_tier <> 'preview' OR preview_accepted OR (width >= {rules.PREVIEW_SIZE[0]} AND height >= {rules.PREVIEW_SIZE[1]})) AS accepted,
  CASE WHEN bool_and(failed) THEN 'download:asset_failures' WHEN bool_or(failed) THEN 'download:assets_partial' ELSE '' END ||
  CASE WHEN bool_or(failed) AND bool_or(download_tier = 'preview' AND NOT failed) THEN ',' ELSE '' END || CASE WHEN bool_or(download_tier = 'preview' AND NOT failed) THEN 'download:assets_preview_fallback' ELSE '' END AS marks FROM a GROUP BY doc_id""")
def asset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many assets of each document each selection keeps, and the marks that downloads leave."""
    every = _assets(spark, sf_dir)
    inside, outside = assets.split_supplementary(every)
    picks = {"body": assets.selected(every), "whole": assets.selected(every, "all"), "inside": inside, "outside": outside, "accepted": assets.accepted_previews(every)}
    tagged = None
    for name, rows in picks.items():
        part = rows.select("doc_id", F.lit(name).alias("pick"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counted = tagged.groupBy("doc_id").agg(*(F.count_if(F.col("pick") == name).alias(name) for name in picks))
    marks = assets.notes(every).select("doc_id", F.array_join("marks", ",").alias("marks"))
    return marks.join(counted, "doc_id", "left").na.fill(0).select("doc_id", *picks, "marks")


@query(f"""
WITH a AS ({_ASSETS_SQL}), n AS (SELECT *, CASE WHEN pos % 13 = 0 THEN NULL ELSE url END AS id, CASE WHEN pos % 4 = 0 THEN '' ELSE concat('c', pos) END AS caption FROM a),
m AS (SELECT doc_id, id, min(pos) AS pos, arg_min(caption, pos) FILTER (caption <> '') AS caption, arg_min(caption, (CASE WHEN kind = 'table' THEN 0 ELSE 1 END, pos)) FILTER (caption <> '') AS ranked FROM n WHERE id IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, id, pos, caption, ranked FROM m UNION ALL SELECT doc_id, NULL, pos, caption, NULL FROM n WHERE id IS NULL""")
def merged_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per document and URL, with the first caption and with that of the kind that counts most."""
    named = _assets(spark, sf_dir).withColumn("id", F.when(F.col("pos") % 13 != 0, F.col("url"))).withColumn("caption", F.when(F.col("pos") % 4 == 0, "").otherwise(F.concat(F.lit("c"), F.col("pos").cast("string"))))
    merged = records.merge_by_identity(named.select("id", "doc_id", "pos", "caption"), ["id", "doc_id"], ["caption"])
    keyed = named.where(F.col("id").isNotNull()).withColumn("both", F.concat_ws(" ", F.col("doc_id").cast("string"), "id"))
    ranked = records.merge_by_priority(keyed, "both", ["caption"], F.when(F.col("kind") == "table", 1).otherwise(0)).select("both", F.col("caption").alias("ranked"))
    out = merged.withColumn("both", F.concat_ws(" ", F.col("doc_id").cast("string"), "id")).join(ranked, "both", "left")
    return out.select("doc_id", "id", "pos", "caption", F.when(F.col("id").isNotNull(), F.col("ranked")).alias("ranked"))


@query(f"""
WITH a AS ({_ASSETS_SQL}), d AS (SELECT DISTINCT doc_id, 'f' || (doc_id % 50) || '.png' AS name FROM a),
p AS (SELECT doc_id, string_split(path, '/')[-1] AS name, path, pos FROM a WHERE kind = 'figure'),
f AS (SELECT doc_id, name, arg_min(path, pos) AS path, min(path) = max(path) AS sole FROM p GROUP BY 1, 2),
o AS (SELECT doc_id, count(*) AS others FROM p JOIN d USING (doc_id) WHERE p.name <> d.name GROUP BY 1), s AS (SELECT doc_id, count(*) FILTER (sole) AS sole FROM f GROUP BY 1)
SELECT doc_id, 'see ![x](' || coalesce(f.path, 'http://h/a/' || d.name) || ') and ![y](z.gif)' AS text, CAST(coalesce(o.others, 0) AS BIGINT) AS others, CAST(coalesce(s.sole, 0) AS BIGINT) AS sole
FROM d LEFT JOIN f USING (doc_id, name) LEFT JOIN o USING (doc_id) LEFT JOIN s USING (doc_id)""")
def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown whose image links point to local files, figures that aren't inline, and file names that stand for one path."""
    every = _assets(spark, sf_dir)
    figures = every.where(F.col("kind") == "figure")
    docs = every.select("doc_id").distinct().select("doc_id", F.concat(F.lit("see ![x](http://h/a/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".png) and ![y](z.gif)")).alias("text"))
    inline = assets.images(docs)
    others = records.anti_inline(figures, inline).groupBy("doc_id").agg(F.count("*").alias("others"))
    sole = records.unambiguous_files(figures).groupBy("doc_id").agg(F.count("*").alias("sole"))
    out = assets.rewrite_links(docs, figures.select("doc_id", "pos", "url", "path"))
    return out.join(others, "doc_id", "left").join(sole, "doc_id", "left").na.fill(0)


@query(f"""
WITH a AS ({_ASSETS_SQL}), b AS (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN concat('**Fig. ', pos % 9, '** a caption') WHEN 1 THEN concat('[[t', pos % 7, ']]') ELSE concat('As Figure ', pos % 9, ' shows') END AS block FROM a),
c AS (SELECT doc_id, pos, pos % 9 AS l, row_number() OVER (PARTITION BY doc_id, pos % 9 ORDER BY pos) AS n FROM b WHERE pos % 3 = 0),
f AS (SELECT doc_id, pos % 9 AS l, url, row_number() OVER (PARTITION BY doc_id, pos % 9 ORDER BY pos) AS n FROM a WHERE kind = 'figure'),
i AS (SELECT doc_id, c.pos, concat('![Figure ', l, '](', url, ')') AS line FROM c JOIN f USING (doc_id, l, n)),
m AS (SELECT doc_id, pos, count(*) AS mentions FROM (SELECT DISTINCT b.doc_id, b.pos, b.pos % 9 AS l FROM b WHERE b.pos % 3 <> 1) x JOIN (SELECT DISTINCT doc_id, pos % 9 AS l FROM a WHERE kind = 'figure') y USING (doc_id, l) GROUP BY 1, 2)
SELECT doc_id, pos, CASE WHEN line IS NOT NULL THEN line || chr(10) || chr(10) || block WHEN pos % 3 = 1 AND pos % 7 < 4 THEN concat('| table ', pos % 7, ' |') ELSE block END AS block, CAST(coalesce(mentions, 0) AS BIGINT) AS mentions
FROM b LEFT JOIN i USING (doc_id, pos) LEFT JOIN m USING (doc_id, pos)""")
def injected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with figures before their captions and tables for their placeholders, and the figures each block mentions."""
    every = _assets(spark, sf_dir)
    n = lambda k: (F.col("pos") % k).cast("string")
    block = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("**Fig. "), n(9), F.lit("** a caption"))).when(F.col("pos") % 3 == 1, F.concat(F.lit("[[t"), n(7), F.lit("]]"))).otherwise(F.concat(F.lit("As Figure "), n(9), F.lit(" shows")))
    blocks = every.select("doc_id", "pos", block.alias("block"))
    tables = every.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("t"))
    tables = tables.select("doc_id", F.concat(F.lit("[[t"), F.col("t").cast("string"), F.lit("]]")).alias("placeholder"), F.concat(F.lit("| table "), F.col("t").cast("string"), F.lit(" |")).alias("markdown"))
    found = assets.mentions(blocks.select("doc_id", "pos", F.col("block").alias("text")), every.where(F.col("kind") == "figure").select("doc_id", F.col("heading").alias("label")))
    counted = found.groupBy("doc_id", F.col("paragraph").alias("pos")).agg(F.count("*").alias("mentions"))
    return assets.inject_tables(assets.inject_figures(blocks, every), tables).join(counted, ["doc_id", "pos"], "left").na.fill(0, ["mentions"])


@query("""
WITH e AS (SELECT user_id, event_id, event_type FROM events), b AS (SELECT user_id AS key, CASE WHEN user_id % 3 = 0 THEN ' ' ELSE concat('t', user_id) END AS title, CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'own' END AS abstract FROM (SELECT DISTINCT user_id FROM e)),
q AS (SELECT user_id AS key, concat('p', min(event_id)) AS title, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'page' END AS abstract FROM e WHERE user_id % 4 <> 0 GROUP BY user_id),
f AS (SELECT user_id AS key, min(event_id) AS first, count(*) AS rows FROM e GROUP BY 1), u AS (SELECT user_id AS key, string_agg(CASE WHEN n = 1 THEN 'a.' || event_type ELSE 'a_' || n || '.' || event_type END, ',' ORDER BY event_id) FILTER (n <= 3) AS files
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM e) GROUP BY 1)
SELECT b.key, coalesce(nullif(trim(b.title), ''), nullif(trim(q.title), '')) AS title, coalesce(nullif(trim(q.abstract), ''), nullif(trim(b.abstract), '')) AS abstract, f.first, f.rows < 60 AS short, u.files, CASE WHEN b.key % 7 = 0 THEN 'fresh' ELSE 'kept' END AS state
FROM b LEFT JOIN q USING (key) JOIN f USING (key) JOIN u USING (key)""")
def overlaid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records filled up from pages, with first rows, short groups, file names of their own and replaced entries."""
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "event_type")
    keys = e.select("key").distinct()
    base = keys.select("key", F.when(F.col("key") % 3 == 0, " ").otherwise(F.concat(F.lit("t"), F.col("key").cast("string"))).alias("title"), F.when(F.col("key") % 2 != 0, "own").alias("abstract"))
    page = e.where(F.col("key") % 4 != 0).groupBy("key").agg(F.concat(F.lit("p"), F.min("event_id").cast("string")).alias("title"), F.first(F.when(F.col("key") % 5 == 0, "").otherwise("page")).alias("abstract"))
    out = records.overlay_page_metadata(base, page, "key", ("title",))
    first = records.first_per_key(e, ["key"], ["event_id"]).select("key", F.col("event_id").alias("first"))
    short = records.short_groups(e, "key", 60).select("key", F.lit(True).alias("short"))
    named = e.withColumns({"folder": F.col("key").cast("string"), "name": F.concat(F.lit("a."), "event_type"), "pos": F.col("event_id")})
    files = records.unique_paths(named).withColumn("n", F.coalesce(F.regexp_extract("file", "_([0-9]+)[.]", 1).try_cast("int"), F.lit(1))).where("n <= 3")
    files = files.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]), ",").alias("files"))
    state = records.refresh(keys.withColumn("state", F.lit("kept")), keys.where(F.col("key") % 7 == 0).withColumn("state", F.lit("fresh")), "key")
    out = out.join(first, "key").join(short, "key", "left").join(files, "key").join(state, "key")
    return out.select("key", "title", "abstract", "first", F.coalesce("short", F.lit(False)).alias("short"), "files", "state")


_FLAGS = ["'fulltext'", "'abstract_only'", "'blocked'", "'unsupported_provider'"]


@query(f"""
WITH r AS (SELECT event_id, {_case('event_id', _FLAGS)} AS status, event_id % 5 = 0 AS gate, event_id % 3 AS k FROM events)
SELECT event_id, CASE WHEN k = 0 THEN 'fulltext' WHEN k = 1 THEN 'abstract_only' ELSE 'blocked' END AS result, CASE status WHEN 'unsupported_provider' THEN 'skipped' WHEN 'fulltext' THEN CASE WHEN gate THEN 'issue' ELSE 'ok' END ELSE 'blocked' END AS review,
  k = 0 OR event_id % 7 = 0 AS gated, event_id % 7 = 0 OR event_id % 2 = 0 AS downgrade,
  concat_ws('|', CASE WHEN event_id % 2 = 1 THEN 'Some tables are only kept as their original files.' END, CASE WHEN event_id % 3 = 1 THEN 'Some formulas are placeholders.' END) AS warnings, event_id % 4 = 0 AS briefing,
  CASE WHEN event_id % 2 = 0 THEN event_id % 6 <> 0 ELSE false END AS cached,
  concat_ws(',', CASE WHEN event_id % 4 <> 0 AND event_id % 3 = 2 THEN 'empty_authors' END, CASE WHEN event_id % 7 = 0 THEN 'high_warning_count' END, CASE WHEN event_id % 10 = 0 THEN 'refs_doi_not_normalized' END, CASE WHEN k = 0 AND event_id % 9 <> 0 THEN 'unexpected_source_path' END) AS flags FROM r""")
def quality_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses, gates, downgrades, warnings, cache hits and issue flags of records that are made from event ids."""
    e = F.col("event_id")
    text = lambda v: F.lit(v)
    none, k = F.array().cast("array<string>"), e % 3
    status = F.element_at(F.array(*(F.expr(x) for x in _FLAGS)), (e % 4 + 1).cast("int"))
    blocking = F.when(e % 7 == 0, F.array(text("aaas_view_abs"))).otherwise(none)
    reason = F.when(k == 0, rules.ACCESS_SIGNAL_TOKENS[0]).when(k == 1, rules.DOWNGRADE_REASONS[0]).otherwise("insufficient_body")
    plain = F.when(k == 0, rules.ACCESS_SIGNAL_TOKENS[0]).otherwise("fine")
    gate = quality.access_gate_detected(plain, blocking, none, none, F.lit(True))
    trail = F.when(k == 1, F.array(text("fulltext:p_abstract_only"))).otherwise(none)
    zero, one = F.lit(0), F.lit(1)
    losses = F.struct(F.when(e % 2 == 1, one).otherwise(zero).alias("table_fallback"), zero.alias("table_semantic"), zero.alias("table_lossy"), zero.alias("table_layout"), zero.alias("formula_fallback"), F.when(k == 1, one).otherwise(zero).alias("formula_missing"))
    headings = F.when(e % 4 == 0, F.transform(F.array(*(text(h) for h in rules.BRIEFING_HEADINGS)), F.upper)).otherwise(F.array(text(rules.BRIEFING_HEADINGS[0])))
    request = lambda modes, tokens: F.struct(modes.alias("modes"), text("s").alias("strategy"), text("all").alias("refs"), tokens.alias("tokens"))
    cached = records.cached_request_matches(request(F.array(text("markdown"), text("article")), text("full")), request(F.when(e % 2 == 0, F.array(text("article"))).otherwise(F.array(text("metadata"))), F.when(e % 6 != 0, "full")))
    row = read_table(spark, sf_dir, "events").select(
        "event_id",
        F.lit("p").alias("provider"),
        F.when(k == 0, "fulltext").otherwise("blocked").alias("status"),
        F.when(e % 9 == 0, "known").otherwise("odd").alias("source"),
        F.lit("").alias("abstract"),
        F.lit("body").alias("body"),
        F.when(k == 2, none).otherwise(F.array(text("A"))).alias("authors"),
        F.when(e % 7 == 0, F.array(text("a"), text("b"), text("c"))).otherwise(none).alias("warnings"),
        F.when(e % 10 == 0, F.array(text("https://doi.org/10.1234/A"))).otherwise(F.array(text("10.1234/a"))).alias("reference_dois"),
        quality.is_briefing(headings).alias("briefing"),
        quality.result_status(text("p"), trail, k == 0).alias("result"),
        quality.review_status(status, F.when(e % 5 == 0, F.array(text("x"))).otherwise(none)).alias("review"),
        gate.alias("gated"),
        quality.requires_downgrade(reason, blocking, F.lit(False) | (k == 0), e % 2 == 1, e % 80).alias("downgrade"),
        F.array_join(quality.loss_warnings(losses), "|").alias("loss"),
        cached.alias("cached"),
    )
    out = row.withColumn("flags", F.array_join(quality.issue_flags(row, {"p": ["known"]}), ","))
    return out.select("event_id", "result", "review", "gated", "downgrade", F.col("loss").alias("warnings"), "briefing", "cached", "flags")


@query("""
WITH s AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'ok' ELSE CASE WHEN user_id % 9 = 0 THEN 'error' ELSE 'rate_limited' END END AS status, event_id % 3 AS code, event_id FROM events),
g AS (SELECT user_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'rate_limited') AND NOT bool_or(status = 'ok') THEN 'rate_limited' WHEN bool_and(status = 'ok') THEN 'ready' WHEN bool_or(status = 'ok') THEN 'partial' ELSE 'not_configured' END AS status,
  'c' || arg_min(code, (CASE code WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, event_id)) AS code FROM s GROUP BY 1), m AS (SELECT user_id, 'm' || code AS message, min(event_id) AS place FROM s GROUP BY 1, 2)
SELECT user_id, status, code, (SELECT string_agg(message, '; ' ORDER BY place) FROM m WHERE m.user_id = g.user_id) AS message FROM g""")
def provider_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's checks as one status, and failures as one of the highest priority."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id")
    k = F.col("event_id") % 4
    checks = e.withColumn("status", F.when(k.isin(0, 2), "ok").when(k == 1, "missing").when(F.col("user_id") % 9 == 0, "error").otherwise("rate_limited"))
    code = (F.col("event_id") % 3).cast("string")
    failures = e.select("user_id", F.col("event_id").alias("pos"), F.concat(F.lit("c"), code).alias("code"), F.concat(F.lit("m"), code).alias("message"), F.array(F.lit("w")).alias("warnings"))
    combined = quality.combine_failures(failures, "user_id", {"c2": 0, "c0": 1}).select("user_id", "code", "message")
    return quality.capability_status(checks, "user_id").join(combined, "user_id")


_SECTION_HEADINGS = ["Abstract", "Significance", "Results", "References", "Introduction"]


@query(f"""
WITH t AS (SELECT conv_id AS doc_id, turn, list_value({', '.join(f"'{h}'" for h in _SECTION_HEADINGS)})[1 + (conv_id + turn) % 5] AS heading, CASE WHEN turn % 4 = 3 THEN 4 ELSE 3 END AS level, md5(text) AS body FROM conversations),
k AS (SELECT *, CASE heading WHEN 'Abstract' THEN 'abstract' WHEN 'Significance' THEN 'abstract' WHEN 'References' THEN 'references' ELSE 'body' END AS kind FROM t)
SELECT doc_id, count(*) FILTER (kind = 'body') AS body, count(*) FILTER (kind = 'abstract') AS abstracts, count(*) FILTER (kind = 'body') AS renderable, CAST(max(level) - min(level) + greatest(min(level) - 2, 0) AS BIGINT) AS deepest,
  coalesce(min(turn) FILTER (heading <> 'Significance'), 0) - 0 AS leading, string_agg(body, chr(10) || chr(10) ORDER BY turn) FILTER (kind = 'abstract') AS abstract FROM k GROUP BY doc_id""")
def section_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body, abstract, renderable and leading sections of conversations as Markdown, a turn a section."""
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    heading = F.element_at(F.array(*(F.lit(h) for h in _SECTION_HEADINGS)), ((F.col("doc_id") + F.col("turn")) % 5 + 1).cast("int"))
    line = F.concat(F.when(F.col("turn") % 4 == 3, "#### ").otherwise("### "), heading, F.lit("\n\n"), F.md5(F.col("text").cast("binary")))
    docs = turns.select("doc_id", F.struct("turn", line.alias("line")).alias("x")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("text"))
    found = sections.level_shift(sections.leading_context(sections.sections(docs)))
    count = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    marks = found.groupBy("doc_id").agg((F.max("level") - F.min("level") + F.first("shift")).cast("long").alias("deepest"), F.count_if("leading").alias("leading"))
    out = marks.join(count(sections.body_sections(found), "body"), "doc_id", "left").join(count(sections.abstract_sections(found), "abstracts"), "doc_id", "left").join(count(sections.renderable_sections(found), "renderable"), "doc_id", "left")
    out = out.join(sections.combined_abstract(found), "doc_id", "left").na.fill(0, ["body", "abstracts", "renderable"])
    return out.select("doc_id", "body", "abstracts", "renderable", "deepest", "leading", "abstract")


@query("""
WITH w AS (SELECT c_custkey AS k, concat('10.1234/w', c_custkey) AS doi, concat(c_name, ' on ', c_mktsegment) AS title, concat('https://www.nature.com/', c_custkey) AS landing FROM customer),
q AS (SELECT k, CASE k % 4 WHEN 0 THEN title WHEN 1 THEN concat('doi:', doi) WHEN 2 THEN concat('https://x.org/', k) ELSE concat('no such thing ', k) END AS query, k % 4 AS kind, doi, landing FROM w)
SELECT k AS query_id, CASE kind WHEN 1 THEN 'doi' WHEN 2 THEN 'url' ELSE 'title' END AS kind, CASE WHEN kind IN (0, 1) THEN doi END AS doi, CASE kind WHEN 2 THEN query WHEN 3 THEN NULL ELSE landing END AS landing_url, CASE WHEN kind IN (0, 1) THEN 'springer' END AS provider FROM q""")
def resolved_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, DOIs and URLs resolved against a table of works, titles by the composite score."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    works = c.select(k, F.concat(F.lit("10.1234/w"), k.cast("string")).alias("doi"), F.concat("c_name", F.lit(" on "), "c_mktsegment").alias("title"), F.concat(F.lit("https://www.nature.com/"), k.cast("string")).alias("landing_url"), F.lit(None).cast("string").alias("publisher"))
    asked = works.select(k.alias("query_id"), F.when(k % 4 == 0, F.col("title")).when(k % 4 == 1, F.concat(F.lit("doi:"), "doi")).when(k % 4 == 2, F.concat(F.lit("https://x.org/"), k.cast("string"))).otherwise(F.concat(F.lit("no such thing "), k.cast("string"))).alias("query"))
    return routing.resolve(asked, works.drop("c_custkey")).select("query_id", "kind", "doi", "landing_url", "provider")


@query("""
WITH r AS (SELECT user_id AS provider, event_id AS pos, CASE WHEN event_id % 2 = 0 THEN 'fulltext' ELSE 'blocked' END AS status, event_id % 3 = 0 AS a, event_id % 5 = 0 AS b, 'fulltext:x' || (event_id % 4) || '_ok' AS mark FROM events),
p AS (SELECT provider, count(DISTINCT CASE WHEN status = 'fulltext' THEN mark END) AS paths, count(*) FILTER (a OR b) AS with_issues, count(*) FILTER (b) AS wanted, min(pos) FILTER (b) AS first FROM r GROUP BY 1)
SELECT provider, paths, with_issues, wanted, first, (SELECT count(*) FROM r) AS attempted, (SELECT count(*) FROM r WHERE status = 'fulltext') AS fulltext, (SELECT count(DISTINCT provider) FROM r) AS providers FROM p""")
def report_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: success paths, results with issues and with a wanted flag; and the totals."""
    e = F.col("event_id")
    none = F.array().cast("array<string>")
    trace = F.array(F.struct(F.lit("fulltext").alias("stage"), F.concat(F.lit("x"), (e % 4).cast("string")).alias("component"), F.lit("ok").alias("outcome")))
    results = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("provider"),
        e.alias("pos"),
        F.when(e % 2 == 0, "fulltext").otherwise("blocked").alias("status"),
        F.concat(F.when(e % 3 == 0, F.array(F.lit("a"))).otherwise(none), F.when(e % 5 == 0, F.array(F.lit("b"))).otherwise(none)).alias("flags"),
        reports.trail(reports.merge_traces(trace, trace)).alias("trail"),
    )
    wanted = reports.with_issues(results, ["b"]).groupBy("provider").agg(F.count("*").alias("wanted"), F.min("pos").alias("first"))
    total = reports.totals(results).select("attempted", "fulltext", "providers")  # a single row
    return reports.path_notes(results).join(wanted, "provider", "left").na.fill(0, ["wanted"]).join(F.broadcast(total)).select("provider", "paths", "with_issues", "wanted", "first", "attempted", "fulltext", "providers")


@query("""
SELECT event_id, concat_ws('|', concat('https://a.org/doi/10.1/', event_id), concat('https://b.org/doi/10.1/', event_id)) AS pages, CASE WHEN event_id % 2 = 0 THEN concat('u', event_id, '|x|v') ELSE concat('u', event_id, '|v') END AS pdfs,
  concat_ws('|', CASE WHEN event_id % 3 <> 0 THEN concat('full', event_id) END, CASE WHEN event_id % 3 = 0 THEN 'page' ELSE concat('page', event_id) END, CASE WHEN event_id % 3 <> 0 THEN concat('prev', event_id) END) AS downloads FROM events""")
def url_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pages, PDF files and downloads in their order, each once."""
    e = F.col("event_id").cast("string")
    some = F.col("event_id") % 3 != 0
    rows = read_table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("10.1/"), e).alias("doi"),
        F.array(F.concat(F.lit("u"), e), F.lit("v")).alias("one"),
        F.array(F.lit("v"), F.concat(F.lit("u"), e)).alias("two"),
        F.when(F.col("event_id") % 2 == 0, "x").alias("extra"),
        F.when(some, F.concat(F.lit("full"), e)).alias("full_size_url"),
        F.when(some, F.concat(F.lit("page"), e)).otherwise("page").alias("page_url"),
        F.when(some, F.concat(F.lit("prev"), e)).otherwise("page").alias("preview_url"),
    )
    out = assets.first_in_order(assets.pdf_candidates(routing.page_urls(rows, ["a.org", "b.org"], ["/doi/{doi}"]), ["one", "two"], 1, "extra"))
    return out.select("event_id", F.array_join("urls", "|").alias("pages"), F.array_join("pdf_urls", "|").alias("pdfs"), F.array_join("candidates", "|").alias("downloads"))


_CODES = {
    "asset_group": (I.asset_group, [("concat('http://h/1-s2.0-S', p_partkey, '-GR', p_partkey, '_lrg.jpg?x=1')", "concat('gr', p_partkey)"), ("concat('a/mmc', p_partkey, '.pdf')", "concat('mmc', p_partkey)"), ("'x/example.png#y'", "'am'"), ("concat('b', p_partkey, '.zip')", "concat('b', p_partkey, '.zip')")]),
    "kind": (
        lambda c: I.asset_kind(F.split_part(c, F.lit(";"), F.lit(1)), F.split_part(c, F.lit(";"), F.lit(2)), F.split_part(c, F.lit(";"), F.lit(3))),
        [("concat('gr', p_partkey, '.jpg;;')", "'image'"), ("'ga1.jpg;;'", "'graphical_abstract'"), ("'fx2.jpg;;'", "'appendix_image'"), ("'tbl3.xml;;'", "'table_asset'"), ("'mmc4.pdf;IMAGE-WEB;'", "'supplementary'"), ("'q.jpg;image-downsampled;'", "'image'"), ("'q.jpg;;Thumbnail'", "'image'"), ("'q.bin;APPLICATION;other'", "'supplementary'")],
    ),
    "figure_points": (
        lambda c: I.figure_score(*(F.split_part(c, F.lit(";"), F.lit(k)) for k in range(1, 6))).cast("long"),
        [("concat('p', p_partkey, ';f/Fig1.png;;v.png;cap')", "CAST(175 AS BIGINT)"), ("';;x/ieq12.gif;;'", "-40"), ("';;;;'", "0"), ("';full.png;;;c'", "25")],
    ),
    "redirected": (lambda c: I.is_abstract_redirect(F.lit("https://h/doi/full/10.1/x"), c), [("concat('https://h/doi/abs/10.1/', p_partkey)", "true"), ("'https://h/doi/full/10.1/x'", "false")]),
    "landing": (lambda c: I.landing_page(F.split(c, " ")), [(f"concat('https://{rules.API_HOSTS[0]}/x https://a.org/', p_partkey)", "concat('https://a.org/', p_partkey)"), (f"'no https://{rules.API_HOSTS[0]}/y'", f"'https://{rules.API_HOSTS[0]}/y'")]),
    "anchor": (I.is_reference_anchor, [("'#ref-CR'", "true"), ("'x#bib'", "true"), ("concat('#sec', p_partkey)", "false")]),
    "element_class": (H.identity_category, [(f"'x {next(iter(rules.IDENTITY_TOKENS.values()))[0]} y'", f"'{next(iter(rules.IDENTITY_TOKENS))}'"), ("''", "''")]),
    "same_image": (lambda c: matching.image_matches(c, F.lit("img/f1.png")), [("'https://h/a/img/f1.png'", "true"), ("'other/f1.png?x'", "true"), ("concat('img/g', p_partkey, '.png')", "false")]),
    "layer": (lambda c: F.coalesce(S.data_layer(c, "dataLayer"), F.lit("")), [("concat('<script>dataLayer={\"a\": ', p_partkey, '};</script>')", "concat('{\"a\": ', p_partkey, '}')"), ("'dataLayer={broken;'", "''")]),
    "tidy": (W.normalize_markdown, [("concat('a  b \n\n\n\n```\n x  y\n```\n', p_partkey)", "concat('a b', chr(10), chr(10), chr(10), '```', chr(10), ' x  y', chr(10), '```', chr(10), p_partkey)")]),
}


@query(_form_query("part", "p_partkey", _CODES))
def link_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and groups of publishers' assets, figure scores, redirects, landing pages, anchors, embedded data and fenced Markdown."""
    return _formed(spark, sf_dir, "part", "p_partkey", _CODES)


_XML = """<article><title>T {k}</title><abstract><p>Ab {k}</p></abstract><body><sec><title>One</title><p>x{k}</p><sec><title>Two</title><p>y</p></sec></sec>
<fig><label>Fig. 1</label><caption>Cap {k}</caption><graphic href="g{k}.png"/></fig><math><mfrac><mi>a</mi><msup><mi>b</mi><mn>{k}</mn></msup></mfrac></math></body>
<ref-list><ref><label>3</label>Doe 2001 10.5555/A{k}.</ref></ref-list></article>"""
_CALS = """<table><tgroup><colspec colname="a"/><colspec colname="b"/><colspec colname="c"/><tbody>
<row><entry morerows="1">x{k}</entry><entry namest="b" nameend="c">y</entry></row><row><entry>1</entry><entry>2</entry></row></tbody></tgroup></table>"""


def _filled(template: str, key: str) -> Column:
    return F.replace(F.lit(template), F.lit("{k}"), F.col(key).cast("string"))


@query(r"""
SELECT s_suppkey, concat('T ', s_suppkey) AS title, concat('Ab ', s_suppkey) AS abstract, concat('One 2 x', s_suppkey, '|Two 3 y') AS sections, concat('3 10.5555/a', s_suppkey, ' 2001') AS refs, concat('Fig. 1 Cap ', s_suppkey, ' g', s_suppkey, '.png') AS figures,
  concat('\frac{a}{{b}^{', s_suppkey, '}}') AS formula, concat('\frac{a}{{b}^{', s_suppkey, '}}') AS latex, concat('x', s_suppkey, ',y,y') AS head, concat('x', s_suppkey, ',1,2') AS row, true AS lossy FROM supplier""")
def xml_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of XML articles that are made from ids: sections, references, figures, formulas, and a table with spans."""
    p = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    x = p.select("s_suppkey", X.parse_article(_filled(_XML, "s_suppkey")).alias("x"), X.cals_table(_filled(_CALS, "s_suppkey")).alias("t"), X.mathml_to_latex(_filled("<math><mfrac><mi>a</mi><msup><mi>b</mi><mn>{k}</mn></msup></mfrac></math>", "s_suppkey")).alias("latex"))
    listed = lambda c, f: F.array_join(F.transform(c, f), "|")
    cells = lambda n: F.array_join(F.filter(F.transform(F.split(F.get(F.split("t.markdown", "\n"), F.lit(n)), "[|]"), lambda v: F.trim(v)), lambda v: v != ""), ",")
    return x.select(
        "s_suppkey",
        "x.title",
        listed(F.col("x.abstracts"), lambda a: a["text"]).alias("abstract"),
        listed(F.col("x.sections"), lambda s: F.concat_ws(" ", s["heading"], s["level"].cast("string"), s["text"])).alias("sections"),
        listed(F.col("x.references"), lambda r: F.concat_ws(" ", r["label"], r["doi"], r["year"])).alias("refs"),
        listed(F.col("x.figures"), lambda f: F.concat_ws(" ", f["label"], f["caption"], f["locator"])).alias("figures"),
        F.array_join("x.formulas", "|").alias("formula"),
        "latex",
        cells(0).alias("head"),
        cells(2).alias("row"),
        F.col("t.lossy").alias("lossy"),
    )


_HTML = """<html><head><title>T</title><meta name="citation_title" content="Study {k}"><meta name="citation_doi" content="10.1234/K{k}">
<meta name="citation_author" content="Jane Doe"><meta name="citation_pdf_url" content="/x{k}.pdf">
<script type="application/ld+json">{"@type": "ScholarlyArticle", "author": [{"name": "Ann Lee{k}"}]}</script></head>
<body><nav>Menu</nav><article><h1>Study {k}</h1><section class="abstract"><h2>Abstract</h2><p>Short &amp; sweet {k}.</p></section>
<p>First <b>bold</b><p>Second <a href="https://e.org">link</a><figure><img src="f{k}.png"><figcaption>Figure 1. Map</figcaption></figure>
<table><tr><th colspan=2>H</th></tr><tr><td>{k}</td><td>2|3</td></tr></table>
<div id="references"><ol><li>Doe 1999, 2001 10.5555/zz{k}.</li></ol></div><a href="/suppl/s{k}.zip">Supplement</a>
<div class="share-bar">share</div></article></body></html>"""


@query(r"""
SELECT s_suppkey, concat('Study ', s_suppkey) AS title, concat('10.1234/k', s_suppkey) AS doi, concat('Jane Doe|Ann Lee', s_suppkey) AS authors, concat('https://p.org/x', s_suppkey, '.pdf') AS pdf, concat('1 10.5555/zz', s_suppkey, ' 2001') AS refs,
  concat('figure https://p.org/a/f', s_suppkey, '.png|supplementary https://p.org/suppl/s', s_suppkey, '.zip') AS assets, concat('Short & sweet ', s_suppkey, '.') AS abstract, 'heading,heading,paragraph,paragraph' AS kinds,
  concat(s_suppkey, ',2+3') AS cells, true AS bold, true AS linked, false AS shared FROM supplier""")
def built_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of HTML pages that are made from ids: metadata, authors, references, assets, blocks, a table and Markdown."""
    p = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("https://p.org/a/").alias("url"), _filled(_HTML, "s_suppkey").alias("html"))
    page = articles.pages_to_articles(p, "s_suppkey")
    listed = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *(x[n] for n in names))), "|")
    # the escaped bar inside a cell becomes a plus before the row is cut at bars
    plain = F.split(F.replace("markdown", F.lit("\\|"), F.lit("+")), "\n")
    cells = F.transform(F.split(F.get(F.filter(plain, lambda line: F.contains(line, F.lit("2+3"))), F.lit(0)), "[|]"), lambda v: F.trim(v))
    return page.select(
        "s_suppkey",
        "title",
        F.col("meta_doi").alias("doi"),
        F.array_join("meta_authors", "|").alias("authors"),
        F.get("pdf_urls", F.lit(0)).alias("pdf"),
        listed(F.col("references"), "label", "doi", "year").alias("refs"),
        listed(F.col("assets"), "kind", "url").alias("assets"),
        listed(F.col("abstracts"), "text").alias("abstract"),
        F.array_join(F.transform(F.slice("blocks", 1, 4), lambda b: b["kind"]), ",").alias("kinds"),
        F.array_join(F.filter(cells, lambda c: c != ""), ",").alias("cells"),
        F.contains("markdown", F.lit("First **bold**")).alias("bold"),
        F.contains("markdown", F.lit("[link](https://e.org)")).alias("linked"),
        F.exists(F.split("markdown", "\n"), lambda line: line == "share").alias("shared"),
    )


_MESSAGE = '{"DOI": "10.1234/W{k}", "title": ["On  {k}"], "container-title": ["J"], "publisher": "P", "abstract": "<p>Ab {k}</p>", "URL": "http://h/{k}", "author": [{"given": "A", "family": "B"}, {"name": "Team {k}"}, {"given": "a", "family": "b"}], "issued": {"date-parts": [[2001, 2]]}, "license": [{"URL": "l"}, {"URL": "l"}], "link": [{"URL": "u{k}"}], "subject": ["s", "t"]}'


@query(r"""
WITH m AS (SELECT c_custkey AS k FROM customer)
SELECT k, concat('10.1234/w', k) AS doi, concat('On ', k) AS title, 'J' AS journal, concat('Ab ', k) AS abstract, concat('A B|Team ', k) AS authors, '2001-2' AS published, 'l' AS licences, concat('u', k) AS links, 's|t' AS keywords, 'likely_yes' AS state,
  CASE WHEN k % 2 = 0 THEN 'abstract_only' ELSE 'metadata_only' END AS kind FROM m""")
def works_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliographic messages as flat records, what they promise, and as articles without a body."""
    raw = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _filled(_MESSAGE, "c_custkey").alias("message"))
    works = articles.probe(records.normalize_works(raw).withColumn("pdf_url", F.lit("")))
    none = articles.metadata_only(works.withColumn("full_abstract", F.col("abstract")).withColumn("abstract", F.when(F.col("k") % 2 == 0, F.col("abstract")).otherwise("")))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return none.select("k", "doi", "title", "journal", F.col("full_abstract").alias("abstract"), joined("authors"), "published", joined("licences"), joined("links"), joined("keywords"), "state", "kind")


@query("""
WITH h AS (SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pos FROM events)
SELECT doc_id, pos, CASE WHEN pos < 4 THEN concat('k', pos) END AS hint FROM h WHERE pos < 6""")
def section_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with the kind of the next hint of their name: the same two names in turn, four hints."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), n.alias("pos")).where("pos < 6")
    name = lambda c: F.when(F.col(c) % 2 == 0, "Results").otherwise("Methods")
    hints = rows.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("order"))
    hints = hints.select("doc_id", "order", name("order").alias("heading"), F.concat(F.lit("k"), F.col("order").cast("string")).alias("kind"))
    return sections.match_hints(rows.withColumn("heading", name("pos")), hints).select("doc_id", "pos", F.col("hint_kind").alias("hint"))


@query("""
WITH t AS (SELECT conv_id AS doc_id, count(*) AS turns FROM conversations GROUP BY 1)
SELECT doc_id, CAST(least(turns, 3) * 10 AS BIGINT) AS tokens, turns > 3 AS truncated, CASE WHEN doc_id % 2 = 0 THEN 'own text' ELSE 'An abstract of some words that is repeated.' || chr(10) || chr(10) || 'own text' END AS body, CAST(2 AS BIGINT) AS prose FROM t""")
def rendered_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks of ten tokens within 35, bodies without a repeated abstract, and the first prose blocks."""
    c = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("group"), F.col("turn").cast("int").alias("pos"), F.lit(10).cast("long").alias("tokens"), F.md5(F.col("text").cast("binary")).alias("text"))
    shown = budgets.render(c, 35).select("doc_id", F.col("tokens").cast("long").alias("tokens"), "truncated")
    abstract = "An abstract of some words that is repeated."
    found = c.select("doc_id").distinct().select("doc_id", F.lit(0).alias("section"), F.lit("Main").alias("heading"), F.lit(2).alias("level"), F.lit("body").alias("kind"), F.lit(f"{abstract}\n\nown text").alias("text"))
    known = found.select("doc_id", F.when(F.col("doc_id") % 2 == 0, abstract.upper()).otherwise("Another one.").alias("abstract"))
    body = sections.without_leading_abstract(found, known).select("doc_id", F.col("text").alias("body"))
    long = F.lit("\n\n".join(["# Head", "word " * 30, "short", "One. Two.", "x " * 60]))
    prose = sections.first_prose(sections.blocks(found.select("doc_id", long.alias("text"))), n=2).groupBy("doc_id").agg(F.count("*").alias("prose"))
    return shown.join(body, "doc_id").join(prose, "doc_id")


@query("""
WITH r AS (SELECT event_id, event_id % 3 = 0 AS a, event_id % 5 = 0 AS b FROM events), f AS (SELECT 'b' AS category, event_id FROM r WHERE b UNION ALL SELECT 'a', event_id FROM r WHERE a)
SELECT category, CASE category WHEN 'b' THEN 'advice one' ELSE 'advice two' END AS advice, count(*) AS rows, CASE category WHEN 'b' THEN CAST(1 AS BIGINT) ELSE 2 END AS priority, min(event_id) AS first FROM f GROUP BY category""")
def issue_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of records in the order of a table of advice."""
    e = F.col("event_id")
    none = F.array().cast("array<string>")
    results = read_table(spark, sf_dir, "events").select(e.alias("pos"), e.alias("doi"), F.concat(F.when(e % 3 == 0, F.array(F.lit("a"))).otherwise(none), F.when(e % 5 == 0, F.array(F.lit("b"), F.lit("b"))).otherwise(none)).alias("flags"))
    advice = spark.createDataFrame([("b", 1, "advice one"), ("none", 2, "no advice"), ("a", 3, "advice two")], "category string, position int, advice string")  # a fixed table
    out = reports.recommendations(results, advice)
    return out.select("category", "advice", "rows", F.col("priority").cast("long").alias("priority"), F.get("samples", F.lit(0)).alias("first"))


@query("""
WITH p AS (SELECT c_custkey AS query_id FROM customer)
SELECT query_id, concat('w', query_id) AS work_id, CAST(1000000 AS BIGINT) AS score, CAST(round((0.7 * 2 / 3 + 0.3 * 36 / 38) * 1000000) AS BIGINT) AS second, true AS confident FROM p""")
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against themselves and against themselves with a word more: tokens and characters weighed, and whether the first is sure."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query_title"))
    work = F.concat(F.lit("w"), F.col("query_id").cast("string"))
    pairs = c.select("query_id", "query_title", work.alias("work_id"), F.col("query_title").alias("title"), F.lit(1).alias("pos"))
    pairs = pairs.unionByName(c.select("query_id", "query_title", F.concat(work, F.lit("x")).alias("work_id"), F.concat("query_title", F.lit(" x")).alias("title"), F.lit(0).alias("pos")))
    out = matching.confident(matching.score_candidates(pairs))
    whole = lambda s: F.round(F.col(s) * 1_000_000).cast("long").alias(s)
    return out.select("query_id", "work_id", whole("score"), whole("second"), "confident")


@query("""
WITH e AS (SELECT event_id, event_id % 2 = 0 AS known FROM events)
SELECT event_id, 'springer' AS provider FROM e WHERE known""")
def official_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are official providers."""
    asked = read_table(spark, sf_dir, "events").select("event_id", F.array(F.when(F.col("event_id") % 2 == 0, "https://www.nature.com/x").otherwise("https://nowhere.example/x")).alias("urls"), F.array().cast("array<string>").alias("publishers"), F.lit("").alias("doi"))
    return routing.official_candidates(routing.route(asked, "event_id"), ["springer"]).select("event_id", "provider")


_PROSE = "This paragraph is made of plain words that stand for the prose of a body and say nothing else at all here {n}."
_LONG = " ".join(_PROSE.replace("{n}", n) for n in ("one", "two"))
_MARKDOWN = [
    f"# T\n\n## Abstract\n\n{_LONG}\n\n## Introduction\n\n{_LONG} a\n\n{_LONG} b\n\n## Results\n\n{_LONG} c\n\n## References\n\n{_LONG} d",
    "## Results\n\nshort text",
    f"## Abstract\n\n{_LONG}",
    "",
]


@query("""
SELECT c_custkey AS doc_id, list_value('fulltext', 'metadata_only', 'abstract_only', 'metadata_only')[1 + k] AS kind, list_value('high', 'low', 'low', 'low')[1 + k] AS confidence, list_value('', 'insufficient_body,weak_body_structure', 'insufficient_body', 'insufficient_body')[1 + k] AS flags,
  CAST(CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS body_blocks, CAST(CASE k WHEN 0 THEN 3 ELSE 0 END AS BIGINT) AS body_paragraphs, CAST(CASE k WHEN 0 THEN 3 ELSE 0 END AS BIGINT) AS run_paragraphs, k = 0 AS post_abstract_run, k IN (0, 2) AS has_abstract, k = 0 AS accepted,
  CASE WHEN k IN (0, 2) THEN '{LONG}' END AS abstract FROM (SELECT c_custkey, c_custkey % 4 AS k FROM customer)""".replace("{LONG}", _LONG))
def assessed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of four shapes (an article, a short text, an abstract, nothing) as articles with their verdicts."""
    docs = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.element_at(F.array(*(F.lit(x) for x in _MARKDOWN)), (F.col("c_custkey") % 4 + 1).cast("int")).alias("text"))
    out = articles.article_from_markdown(docs)
    return out.select("doc_id", "kind", "confidence", F.array_join("flags", ",").alias("flags"), "body_blocks", "body_paragraphs", "run_paragraphs", "post_abstract_run", "has_abstract", "accepted", F.col("section_abstract").alias("abstract"))


@query(f"""
SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 2 = 0 THEN 'fulltext' ELSE 'metadata_only' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'access_gate_detected' END AS flags,
  concat('## Results', chr(10), chr(10), 'kept ', s_suppkey) AS cleaned FROM supplier""")
def judged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with and without a sign of an access gate, and Markdown without navigation lines and sections."""
    k = F.col("s_suppkey")
    body = "".join(f"<h2>Part {n}</h2><p>{_LONG} {n}</p>" for n in range(3))
    page = F.concat(F.lit(f"<html><head><title>T</title></head><body><article><h1>Deep rivers</h1>{body}<p>"), F.when(k % 2 == 0, "The end").otherwise(rules.ACCESS_GATE_PHRASES[0]), F.lit("</p></article></body></html>"))
    rows = read_table(spark, sf_dir, "supplier").select(k.alias("page_id"), F.lit("https://p.org/").alias("url"), page.alias("html"))
    found = articles.page_verdicts(articles.pages_to_articles(rows)).select("page_id", "kind", "confidence", F.array_join("flags", ",").alias("flags"))
    noisy = F.concat(F.lit(f"## {rules.CHROME_HEADINGS[0].title()}\n\nlink\n\n### Deeper\n\nmore\n\n## Results\n\n{rules.LINE_EXACT_NOISE[0]}\nkept "), F.col("page_id").cast("string"))
    cleaned = sections.clean_lines(rows.select("page_id", noisy.alias("text")), "page_id")
    return found.join(cleaned.withColumnRenamed("text", "cleaned"), "page_id")


_SITE = """<html><body><main><div class="permissions">P</div><div class="card">C</div><div class="epub-reference">W</div><div class="article-tools">T</div><p>Permissions</p><p>Recommended articles</p>
<div class="x advert">A</div><script>s</script><p>Body {k}</p></main><div class="cookie-banner">no</div></body></html>"""


@query("""
SELECT s_suppkey AS page_id, list_value('science', 'pnas', 'wiley', 'other')[1 + s_suppkey % 4] AS publisher, 'body' AS container,
  list_value('C|W|Recommended articles', 'P|W|Permissions|Recommended articles|A', 'P|C|Permissions|A', 'P|C|W|Permissions|Recommended articles|A')[1 + s_suppkey % 4] || '|Body ' || s_suppkey AS kept FROM supplier""")
def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the site rules of four publishers keep of one page."""
    k = F.col("s_suppkey")
    publisher = F.element_at(F.array(*(F.lit(x) for x in ("science", "pnas", "wiley", "other"))), (k % 4 + 1).cast("int"))
    rows = read_table(spark, sf_dir, "supplier").select(k.alias("page_id"), publisher.alias("publisher"), _filled(_SITE, "s_suppkey").alias("html"))
    out = rows.withColumn("x", once(sites.site_page("html", "publisher")))
    return out.select("page_id", "publisher", "x.container", F.replace("x.markdown", F.lit("\n\n"), F.lit("|")).alias("kept"))
