"""Column functions on literals."""

import pytest
from pyspark.sql import functions as F

from scriptorium import rules
from scriptorium.functions import headings as H
from scriptorium.functions import html as W
from scriptorium.functions import sites
from scriptorium.functions import identifiers as I
from scriptorium.functions import signals as S
from scriptorium.functions import text as T
from scriptorium.functions import xml as X
from scriptorium.operators import matching, quality, reports


@pytest.fixture
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, ""), ("  a\xa0 b\t\tc \n\n\n d ", "a b c\nd"), (" x ", "x"), ("a\n \n b", "a\nb")],
)
def test_normalize_text(value, text, want):
    assert value(T.normalize_text(F.lit(text))) == want


def test_tokens_and_truncation(value):
    assert value(T.estimate_tokens(F.lit(""))) == 0 and value(T.estimate_tokens(F.lit("abcde"))) == 2
    long = "word " * 40
    assert value(T.truncate_to_tokens(F.lit(long.strip()), 10)) == (long[:40]).rstrip() + "..."
    assert value(T.truncate_to_tokens(F.lit("short"), 10)) == "short" and value(T.truncate_to_tokens(F.lit("short"), 0)) == ""


def test_words_are_unicode(value):
    assert value(T.count_words(F.lit("naïve café x_1"))) == 3 and value(T.count_cjk(F.lit("a中文b"))) == 2


def test_authors(value):
    names = F.array(*(F.lit(x) for x in ("Doe, Jane", "Jane Doe", " ", "Lee  K.", "lee k")))
    assert value(T.dedupe_authors(names)) == ["Doe, Jane", "Lee K."]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("https://doi.org/10.1016/J.X.2020–1).", "10.1016/j.x.2020-1"), ("doi: 10.1000/AB c", "10.1000/abc"), ("", "")],
)
def test_clean_doi(value, raw, want):
    assert value(I.clean_doi(F.lit(raw))) == want


def test_extract_doi(value):
    assert value(I.extract_doi(F.lit('see <a href="https://doi.org/10.1126/Sci.1">'))) == "10.1126/sci.1"
    assert value(I.extract_doi(F.lit("none"))) is None
    assert value(I.doi_needs_cleaning(F.lit("https://doi.org/10.1/x"))) and not value(I.doi_needs_cleaning(F.lit("10.1234/x")))


def test_urls(value):
    assert value(I.is_http_url(F.lit("https://a.b/c"))) and not value(I.is_http_url(F.lit("ftp://a.b")))
    assert value(I.is_api_like_url(F.lit("https://api.x.org/1"))) and value(I.is_api_like_url(F.lit("https://x/content/article/1")))
    urls = F.array(F.lit("https://api.x.org/1"), F.lit("bad"), F.lit("https://x.org/2"))
    assert value(I.landing_page(urls)) == "https://x.org/2"
    assert value(I.is_reference_anchor(F.lit("#ref-12"))) and not value(I.is_reference_anchor(F.lit("#sec1")))


def test_file_names(value):
    assert value(I.file_name(F.lit("a b//c?.pdf"))) == "a_b_c_.pdf"
    assert value(I.file_name(F.lit(""))) == "fulltext_da39a3ee"
    assert len(value(I.file_name(F.lit("x" * 300)))) == 180
    assert value(I.extension(F.lit("text/html; charset=utf-8"), F.lit(None).cast("string"))) == ".html"
    assert value(I.extension(F.lit("odd"), F.lit("http://a/b.tar.gz?x"))) == ".gz" and value(I.extension(F.lit(None).cast("string"), F.lit("http://a/b"))) == ".bin"


def test_images(value):
    assert value(I.image_type(F.lit(bytearray(b"\x89PNG\r\n\x1a\n....")))) == "image/png"
    assert value(I.image_url_from_srcset(F.lit("a.jpg 1x, b.jpg 2x, c.jpg 2x"))) == "c.jpg"


@pytest.mark.parametrize(
    ("heading", "page", "markdown"),
    [
        ("Abstract.", "abstract", "abstract"), ("Editor's summary", "abstract", "front_matter"), ("Significance", "abstract", "abstract"),
        ("Data availability and use", "data_availability", "data_availability"), ("References", "references_or_back_matter", "references_or_back_matter"),
        ("Share", "ancillary", "auxiliary"), ("Keywords", "front_matter", "front_matter"), ("Results", "body_heading", "body_heading"), ("", "body_heading", "body_heading"),
    ],
)
def test_heading_classes(value, heading, page, markdown):
    assert value(H.heading_category(F.lit("h2"), F.lit(heading))) == page
    assert value(H.markdown_heading_category(F.lit(heading))) == markdown


def test_heading_rules_in_order(value):
    assert value(H.heading_category(F.lit("h1"), F.lit("Results"))) == "front_matter"
    assert value(H.heading_category(F.lit("h2"), F.lit("My Title"), F.lit("my title."))) == "front_matter"
    assert value(H.markdown_heading_category(F.lit("Anything"), hint=F.lit("references"))) == "references_or_back_matter"
    assert value(H.section_priority(F.lit("Materials and Methods"))) == 2 and value(H.section_priority(F.lit("Other"))) == 4
    assert value(H.identity_category(F.lit("div article-body main"))) == "body" and value(H.identity_category(F.lit("zzz"))) == ""


def test_signals(value):
    got = value(T.access_signals(F.lit("Just a moment"), F.lit("Page not found. Buy now"), F.lit(403), no_access=True))
    assert got == ["cloudflare_challenge", "publisher_not_found", "publisher_access_denied", "publisher_paywall"]
    assert value(T.access_gate_phrases(F.lit("Buy now or check access"))) == ["buy now", "check access"]


def test_citations_and_labels(value):
    assert value(T.numeric_citations(F.lit("1 - 3, 5"))) == "1–3, 5" and value(T.numeric_citations(F.lit("1, x"))) is None
    assert value(T.figure_label(F.lit("Fig. 3A shows"))) == "figure 3a" and value(T.last_year(F.lit("1999; 2004"))) == "2004"
    assert value(T.latex(F.lit(" $\\upalpha  x$ "))) == "\\alpha x"


def test_overlap(value):
    part = "sentence of some length " * 12
    assert value(T.abstract_body_overlap(F.lit(part), F.lit("before " + part + " after"))) and not value(T.abstract_body_overlap(F.lit("short"), F.lit("short")))
    assert value(T.semantic_match(F.lit("The quick brown fox jumps over"), F.lit("the quick brown fox jumps again")))


def test_ratios(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("abc", "abc")], "a string, b string")
    got = [r.v for r in rows.select(matching.indel_ratio("a", "b").alias("v")).collect()]
    assert got == [pytest.approx(8 / 13), 1.0, 1.0]


def test_marks(value):
    got = value(reports.parse_mark(F.lit("fulltext:wiley_html_ok"), ["ok", "fail"]))
    assert tuple(got) == ("fulltext", "wiley_html", "ok")
    assert value(reports.success_path(F.array(F.lit("a:b_ok"), F.lit("c:d_fail"), F.lit("e:f_ok")))) == "a:b_ok -> e:f_ok"


def test_confidence(value):
    flags = lambda *x: F.array(*(F.lit(v) for v in x)) if x else F.array().cast("array<string>")
    assert value(quality.confidence(F.lit("fulltext"), flags())) == "high"
    assert value(quality.confidence(F.lit("fulltext"), flags("weak_body_structure"))) == "medium"
    assert value(quality.confidence(F.lit("fulltext"), flags(), 2)) == "medium" and value(quality.confidence(F.lit("abstract_only"), flags())) == "low"


PAGE = """<html><head><title>T</title><meta name="citation_title" content="A study"><meta name="citation_doi" content="10.1234/AbC">
<meta name="citation_author" content="Jane Doe"><meta name="citation_pdf_url" content="/x.pdf">
<script type="application/ld+json">{"@type": "ScholarlyArticle", "author": [{"name": "Ann Lee"}]}</script></head>
<body><nav>Menu</nav><article><h1>A study</h1><section class="abstract"><h2>Abstract</h2><p>Short &amp; sweet.</p></section>
<p>First <b>bold</b><p>Second <a href="https://e.org">link</a><figure><img src="f.png"><figcaption>Figure 1. Map</figcaption></figure>
<table><tr><th colspan=2>H</th></tr><tr><td>1</td><td>2|3</td></tr></table>
<div id="references"><ol><li>Doe 1999, 2001 10.5555/zz.</li></ol></div><a href="/suppl/s1.zip">Supplement</a>
<div class="share-bar">share</div></article><script>var x = "</p>";</script></body></html>"""


def test_page_facts(spark):
    (r,) = spark.createDataFrame([(PAGE, "https://p.org/a/")], "html string, url string").select(W.parse_page("html", "url").alias("p")).select("p.*").collect()
    assert (r.title, r.meta_title, r.meta_doi, r.meta_pdf_url) == ("A study", "A study", "10.1234/abc", "/x.pdf")
    assert r.meta_authors == ["Jane Doe", "Ann Lee"] and r.pdf_urls[0] == "https://p.org/x.pdf"
    assert [(x.label, x.doi, x.year) for x in r.references] == [("1", "10.5555/zz", "2001")]
    assert [(a.kind, a.url) for a in r.assets] == [("figure", "https://p.org/a/f.png"), ("supplementary", "https://p.org/suppl/s1.zip")]
    assert [a.text for a in r.abstracts] == ["Short & sweet."]
    assert "First **bold**" in r.markdown and "[link](https://e.org)" in r.markdown and "| 1   | 2\\|3" in r.markdown and "share" not in r.markdown.split("\n")
    assert [b.kind for b in r.blocks][:4] == ["heading", "heading", "paragraph", "paragraph"]


def test_tables_with_spans():
    cell = lambda t, r=1, c=1: {"text": t, "rows": r, "columns": c, "header": False}
    assert W.table_matrix([[cell("a", 2), cell("b", 1, 2)], [cell("c"), cell("d")]]) == [["a", "b", "b"], ["a", "c", "d"]]
    assert W.table_matrix([[cell("a"), cell("b")], [cell("c")]]) is None and W.table_matrix([]) is None
    assert W.header_names([["x", "x", ""], ["y", "x", ""]]) == ["x / y", "x", "Column 3"]


def test_balanced_json():
    assert W.balanced_json('x = {"a": "}\\"", "b": {"c": 1}}; y') == '{"a": "}\\"", "b": {"c": 1}}' and W.balanced_json("{ open") == ""


def test_markdown_normaliser(spark):
    text = "a  b \n\n\n\n```\n x  y\n```\n$$\n\nz\n\n$$"
    assert spark.createDataFrame([(text,)], "t string").select(W.normalize_markdown("t").alias("v")).first().v == "a b\n\n\n```\n x  y\n```\n$$\nz\n$$"


def test_xml(spark):
    raw = '<article><title>T</title><abstract><p>Ab</p></abstract><body><sec><title>One</title><p>x</p><sec><title>Two</title><p>y</p></sec></sec></body><ref-list><ref><label>3</label>Doe 2001</ref></ref-list></article>'
    r = spark.createDataFrame([(raw,), ("<broken",), (None,)], "x string").select(X.parse_article("x").alias("p")).select("p.*").collect()
    assert r[0].title == "T" and [(s.heading, s.level, s.text) for s in r[0].sections] == [("One", 2, "x"), ("Two", 3, "y")]
    assert [(x.label, x.year) for x in r[0].references] == [("3", "2001")] and r[1].sections == [] and r[2].title is None
    math = "<math><mfrac><mi>a</mi><msup><mi>b</mi><mn>2</mn></msup></mfrac></math>"
    assert spark.createDataFrame([(math,)], "x string").select(X.mathml_to_latex("x").alias("v")).first().v == "\\frac{a}{{b}^{2}}"


def test_catalogue_is_small():
    assert sum(len(p[2]) + len(p[3]) + len(p[4]) for p in rules.PROVIDERS) < 100


def test_more_text(value):
    assert value(T.citation_sup(F.lit("as shown [1 - 3] , here"))) == "as shown<sup>1–3</sup>, here"
    assert value(T.clean_citation_markers(F.lit("see [x](#ref1) in Fig 3 ."), True, True)) == "see x in Fig3."
    assert value(T.join_fragments(F.array(F.lit("a"), F.lit(" "), F.lit("b"), F.lit(".")))) == "a b."
    assert value(T.strip_title_heading(F.lit("# My  Title\n\nbody"), F.lit("my title"))) == "body"
    assert value(T.strip_abstract_label(F.lit("Abstract: text"))) == "text"
    assert value(T.is_lookup_title(F.lit("A paper"), 3)) and not value(T.is_lookup_title(F.lit("Redirecting")))
    assert value(T.language(F.lit("en_US"))) == "en" and value(T.language(F.lit("German"))) == "de" and value(T.language(F.lit("??"))) is None
    assert value(I.is_full_size_image(F.lit("http://a/full/x.png"))) and not value(I.is_full_size_image(F.lit("http://a/full/thumb/x")))
    assert "x/y.png" in value(I.url_keys(F.lit("./x//y.png"))) and value(I.acceptable_preview(F.lit(300), F.lit(200)))


def test_embedded_signals(value):
    page = F.lit('<script>AAASdataLayer={"page": {"pageInfo": {"pageType": "journal-article-denial", "viewType": "abs"}}, "user": {"entitled": "false"}};</script>')
    assert value(S.science_blocking(S.data_layer(page, "AAASdataLayer"))) == ["aaas_page_type_denial", "aaas_view_abs", "aaas_entitlement_denied"]
    assert value(S.data_layer(F.lit("x = {broken;"), "x")) is None
    shut = F.lit('{"page": {"attributes": {"accessType": "Paywall", "freeAccess": "no"}}, "user": {"access": "no"}}')
    assert value(S.pnas_blocking(shut)) == ["pnas_paywall_no_access"]
    assert value(S.wiley_blocking(F.lit('{"content": {"item": {"access": "no", "format-viewed": "abstract"}}, "page": {"tertiary-section": "abs"}}'))) == ["wiley_access_no", "wiley_format_viewed_abstract", "wiley_page_tertiary_abs"]
    assert value(S.positive(F.lit('<article class="article-body">'))["strong"]) == ["article_body_marker"]
    assert value(S.urls_in_json(F.lit('{"a": {"url": "http://x/1"}, "href": "http://x/1", "value": "no"}'))) == ["http://x/1"]


def test_containers():
    root = W.tree('<html><body><main><h1>T</h1><div class="abstract">a</div><div class="article-body"><p>text</p></div></main></body></html>')
    body = next(n for n in root.walk() if n.attrs.get("class") == "article-body")
    assert W.complete_ancestor(body).tag in ("main", "body") and W.container_score(body) > 400
    assert W.primary_language([{"language": "fr"}, {"language": "en-US"}]) == [{"language": "en-US"}]


def test_image_dimensions(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"....."
    rows = spark.createDataFrame([(bytearray(png),), (bytearray(jpeg),), (bytearray(b"GIF89a\x05\0\x06\0"),), (bytearray(b"x"),), (None,)], "b binary").select(I.image_dimensions("b").alias("d")).select("d.*")
    assert [tuple(r) for r in rows.collect()] == [(640, 480), (40, 30), (5, 6), (None, None), (None, None)]


def test_cals_tables(spark):
    head = '<table><tgroup><colspec colname="a"/><colspec colname="b"/><colspec colname="c"/><tbody>'
    ok = head + '<row><entry morerows="1">x</entry><entry namest="b" nameend="c">y</entry></row><row><entry>1</entry><entry>2</entry></row></tbody></tgroup></table>'
    bad = head + '<row><entry namest="a" nameend="c">x</entry><entry namest="b" nameend="c">y</entry></row></tbody></tgroup></table>'
    r = spark.createDataFrame([(ok,), (bad,), ("<no",)], "x string").select(X.cals_table("x").alias("t")).select("t.*").collect()
    assert r[0].markdown.split("\n")[0] == "| x   | y   | y   |" and r[0].markdown.split("\n")[2] == "| x   | 1   | 2   |" and r[0].lossy
    assert r[1].markdown == "" and r[2].markdown == ""


def test_site_rules_and_selectors():
    root = W.tree('<html><body><header><div class="social-share a">x</div></header><div id="main-content"><div class="article__fulltext"><p>text</p></div></div><div role="main"><article>y</article></div></body></html>')
    by = {n.attrs.get("class") or n.attrs.get("id") or n.tag: n for n in root.walk()}
    assert sites.matches(by["social-share a"], "header .social-share") and not sites.matches(by["article__fulltext"], "header .article__fulltext")
    assert sites.matches(by["main-content"], "#main-content") and sites.matches(by["article"], "[role='main'] article") and not sites.matches(by["article"], "main article")
    assert sites.site_rule(" Science ")["texts"] == ("Check for updates", "View Metrics", "Share", "Cite", "Permissions") and sites.site_rule(None) == sites.site_rule("unknown")
    assert sites.site_rule("pnas")["noise"] == ("pnas",) and sites.site_rule("wiley")["noise"] == ("generic",)
    assert sites.best_container(W.tree("<p>x</p>"), "wiley").tag == ""
