"""Operators on small tables."""

import datetime as dt
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scriptorium import sources
from scriptorium.operators import assets as A
from scriptorium.operators import budgets, matching, quality, records, reports, routing, sections
from scriptorium.plans import articles
from scriptorium.streaming import counts_by_window, deduplicated

MARKDOWN = """# A title

## Abstract

This abstract is a paragraph that is long enough to be taken for substantial prose by the rules of the structure analysis.

## Methods

### Sites

First body paragraph, long enough to count as substantial prose for the rules of the structure analysis of documents here.

Second body paragraph, long enough to count as substantial prose for the rules of the structure analysis of documents too.

## References

1. Doe 2001, a reference that is long enough to be a paragraph of prose but stands in the back matter of the document."""


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, MARKDOWN), (2, "plain words"), (3, ""), (4, None)], "doc_id long, text string")


def test_sections(docs):
    got = [(r.heading, r.level, r.kind, r.text != "") for r in sections.sections(docs).where("doc_id = 1").orderBy("section").collect()]
    assert got == [("A title", 1, "body", False), ("Abstract", 2, "abstract", True), ("Methods", 2, "body", False), ("Sites", 3, "body", True), ("References", 2, "references", True)] or got[1:] == [("Abstract", 2, "abstract", True), ("Methods", 2, "body", False), ("Sites", 3, "body", True), ("References", 2, "references", True)]
    assert [r.heading for r in sections.sections(docs).where("doc_id = 2").collect()] == ["Full Text"]
    shown = sections.renderable_sections(sections.sections(docs)).where("doc_id = 1").orderBy("section").collect()
    assert [r.heading for r in shown][-2:] == ["Methods", "Sites"]


def test_structure_and_metrics(docs):
    got = sections.structure(sections.blocks(docs)).where("doc_id = 1").first()
    assert (got.body_paragraphs, got.run_paragraphs, got.post_abstract_run) == (2, 2, True)
    m = sections.body_metrics(docs).where("doc_id = 1").first()
    assert (m.body_blocks, m.body_headings, m.has_abstract) == (2, 3, True) and m.abstract.startswith("This abstract")
    verdict = {r.doc_id: r for r in quality.assess_text(docs).collect()}
    assert len(verdict) == 4 and verdict[2].kind == "metadata_only" and verdict[3].confidence == "low"


def test_chrome_and_noise_lines(spark):
    text = "# T\n\nbody\n\n## Permissions\n\nhidden\n\n### deeper\n\nhidden too\n\n## Next\n\nSkip to main content\n\nkept (refs. )\n\nSign in"
    got = sections.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert got == "# T\n\nbody\n\n## Next\n\n\nkept"


def test_hints_move_forward(spark):
    heads = spark.createDataFrame([(1, 0, "A"), (1, 1, "C"), (1, 2, "B"), (1, 3, "D")], "doc_id long, pos int, heading string")
    hints = spark.createDataFrame([(1, 1, "a", "body"), (1, 2, "b", "references"), (1, 3, "c", "body"), (1, 4, "d", "body")], "doc_id long, order int, heading string, kind string")
    got = {r.pos: r.hint_kind for r in sections.match_hints(heads, hints).collect()}
    assert got == {0: "body", 1: "body", 2: None, 3: "body"}


def test_packing_to_the_first_misfit(spark):
    rows = spark.createDataFrame([(1, k, 50, "x" * 200) for k in range(4)], "doc_id long, pos int, tokens int, text string")
    got = budgets.pack_prefix(rows, 170, "doc_id", ["pos"]).orderBy("pos").collect()
    assert [r.pos for r in got] == [0, 1, 2]
    got = budgets.pack_prefix(rows, 120, "doc_id", ["pos"], truncation_left=16).orderBy("pos").collect()
    assert [(r.pos, r.truncated) for r in got] == [(0, False), (1, False), (2, True)] and got[2].shown.endswith("...")


def test_packing_that_skips(spark):
    rows = spark.createDataFrame([(1, 0, 60), (1, 1, 70), (1, 2, 30), (1, 3, 5), (1, 4, 1)], "doc_id long, pos long, bytes long")
    assert sorted(r.pos for r in budgets.pack_skipping(rows, 100, "doc_id", most=3).collect()) == [0, 2, 3]


def test_render_shares_one_budget(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a", 10), (1, 0, 1, "b", 100), (1, 0, 2, "c", 1), (1, 1, 0, "d", 5)], "doc_id long, group int, pos int, text string, tokens int")
    r = budgets.render(rows, 50).first()
    assert (r.markdown, r.tokens, r.truncated) == ("a\n\nd", 15, True)


def test_routing(spark):
    asked = spark.createDataFrame([(1, ["https://www.nature.com/x"], ["Wiley"], "10.1016/x"), (2, [], ["Elsevier B.V."], "10.1016/y"), (3, [], [], "10.9/z"), (4, None, None, None)], "query_id long, urls array<string>, publishers array<string>, doi string")
    got = {(r.query_id, r.rank): (r.provider, r.signal) for r in routing.route(asked).collect()}
    assert got == {(1, 1): ("springer", "domain"), (1, 2): ("wiley", "publisher"), (1, 3): ("elsevier", "doi"), (2, 1): ("elsevier", "doi")} or got[(2, 1)] == ("elsevier", "publisher")
    assert routing.official_candidates(routing.route(asked), ["wiley"]).count() == 1


def test_resolve(spark):
    queries = spark.createDataFrame([(1, "https://doi.org/10.1126/a"), (2, "a study of lakes and rivers"), (3, "10.1073/b")], "query_id long, query string")
    works = spark.createDataFrame([("10.1126/a", "Other thing", "https://www.science.org/a", "AAAS"), ("10.1016/l", "A Study of Lakes and Rivers", None, "Elsevier"), ("10.1073/b", "Zed", None, None)], "doi string, title string, landing_url string, publisher string")
    got = {r.query_id: (r.kind, r.doi, r.provider) for r in routing.resolve(queries, works).collect()}
    assert got == {1: ("url", "10.1126/a", "science"), 2: ("title", "10.1016/l", "elsevier"), 3: ("doi", "10.1073/b", "pnas")}


def test_merge_rules(spark):
    p = spark.createDataFrame([("1", "", ["a"]), ("2", None, None)], "doi string, title string, names array<string>")
    s = spark.createDataFrame([("1", "second", ["b", "a"]), ("2", "given", ["c"]), ("3", "only", [])], "doi string, title string, names array<string>")
    got = {r.doi: (r.title, r.names) for r in records.merge_metadata(p, s, "doi", ("title",), ("names",)).collect()}
    assert got == {"1": (None, ["a", "b"]), "2": ("given", ["c"]), "3": ("only", [])}


def test_assets(spark):
    rows = spark.createDataFrame([("k", 0, "", "x"), ("k", 1, "cap", "y"), (None, 2, "free", None)], "id string, pos int, caption string, url string")
    got = sorted((r.id or "", r.caption, r.url) for r in records.merge_by_identity(rows, ["id"], ["caption", "url"]).collect())
    assert got == [("", "free", None), ("k", "cap", "x")]
    figures = spark.createDataFrame([(1, "a/x.png"), (1, "a/y.png")], "doc_id long, url string")
    seen = spark.createDataFrame([(1, "https://h/x.png?s=1")], "doc_id long, url string")
    assert [r.url for r in records.anti_inline(figures, seen).collect()] == ["a/y.png"]
    names = spark.createDataFrame([("d", "a.png", 0), ("d", "A.png", 1), ("d", "b", 2)], "folder string, name string, pos int")
    assert [r.file for r in records.unique_paths(names).orderBy("pos").collect()] == ["a.png", "A_2.png", "b"]


def test_caches(spark):
    now = dt.datetime(2024, 1, 10)
    rows = spark.createDataFrame([(k, now - dt.timedelta(days=k), 10) for k in range(6)], "entry_id int, stored_at timestamp, bytes int")
    kept = records.evict(rows, F.lit(now), F.expr("INTERVAL 4 DAYS"), 4, 25)
    assert sorted(r.entry_id for r in kept.collect()) == [0, 1]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "doi string, v int")
    fresh = spark.createDataFrame([("a", 9), ("a", 8)], "doi string, v int")
    assert sorted(tuple(r) for r in records.refresh(old, fresh).collect()) == [("a", 8), ("a", 9), ("b", 2)]


def test_works_from_json(spark):
    raw = '{"DOI": "10.1/AB", "title": ["A  title"], "author": [{"given": "J", "family": "Doe"}], "issued": {"date-parts": [[2020, 3]]}, "license": [{"URL": "u"}], "abstract": "<p>x</p>"}'
    r = records.normalize_works(spark.createDataFrame([(raw,), ("bad",)], "message string")).collect()
    assert (r[0].doi, r[0].title, r[0].authors, r[0].published, r[0].licences, r[0].abstract) == ("10.1/ab", "A title", ["J Doe"], "2020-3", ["u"], "x") and r[1].doi == ""


def test_waterfall_and_probes(spark):
    tries = spark.createDataFrame([(1, 0, "failed"), (1, 1, "success"), (2, 0, "stop"), (2, 1, "success"), (3, 0, "failed")], "query_id long, pos int, outcome string")
    assert {r.query_id: r.winner for r in routing.waterfall(tries).collect()} == {1: 1, 2: None, 3: None}
    probes = spark.createDataFrame([(1, 0, "negative"), (1, 1, "unknown"), (1, 2, "unknown")], "query_id long, pos int, state string")
    assert routing.best_probe(probes).first().pos == 1


def test_reports(spark):
    rows = spark.createDataFrame([(k, f"d{k}", "p" if k < 5 else "q", "fulltext" if k % 2 else "blocked", "s", ["x"] if k > 1 else [], ["a:b_ok"]) for k in range(7)], "pos int, doi string, provider string, status string, source string, flags array<string>, trail array<string>")
    by = {r.provider: (r.attempted, r.n_fulltext, r.samples) for r in reports.by_provider(rows, ["fulltext", "blocked"]).collect()}
    assert by == {"p": (5, 2, ["d0", "d1", "d2"]), "q": (2, 1, ["d5", "d6"])}
    issue = reports.by_issue(rows).first()
    assert (issue["flag"], issue["rows"], issue["samples"]) == ("x", 5, ["d2", "d3", "d4", "d5", "d6"])
    assert reports.with_issues(rows, ["x"], 2).count() == 2 and reports.totals(rows).first().attempted == 7


def test_failures(spark):
    rows = spark.createDataFrame([("q", 0, "no_access", "m1", ["w"]), ("q", 1, "error", "m2", ["w", "v"])], "key string, pos int, code string, message string, warnings array<string>")
    r = quality.combine_failures(rows, "key", {"error": 0, "no_access": 1}).first()
    assert (r.code, r.message, r.warnings) == ("error", "m1; m2", ["w", "v"])
    checks = spark.createDataFrame([("a", "ok"), ("a", "missing"), ("b", "ok"), ("c", "error"), ("d", "rate_limited")], "provider string, status string")
    assert {r.provider: r.status for r in quality.capability_status(checks).collect()} == {"a": "partial", "b": "ready", "c": "error", "d": "rate_limited"}


def test_near_duplicates(spark):
    base = " ".join({3: "z", 200: "q"}.get(k, f"word{k}") for k in range(300))  # rare letters: the matcher skips very common ones in long texts
    rows = [(1, base), (2, base), (3, base.replace("word7 ", "worx7 ")), (4, base[:900])]
    got = matching.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.left, r.right) for r in got] == [(1, 3)]


def test_scores(spark):
    pairs = spark.createDataFrame([(1, "deep lakes", "a", "Deep Lakes!", 0), (1, "deep lakes", "b", "deep seas", 1)], "query_id long, query_title string, work_id string, title string, pos int")
    r = matching.confident(matching.score_candidates(pairs)).first()
    assert (r.work_id, r.score, r.confident) == ("a", 1.0, True)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>é</p>".encode("latin-1"))
    (tmp_path / "b.html").write_bytes("<p>é</p>".encode())
    assert {r.html for r in sources.read_pages(spark, str(tmp_path)).collect()} == {"<p>é</p>"}
    rows = spark.createDataFrame([("10.1/a", "s", "fulltext", True, [], ["x"], "md", None, None, 2, (["markdown"], "s", "all", "full"))], sources.ENVELOPE)
    sources.write_envelopes(rows, str(tmp_path / "env"))
    back = sources.read_envelopes(spark, str(tmp_path / "env"), 2).collect()
    assert len(back) == 1 and back[0].request.modes == ["markdown"]
    skipped = sources.write_markdown(rows.unionByName(rows.withColumn("content_kind", F.lit("abstract_only"))), str(tmp_path / "md"))
    assert skipped.first().source_trail[-1] == "download:markdown_skipped_no_fulltext" and spark.read.parquet(str(tmp_path / "md")).count() == 1
    assert '"doi":"10.1/a"' in sources.serialize(rows).first().output


def test_parallel_calls_keep_order(spark):
    rows = spark.range(20).withColumnRenamed("id", "pos")
    out = sources.map_in_parallel(rows, lambda b: b.assign(v=b.pos * 2)[["pos", "v"]], "pos long, v long", 3).collect()
    assert [r.v for r in out] == [2 * k for k in range(20)]


def test_streams(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1, k % 3), "ab"[k % 2]) for k in range(12)]
    table = spark.createDataFrame(rows, "id long, at timestamp, kind string")
    table.write.parquet(str(tmp_path / "in"))
    stream = counts_by_window(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "at", "kind")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, counts_by_window(table, "at", "kind").collect()))
    assert deduplicated(table, ["kind"], "at").count() == 2


def test_articles(docs):
    r = articles.article_from_markdown(docs).where("doc_id = 1").first()
    assert r.kind in ("fulltext", "abstract_only") and len(r.sections) >= 4 and r.section_abstract.startswith("This abstract")
    assert articles.envelope(articles.article_from_markdown(docs), ["markdown"]).columns == ["doc_id", "kind", "confidence", "tokens", "markdown"]


def test_images_and_assets(spark):
    docs = spark.createDataFrame([(1, "![a](https://h/x/f1.png?s=2) and ![b](img/f2.png) ![c](none.png)"), (2, None)], "doc_id long, text string")
    assets = spark.createDataFrame([(1, 0, "figure", "https://o/f1.png", "local/1.png", "Figure 1", "body"), (1, 1, "figure", "./img//f2.png", "local/2.png", "Fig. 2", "appendix"), (1, 2, "supplementary", "s.zip", "s", "S", "")], "doc_id long, pos int, kind string, url string, path string, heading string, section string")
    got = {r.doc_id: r.text for r in A.rewrite_links(docs, assets).collect()}
    assert got == {1: "![a](local/1.png) and ![b](local/2.png) ![c](none.png)", 2: ""}
    assert [r.pos for r in A.selected(assets, "body").collect()] == [0] and A.selected(assets, "all").count() == 3 and A.selected(assets, "none").count() == 0
    assert [x.count() for x in A.split_supplementary(assets)] == [1, 2]


def test_injections(spark):
    blocks = spark.createDataFrame([(1, 0, "**Figure 1.** Map"), (1, 1, "TABLE_1"), (1, 2, "text")], "doc_id long, pos int, block string")
    figs = spark.createDataFrame([(1, 0, "figure", "f.png", "Fig. 1")], "doc_id long, pos int, kind string, url string, heading string")
    tables = spark.createDataFrame([(1, "TABLE_1", "| a |")], "doc_id long, placeholder string, markdown string")
    out = A.inject_tables(A.inject_figures(blocks, figs), tables).orderBy("pos").collect()
    assert [r.block for r in out] == ["![Figure 1](f.png)\n\n**Figure 1.** Map", "| a |", "text"]
    text = spark.createDataFrame([(1, 0, "see Fig. 1a and Table 2")], "doc_id long, pos int, text string")
    labels = spark.createDataFrame([(1, "Figure 1"), (1, "Figure 3")], "doc_id long, label string")
    assert [tuple(r) for r in A.mentions(text, labels).collect()] == [(1, "figure 1", 0)]


def test_download_notes(spark):
    rows = spark.createDataFrame([(1, True, None, 10, 10, False), (1, False, "preview", 400, 300, None), (2, False, "full", 0, 0, None), (1, False, "preview", 10, 10, None)], "doc_id long, failed boolean, download_tier string, width int, height int, preview_accepted boolean")
    assert {r.doc_id: r.marks for r in A.notes(rows).collect()} == {1: ["download:assets_partial", "download:assets_preview_fallback"], 2: []}
    assert A.accepted_previews(rows).count() == 3
    urls = spark.createDataFrame([(["a", "b", "a"], "x")], "u array<string>, p string")
    assert A.pdf_candidates(urls, ["u"], 1, "p").first().pdf_urls == ["a", "x", "b"]


def test_repeated_abstract_paragraphs(spark):
    rows = [(1, 0, "Body", 2, "body", "same words here\n\nown words"), (1, 1, "Other", 2, "body", "same words here"), (1, 2, "References", 2, "references", "same words here")]
    found = spark.createDataFrame(rows, "doc_id long, section int, heading string, level int, kind string, text string")
    abstracts = spark.createDataFrame([(1, "Same words, here")], "doc_id long, abstract string")
    got = [(r.section, r.text) for r in sections.without_leading_abstract(found, abstracts).orderBy("section").collect()]
    assert got == [(0, "own words"), (2, "same words here")]
    blocks = spark.createDataFrame([(1, k, "One. Two." if k % 2 else "short") for k in range(20)], "doc_id long, pos int, block string")
    assert [r.pos for r in sections.first_prose(blocks).orderBy("pos").collect()] == [1, 3, 5, 7, 9, 11]


def test_near_duplicates_against_brute_force(spark):
    """Texts with and without spaces, edits at all places, lengths at the band's edge."""
    rng = random.Random(4)
    word = lambda n, letters="abcdefghij": "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for size, letters in ((150, "abcdefghij"), (220, "中文字符没有空格的很长句子"), (400, "ab"), (1300, "abcdefghij"), (9000, "abcdefghijklmnop")):
        base = word(size, letters)
        texts.append(base)
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(1, max(1, size // 90))):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 2)
            texts.append("".join(own))
        texts.append(base[: size // 2] + word(1, letters) + base[size // 2 :])
        texts.append(base + word(int(size * 0.008), letters))
    texts += ["long" * 30 + " x " + "word" * 30, "long" * 30 + " xy " + "word" * 30, "", None, "short", "shorter"]
    rows = list(enumerate(texts))
    first = {}
    for k, t in rows:
        key = re.sub(r"[\W_]+", "", (t or "").lower())
        if key:
            first.setdefault(key, k)
    plain = sorted((k, t) for t, k in first.items())
    want = set()
    for i, (a, x) in enumerate(plain):
        for b, y in plain[i + 1 :]:
            if abs(len(x) - len(y)) <= 64 and SequenceMatcher(None, x, y).ratio() >= 0.995:
                want.add((a, b))
    got = {(r.left, r.right) for r in matching.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and len(got) > 5


def test_edited_texts_meet_on_few_grams():
    """Ordinary texts have at most three grams an edit and one more; edited texts share one at near places, texts with few anchors too."""
    rng = random.Random(11)
    for letters in ("abcdefghijklmnopqrst", "abc", "ab", "a", "中文字符没有空格的很长句子"):
        for size in (110, 300, 900, 4000):
            base = "".join(rng.choice(letters) for _ in range(size))
            if size == 900:
                base = base[:6] * 150
            for _ in range(6):
                other, left = list(base), int(0.005 * 2 * size)
                while left:
                    at = rng.choice([0, len(other), rng.randrange(len(other) + 1)])
                    if rng.random() < 0.5 and at < len(other):
                        del other[at]
                    else:
                        other.insert(at, rng.choice(letters))
                    left -= 1
                other = "".join(other)
                apart = 0.005 * (len(base) + len(other)) + 1e-9
                if abs(len(base) - len(other)) > apart or 2 * matching._common_subsequence(base, other) < 0.995 * (len(base) + len(other)):
                    continue
                a, b = ({g: (i, j) for g, i, j in matching._gram_prefix(t, 0.995, 64)} for t in (base, other))
                assert any(a[g][0] - b[g][1] <= apart and b[g][0] - a[g][1] <= apart for g in a.keys() & b.keys())
                if len(letters) == 20 and size != 900:
                    assert len(a) <= 3 * matching.edits(size, 0.995, 64) + 1


def test_counts_of_letters_never_exceed_the_edits(spark):
    rng = random.Random(12)
    pairs = []
    for size in (0, 3, 200, 5000):
        base = "".join(rng.choice("aaaabcdefgh中é") for _ in range(size))
        for count in (0, 1, 40, 700):
            other = list(base)
            for _ in range(count):
                other.insert(rng.randrange(len(other) + 1), rng.choice("aab"))
            pairs += [(matching._letter_counts(base), matching._letter_counts("".join(other)), count), (matching._letter_counts("".join(other)), matching._letter_counts(base), count)]
    rows = spark.createDataFrame(pairs, "l long, r long, edits long").select("edits", matching._letter_edits("l", "r").alias("least")).collect()
    assert all(0 <= r.least <= r.edits for r in rows) and all(r.least == r.edits for r in rows if r.edits <= 40)


def test_resolve_weighs_tokens_and_characters(spark):
    """A title with all tokens in another order is like in tokens but not in characters; a close second takes the margin."""
    works = spark.createDataFrame([("10.1/a", "gamma beta alpha of deep rivers", None, None), ("10.1/b", "slow rivers carry sand", None, None), ("10.1/c", "slow rivers carry sands", None, None), ("10.1/d", "unique words about quiet lakes", None, None)], "doi string, title string, landing_url string, publisher string")
    asked = spark.createDataFrame([(1, "alpha beta gamma of deep rivers"), (2, "slow rivers carry sand"), (3, "unique words about quiet lakes"), (4, "of the")], "query_id long, query string")
    got = {r.query_id: r.doi for r in routing.resolve(asked, works).collect()}
    score = lambda a, b: round(0.7 * len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) + 0.3 * 2 * matching._common_subsequence(a, b) / (len(a) + len(b)), 6)
    assert score("alpha beta gamma of deep rivers", "gamma beta alpha of deep rivers") < 0.9 + 0.05
    assert got[1] == ("10.1/a" if score("alpha beta gamma of deep rivers", "gamma beta alpha of deep rivers") >= 0.9 else None)
    assert got[2] == "10.1/b" and got[3] == "10.1/d" and got[4] is None


def test_titles_above_a_similarity_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["the", "of", "a", "river", "model", "deep", "learning", "soil", "carbon", "forest"]
    titles = [(k, " ".join(rng.sample(words, rng.randint(1, 8)))) for k in range(150)]
    queries = spark.createDataFrame(titles[:40], "query_id long, title string")
    works = spark.createDataFrame(titles[40:], "work_id long, title string")
    want = set()
    for q, t in titles[:40]:
        scored = []
        for w, o in titles[40:]:
            a, b = set(t.split()), set(o.split())
            scored.append((-len(a & b) / len(a | b), w))
        want |= {(q, w) for s, w in sorted(scored)[:5] if -s >= 0.6}
    assert {(r.query_id, r.work_id) for r in matching.title_candidates(queries, works, 5, 0.6).collect()} == want


def test_a_long_word_of_many_titles_joins_none_of_them(spark):
    """Titles meet on their rare tokens, however long the common ones; equal titles count once, with their smallest ids."""
    titles = spark.createDataFrame([(k, f"customer {k:05d} on automobile") for k in range(300)], "work_id long, title string")
    kinds = titles.select(F.array_sort(matching.title_tokens(F.col("title"))).alias("tokens"))
    often = kinds.select(F.explode("tokens").alias("token")).groupBy("token").count().where("count > 1")
    met = matching._rare_tokens(kinds, often, "tokens", 0.78).groupBy("token").count()
    assert met.count() == 300 and met.agg(F.max("count")).first()[0] == 1
    copies = titles.unionByName(titles.withColumn("work_id", F.col("work_id") + 1000)).unionByName(titles.withColumn("work_id", F.col("work_id") + 2000))
    got = matching.title_candidates(titles.withColumnRenamed("work_id", "query_id"), copies, 2, 0.78).collect()
    assert sorted((r.query_id, r.work_id, r.jaccard, r.rank) for r in got) == sorted((k, k + 1000 * i, 1.0, i + 1) for k in range(300) for i in range(2))


def test_batches_after_a_rate_limit_come_back_with_the_reason(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = spark.range(20).select(F.col("id").alias("pos")).coalesce(1)
        call = lambda b: b.assign(v=1, rate_limited=b.pos == 7, not_run=None)[["pos", "v", "rate_limited", "not_run"]]
        out = sources.map_in_parallel(rows, call, "pos long, v long, rate_limited boolean, not_run string", 1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.pos for r in out] == list(range(20)) and [r.pos for r in out if r.not_run] == list(range(10, 20))
