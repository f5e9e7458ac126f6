import hashlib
import os
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import fingerprints, jaccard_join, suffix_dedup
from scriptorium.llm.components import components

SF = "/root/testdata/sf0.001"


def shingles(text, size, lower):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "") if lower else text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, how):
    """Rows of one doc_id are one document; component ids of documents, and each row's set."""
    sets = [shingles(t, how.size, how.lower) for _, t in rows]
    node = [d if d is not None else ("null", t) for d, t in rows]
    parent = {x: x for x in node}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= how.percent * (len(sets[i]) + len(sets[j]) - common):
            a, b = find(node[i]), find(node[j])
            if a != b:
                keep, gone = sorted((a, b), key=lambda x: (isinstance(x, tuple), x if not isinstance(x, tuple) else 0))
                parent[gone] = keep
    return sets, [find(x) if not isinstance(find(x), tuple) else None for x in node]


@pytest.mark.parametrize("how", [jaccard_join.Likeness(4, 85, True), jaccard_join.Likeness(5, 80)])
def test_join_of_edge_cases(edge, edge_rows, how):
    rows = [(d, t) for d, t, *_ in edge_rows]
    sets, labels = brute_components(rows, how)
    want = Counter((d, len(s), c) for (d, _), s, c in zip(rows, sets, labels))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(edge, how).collect())
    assert got == want


def test_join_of_long_lists_and_groups(spark, monkeypatch):
    """Bounds so low that pivots, chains, stars and the exact rest all take part."""
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", 2)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for d in range(120):
        own = list(base)
        for k in rng.choice(80, int(rng.integers(0, 9)), replace=False):
            own[k] = f"e{rng.integers(0, 30)}"
        rows.append((d, " ".join(own)))
    how = jaccard_join.Likeness(4, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets, labels = brute_components(rows, how)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, how).collect()}
    assert got == {d: (len(s), c) for (d, _), s, c in zip(rows, sets, labels)}


def test_join_keeps_one_of_each_group(edge, empty):
    kept = jaccard_join.keep_one(edge.where("doc_id is not null")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id in (1, 2, 3, 15)) == [1]
    assert jaccard_join.keep_one(empty).collect() == []
    assert jaccard_join.join(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}}


def brute_spans(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), edges, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("length", "hot"), [(400, 8192), (100, 8192), (100, 1), (24, 8192), (24, 3)])
def test_spans_against_brute_force(spark, edge_rows, length, hot):
    rows = [(d, t[:9000] if t else t) for d, t, *_ in edge_rows] + [(30, "abc" * 300 + "xyz" + "abc" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in suffix_dedup.spans(docs, length, hot).collect())
    assert got == brute_spans(rows, length)


@pytest.mark.parametrize("hot", [8192, 20])
def test_spans_of_many_contexts(spark, hot):
    """One passage in many surroundings, cut at different places: buckets with many different contexts, sorted whole or split."""
    rng = np.random.default_rng(1)
    passage = "".join(rng.choice(list("abcdefghij "), 900))
    noise = lambda n: "".join(rng.choice(list("klmnopqrst "), n))
    rows = [(d, noise(50) + passage[int(rng.integers(0, 500)) :][: int(rng.integers(200, 800))] + noise(60)) for d in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in suffix_dedup.spans(docs, 150, hot).collect()) == brute_spans(rows, 150)


def test_removed_texts_keep_their_columns(edge, empty):
    out = suffix_dedup.remove(edge, 200)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert suffix_dedup.remove(empty).collect() == [] and suffix_dedup.spans(empty).collect() == []


@pytest.mark.parametrize("r", [1, 2, 3])
def test_difference_cover(r):
    v, residues = suffix_dedup.difference_cover(r)
    assert {(a - b) % v for a in residues for b in residues} == set(range(v)) and len(residues) == 6 * r + 4


def test_bucket_order_is_the_suffixes_order():
    rng = np.random.default_rng(3)
    texts = [rng.choice([97, 98], int(rng.integers(1, 400))).astype(np.uint8).tobytes() for _ in range(60)] + [b"ab" * 200, b"ab" * 199 + b"b", b"ab" * 200]
    rows, _ = suffix_dedup._matrix(texts, 400)
    order = suffix_dedup._sort_buckets(rows, [range(30), range(30, 63)])
    for part in order:
        assert [texts[k] for k in part] == sorted(texts[k] for k in part)


def test_fingerprints_of_equal_and_edited_texts(edge, edge_rows, empty):
    rows = sorted(((d is not None, d or 0, t or "") for d, t, *_ in edge_rows), key=lambda r: (*r[:2], hashlib.md5(r[2].encode()).digest()))
    got = fingerprints.likeness_to_edited(edge).collect()
    want = Counter()
    for k, (known, d, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][2], len(t) // 2
        want[(d if known else None, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.likeness_to_edited(empty).collect() == [] and fingerprints.fingerprint(empty).collect() == []


def test_single_document_is_its_own_next(spark):
    (row,) = fingerprints.likeness_to_edited(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_radius_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (12, fingerprints.BITS // 8), np.uint8)
    fps = [base]
    for flips in (1, 2, 3, 4, 9):
        bits = np.unpackbits(base, axis=1)
        for row in bits:
            row[rng.choice(fingerprints.BITS, flips, replace=False)] ^= 1
        fps.append(np.packbits(bits, axis=1))
    names = [x.tobytes().hex() for x in np.concatenate(fps)]
    got = {(r.left, r.right): r.distance for r in fingerprints.within_radius(spark.createDataFrame([(n,) for n in names + names[:3]], "fingerprint string"), 3).collect()}
    want = {}
    for a, b in combinations(sorted(set(names)), 2):
        d = (int(a, 16) ^ int(b, 16)).bit_count()
        if d <= 3:
            want[a, b] = d
    assert got == want and got


@pytest.mark.parametrize("every", [1, 100])
def test_near_fingerprints_are_counted(spark, edge, empty, every):
    rows = fingerprints.report(spark.read.parquet(f"{SF}/documents.parquet"), every=every).collect()
    fps = {r.word_fingerprint for r in rows}
    for r in rows:
        own = int(r.word_fingerprint, 16)
        near = sum(0 < (own ^ int(f, 16)).bit_count() <= fingerprints.RADIUS for f in fps)
        assert r.near_fingerprints == (near if r.doc_id % every == 0 else None)
    assert every > 1 or any(r.near_fingerprints for r in rows)
    assert fingerprints.report(edge).count() == edge.count() and fingerprints.report(empty).collect() == []


def test_radius_finds_near_copies(spark):
    """Recall of the real texts' pairs of similarity 0.8 or more (five words) at the production radius."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = [shingles(t, 5, False) for t in texts]
    holders = defaultdict(list)
    for k, own in enumerate(sets):
        for x in own:
            holders[x].append(k)
    together = Counter(pair for own in holders.values() if len(own) < 100 for pair in combinations(own, 2))
    pairs = [(a, b) for (a, b), n in together.items() if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    fps = fingerprints.simhash(pa.array(texts, pa.large_string()), 1)
    near = [int(np.bitwise_count(fps[a] ^ fps[b]).sum()) <= fingerprints.RADIUS for a, b in pairs]
    assert len(pairs) > 10 and np.mean(near) > 0.8


def test_separation_on_real_texts(spark):
    rows = fingerprints.likeness_to_edited(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95


def test_simhash_depends_on_text_only():
    a = fingerprints.simhash(pa.array(["some words in a row here", None, ""]).fill_null(""))
    b = fingerprints.simhash(pa.array(["x", "some words in a row here"]))
    assert (a[0] == b[1]).all() and not a[1].any() and not a[2].any()


@pytest.mark.parametrize("piece", [1 << 19, 4000])
def test_links_of_a_long_cluster_are_all_counted(spark, monkeypatch, piece):
    """Over 64 distinct near copies, copies of them, texts apart, and an id with two texts; one piece, and several."""
    monkeypatch.setattr(jaccard_join, "_PIECE", piece)
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(100):
        own = list(base)
        for k in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            own[k] = f"e{rng.integers(0, 60)}"
        rows.append((d, " ".join(own)))
    rows += [(200 + k, rows[3 * k][1]) for k in range(20)] + [(300, "a b c d e f"), (301, "a b c d e f"), (302, "g h"), (303, None), (304, None), (5, "other words than these are in it")]
    how = jaccard_join.Likeness(4, 85)
    sets = {(d, shingles(t, 4, False)) for d, t in rows}
    alike = lambda x, y: x and y and 100 * len(x & y) >= 85 * len(x | y)
    want = Counter((d, len(own := shingles(t, 4, False)), sum(bool(alike(own, s)) for e, s in sets if (e, s) != (d, own))) for d, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.n_links) for r in jaccard_join.join(docs, how).collect())
    assert got == want and max(n for _, _, n in got) > 64


def test_many_rows_of_one_id_and_of_none(spark):
    """A third of the rows share an id, another third has none: their ranges are cut by digest, and each row finds its next one."""
    rows = [(7, f"text {k} of the seventh {k * k}") for k in range(200)] + [(None, f"unnamed {k} text {k * 3}") for k in range(200)] + [(1000 + k, f"row {k}") for k in range(200)] + [(7, "a copy")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    want = Counter()
    for k, (d, t) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        want[(d, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    got = Counter((r.doc_id, r.edited_sha256) for r in fingerprints.likeness_to_edited(docs).collect())
    assert got == want
    ranges, starts = fingerprints._ranges(docs)
    assert ranges.nulls >= 2 and ranges.widths.max() >= 2 and len(starts) >= 6


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_passage_in_many_documents_is_split(spark):
    """More contexts of one anchor than are sorted whole: every copy of the passage goes, and nothing else."""
    rng = np.random.default_rng(11)
    passage = "".join(rng.choice(list("abcdefgh "), 450))
    noise = lambda n: "".join(rng.choice(list("ijklmnop "), n))
    sides = [(noise(60), noise(60)) for _ in range(suffix_dedup.HOT + 500)]
    rows = [(d, f"{a}X{passage}Y{b}") for d, (a, b) in enumerate(sides)]
    out = suffix_dedup.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()

    def reach(texts):  # what each text shares with its likest other one, from its start
        order, got = sorted(range(len(texts)), key=texts.__getitem__), [0] * len(texts)
        for x, y in zip(order, order[1:]):
            n = len(os.path.commonprefix([texts[x], texts[y]]))
            got[x], got[y] = max(got[x], n), max(got[y], n)
        return got

    before, after = reach([a[::-1] for a, _ in sides]), reach([b for _, b in sides])
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in out} == {(d, 452 + before[d] + after[d], 1) for d in range(len(rows))}
