import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import compression_quality, mixing, rule_lists, sharding, warc
from scriptorium.llm.common import new_folder

SF = "/root/testdata/sf0.001"


def test_shards_fit_and_partition_the_rows(edge, edge_rows, empty):
    rows = sharding.shard(edge.select("doc_id", "text", "slot", "shard", "n_bytes"), 3000).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((d, t) for d, t, *_ in edge_rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.n_bytes)
    assert all(sum(x) <= 3000 or len(x) == 1 for x in by.values())
    names = [s for s in by if "." not in s]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.shard(empty, 100).collect() == []
    assert {r.shard for r in sharding.shard(edge, 1 << 30).collect()} == {""}


def test_copies_of_one_row_get_pages(spark):
    docs = spark.createDataFrame([(1, "x" * 100)] * 50 + [(2, "y" * 700)], "doc_id long, text string").repartition(4)
    rows = sharding.shard(docs, 450).collect()
    by = Counter(r.shard for r in rows if r.doc_id == 1)
    assert len(rows) == 51 and max(by.values()) <= 4 and all(r.page is not None for r in rows)


def test_warc_round_trip(spark):
    pages = [(1, "http://a/\r\nX: y", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "http://c", None), (4, "u", ""), (5, "u", "<p>é中</p>" * 9000), (None, "n", "<p>a</p>"), (5, "v", "<p>é中</p>" * 9000), (None, "n", "only null")]
    docs = spark.createDataFrame([(i, u, h, 1) for i, u, h in pages], "page_id long, url string, html string, revisit int").repartition(3)
    got = warc.round_trip(docs).collect()
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in pages:
        raw, top = (h or "").encode(), last[h or ""]
        again = top >= 0 and i != top
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_bundles_are_standard_zstandard(spark):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 500) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    folder = new_folder(spark, "test")
    manifest = warc.write(pages, folder, frame_bytes=4096, bundle_bytes=9000).collect()
    bundles = {r.bundle for r in manifest}
    assert len(bundles) > 1
    fs, base = warc.file_system(folder)
    for name in bundles:
        raw = fs.open_input_file(f"{base}/{name}").read()
        text = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert text.count(b"WARC/1.1\r\n") == sum(r.bundle == name for r in manifest)
        table = warc.seek_table(fs.open_input_file(f"{base}/{name}"))
        assert sum(x[3] for x in table) == len(text) and len({r.frame for r in manifest if r.bundle == name}) == len(table)


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_pfair_period_deviates_by_less_than_a_block(shares):
    slots = mixing.pfair_period(shares)
    order = [0] * sum(shares)
    for s, own in enumerate(slots):
        assert own == sorted(own)
        for t in own:
            order[t] = s
    assert sorted(t for own in slots for t in own) == list(range(sum(shares)))
    assert mixing.deviation(shares, order * 2) < 1


def test_schedule_places_every_block_once():
    blocks, weights = [5, 40, 1, 17], [1.0, 2.0, 3.0, 0.5]
    seen = Counter()
    for s, phase, first, start, q, own in (table := mixing.schedule(weights, blocks, 60)):
        last = min([x[2] for x in table if x[0] == s and x[1] > phase], default=blocks[s])
        for b in range(first, last):
            seen[start + (b - first) // len(own) * q + own[(b - first) % len(own)]] += 1
    assert len(seen) == sum(blocks) == max(seen) + 1 and set(seen.values()) == {1}


def test_mixture_keeps_all_rows_and_shares(edge, edge_rows, empty, spark):
    rows = mixing.mix(edge, block_bytes=500).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter((d, t, s) for d, t, _, s, *_ in edge_rows)
    assert mixing.mix(empty).collect() == []
    many = spark.createDataFrame([(k, "x" * 100, "a" if k % 3 else "b") for k in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix(many, {"a": 3, "b": 1}, block_bytes=1000, period=8).collect()
    by_source = {s: sorted((r["rank"], r.block, r.slot) for r in rows if r.source == s) for s in "ab"}
    for s, own in by_source.items():
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == [k // 10 for k in range(len(own))]
    order = [r.source for r in sorted({(r.slot, r.source): r for r in rows}.values(), key=lambda r: r.slot)]
    both = order[: 4 * 20]  # 20 blocks a source at least
    for t in range(1, len(both) + 1):
        assert abs(Fraction(3 * t, 4) - both[:t].count("a")) < 1


def test_classifier_on_held_out_rows(spark, edge, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = compression_quality.train_from(docs, labels.where(~compression_quality.held_out()))
    rows = compression_quality.score(docs, model).join(labels, "doc_id").where(compression_quality.held_out()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    scored = compression_quality.score(edge, model).collect()
    assert len(scored) == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    assert compression_quality.score(empty, model).collect() == []


def test_classifier_without_both_classes(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in compression_quality.score(edge, compression_quality.train_from(edge, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in compression_quality.score(edge, compression_quality.train_from(edge, one)).collect())


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    inside = {k for i, x in enumerate(windows) if count[x] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("which", ["edge", "real"])
def test_statistics_against_brute_force(spark, edge, which):
    docs = (edge if which == "edge" else spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "text")
    got = rule_lists.apply_rules(docs, []).collect()
    for r in got:
        base = brute_statistics(r.text)
        assert tuple(r[k] for k in rule_lists.BASE) == base, r.doc_id
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0]) and r.kept == (not r.base_failed)


def test_rules_are_learned_and_native(spark, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = rule_lists.learn_from(docs, labels)
    out = rule_lists.apply_rules(docs, rules)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.join(labels, "doc_id").where("not base_failed").collect()
    assert rules and np.mean([r.kept for r in rows if r.quality == 1]) > 0.97 and np.mean([not r.kept for r in rows if r.quality == 0]) > 0.8
    assert rule_lists.learn_from(docs, labels.limit(0)) == [] and rule_lists.apply_rules(empty, rules).collect() == []
    kept = rule_lists.apply_rules(docs, rules).where(F.col("kept"))
    assert kept.count() == out.where("kept").count()


def test_learner_finds_a_planted_conjunction():
    rng = np.random.default_rng(4)
    table = {f: rng.random(3000) for f in rule_lists.FEATURES}
    bad = (table["symbols_per_word"] > 0.7) & (table["capital_share"] < 0.4)
    rules = rule_lists.learn_rules(table, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= rule_lists._matches(r, table)
    assert (hit == bad).mean() > 0.97


def test_sql_of_warc_query():
    from scriptorium.llm import queries

    sql = queries.oracle_sql()["op4_warc"]
    con = duckdb.connect()
    con.execute("create table pages as select * from (values (1, 'a'), (2, 'a'), (3, null), (4, '')) t(page_id, html)")
    rows = con.execute(sql).fetchall()
    want = {i: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for i, h in ((1, "a"), (2, "a"), (3, None), (4, ""))}
    assert {r[0]: r[2] for r in rows} == want


def test_schedule_keeps_weights_that_are_no_thousandths():
    """Over many periods, down to a source far below one slot in a thousand."""
    for weights in ([1 / 3, 2 / 3], [2**0.5, 3**0.5, 0.0004, 1.0]):
        blocks = [20_000] * len(weights)
        order = {}
        for s, phase, first, start, q, own in (table := mixing.schedule(weights, blocks)):
            last = min([x[2] for x in table if x[0] == s and x[1] > phase], default=blocks[s])
            order.update({start + (b - first) // len(own) * q + own[(b - first) % len(own)]: s for b in range(first, last)})
        slots = [order[t] for t in range(len(order))]
        until = min(max(t for t, s in order.items() if s == k) for k in range(len(weights)))
        total, exact, done = sum(map(Fraction, weights)), [Fraction(w) for w in weights], [0] * len(weights)
        for t, s in enumerate(slots[:until], 1):
            done[s] += 1
            if t % 97 == 0:
                assert all(abs(w * t / total - d) < 1 for w, d in zip(exact, done))


def test_mixture_takes_slots_from_the_schedule(spark, monkeypatch):
    """Irrational weights and blocks over several rows of the schedule's table, joined with and without a broadcast."""
    docs = spark.createDataFrame([(k, "x" * 50, "abc"[k % 7 % 3]) for k in range(900)], "doc_id long, text string, source string")
    for bound in (mixing.BROADCAST_ENTRIES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", bound)
        rows = mixing.mix(docs, block_bytes=100).collect()
        sizes = [50 * sum(r.source == s for r in rows) for s in "abc"]
        blocks = [max(1, -(-n // 100)) for n in sizes]
        want = {}
        for k, chunk, phase, first, slots in mixing.placements(mixing.schedule([n**0.5 for n in sizes], blocks), blocks):
            want.update({("abc"[k], first + j): (phase, slot) for j, slot in enumerate(slots)})
        assert len(rows) == 900 and len(want) == len({x[1] for x in want.values()}) == sum(blocks)
        assert all((r.phase, r.slot) == want[r.source, r.block] for r in rows)


def test_training_passes_over_a_row_that_does_not_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(compression_quality, "train", lambda texts, good, **how: seen.append(texts) or compression_quality.Model(b"", b"", 0.0, 0.0, 512, 3))
    ids = [r.doc_id for r in spark.range(12).toDF("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    text = {d: "y" * 30 for d in ids} | {ids[0]: "x" * 5000, ids[3]: "é" * 300}  # 300 characters, 600 bytes
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in ids], "doc_id long, quality int")
    compression_quality.train_from(docs, labels, sample_bytes=500)
    assert seen == [["y" * 30] * 10]


@pytest.mark.parametrize("limit", [600, 3000, 20_000])
def test_shards_are_those_of_extendible_hashing(spark, edge, limit):
    """Against splitting one bucket after the other."""
    docs = edge.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True).select("doc_id", "text")
    rows = sharding.shard(docs.withColumn("own", F.xxhash64("doc_id", "text")), limit).collect()
    want, todo = {}, [("", [(format(r.own % 2**64, "064b"), r.n_bytes) for r in rows])]
    while todo:
        name, bucket = todo.pop()
        if sum(n for _, n in bucket) <= limit or len(name) == 64:
            want |= {h: name for h, _ in bucket}
        else:
            todo += [(name + bit, [x for x in bucket if x[0][len(name)] == bit]) for bit in "01"]
    assert all(r.shard.split(".")[0] == want[format(r.own % 2**64, "064b")] and r.depth == len(r.shard.split(".")[0]) for r in rows)
    assert len(set(want.values())) > 5


def test_shards_are_written_to_folders_of_their_own(spark, edge, edge_rows):
    folder = new_folder(spark, "test")
    out = sharding.shard(edge.select("doc_id", "text"), 3000)
    sharding.write_shards(out, folder)
    back = spark.read.option("recursiveFileLookup", "false").schema(out.schema).parquet(folder)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((d, t) for d, t, *_ in edge_rows)
    assert back.withColumn("file", F.input_file_name()).select("shard", "file").distinct().groupBy("shard").count().where("count > 1").isEmpty()


def test_directory_beyond_the_broadcast_bound(spark, edge, monkeypatch):
    want = Counter((r.doc_id, r.shard) for r in sharding.shard(edge.where("doc_id < 15"), 3000).collect())
    monkeypatch.setattr(sharding, "BROADCAST_ENTRIES", 0)
    assert Counter((r.doc_id, r.shard) for r in sharding.shard(edge.where("doc_id < 15"), 3000).collect()) == want


def test_a_source_of_no_bytes_and_rows_behind_the_last_byte(spark):
    docs = spark.createDataFrame([(k, "x" * 100, "a") for k in range(20)] + [(k, "", "a") for k in range(20, 60)] + [(k, None, "b") for k in range(60, 64)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, block_bytes=100).collect()
    assert len(rows) == 64 and {r.block for r in rows if r.source == "a"} == set(range(20)) and {r.block for r in rows if r.source == "b"} == {0}
    assert sorted({r.slot for r in rows}) == list(range(21))


def test_columns_named_like_the_schedule_or_a_statistic_stay(spark):
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(k, f"{k} {text}", "s", "mine", 7.5, "own") for k in range(5)], "doc_id long, text string, source string, rank string, words double, n_words string")
    kept = rule_lists.keep(docs, [(rule_lists.Condition("words", True, 1000.0),)])
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
    mixed = mixing.mix(docs, prefix="_mix_")
    assert sorted(mixed.select(*docs.columns).collect()) == sorted(docs.collect()) and "_mix_slot" in mixed.columns


def test_classifier_moves_no_text_that_does_not_fit(spark):
    """A labelled text above the bound, and many copies of one row, leave the other rows to train on."""
    rng = np.random.default_rng(3)
    texts = {k: " ".join(rng.choice(["good", "plain", "words"] if k % 2 else ["###", "buy", "now!!"], 60)) for k in range(60)} | {60: "z" * 3_000_000}
    rows = [*texts.items(), *[(2, texts[2])] * 50]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, quality int")
    model = compression_quality.train_from(docs, labels, sample_bytes=1 << 20)
    assert model.good and model.bad
    right = [r.predicted == r.doc_id % 2 for r in compression_quality.score(docs.where("doc_id < 60"), model, 0.5).collect()]
    assert np.mean(right) > 0.95
