import hashlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import jaccard_join, mixing, packing, rule_lists, suffix_dedup
from test_near_copies import brute_components, brute_spans

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, SF).persist()
    rules = rule_lists.learn_from(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rule_lists.apply_rules(docs, rules).where("kept").collect()}

    one = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, kept, SF).persist()
    rows = [(r.doc_id, r.text) for r in kept.orderBy("doc_id").collect()]
    _, labels = brute_components(rows, jaccard_join.Likeness(5, 80))
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(set(labels))

    cut = dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, one, SF).persist()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    want = {x[0]: x[4] for x in brute_spans(rows, corpus_pipeline.PASSAGE_BYTES)}
    assert cut.columns == columns and cut.count() == len(rows)
    same = [hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] for r in cut.collect()]
    assert sum(same) >= 0.98 * len(same)  # else a character was cut in two
    assert suffix_dedup.spans(one, corpus_pipeline.PASSAGE_BYTES).where("n_removed > 0").count() > 0

    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, cut, SF)
    assert mixed.columns == columns and Counter(map(tuple, mixed.collect())) == Counter(map(tuple, cut.collect()))


def test_run_gives_pieces(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())


def test_stages_are_four_or_five():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_prefixes_of_sequences_follow_the_mixture(spark, monkeypatch):
    """One dominant source, weights by square root; blocks and groups so small that there are many ranges."""
    rows = [(k, " ".join(f"w{k * 7 + j}" for j in range(20 + k % 60)), "a" if k % 10 else "b") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plain_mix, plain_pack = mixing.mix, packing.pack
    monkeypatch.setattr(mixing, "mix", lambda d, **how: plain_mix(d, block_bytes=2000, **how))
    monkeypatch.setattr(packing, "pack", lambda *x, **how: plain_pack(*x, **how, group_rows=150))
    stages = dict(corpus_pipeline.STAGES)
    pieces = stages["packing"](spark, stages["mixing"](spark, docs, SF), SF).collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    size, source = {d: len(t) for d, t, _ in rows}, {d: s for d, _, s in rows}
    total = {s: sum(size[d] for d in size if source[d] == s) for s in "ab"}
    share = total["b"] ** 0.5 / (total["a"] ** 0.5 + total["b"] ** 0.5)
    done, at = Counter(), 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        done[source[p.doc_id]] += p.length
        tokens = done["a"] + done["b"]
        if done["b"] < 0.9 * sum(p.length for p in pieces if source[p.doc_id] == "b") and tokens > 15000:
            assert abs(done["b"] / tokens - share) < 0.08
            at += 1
    assert at > 100


def test_stages_of_edge_cases_and_clashing_names(spark, edge, empty):
    """Null, empty, very long and repeated texts; columns named like those that operators add keep their values."""
    docs = edge.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("words", "rank", "n_bytes", "block", "n_words", "kept", "component_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = {(r.doc_id, r.text): r for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        changed = {"text", "n_chars"} if name == "suffix_dedup" else set()
        for r in out.collect():
            if not changed:
                assert r == rows[r.doc_id, r.text]
            else:
                assert r.words == (None if r.doc_id is None else f"words{r.doc_id}")
        docs = out
    assert corpus_pipeline.packed(spark, docs, SF).count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
