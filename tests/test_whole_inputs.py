"""Registered queries against brute force on inputs beyond the smallest tables."""

from collections import defaultdict

from scriptorium.plans.queries import QUERIES


def test_success_paths_of_all_events(spark, tmp_path):
    rows = [(k, (k * 7) % 11 if k < 3000 else 11 + k % 3, "abc"[k % 5 % 3]) for k in range(1500, 4000, 3 * 7 + 1)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    marks = defaultdict(list)
    for e, u, t in sorted(rows):
        marks[u].append(f"fulltext:{t}_{('ok', 'fail', 'odd')[e % 3]}")
    want = {u: (" -> ".join(m for m in own if m.endswith("_ok")) or None, len({m for m in own if not m.endswith("_odd")})) for u, own in marks.items()}
    assert {r.user_id: (r.path, r.marks) for r in QUERIES["success_paths"](spark, str(tmp_path)).collect()} == want
