"""Closures and groups: longer pairs are made once, and more rows get more tasks instead of larger ones."""

from areaframe.operators import hierarchy, release
from areaframe.sources import workspace


def test_longer_pairs_are_made_once(spark):
    n = 64
    pairs = spark.createDataFrame([(f"x{i:02}", f"x{j:02}", j - i) for i in range(n) for j in range(i + 1, min(n, i + 9))], "id string, ancestor_id string, depth int")
    seen = []
    least = hierarchy._least
    hierarchy._least = lambda df: (seen.append(df.count()), least(df))[1]
    try:
        out = hierarchy._twice(pairs, pairs.where("depth = 8"))
    finally:
        hierarchy._least = least
    want = {(f"x{i:02}", f"x{j:02}", j - i) for i in range(n) for j in range(i + 1, min(n, i + 17))}
    assert {tuple(r) for r in out.collect()} == want
    assert seen == [len(want)]


def test_closure_of_cycles_and_several_parents(spark):
    edges = [(f"c{i}", f"c{(i + 1) % 11}") for i in range(11)] + [("a", "b"), ("b", "c"), ("a", "c"), ("c", "c0"), ("s", "s"), ("z", None)]
    found = {(r.id, r.ancestor_id): r.depth for r in hierarchy.ancestors(spark.createDataFrame(edges, "id string, parent_id string")).collect()}
    up, want = {}, {}
    for x, y in edges:
        if y:
            up.setdefault(x, set()).add(y)
    for x in up:
        step, depth = up[x], 1
        while step:
            new = {y for y in step if (x, y) not in want}
            want |= {(x, y): depth for y in new}
            step, depth = set().union(*(up.get(y, set()) for y in new)) if new else set(), depth + 1
    assert found == want


def test_groups_are_compared_row_by_row_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(workspace, "TASK_ROWS", 50)
    rows = [(g, i) for g in range(100) for i in range(10)]
    e = spark.createDataFrame([*rows, (200, 1), (200, 1), (300, None), (400, 5)], "group_id bigint, id bigint")
    u = spark.createDataFrame([(7, 3, -3), (8, 4, -4)], "group_id bigint, previous_id bigint, current_id bigint")
    r = spark.createDataFrame([*(x for x in rows if x not in [(8, 4), (9, 9)]), (8, -4), (200, 1), (300, None), (400, 5), (400, 5)], "group_id bigint, id bigint")
    out = release.reproduced_groups(e, u, r)
    assert sorted(map(tuple, out.collect())) == [(7, "not_extracted"), (7, "not_reviewed"), (9, "not_reviewed"), (200, "not_reviewed"), (400, "not_extracted")]
    assert "hashpartitioning(group_id#" in out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() >= 20
