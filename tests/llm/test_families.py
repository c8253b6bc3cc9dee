"""Families of unlinked copies: every row of a bucket meets its pivot once, however many copies share the keys."""

from areaframe.llm import minhash


def _rows(spark, copies, keys):
    rows = [(k, node, 1000 - node) for node in range(copies) for k in range(keys) if (node + k) % 7]
    rows += [(10_000 + node, node, 5) for node in range(0, copies, 3)] + [(10_000 + node, 5000 + node, 4) for node in range(0, copies, 3)]
    return spark.createDataFrame(rows, "key bigint, node bigint, company bigint"), rows


def test_classes_of_a_bucket_meet_and_families_do_not_chain(spark):
    df, rows = _rows(spark, 60, 12)
    roots = {node: node // 2 for _, node, _ in rows}
    group = spark.createDataFrame(list(roots.items()), "node bigint, root bigint")
    out = minhash._families(df, group).collect()
    assert all(r.root == roots[r.node] for r in out)
    members, keys = {}, {}
    for r in out:
        members.setdefault(r.family, set()).add(r.node)
    for k, node, _ in rows:
        keys.setdefault(k, set()).add(node)
    for nodes in keys.values():
        if len({roots[x] for x in nodes}) > 1:
            assert any(nodes <= m for m in members.values())
    for hub, nodes in members.items():
        assert all(any({hub, x} <= own for own in keys.values()) for x in nodes)


def test_rows_of_a_bucket_meet_by_key_once(spark, monkeypatch):
    df, rows = _rows(spark, 40, 10)
    group = spark.createDataFrame([(0, 0)], "node bigint, root bigint")
    plans = []
    write = minhash.write_table
    monkeypatch.setattr(minhash, "write_table", lambda t, name: (plans.append(t._jdf.queryExecution().sparkPlan().toString()), write(t, name))[1])
    minhash._families(df, group)
    by_key = [line for p in plans for line in p.splitlines() if "Join [key#" in line and "Inner" in line]
    assert len(by_key) == 1
