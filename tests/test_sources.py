"""Inputs with contracts, conformance checks and streams on small made cases."""

import hashlib

from pyspark.sql import functions as F

from areaframe.operators import catalogue, conformance, contract, population, review
from areaframe.schema import GEOMETRY
from areaframe.sources import readers
from areaframe.streaming import lookup as stream
from tests.test_geography import areas, box, shapes


def test_transfers_skip_preamble_and_keep_unknown_counts(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Interim list,,,,\nGaining,Losing,Count,Date,File Number\n1,2,15,2021-01-01,24-001\n3,4,1.5,2021-01-01,24-002\n5,6,20.0,2021-01-01,24-003\n")
    got = {r["gain_id"]: r["n"] for r in readers.transfers(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {"1": 15, "3": None, "5": 20}


def test_unknown_population_is_never_zero(spark):
    a = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "area_id string")
    f = spark.createDataFrame([("a", 10, None, True), ("b", None, "suppressed", True), ("c", 5, None, True)], "area_id string, value bigint, reason string, matched boolean")
    t = spark.createDataFrame([("a", "c", 3), ("c", "b", None)], "gain_id string, loss_id string, n bigint")
    got = {r["area_id"]: (r["population"], r["reason"]) for r in population.adjusted(a, f, t).collect()}
    assert got == {"a": (13, None), "b": (None, "suppressed"), "c": (None, "transfer_not_available"), "d": (None, "unmatched")}


def test_snapshot_and_name_faults(spark):
    pages = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "x")], "page int, id string")
    before, after = (spark.createDataFrame([(i,) for i in ids], "id string") for ids in (["a", "b", "c"], ["a", "b", "d"]))
    got = {(r["id"], r["fault"]) for r in readers.snapshot_faults(pages, before, after).collect()}
    assert got == {("b", "duplicate"), ("x", "unexpected"), ("c", "missing"), ("c", "drift"), ("d", "drift")}
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert {r["name"] for r in readers.named_join_faults(names("a", "b", "b", "c"), names("a", "b", "b", "d")).collect()} == {"b", "c", "d"}


def test_release_files(spark, tmp_path):
    root = tmp_path / "release"
    root.mkdir()
    for n, body in (("a.txt", b"one"), ("b.txt", b"two"), ("d.txt", b"new")):
        (root / n).write_bytes(body)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("a.txt", 3, sha(b"one")), ("b.txt", 3, sha(b"TWO")), ("c.txt", 1, sha(b"x"))], "name string, bytes bigint, sha256 string")
    got = {(r["name"], r["fault"]) for r in readers.release_faults(spark, str(root), manifest).collect()}
    assert got == {("b.txt", "content"), ("c.txt", "missing"), ("d.txt", "unexpected")}


def test_inventory_faults(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"id":"1","kind":"province","names":["A"]}\n{"id":"2","names":["B"]}\n{"id":"3","kind":"x","names":[]}\n')
    got = {r["foreign_id"]: r["fault"] for r in readers.inventory(spark, str(tmp_path / "i.json")).collect()}
    assert got == {"1": None, "2": "kind", "3": "names"}


def test_boundaries_holes_and_corridors(spark):
    a = shapes(spark, x=[box(0, 0, 9, 9), box(3, 3, 6, 6, hole=True)], y=[box(0, 0, 1, 1)])
    b = shapes(spark, x=[box(3, 3, 6, 6, hole=True), box(0, 0, 9, 9)], y=[box(0, 0, 1, 2)])
    assert {r["area_id"]: r["same"] for r in conformance.same_boundary(a, b).collect()} == {"x": True, "y": False}
    assert conformance.holes_matched(a, shapes(spark, e=[box(3, 3, 6, 6)])).first()["matched"]
    assert not conformance.holes_matched(a, shapes(spark, e=[box(3, 3, 6, 7)])).first()["matched"]
    d = {r["area_id"]: r["distance"] for r in conformance.corridor_distance(shapes(spark, x=[box(0, 0, 9, 10)], y=[box(0, 0, 1, 1)]), a, 4.0).collect()}
    assert d == {"x": 1.0, "y": 0.0}


def test_layer_qualification(spark):
    rows = [("a", 100.0, 0.5, 0.0, 0.95), ("b", 100.0, 5.0, 0.0, 0.95), ("c", 100.0, 11.0, 0.0, 0.95), ("d", 100.0, 0.0, 1.5, 0.95), ("e", 100.0, 0.0, 0.0, 0.5), ("f", 0.0, 0.0, 0.0, 1.0)]
    m = spark.createDataFrame(rows, "area_id string, area double, outside double, overlap double, covered_share double")
    got = {r["area_id"]: r["status"] for r in conformance.qualify_layer(m).collect()}
    assert got == {"a": "validated_source", "b": "unreviewed_parent", "c": "rejected", "d": "unreviewed_overlap", "e": "display_reference", "f": "rejected"}


def test_municipal_escalation(spark):
    result = spark.createDataFrame([(i, "matched") for i in range(5)], "point_id int, status string")
    located = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (4, "none")], "point_id int, area_id string")
    cover = spark.createDataFrame([("a", "included"), ("b", "reference"), ("c", "partial")], "area_id string, status string")
    raised = lambda explicit: [r["status"] == "review_required" for r in conformance.escalate_municipal(result, located, cover, explicit).orderBy("point_id").collect()]
    assert raised(False) == [False, True, True, True, True] and raised(True) == [False, False, True, False, True]


def test_bundles(spark):
    members = spark.createDataFrame([("b1", "x"), ("b2", "x"), ("b3", "y")], "bundle_id string, area_id string")
    docs = conformance.bundle_documents(members, shapes(spark, x=[box(0, 0, 1, 1)], y=[box(0, 0, 2, 1)]), limit_bytes=10)
    assert {r["status"] for r in docs.collect()} == {"too_large"}
    assert sorted(r["bundles"] for r in conformance.artefacts(docs.select("bundle_id", "body")).collect()) == [["b1", "b2"], ["b3"]]
    b = spark.createDataFrame([("b", "r", None), ("b", "k", "r"), ("b", "z", "gone")], "bundle_id string, id string, parent_id string")
    assert [r["id"] for r in conformance.bundle_faults(b, spark.createDataFrame([("b", "r")], "bundle_id string, root_id string")).collect()] == ["z"]


def test_evidence_and_succession(spark):
    docs = spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "c": null}'), (2, "not json")], "doc_id int, json string")
    got = {(r["path"], r["value"]) for r in catalogue.evidence_nodes(docs).where("doc_id = 1").collect()}
    assert {("$.a.b[0]", "1"), ("$.a.b[1]", "x"), ("$.a", None)} <= got
    s = spark.createDataFrame([("n", ["o"], None), ("o", None, ["n"]), ("p", None, ["n"])], "id string, predecessor_ids array<string>, successor_ids array<string>")
    assert [(r["old"], r["fault"]) for r in contract.asymmetric_succession(s).collect()] == [("p", "successor_only")]


def test_review_joint_decisions_and_probes(spark):
    d = spark.createDataFrame([("a", 1, "minor_correction"), ("b", 1, "keep_review"), ("c", 2, "topology_only")], "id string, group int, decision string")
    joint = review.joint(d)
    assert {r["id"]: r["approved"] for r in joint.collect()} == {"a": False, "b": False, "c": True}
    out = review.apply_review(areas(spark, {"id": "c", "assignment_status": "unreviewed_repair", "issues": ["x"]}), joint).first()
    assert out["assignment_status"] == "validated_source" and out["issues"] == []
    p = lambda *x: spark.createDataFrame(list(x), "point_id int, direct array<string>")
    assert review.changed_answers(p((1, ["a"]), (2, ["b"])), p((1, ["a"]), (2, []))).count() == 1


def test_stream_drops_late_points(spark, tmp_path):
    from areaframe.operators.cells import polygon_cells

    cells = polygon_cells(spark.createDataFrame([("a", "assignment", [box(0, 0, 1, 1)])], GEOMETRY))
    rows = lambda *ts: spark.createDataFrame([(i, t, 0.5, 0.5) for i, t in enumerate(ts)], "point_id int, ts string, x double, y double").withColumn("ts", F.to_timestamp("ts"))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in (rows("2024-01-01 00:10:00", "2024-01-01 00:20:00"), rows("2024-01-01 03:00:00"), rows("2024-01-01 00:30:00", "2024-01-01 06:00:00"), rows("2024-01-01 09:00:00")):
        batch.coalesce(1).write.mode("append").parquet(source)
        points = spark.readStream.schema(batch.schema).parquet(source)
        stream.run_available(stream.window_counts(stream.stream_lookup(points, cells)), out, state)
    got = {(str(r["window_start"]), r["n"]) for r in spark.read.parquet(out).collect()}
    assert ("2024-01-01 00:00:00", 2) in got  # the point of 00:30 came after the watermark
