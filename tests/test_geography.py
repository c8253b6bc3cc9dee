"""The geography queries against their oracles, and hand-made cases of the operators."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from areaframe.functions import geometry as G
from areaframe.functions import text as T
from areaframe.operators import catalogue, cells, circle, contract, editions, hierarchy, lifecycle, lookup, overlay, review
from areaframe.plans import registry
from areaframe.schema import AREA, GEOMETRY
from areaframe.sources import fixtures, readers

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == normal(want.fetchall(), want.columns)
    else:
        assert got


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def box(x0, y0, x1, y1, part=0, hole=False):
    pts = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return (part, int(hole), [(float(x), float(y)) for x, y in (pts[::-1] if hole else pts)])


def shapes(spark, **rings):
    return spark.createDataFrame([(k, "assignment", v) for k, v in rings.items()], GEOMETRY)


def test_cover_holds_boundaries_and_leaves_out_holes(spark):
    g = shapes(spark, a=[box(0, 0, 10, 10), box(4, 4, 6, 6, hole=True), box(12, 0, 13, 1, part=1)], t=[(0, 0, [(20.0, 0.0), (24.0, 0.0), (22.0, 4.0), (20.0, 0.0)])])
    pts = [(1, 5.0, 5.0), (2, 4.0, 5.0), (3, 0.0, 0.0), (4, 10.0, 3.3), (5, 12.5, 0.5), (6, 11.0, 0.5), (7, 21.0, 2.0), (8, 20.9, 2.0), (9, float("nan"), 1.0), (10, None, 1.0), (11, 22.0, 4.0)]
    p = spark.createDataFrame(pts, "point_id int, x double, y double")
    want = {(2, "a"), (3, "a"), (4, "a"), (5, "a"), (7, "t"), (11, "t")}
    for size in (0.5, 2.0, 50.0):
        assert {(r["point_id"], r["area_id"]) for r in cells.covering(p, cells.polygon_cells(g, size), "point_id", size=size).collect()} == want
    assert {(r["point_id"], r["area_id"]) for r in cells.nested_loop(p.where("x IS NOT NULL AND NOT isnan(x)"), g, "point_id").collect()} == want


def areas(spark, *rows):
    full = [{**dict.fromkeys(AREA.fieldNames()), "lifecycle_status": "current", "layer": "administrative", "assignment_status": "validated_source", **r} for r in rows]
    return spark.createDataFrame(full, AREA)


def test_lookup_statuses(spark):
    a = areas(
        spark, {"id": "c", "level": "country"}, {"id": "m", "level": "municipality", "parent_id": "c"}, {"id": "n", "level": "municipality", "parent_id": "c"},
        {"id": "k", "level": "city_area", "scheme": "s1", "parent_id": "m"}, {"id": "l", "level": "city_area", "scheme": "s2", "parent_id": "m"}, {"id": "w", "level": "municipality", "parent_id": "c"},
    )
    g = shapes(spark, m=[box(0, 0, 10, 10)], n=[box(10, 0, 20, 10)], k=[box(0, 0, 11, 5)], l=[box(0, 0, 5, 5)])
    g = g.unionByName(spark.createDataFrame([("w", "candidate", [box(30, 0, 40, 10)])], GEOMETRY))
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 10.0, 7.0), (3, 10.5, 1.0), (4, 35.0, 5.0), (5, 50.0, 50.0), (6, 15.0, 7.0)], "point_id int, x double, y double")
    visible = a.where("level <> 'country'")
    got = {r["point_id"]: r for r in lookup.lookup(p, visible, g, hierarchy.ancestors(a)).collect()}
    assert (got[1]["status"], got[1]["matched"]) == ("matched", ["c", "k", "l", "m"])  # parallel schemes are not ambiguous
    assert got[2]["status"] == "ambiguous" and got[2]["direct"] == ["m", "n"]  # a shared edge gives both
    assert got[3]["status"] == "review_required" and got[3]["n_disagreements"] == 1  # in k, but not in its parent m
    assert got[4]["status"] == "review_required" and got[4]["direct"] == [] and got[4]["pending"] == ["w"]  # a candidate never assigns
    assert got[5]["status"] == "no_match" and got[6]["status"] == "matched"
    lost = lookup.lookup(p, visible.unionByName(areas(spark, {"id": "u", "level": "municipality"})), g, hierarchy.ancestors(a))
    assert {r["status"] for r in lost.collect()} == {"review_required"}  # unknown never becomes "no match"


@pytest.mark.parametrize(
    "a, b, common",
    [
        ([box(0, 0, 4, 4)], [box(2, 2, 6, 6)], 4.0),
        ([box(0, 0, 4, 4)], [box(4, 0, 8, 4)], 0.0),
        ([box(0, 0, 4, 4)], [box(0, 0, 4, 4)], 16.0),
        ([box(0, 0, 8, 8)], [box(2, 2, 4, 4)], 4.0),
        ([box(0, 0, 4, 4)], [box(0, 0, 2, 4)], 8.0),
        ([box(0, 0, 8, 8), box(2, 2, 6, 6, hole=True)], [box(3, 3, 10, 5)], 4.0),
        ([(0, 0, [(0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (2.0, 2.0), (2.0, 6.0), (0.0, 6.0), (0.0, 0.0)])], [box(1, 1, 5, 5)], 7.0),
        ([(0, 0, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)])], [box(0, 0, 2, 2)], 4.0),
    ],
)
def test_overlay_areas(spark, a, b, common):
    left, right = shapes(spark, a=a), shapes(spark, b=b)
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    r = overlay.overlay_areas(pairs, left, right).first()
    assert math.isclose(r["intersection"], common, abs_tol=1e-9)
    assert math.isclose(r["union_area"], r["area_a"] + r["area_b"] - common, abs_tol=1e-9)
    cross = "sum((px * qy - py * qx) / 2D)"
    parts = {how: overlay.boundary(pairs, left, right, how).selectExpr(cross).first()[0] or 0.0 for how in ("intersection", "union", "difference", "symmetric difference")}
    assert math.isclose(parts["difference"], r["outside_a"], abs_tol=1e-9)
    assert math.isclose(parts["symmetric difference"], r["outside_a"] + r["outside_b"], abs_tol=1e-9)


def test_projection(spark):
    x, y = G.lcc_sql("lon", "lat")
    u, v = G.unprojected_sql("x", "y")
    df = spark.createDataFrame([(-91.86666666666666, 63.390675), (-75.7, 45.4), (-130.0, 60.0)], "lon double, lat double").selectExpr("lon", "lat", f"{x} AS x", f"{y} AS y").selectExpr("*", f"{u} AS u", f"{v} AS v")
    rows = df.collect()
    assert math.isclose(rows[0]["x"], 6200000, abs_tol=1e-6) and math.isclose(rows[0]["y"], 3000000, abs_tol=1e-6)
    assert all(math.isclose(r["u"], r["lon"], abs_tol=1e-9) and math.isclose(r["v"], r["lat"], abs_tol=1e-9) for r in rows)


def test_geodesic_distance_and_circles(spark):
    d = circle.distance(np.array([0.0, 0.0]), np.array([0.0, 0.0]), np.array([1.0, 0.0]), np.array([0.0, 1.0]))
    assert np.allclose(d, [111319.4908, 110574.3886], atol=1e-3)
    g = shapes(spark, east=[box(1, -5, 2, 5)], far=[box(5, 5, 6, 6)], here=[box(-0.1, -0.1, 0.1, 0.1)])
    c = spark.createDataFrame([(1, 0.0, 0.0, 111319.0), (2, 0.0, 0.0, 111320.0), (3, 179.99, 0.0, 5000.0)], "circle_id int, x double, y double, radius_m double")
    got = {(r["circle_id"], r["area_id"]) for r in circle.circle_hits(c, g).collect()}
    assert got == {(1, "here"), (2, "here"), (2, "east")}  # the nearest point is no vertex
    boxes = circle.envelopes(c).where("circle_id = 3").orderBy("west").collect()
    assert len(boxes) == 2 and boxes[0]["west"] == -180 and boxes[1]["east"] == 180
    polar = circle.envelopes(spark.createDataFrame([(1, 10.0, 89.9, 50000.0)], c.schema)).first()
    assert (polar["west"], polar["east"], polar["north"]) == (-180, 180, 90)


def test_circle_reasons(spark):
    g = shapes(spark, a=[box(0, 0, 1, 1)]).unionByName(spark.createDataFrame([("a", "review", [box(0.9, 0, 1, 1)]), ("b", "bbox", [box(3, 0, 4, 1)])], GEOMETRY))
    munis = g.select("area_id").distinct()
    c = spark.createDataFrame([(1, 0.5, 0.5, 1000.0), (2, 0.95, 0.5, 1000.0), (3, 3.5, 0.5, 1000.0), (4, 9.0, 9.0, 1000.0), (5, 0.95, 0.5, 20000.0)], "circle_id int, x double, y double, radius_m double")
    got = {r["circle_id"]: r for r in circle.discover(c, munis, g, shapes(spark, a=[box(0, 0, 0.9, 1)])).collect()}
    assert got[1]["status"] == "complete" and got[1]["matches"] == ["a"] and got[4]["n_matches"] == 0
    assert got[2]["reasons"] == "boundary_disagreement:1" and got[3]["reasons"] == "municipal_geometry_unavailable:1"
    assert got[5]["matches"] == ["a"]  # it reaches what no dispute touches
    assert circle.page(circle.discover(c, munis, g), 0, 1).count() == 1


def test_hierarchy_faults(spark):
    a = areas(spark, {"id": "a", "parent_id": "b"}, {"id": "b", "parent_id": "a"}, {"id": "s", "parent_id": "s"}, {"id": "o", "parent_id": "none"}, {"id": "x", "parent_id": "old"}, {"id": "old", "lifecycle_status": "superseded"})
    assert {(r["id"], r["fault"]) for r in hierarchy.orphans(a).collect()} == {("s", "self_parent"), ("o", "missing_parent"), ("x", "superseded_parent")}
    assert {r["id"] for r in hierarchy.cycles(a).collect()} == {"a", "b", "s"}


def test_text_functions(spark):
    df = spark.createDataFrame([("Crème Brûlée ﬁn", "12.0", "7"), (None, "x1", "12345678")], "a string, b string, c string")
    r = df.select(T.fold_text("a"), T.slug(F.col("a")), T.stable_string(F.col("b")), T.code(F.col("c"), 7, "n")).collect()
    assert r[0][0] == "creme brulee fin" and r[0][2] == "12" and r[0][3] == "n0000007" and r[1][0] is None and r[1][2] == "x1" and r[1][3] == "n12345678"
    d = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("2024-2-9",), (None,)], "d string").select(T.is_date(F.col("d"))).collect()
    assert [x[0] for x in d] == [False, True, False, False]


def test_geojson_round_trip(spark):
    g = shapes(spark, a=[box(0, 0, 10, 10), box(4, 4, 6, 6, hole=True), box(12, 0, 13, 1, part=1)])
    back = g.withColumn("j", G.to_geojson("rings")).withColumn("r", G.from_geojson("j"))
    r = back.first()
    assert r["r"] == r["rings"]
    assert back.select(G.fingerprint("r") == G.fingerprint("rings")).first()[0]


def test_geometry_issues(spark):
    nan = float("nan")
    g = shapes(spark, ok=[box(0, 0, 1, 1)], open=[(0, 0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], short=[(0, 0, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])], nan=[(0, 0, [(0.0, 0.0), (nan, 0.0), (1.0, 1.0), (0.0, 0.0)])], none=None)
    got = {r["area_id"]: r["i"] for r in g.select("area_id", G.issue("rings").alias("i")).collect()}
    assert got == {"ok": None, "open": "open_ring", "short": "short_ring", "nan": "not_finite", "none": "missing"}


def test_retraced_and_small_parts(spark):
    spike = [(0, 0, [(0.0, 0.0), (4.0, 0.0), (6.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)])]
    assert review.retraced(shapes(spark, a=spike, b=[box(0, 0, 1, 1)])).count() == 1
    kept = shapes(spark, a=[box(0, 0, 4, 4), box(1, 1, 1.1, 1.1, hole=True), box(9, 9, 9.1, 9.1, part=1)]).select(G.without_small("rings", 0.5).alias("r")).first()["r"]
    assert len(kept) == 1


def test_review_decisions(spark):
    rows = [("a", 0.5, 1e-8, 1e9, 1.0, 99.0, False), ("b", 5.0, 1e-3, 99.0, 1e-5, 4.9, False), ("c", 5.0, 1e-3, 101.0, 1e-5, 4.9, False), ("d", 5.0, 1e-3, 5999.0, 1e-5, 4.9, True), ("e", None, None, None, None, None, False)]
    df = spark.createDataFrame(rows, "id string, overlap_m2 double, overlap_share double, changed_m2 double, changed_share double, shift_m double, proven boolean")
    got = {r["id"]: (r["decision"], len(r["reasons"])) for r in review.decide(df).collect()}
    assert got == {"a": ("topology_only", 0), "b": ("minor_correction", 0), "c": ("keep_review", 1), "d": ("minor_correction", 0), "e": ("keep_review", 3)}


def test_lifecycle(spark):
    a = areas(spark, {"id": "a", "name": "Old", "aliases": ["First"]}, {"id": "b", "name": "B"})
    r = {x["id"]: x for x in lifecycle.rename(a, spark.createDataFrame([("a", "New")], "id string, new_name string")).collect()}
    assert r["a"]["name"] == "New" and r["a"]["aliases"] == ["First", "Old"] and r["b"]["name"] == "B"
    rev = spark.createDataFrame([("a", 1, "metadata", "X"), ("a", 2, "retire", None), ("n", 1, "new", "N")], "id string, seq int, operation string, name string")
    out = {x["id"]: (x["name"], x["lifecycle_status"]) for x in lifecycle.apply_revisions(a, rev).collect()}
    assert out == {"a": ("X", "superseded"), "b": ("B", "current"), "n": ("N", "current")}
    members = spark.createDataFrame([("1", "g"), ("2", "g")], "area_id string, region_id string")
    now, touched = lifecycle.move_members(members, spark.createDataFrame([("2", "h")], members.schema))
    assert {(x[0], x[1]) for x in now.collect()} == {("1", "g"), ("2", "h")} and {x[0] for x in touched.collect()} == {"g", "h"}


def test_succession_is_deferred_below_the_threshold(spark):
    old = spark.createDataFrame([("s", "a", [box(0, 0, 5, 10)]), ("s", "b", [box(5, 0, 10, 10)])], "successor_id string, area_id string, rings " + GEOMETRY["rings"].dataType.simpleString())
    for x1, deferred in ((8.0, False), (7.9, True)):
        got = lifecycle.succeed(old, shapes(spark, s=[box(0, 0, x1, 10)])).first()
        assert (len(got["rings"]), got["area"], got["deferred"]) == (1, 100.0, deferred)


def test_editions(spark):
    e = spark.createDataFrame([("e1", "federal", True), ("e2", "federal", False)], 'id string, layer string, default boolean')
    assert editions.selected(e, "federal") == ["e1"] and editions.selected(e, "federal", ["e2"]) == ["e2"]
    with pytest.raises(ValueError):
        editions.selected(e, "federal", ["e3"])
    rows = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, {"a": "x", "b": "n"})], "row_id int, props map<string, string>")
    rules = spark.createDataFrame([("e", "a", ["x"]), ("e", "b", ["y", "z"])], "edition string, field string, values array<string>")
    assert [r["row_id"] for r in editions.rule_rows(rows, rules).collect()] == [1]


def test_contract_violations(spark):
    df = spark.createDataFrame([("3506008", "3506", "35", "Ottawa"), ("35x", "3506", "24", " ")], "csd string, cd string, pr string, name string")
    bad = contract.source_record_violations(df).collect()
    assert len(bad) == 1 and bad[0]["violations"] == ["municipality_id", "division_prefix", "province_prefix", "label"]


def test_sources(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"code":"1","name":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{"code":"2","name":"Z"},"geometry":null}]}')
    rows = readers.feature_collection(spark, str(tmp_path / "f.json"))
    pins = spark.createDataFrame([("1", {"name": "A"}), ("2", {"name": "B"}), ("3", {})], "id string, props map<string, string>")
    got = {(r["id"], r["fault"]) for r in readers.checked_source(rows, pins, "code", 3).collect()}
    assert got == {("3", "missing"), ("2", "properties"), ("2", "geometry:missing"), (None, "count:2")}
    (tmp_path / "c.csv").write_text("REF_DATE,GEO,DGUID,Coordinate,Population,Symbols\n2021,x,2021A00051001101,1,197,\n2021,x,2021A00051001102,1,,x\n2021,x,2021A000211,1,5,\n")
    c = {r["code"]: (r["value"], r["reason"]) for r in readers.census(spark, str(tmp_path / "c.csv")).collect()}
    assert c == {"1001101": (197, None), "1001102": (None, "suppressed")}
    a = areas(spark, {"id": "p-1", "level": "province", "name": "P", "province_id": "p-1"})
    readers.export_release(a, shapes(spark, **{"p-1": [box(0, 0, 1, 1)]}), str(tmp_path / "rel"))
    assert spark.read.parquet(str(tmp_path / "rel/area")).count() == 1 and '"MultiPolygon"' in spark.read.text(str(tmp_path / "rel/display")).first()["value"]
    with pytest.raises(Exception, match="already exists"):
        readers.export_release(a, shapes(spark), str(tmp_path / "rel"))


def test_group_plans_and_bundles(spark):
    g = spark.createDataFrame([("g1", ["1", "2"]), ("g2", ["2", "3"]), ("g3", ["5", "4"])], "group_id string, municipality_ids array<string>")
    assert {(r[0], r[1]) for r in catalogue.group_plan_faults(g).collect()} == {("g1", "shared_member"), ("g2", "shared_member"), ("g3", "not_sorted_unique")}


@needs_data
def test_cell_join_equals_nested_loop(spark):
    p = fixtures.points(spark, SF)
    g = fixtures.municipal_geometry(fixtures.municipalities(spark, SF))
    a, b = cells.covering(p, cells.polygon_cells(g), "point_id"), cells.nested_loop(p, g, "point_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
