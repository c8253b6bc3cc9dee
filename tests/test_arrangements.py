"""Arrangements, rings, validity, coverage and revisions against grids, closed forms and hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaframe.functions import geometry as G
from areaframe.operators import arrangement as A
from areaframe.operators import circle, hierarchy, lifecycle, overlay, release, validity
from areaframe.schema import GEOMETRY
from tests.test_geography import areas, box, shapes

RINGS = GEOMETRY["rings"].dataType.simpleString()


def ring(points, part=0, number=0):
    return (part, number, [(float(x), float(y)) for x, y in [*points, points[0]]])


def area(rings):
    return sum(sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(r["pts"], r["pts"][1:], strict=False)) / 2 for r in rings)


@pytest.fixture(scope="module")
def grids():
    """Groups of boxes on whole numbers, with a grid of how many cover each square: shared edges, corners that touch, holes that enclose others."""
    r, rows, counts = random.Random(3), [], {}
    for g in range(30):
        grid = np.zeros((16, 16), int)
        for _ in range(r.randint(1, 9)):
            x0, y0 = r.randint(0, 14), r.randint(0, 14)
            x1, y1 = r.randint(x0 + 1, min(16, x0 + 5)), r.randint(y0 + 1, min(16, y0 + 5))
            grid[x0:x1, y0:y1] += 1
            rows.append((g, [box(x0, y0, x1, y1)]))
        counts[g] = grid
    return rows, counts


def test_depths_equal_a_grid(spark, grids):
    rows, counts = grids
    arcs = A.arranged(A.shape_edges(spark.createDataFrame(rows, f"g int, rings {RINGS}"), ["g"], "A"), ["g"])
    got = {r["g"]: (r["u"], r["m"]) for r in arcs.groupBy("g").agg(A.region_area("a").alias("u"), A.region_area("repeated").alias("m")).collect()}
    assert got == {g: ((c > 0).sum(), (c > 1).sum()) for g, c in counts.items()}


def test_united_rings_equal_a_grid_and_are_simple(spark, grids):
    rows, counts = grids
    got = {r["g"]: r["rings"] for r in overlay.united(spark.createDataFrame(rows, f"g int, rings {RINGS}"), "g").collect()}
    for g, c in counts.items():
        assert math.isclose(area(got[g]), (c > 0).sum(), abs_tol=1e-9)
        for r in got[g]:
            points = [(p["x"], p["y"]) for p in r["pts"]]
            assert points[0] == points[-1] and len(set(points)) == len(points) - 1  # no ring passes a point twice
            assert (area([r]) > 0) == (r["ring"] == 0)
    # whole rings are valid input again
    again = spark.createDataFrame([(str(g), rs) for g, rs in got.items()], f"area_id string, rings {RINGS}")
    assert validity.faults(again).count() == 0


def test_overlay_of_crossing_shapes_equals_sampling(spark):
    def star(cx, n, r0, r1, seed):
        q = random.Random(seed)
        return [(cx + (v := q.uniform(r0, r1)) * math.cos(a), v * math.sin(a)) for a in sorted(q.random() * 2 * math.pi for _ in range(n))]

    def inside(p, x, y):
        out = np.zeros(len(x), bool)
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
            if ay != by:
                out ^= ((ay > y) != (by > y)) & (ax + (bx - ax) * (y - ay) / (by - ay) > x)
        return out

    x, y = (v.ravel() for v in np.meshgrid(np.linspace(-3, 3, 700) + 7e-4, np.linspace(-3, 3, 700) + 3e-4))
    stars = {i: (star(0, n, 0.5, 2.5, i), star(0.5, m, 0.5, 2.0, 50 + i)) for i, (n, m) in enumerate([(14, 14), (30, 16), (200, 40), (40, 300)])}
    left, right = ({f"{s}{i}": [ring(p[k])] for i, p in stars.items()} for k, s in enumerate("ab"))
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in stars], "a string, b string")
    ldf, rdf = shapes(spark, **left), shapes(spark, **right)
    sums = {r["a"]: r for r in overlay.overlay_areas(pairs, ldf, rdf).collect()}
    whole = {how: {r["a"]: area(r["rings"]) for r in overlay.shapes(pairs, ldf, rdf, how).collect()} for how in ("intersection", "difference", "union")}
    for i, (p, q) in stars.items():
        a, b = inside(p, x, y), inside(q, x, y)
        r = sums[f"a{i}"]
        assert abs(r["intersection"] - (a & b).mean() * 36) < 0.05 and abs(r["union_area"] - (a | b).mean() * 36) < 0.05
        assert math.isclose(r["area_a"] + r["area_b"], r["intersection"] + r["union_area"], abs_tol=1e-9)
        assert math.isclose(whole["intersection"][f"a{i}"], r["intersection"], abs_tol=1e-9) and math.isclose(whole["union"][f"a{i}"], r["union_area"], abs_tol=1e-9)
        assert math.isclose(whole["difference"][f"a{i}"], r["outside_a"], abs_tol=1e-9)


def test_nearly_equal_borders_leave_no_stray_area(spark):
    e = 1e-14
    left = shapes(spark, a=[box(-71.06666666666666, 58, -68.9 + e, 66)], c=[box(0, 0, 1 / 3, 1)])
    right = shapes(spark, b=[box(-70.2, 50, -68.9, 58)], d=[box(1 / 3 + e, 0, 1, 1)])
    got = overlay.overlay_areas(spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string"), left, right).collect()
    assert all(abs(r["intersection"]) < 1e-9 for r in got)


def test_rings_that_touch(spark):
    cases = {
        "corner": [box(0, 0, 1, 1), box(1, 1, 2, 2, part=1)],
        "hole": [box(0, 0, 4, 4), ring([(0, 1), (1, 2), (2, 1), (1, 0.5)], 0, 1)],
        "island": [box(0, 0, 9, 9), box(1, 1, 8, 8, hole=True), box(2, 2, 7, 7, part=1), box(3, 3, 6, 6, part=1, hole=True)],
        "chain": [box(0, 0, 6, 6), ring([(0, 3), (2, 4), (3, 3), (2, 2)], 0, 1), ring([(3, 3), (4, 4), (5, 3), (4, 2)], 0, 2)],
    }
    got = {r["area_id"]: r["rings"] for r in overlay.united(shapes(spark, **cases).select("area_id", "rings"), "area_id").collect()}
    parts = {k: sorted((r["part"], r["ring"] > 0) for r in v) for k, v in got.items()}
    assert parts == {"corner": [(0, False), (1, False)], "hole": [(0, False), (0, True)], "island": [(0, False), (0, True), (1, False), (1, True)], "chain": [(0, False), (0, True), (0, True)]}
    assert {k: round(area(v), 9) for k, v in got.items()} == {"corner": 2.0, "hole": 14.5, "island": 48.0, "chain": 31.0}


def test_validity(spark):
    spike = ring([(0, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 4)])
    cases = {
        "sound": [box(0, 0, 9, 9), box(1, 1, 2, 2, hole=True)],
        "turned": [(0, 0, box(0, 0, 9, 9)[2][::-1]), (0, 1, box(1, 1, 2, 2, hole=True)[2][::-1])],
        "touching": [box(0, 0, 4, 4), ring([(0, 1), (1, 2), (2, 1)], 0, 1)],
        "nested_in_hole": [box(0, 0, 9, 9), box(1, 1, 8, 8, hole=True), box(2, 2, 3, 3, part=1)],
        "bowtie": [ring([(0, 0), (2, 2), (2, 0), (0, 2)])], "bowtie_hole": [box(-5, -5, 5, 5), ring([(0, 0), (2, 2), (2, 0), (0, 2)], 0, 1)],
        "nested": [box(0, 0, 9, 9), box(2, 2, 3, 3, part=1)], "twice": [box(0, 0, 2, 2), box(0, 0, 2, 2, part=1)], "outside": [box(0, 0, 2, 2), box(5, 5, 6, 6, hole=True)],
        "hole_of_other": [box(0, 0, 9, 9), box(20, 0, 29, 9, part=1), box(2, 2, 3, 3, hole=True, part=1)],
        "spike": [spike], "shared": [box(0, 0, 1, 1), box(1, 0, 2, 1, part=1)], "eight": [ring([(0, 0), (1, 1), (2, 0), (2, 2), (1, 1), (0, 2)])], "holes": [box(0, 0, 9, 9), box(1, 1, 4, 4, hole=True), ring([(3, 3), (3, 6), (6, 6), (6, 3)], 0, 2)],
        "open": [(0, 0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "none": None,
    }
    got = {r["area_id"]: r["fault"] for r in validity.faults(shapes(spark, **cases)).collect()}
    assert got == {
        "bowtie": "crossing", "bowtie_hole": "crossing_holes", "nested": "nested_parts", "twice": "overlapping_edges", "outside": "hole_outside", "hole_of_other": "hole_outside",
        "spike": "overlapping_edges", "shared": "overlapping_edges", "eight": "touching_itself", "holes": "crossing_holes", "open": "open_ring", "none": "missing",
    }


def test_an_overlap_does_not_make_up_for_a_gap(spark):
    rows = [("a", "p", "t", [box(0, 0, 6, 1)]), ("b", "p", "t", [box(5, 0, 9, 1)]), ("c", "q", "t", [box(0, 0, 6, 1)]), ("d", "q", "t", [box(6, 0, 10, 1)])]
    kids = spark.createDataFrame(rows, f"area_id string, parent_id string, track string, rings {RINGS}")
    cover = {r["parent_id"]: r.asDict() for r in lifecycle.child_coverage(kids, shapes(spark, p=[box(0, 0, 10, 1)], q=[box(0, 0, 10, 1)])).collect()}
    assert cover["p"] == {"parent_id": "p", "track": "t", "covered": 9.0, "outside": 0.0, "uncovered": 1.0, "repeated": 1.0}
    approved = {r["parent_id"]: r["approved"] for r in release.child_union(lifecycle.child_coverage(kids, shapes(spark, p=[box(0, 0, 10, 1)], q=[box(0, 0, 10, 1)]))).collect()}
    assert approved == {"p": False, "q": True}


def test_proofs_ignore_vertices_and_see_areas(spark):
    old = spark.createDataFrame([("s", [box(0, 0, 5, 10)]), ("s", [box(5, 0, 10, 10)]), ("t", [box(0, 0, 1, 1)])], f"successor_id string, rings {RINGS}")
    dense = ring([(0, 0), (3, 0), (7, 0), (10, 0), (10, 4), (10, 10), (0, 10), (0, 2)])
    got = {r["successor_id"]: (r["proven"], r["differs"]) for r in release.migration_proofs(old, shapes(spark, s=[dense], t=[box(0, 0, 1, 1.5)], u=[box(0, 0, 2, 1)])).collect()}
    assert got == {"s": (True, 0.0), "t": (False, 0.5), "u": (False, 2.0)}


def test_slivers_are_cut_from_whole_candidates_only(spark):
    new, old = shapes(spark, a=[box(0, 0, 10.1, 10)], b=[box(0, 20, 15, 30)]), shapes(spark, x=[box(10, 0, 20, 10)], y=[box(10, 20, 20, 30)])
    s = release.sliver_correction(spark.createDataFrame([("a", "x"), ("b", "y")], "a string, b string"), new, old, 2.0, 0.05)
    got = release.cut_slivers(s, new, old).collect()
    assert [(r["area_id"], round(r["area"], 9)) for r in got] == [("a", 100.0)]


def test_closure_of_a_long_chain_and_a_cycle(spark):
    rows = [{"id": f"c{i}", "parent_id": f"c{i - 1}" if i else None} for i in range(41)] + [{"id": f"y{i}", "parent_id": f"y{(i + 1) % 11}"} for i in range(11)] + [{"id": "in", "parent_id": "y0"}]
    a = areas(spark, *rows)
    up = hierarchy.ancestors(a)
    assert up.where("id = 'c40'").count() == 40 and up.where("id LIKE 'c%'").agg(F.max("depth")).first()[0] == 40
    assert {r["id"] for r in hierarchy.cycles(a).collect()} == {f"y{i}" for i in range(11)}
    assert up.where("id = 'in'").count() == 11 and hierarchy.ancestors(a, 3).where("id = 'c40'").count() == 3
    s = {r["root_id"]: (r["members"], r["fault"]) for r in hierarchy.scope(a, spark.createDataFrame([("c0",), ("c30",), ("y3",), ("c40",)], "root_id string"), 20, 5).collect()}
    assert s == {"c0": (40, "too_many_members"), "c30": (10, "too_deep"), "y3": (12, "cycle"), "c40": (0, None)}


def test_revisions_fold_in_order(spark):
    a = areas(spark, {"id": "a", "name": "Old", "level": "municipality"}, {"id": "r", "name": "R", "level": "region"})
    g = shapes(spark, a=[box(0, 0, 1, 1)]).unionByName(spark.createDataFrame([("r", "candidate", [box(0, 0, 2, 2)])], GEOMETRY))
    schema = f"id string, seq int, operation string, evidence string, name string, full {RINGS}, review {RINGS}"
    log = spark.createDataFrame(
        [
            ("a", 1, "metadata", "e", "New", None, None), ("a", 2, "boundary", "e", None, [box(0, 0, 3, 1)], [box(2, 0, 3, 1)]), ("a", 3, "deferred_boundary", "e", None, [box(0, 0, 1, 1)], [box(0, 0, 5, 1)]),
            ("a", 4, "retire", None, None, None, None), ("n", 5, "new", "e", "N", [box(9, 9, 10, 10)], None), ("n", 6, "metadata", "e", "N2", None, None), ("r", 7, "region", "e", None, [box(0, 0, 2, 2)], None), ("z", 8, "metadata", "e", "Z", None, None),
        ],
        schema,
    )
    now = {r["id"]: (r["name"], r["lifecycle_status"]) for r in lifecycle.apply_revisions(a, log.select("id", "seq", "operation", "name")).collect()}
    assert now == {"a": ("New", "superseded"), "r": ("R", "current"), "n": ("N2", "current")}
    roles = {(r["area_id"], r["role"]): r["s"] for r in lifecycle.revise_geometry(g, log).select("area_id", "role", G.area("rings").alias("s")).collect()}
    assert roles == {("a", "assignment"): 1.0, ("a", "review"): 5.0, ("n", "assignment"): 1.0, ("r", "assignment"): 4.0}
    faults = {(r["id"], r["seq"], r["fault"]) for r in lifecycle.revision_faults(a, g, log).collect()}
    assert faults == {("a", 4, "evidence"), ("r", 7, "not_approved"), ("r", 7, "candidate"), ("z", 8, "known")}


def test_region_ledger_with_divisions_left_out(spark):
    m = spark.createDataFrame([("1", "d"), ("2", "e"), ("3", "f")], "area_id string, division_id string")
    plan = spark.createDataFrame([("r", ["d"], ["2"])], "region_id string, division_ids array<string>, member_ids array<string>")
    out = spark.createDataFrame([("e",), ("f",)], "division_id string")
    got = {r["division_id"]: r["state"] for r in lifecycle.region_ledger(m, lifecycle.build_regions(plan, m), out).collect()}
    assert got == {"d": "assigned", "e": "conflict", "f": "excluded"}


def test_circle_rules_change_only_what_the_dispute_left_open(spark):
    g = shapes(spark, a=[box(0, 0, 1, 1)]).unionByName(spark.createDataFrame([("a", "review", [box(0.9, 0, 1, 1)]), ("b", "review", [box(0.9, 0, 1, 1)]), ("b", "assignment", [box(0.9, 0, 2, 1)])], GEOMETRY))
    c = spark.createDataFrame([(1, 0.5, 0.5, 1000.0), (2, 0.95, 0.5, 1000.0), (3, 0.95, 0.5, 9000.0), (4, 0.95, 0.5, 15000.0)], "circle_id int, x double, y double, radius_m double")
    stable = shapes(spark, a=[box(0, 0, 0.9, 1)], b=[box(1.0, 0, 2, 1)]).select("area_id", "rings")
    got = {r["circle_id"]: (r["legacy_status"], r["status"], r["change"]) for r in circle.compare_rules(c, g.select("area_id").distinct(), g, stable).collect()}
    assert got[1] == ("complete", "complete", "unchanged") and got[2] == ("incomplete", "incomplete", "unchanged") and got[3][2] == got[4][2] == "completed"
