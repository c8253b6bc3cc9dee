"""Circles are counted where their edges are found: no pair of a circle and an area is exchanged, and the counts are those of all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from areaframe.operators import circle
from areaframe.schema import GEOMETRY

ROLES = ("assignment", "candidate", "bbox", "review")


@pytest.fixture(scope="module")
def made():
    """Boxes (area_id, role, west, south, east, north) beside each other and circles of 1 to 60 km around them."""
    r = np.random.default_rng(11)
    x0, y0 = (-100 + 0.2 * np.arange(60) % 4, 50 + 0.5 * (np.arange(60) // 20))
    b = pd.DataFrame({"area_id": [f"m-{i}" for i in range(60)], "role": [ROLES[(i % 11 == 3) + 2 * (i % 13 == 4) if i % 11 != 3 or i % 13 != 4 else 1] for i in range(60)], "west": x0, "south": y0, "east": x0 + 0.2, "north": y0 + 0.5})
    strips = b[(b.role == "assignment") & (b.index % 5 == 1)].assign(role="review", west=lambda d: d.east - 0.02)
    c = pd.DataFrame({"circle_id": np.arange(160), "x": r.uniform(-100.5, -95.5, 160), "y": r.uniform(49.8, 51.8, 160), "radius_m": 1000.0 * r.choice([1, 3, 9, 60], 160)})
    c.loc[:20, ["x", "y", "radius_m"]] = np.c_[x0[:21] + 0.1, y0[:21] + 0.25, np.full(21, 800.0)]  # inside one box, near no edge
    return c, pd.concat([b, strips], ignore_index=True), strips


def _geometry(spark, boxes):
    ring = lambda q: (0, 0, [(q.west, q.south), (q.east, q.south), (q.east, q.north), (q.west, q.north), (q.west, q.south)])
    return spark.createDataFrame([(q.area_id, q.role, [ring(q)]) for q in boxes.itertuples()], GEOMETRY)


def _roles(c, boxes):
    """By brute force: circle_id, area_id -> roles reached."""
    m = c.merge(boxes, how="cross")
    near = ((m.x >= m.west) & (m.x <= m.east) & (m.y >= m.south) & (m.y <= m.north)).to_numpy()
    for a, b in ((("west", "south"), ("east", "south")), (("east", "south"), ("east", "north")), (("east", "north"), ("west", "north")), (("west", "north"), ("west", "south"))):
        near |= circle.within(m.assign(ax=m[a[0]], ay=m[a[1]], bx=m[b[0]], by=m[b[1]]))
    return m[near].groupby(["circle_id", "area_id"]).role.agg(set).to_dict()


def _reasons(c, roles):
    out = {i: {} for i in c.circle_id}
    for (i, a), r in roles.items():
        out[i][a] = "u" if r & {"candidate", "bbox"} else "d" if "review" in r and "stable" not in r else "m"
    return out


def test_discovery_equals_all_pairs(spark, made, monkeypatch):
    monkeypatch.setattr(circle, "BROADCAST_BYTES", 12_000)  # divides the areas into several parts
    c, boxes, _ = made
    g = _geometry(spark, boxes)
    got = {r["circle_id"]: r for r in circle.discover(spark.createDataFrame(c), g.select("area_id").distinct(), g).collect()}
    want = _reasons(c, _roles(c, boxes))
    assert got.keys() == want.keys()
    for i, w in want.items():
        bad = sorted(a for a, k in w.items() if k != "m")
        n = {k: list(w.values()).count(k) for k in "ud"}
        text = ",".join(f"{k}:{v}" for k, v in (("boundary_disagreement", n["d"]), ("municipal_geometry_unavailable", n["u"])) if v)
        assert (got[i]["status"], got[i]["n_affected"], got[i]["affected"], got[i]["reasons"]) == ("incomplete" if bad else "complete", len(bad), bad[:20], text)
        assert got[i]["matches"] == ([] if bad else sorted(w)) and got[i]["n_matches"] == len(got[i]["matches"])


def test_rules_equal_all_pairs(spark, made):
    c, boxes, strips = made
    held = boxes[(boxes.role == "assignment") & boxes.area_id.isin(strips.area_id)].assign(role="stable", east=lambda d: d.east - 0.02)
    stable = _geometry(spark, held).select("area_id", "rings")
    g = _geometry(spark, boxes)
    got = {r["circle_id"]: (r["legacy_status"], r["status"], r["n_legacy"], r["n_matches"], r["change"]) for r in circle.compare_rules(spark.createDataFrame(c), g.select("area_id").distinct(), g, stable).collect()}
    old, new = _reasons(c, _roles(c, boxes)), _reasons(c, _roles(c, pd.concat([boxes, held], ignore_index=True)))
    want = {}
    for i in c.circle_id:
        a, b = ([k for k, v in w[i].items() if v != "m"] for w in (old, new))
        change = "unchanged" if (len(a), 0 if a else sorted(old[i])) == (len(b), 0 if b else sorted(new[i])) else "completed" if a and not b else "fewer_affected"
        want[i] = ("incomplete" if a else "complete", "incomplete" if b else "complete", 0 if a else len(old[i]), 0 if b else len(new[i]), change)
    assert got == want and {w[-1] for w in want.values()} == {"unchanged", "completed", "fewer_affected"}


def test_pairs_of_a_circle_stay_in_its_task(spark, made, monkeypatch):
    monkeypatch.setattr(circle, "CIRCLES_EACH", 40)
    c, boxes, _ = made
    plan = circle._tallied(spark.createDataFrame(c), _geometry(spark, boxes), False)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt)


def test_edges_settled_by_the_engine_agree_with_the_kernel(spark):
    r = np.random.default_rng(7)
    n = 6000
    y, x, radius = r.uniform(-84, 84, n), r.uniform(-170, 170, n), 1000.0 * r.integers(1, 101, n)
    reach, turn, slant, long = np.degrees(radius / 6.37e6), r.uniform(0, 2 * np.pi, n), r.uniform(0, 2 * np.pi, n), r.uniform(0.1, 20, n)
    off = reach * r.uniform(0.985, 1.015, n)
    px, py = x + off * np.cos(turn) / np.cos(np.radians(y)), y + off * np.sin(turn)
    flat = np.where(np.arange(n) % 2 == 0, turn + np.pi / 2, slant)  # half of them touch the circle
    dx, dy = long * reach * np.cos(flat) / np.cos(np.radians(y)), long * reach * np.sin(flat)
    c = pd.DataFrame({"circle_id": np.arange(n), "x": x, "y": y, "radius_m": radius, "ax": px - dx, "ay": np.clip(py - dy, -89, 89), "bx": px + dx, "by": np.clip(py + dy, -89, 89)})
    want = pd.Series(circle.nearest(c) <= radius + circle.BAND, c.circle_id)
    met = circle._bounds(circle.envelopes(spark.createDataFrame(c[["circle_id", "x", "y", "radius_m"]]))).join(spark.createDataFrame(c[["circle_id", "ax", "ay", "bx", "by"]]), "circle_id")
    state = F.expr(f"CASE WHEN ({circle._IN}) THEN 2 WHEN ({circle._OUT}) THEN 0 WHEN _dd IS NULL THEN 1 ELSE {circle._fine()} END")
    got = met.withColumn("_t", F.expr(circle._T)).select("circle_id", state.alias("state")).toPandas()
    held = want[got.circle_id].to_numpy()
    assert held[got.state == 2].all() and not held[got.state == 0].any()
    assert (got.state == 1).mean() < 0.1 and (got.state == 2).sum() > 500 and (got.state == 0).sum() > 500
