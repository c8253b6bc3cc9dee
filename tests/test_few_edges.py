"""Keys of few edges are arranged within tasks, with the results of the cells, after one shuffle of whole shapes."""

import random

import pytest

from areaframe.operators import arrangement as A
from areaframe.operators import overlay
from tests.test_arrangements import RINGS, area
from tests.test_geography import box


@pytest.fixture(scope="module")
def sides(spark):
    r, rows = random.Random(5), []
    for g in range(12):
        for i in range(r.randint(2, 7)):
            x0, y0 = r.randint(0, 6), r.randint(0, 6)
            rows.append((g, "AB"[i % 2], [box(x0, y0, x0 + r.randint(1, 4), y0 + r.randint(1, 4) + 0.1 * i)]))
    return spark.createDataFrame(rows, f"g int, side string, rings {RINGS}")


@pytest.mark.parametrize("limit", [0, 18])
def test_few_and_many_edges_agree(sides, monkeypatch, limit):
    def run():
        arcs = {tuple(r) for r in A.arranged_shapes(sides, ["g"]).collect()}
        rings = {r["g"]: (len(r["rings"]), round(area(r["rings"]), 9)) for r in A.region_polygons(sides, ["g"], "union").collect()}
        return arcs, rings

    got = run()
    monkeypatch.setattr(A, "KEY_EDGES", limit)  # all keys by cells, or those of more than three boxes
    assert got == run()


def test_shapes_cross_one_shuffle(sides):
    out = overlay.coverage(sides.where("side = 'B'"), sides.where("side = 'A'"), ["g"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count(" Exchange ") == 1 and "SortMergeJoin" not in plan
