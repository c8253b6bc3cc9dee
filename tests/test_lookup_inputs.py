"""A lookup reads areas, geometry and chains several times; what they come from is worked out once."""

from areaframe.operators import lookup
from areaframe.plans import lookups
from areaframe.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def test_inputs_are_not_worked_out_again_for_the_answers(spark):
    areas, geometry = lookups._admin(spark, SF)
    found = lookup.lookup(X.points(spark, SF), areas.where("id <> 'no such area'"), geometry.where("area_id <> 'no such shape'"), lookups._closure(spark, SF))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "no such area" not in plan and "no such shape" not in plan
    assert found.count() == X.points(spark, SF).count()
