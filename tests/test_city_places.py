"""City slices: customers find their municipality by its place in the nation, not by trying all of them."""

from areaframe.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def test_slices_equal_those_of_the_stated_join(spark):
    stated = spark.sql(X.CITY, customer=X.table(spark, SF, "customer"), muni=X.municipalities(spark, SF))
    slices = X.city_slices(spark, SF)
    assert slices.columns == stated.columns
    assert slices.exceptAll(stated).isEmpty() and stated.exceptAll(slices).isEmpty()
    assert not slices.isEmpty()


def test_customers_meet_one_municipality(spark):
    def residues(df):
        """What the joins check pair by pair, beside their keys."""
        plan = df._jdf.queryExecution().sparkPlan().toString()
        return [line.split("Inner", 1)[1] for line in plan.splitlines() if "Join" in line and "Inner" in line]

    found = residues(X.city_slices(spark, SF))
    assert found and not any(" = " in x for x in found)
    stated = spark.sql(X.CITY, customer=X.table(spark, SF, "customer"), muni=X.municipalities(spark, SF))
    assert any(" = " in x for x in residues(stated))
