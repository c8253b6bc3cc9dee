"""Versions, imports, bundles and streams of whole answers."""

import pytest
from pyspark.sql import functions as F

from areaframe.functions import text as T
from areaframe.operators import bundles, editions, hierarchy, imports
from areaframe.schema import GEOMETRY
from areaframe.sources import published, readers
from areaframe.streaming import answers
from tests.test_geography import areas, box, shapes

RINGS = GEOMETRY["rings"].dataType.simpleString()


def test_versions_only_grow(spark, tmp_path):
    root = str(tmp_path / "t")
    assert published.current(spark, root) == (None, 0)
    assert published.publish(spark.range(5), root, "one", 0) == 1
    with pytest.raises(published.Refused, match="was read"):
        published.publish(spark.range(9), root, "late", 0)
    with pytest.raises(published.Refused) as e:
        published.publish(spark.range(9), root, "guarded", 1, spark.createDataFrame([("x", "exists")], "id string, fault string"))
    assert e.value.faults[0]["id"] == "x" and published.current(spark, root)[1] == 1
    assert published.publish(spark.range(9), root, "two", 1) == 2
    assert published.current(spark, root)[0].count() == 9 and published.current(spark, root, 1)[0].count() == 5
    assert published.integrity_faults(spark, root).count() == 0
    path = published.versions(spark, root).where("version = 2").first()["path"]
    spark.range(1).write.mode("append").parquet(path)
    assert {r["fault"] for r in published.integrity_faults(spark, root).collect()} == {"unexpected"} and published.integrity_faults(spark, root, 1).count() == 0


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    published.publish(spark.range(5), root, "one")
    broken = spark.range(5).withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        published.publish(broken, root, "two")
    assert published.current(spark, root)[1] == 1 and published.current(spark, root)[0].count() == 5


def test_import_of_editions(spark):
    e = spark.createDataFrame([("e1", "m", "s", True, "w", None, 2), ("e2", "m", "s", True, "w", "2024-02-30", 1), ("e3", "x", "s", False, "v", None, 1)], "id string, authority_id string, scheme string, default boolean, source string, effective_date string, expected_count int")
    old = spark.createDataFrame([("e3", "m", "s", True), ("e0", "m", "s", True), ("e9", "m", "t", True)], "id string, authority_id string, scheme string, default boolean")
    a = areas(spark, {"id": "m", "level": "municipality"})
    sources = spark.createDataFrame([("w", 3)], "source string, n_features int")
    got = {(r["id"], r["fault"]) for r in imports.edition_faults(e, old, a, sources).collect()}
    assert got == {("e1", "one_default"), ("e2", "one_default"), ("e2", "effective_date"), ("e3", "new"), ("e3", "authority"), ("e3", "source")}
    merged = {r["id"]: r["default"] for r in imports.merged_editions(old, e.where("id = 'e1'")).collect()}
    assert merged == {"e3": False, "e0": False, "e9": True, "e1": True}
    bow = [(0, 0, [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)])]
    f = spark.createDataFrame([("w", 1, "A", "A", {"k": "1"}, [box(0, 0, 1, 1)]), ("w", 2, "A", "A", {"k": "1"}, [box(5, 0, 6, 1)]), ("w", 3, "B", "B", {"k": "1"}, bow), ("w", 4, "C", "C", {"k": "2"}, [box(0, 0, 1, 1)]), ("w", 5, "D", "D", {"k": "1"}, None)], f"source string, row_id int, code string, name string, props map<string, string>, rings {RINGS}")
    rules = spark.createDataFrame([("e1", "k", ["1"])], "edition string, field string, values array<string>")
    rows = imports.district_rows(f, e.where("id = 'e1'"), rules)
    got_areas, got_geometry = imports.districts(rows, e)
    assert {r["id"]: r["assignment_status"] for r in got_areas.collect()} == {"d-e1-A": "validated_source", "d-e1-B": "unreviewed_repair", "d-e1-D": "missing_geometry"}
    assert {(r["area_id"], r["role"], len(r["rings"])) for r in got_geometry.collect()} == {("d-e1-A", "assignment", 2), ("d-e1-B", "candidate", 2)}
    checks = imports.edition_checks(got_areas, got_geometry, e.where("id = 'e1'"), 1e-9).first()
    assert (checks["n"], checks["n_unavailable"], checks["n_overlaps"], checks["count_agrees"]) == (3, 2, 0, False)


def test_merged_parts_never_share_a_number(spark):
    rows = spark.createDataFrame([(1, "a", "n", [box(0, 0, 1, 1, part=20_000)]), (2, "a", "n", [box(2, 0, 3, 1, part=0)])], f"row_id int, id string, name string, rings {RINGS}")
    r = editions.merged_features(rows, "id").first()["rings"]
    assert len({x["part"] for x in r}) == 2


def bundle(spark, n=40):
    g = shapes(spark, **{f"m{i}": [box(i, 0, i + 1, 1)] for i in range(n)}).select("area_id", "rings")
    members = spark.createDataFrame([("b", f"m{i}") for i in range(n)] + [("b", "none"), ("e", "void")], "bundle_id string, area_id string")
    return members, g


@pytest.mark.parametrize("limit", [1, 700, 1 << 20])
def test_bundle_parts_hold_every_member_once(spark, limit):
    members, g = bundle(spark)
    parts = bundles.parts(members, g, limit).collect()
    ids = [x for p in parts for x in spark.range(1).select(F.from_json(F.lit(p["body"]), "features array<struct<id: struct<area_id: string>>>").alias("d")).first()["d"]["features"]]
    assert sorted(x["id"]["area_id"] for x in ids) == sorted(f"m{i}" for i in range(40))
    assert len(parts) == {1: 40, 1 << 20: 1}.get(limit, len(parts)) and (limit != 700 or 5 < len(parts) < 40)
    d = {r["bundle_id"]: r for r in bundles.descriptors(members, bundles.parts(members, g, limit)).collect()}
    assert (d["b"]["areas"], d["b"]["available"], d["b"]["coverage"], d["b"]["east"]) == (41, 40, "partial", 40.0) and d["e"]["status"] == "unavailable"


def test_bundle_verification(spark):
    members, g = bundle(spark)
    parts = bundles.parts(members, g, 700)
    stated = bundles.descriptors(members, parts)
    check = lambda s=stated, p=parts, m=members, now=g: {(r["bundle_id"], r["fault"]) for r in bundles.verification(s, p, m, members, now, 700).collect()}
    assert check() == set()
    assert check(s=stated.withColumn("north", F.col("north") + 1)) == {("b", "box")}
    assert check(p=parts.withColumn("body", F.when(F.col("part") == 2, F.concat("body", F.lit(" "))).otherwise(F.col("body")))) == {("b", "altered_bytes")}
    assert check(p=parts.where("part <> 1")) == {("b", "missing_part")}
    assert check(m=members.where("area_id <> 'm7'")) == {("b", "missing_member")}
    moved = g.withColumn("rings", F.expr("IF(area_id = 'm39', transform(rings, r -> named_struct('part', r.part, 'ring', r.ring, 'pts', transform(r.pts, p -> named_struct('x', p.x + 7, 'y', p.y)))), rings)"))
    assert {f for _, f in check(now=moved)} == {"stale_part", "box", "digest"}


def test_stream_answers_are_replaced_not_doubled_and_restated(spark, tmp_path):
    root, target = str(tmp_path / "g"), str(tmp_path / "a")
    a = areas(spark, {"id": "m", "level": "municipality"}, {"id": "n", "level": "municipality"})
    closure = hierarchy.ancestors(a)
    published.publish(shapes(spark, m=[box(0, 0, 1, 1)], n=[box(1, 0, 2, 1)]), root, "one")
    answer = answers.batch_answers(a, closure, root, target)
    batch = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 9.0, 9.0), (3, 9.0, 9.0)], "point_id int, x double, y double")
    answer(batch.where("point_id < 3"), 0)
    answer(batch, 1)
    answer(batch, 1)  # Spark repeats a batch
    got = lambda: {r["point_id"]: (r["status"], r["direct"], r["version"]) for r in answers.answers(spark, target).collect()}
    assert got() == {1: ("matched", ["m"], 1), 2: ("matched", ["n"], 1), 3: ("no_match", [], 1)}
    published.publish(shapes(spark, m=[box(0, 0, 1, 1)], n=[box(1, 0, 10, 10)]), root, "two", 1)
    assert answers.restate(spark, a, closure, root, target) == 2 == answers.restate(spark, a, closure, root, target)
    assert got() == {1: ("matched", ["m"], 2), 2: ("matched", ["n"], 2), 3: ("matched", ["n"], 2)}
    answer(spark.createDataFrame([(4, 5.0, 5.0)], batch.schema), 2)
    assert got()[4] == ("matched", ["n"], 2) and len(got()) == 4


def test_slugs(spark):
    r = spark.range(1).select(T.slug(F.lit("  Ward No. 7 & East! ")).alias("s")).first()
    assert r["s"] == "ward-no-7-east"


def test_vector_layers_read_only_what_is_asked_for(spark, tmp_path):
    path = str(tmp_path / "layer")
    spark.range(100).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS wide").write.parquet(path)
    plan = readers.vector_layer(spark, path, ["id", "k"], 100).where("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,3)]" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan
    with pytest.raises(ValueError, match="no columns"):
        readers.vector_layer(spark, path, ["id", "x"])
    with pytest.raises(ValueError, match="100 features"):
        readers.vector_layer(spark, path, ["id"], 99)


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from types import SimpleNamespace

    from areaframe.sources.workspace import shared_path

    none = SimpleNamespace(get=lambda k, d=None: d)
    session = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: none, master="spark://host:7077"), conf=none)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_path(session, "x")
