"""Readers and writers of the catalogue's inputs and outputs, with their contracts.

Schemas are explicit. What breaks a contract comes back as rows, so that a batch can be
quarantined; ``strict`` raises instead.
"""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions import geometry as G
from areaframe.functions import text as T
from areaframe.operators.contract import identity_diff

FEATURES = "type string, features array<struct<type: string, properties: map<string, string>, geometry: string>>"
CENSUS = "REF_DATE string, GEO string, DGUID string, Coordinate string, Population string, Symbols string"


def feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """feature (number), props, geometry (GeoJSON text), rings of a pinned FeatureCollection file."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", FEATURES).alias("d"))
    rows = doc.select(F.posexplode("d.features").alias("feature", "f")).select("feature", F.col("f.properties").alias("props"), F.col("f.geometry").alias("geometry"))
    return rows.withColumn("rings", G.from_geojson("geometry"))


def checked_source(rows: DataFrame, pins: DataFrame, id_field: str, count: int) -> DataFrame:
    """Faults of a pinned source: wrong count, missing, unexpected or repeated ids, changed properties, bad geometry.

    ``pins`` hold id and the expected props.
    """
    own = rows.select(F.try_element_at("props", F.lit(id_field)).alias("id"), "props", G.issue("rings").alias("issue"))
    faults = identity_diff(pins, own)
    changed = own.join(pins.withColumnRenamed("props", "pinned"), "id").where(F.exists(F.map_entries("pinned"), lambda e: ~F.try_element_at("props", e["key"]).eqNullSafe(e["value"])))
    bad = own.where("issue IS NOT NULL").select("id", F.concat(F.lit("geometry:"), "issue").alias("fault"))
    total = own.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != count).select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("count:"), F.col("n").cast("string")).alias("fault"))
    return faults.unionByName(changed.select("id", F.lit("properties").alias("fault"))).unionByName(bad).unionByName(total)


def census(spark: SparkSession, path: str, prefix: str = "2021A0005") -> DataFrame:
    """dguid, code, value, reason, flags of a census file; only rows of the geographic level ``prefix``."""
    raw = spark.read.schema(CENSUS).csv(path, header=True, enforceSchema=False)
    return census_rows(raw, prefix)


def census_rows(raw: DataFrame, prefix: str) -> DataFrame:
    value, reason, flags = T.census_symbol(F.col("Population").try_cast("bigint"), F.col("Symbols"))
    own = raw.where(F.col("DGUID").rlike(f"^{prefix}[0-9]+$"))
    return own.select(F.col("DGUID").alias("dguid"), F.substring("DGUID", len(prefix) + 1, 20).alias("code"), value.alias("value"), reason.alias("reason"), flags.alias("flags"))


def transfers(spark: SparkSession, path: str) -> DataFrame:
    """Interim transfers: lines without a file number (preamble, headings) are skipped; rows are known by their digest."""
    raw = spark.read.schema("gain_id string, loss_id string, n string, effective string, file string").csv(path)
    rows = raw.where(F.col("file").rlike(r"^[0-9A-Z]+-[0-9]+$"))
    count = F.when(T.is_integral(F.col("n")), F.col("n").try_cast("decimal(20,4)").cast("bigint"))
    return rows.withColumn("row_id", T.record_digest("gain_id", "loss_id", "n", "effective", "file")).withColumn("n", count)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """A consumer's area inventory: foreign_id, kind, province_id, names; rows that break the contract keep a fault."""
    raw = spark.read.schema("id string, kind string, parent_id string, province_id string, names array<string>").json(path)
    fault = F.when(F.col("id").isNull(), "id").when(F.col("kind").isNull(), "kind").when(F.coalesce(F.size("names"), F.lit(0)) == 0, "names")
    return raw.select(F.col("id").alias("foreign_id"), "kind", "parent_id", "province_id", "names", fault.alias("fault"))


def list_members(pages: DataFrame) -> DataFrame:
    """page_id, group_code, code, name: member items of an HTML list with the header item they follow."""
    item = r'<li class="list-group-item indent-(\d+)">([^<]*?) - ([^<]*)</li>'
    found = F.regexp_extract_all("html", F.lit(item), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "li"))
    part = lambda k: F.regexp_extract("li", item, k)
    rows = rows.select("page_id", "pos", part(1).cast("int").alias("indent"), F.trim(part(2)).alias("code"), F.trim(part(3)).alias("name"))
    carried = F.last(F.when(F.col("indent") == 2, F.col("code")), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("group_code", carried).where("indent = 3").select("page_id", "group_code", "code", "name")


def snapshot_faults(pages: DataFrame, ids_before: DataFrame, ids_after: DataFrame) -> DataFrame:
    """Faults of a paged snapshot (page, id): repeated, missing or unexpected ids, and drift of the id list meanwhile."""
    faults = identity_diff(ids_before, pages)
    drift = ids_before.select("id").exceptAll(ids_after.select("id")).unionByName(ids_after.select("id").exceptAll(ids_before.select("id")))
    return faults.unionByName(drift.select("id", F.lit("drift").alias("fault")))


def named_join_faults(inventory_: DataFrame, shapes: DataFrame) -> DataFrame:
    """Names that inventory and shapes do not share equally often: name, n_inventory, n_shapes."""
    a = inventory_.groupBy("name").agg(F.count(F.lit(1)).alias("n_inventory"))
    b = shapes.groupBy("name").agg(F.count(F.lit(1)).alias("n_shapes"))
    return a.join(b, "name", "full").na.fill(0, ["n_inventory", "n_shapes"]).where("n_inventory <> n_shapes OR n_inventory > 1")


#: Files up to this size are hashed as one row each; larger ones are reported instead of being passed over.
HASHED_BYTES = 1 << 30
#: What the public may see of an area.
PUBLIC = ["id", "name", "level", "layer", "parent_id", "province_id", "scheme", "edition", "assignment_status", "lifecycle_status"]


def inventory_of(spark: SparkSession, root: str, hashed_bytes: int = HASHED_BYTES) -> DataFrame:
    """name (path below the folder), bytes, sha256 of all files of a folder but for hidden ones and marks of the
    writer; sha256 is null for files that are too large to be one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = urlparse(root).path.rstrip("/") + "/"
    name = F.substring("path", F.instr(F.col("path"), below) + len(below), F.length("path"))
    files = files.withColumn("name", name).where(~F.element_at(F.split("name", "/"), -1).rlike("^[_.]"))
    small = files.where(F.col("length") <= hashed_bytes).select("name", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return small.unionByName(files.where(F.col("length") > hashed_bytes).select("name", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256")))


def release_faults(spark: SparkSession, root: str, manifest: DataFrame, hashed_bytes: int = HASHED_BYTES) -> DataFrame:
    """Files of a release against its manifest (name, bytes, sha256): name, fault.

    Files that are too large to be hashed are compared by size only, and say so. The manifest's own folder is not part of it.
    """
    own = inventory_of(spark, root, hashed_bytes).where("NOT startswith(name, 'manifest/')").withColumnsRenamed({"bytes": "own_bytes", "sha256": "own_sha"})
    j = manifest.join(own, "name", "full")
    fault = F.when(F.col("own_bytes").isNull(), "missing").when(F.col("bytes").isNull(), "unexpected").when(F.col("bytes") != F.col("own_bytes"), "size")
    fault = fault.when(F.col("own_sha").isNull(), "too_large_to_hash").when(F.col("sha256") != F.col("own_sha"), "content")
    return j.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def vector_layer(spark: SparkSession, path: str, columns: list[str], most: int | None = None) -> DataFrame:
    """The named columns of a vector layer in Parquet; a column that it lacks is an error, and so are more than ``most`` features.

    Only these columns are read, and filters on the result reach the files.
    """
    layer = spark.read.parquet(path)
    if lacking := sorted(set(columns) - set(layer.columns)):
        raise ValueError(f"{path} has no columns {lacking}")
    out = layer.select(*columns)
    if most is not None and (n := layer.count()) > most:  # answered from the files' footers
        raise ValueError(f"{path} has {n} features, {most} are allowed")
    return out


def export_release(areas: DataFrame, geometry: DataFrame, target: str, columns: list[str] = PUBLIC) -> None:
    """Write a release, never over an existing one: public columns of the areas by level and province, display
    documents by province, and last a manifest of both."""
    spark = areas.sparkSession
    own = areas.withColumn("province", F.coalesce("province_id", F.lit("-")))
    level = F.col("level").alias("of_level")
    own.select(*columns, level, "province").write.mode("errorifexists").partitionBy("of_level", "province").parquet(f"{target}/area")
    display_collections(areas, geometry).write.mode("errorifexists").partitionBy("province").text(f"{target}/display")
    inventory_of(spark, target).coalesce(1).write.mode("errorifexists").parquet(f"{target}/manifest")


def display_collections(areas: DataFrame, geometry: DataFrame) -> DataFrame:
    """province, value: one GeoJSON feature a line for every geometry, with its id, name and role."""
    shown = geometry.join(areas.select(F.col("id").alias("area_id"), "name", F.coalesce("province_id", F.lit("-")).alias("province")), "area_id")
    body = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("area_id", "name", "role")), F.lit(',"geometry":'), G.to_geojson("rings"), F.lit("}"))
    return shown.select("province", body.alias("value"))


def licence_release_faults(old: DataFrame, new: DataFrame, key: str, licence_columns: list[str]) -> DataFrame:
    """key, fault of a derived release of sources in which only ``licence_columns`` may differ: added, removed, or another column changed."""
    from areaframe.operators.lifecycle import release_diff

    fixed = [c for c in old.columns if c != key and c not in licence_columns]
    return release_diff(old, new, key, fixed).select(key, F.coalesce(F.array_join("columns", ","), "change").alias("fault"))


# The groups of a website catalogue, by level.
GROUPS = {"country": "countries", "province": "provinces", "region": "regions", "municipality": "municipalities", "city_area": "city_areas"}


def website_catalogue(areas: DataFrame, counts: DataFrame) -> DataFrame:
    """group, id, name, parent, parent_name, province, n_children of the five groups; ids and parents are those of the website, group/code."""
    pairs = [F.lit(x) for kv in GROUPS.items() for x in kv]
    own = areas.withColumn("group", F.try_element_at(F.create_map(*pairs), F.col("level"))).where("group IS NOT NULL")
    own = own.withColumn("web", F.concat_ws("/", "group", F.substring_index("id", "-", -1)))
    totals = counts.groupBy(F.col("parent_id").alias("id")).agg(F.sum("n_children").alias("n_children"))
    parents = own.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"), F.col("web").alias("parent"))
    province = own.where("level = 'province'").select(F.col("id").alias("province_id"), F.col("web").alias("province"))
    j = own.join(totals.hint("merge"), "id", "left").join(parents.hint("merge"), "parent_id", "left").join(province.hint("merge"), "province_id", "left")
    return j.select("group", F.col("web").alias("id"), "name", "parent", "parent_name", "province", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def catalogue_export(areas: DataFrame, counts: DataFrame, target: str) -> None:
    """Denormalised catalogue as JSON lines, by level, with child counts."""
    totals = counts.groupBy(F.col("parent_id").alias("id")).agg(F.sum("n_children").alias("n_children"))
    parents = areas.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    areas.join(totals, "id", "left").join(parents, "parent_id", "left").write.mode("errorifexists").partitionBy("level").json(target)
