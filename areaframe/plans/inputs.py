"""Queries of sources, exports and value functions; files are written to the shared folder and read back. With their oracles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaframe.functions import geometry as G
from areaframe.functions import text as T
from areaframe.operators import catalogue, cells, conformance, contract, editions, hierarchy, lifecycle, population, release, review
from areaframe.plans import audits
from areaframe.plans.lookups import IN_MUNI, MUNI
from areaframe.plans.records import AREAS, _id
from areaframe.sources import fixtures as X
from areaframe.sources import readers
from areaframe.sources.workspace import shared_path, written

SHAPED = "shape IN ('plain', 'hole', 'multipart')"


def _k() -> Column:
    return F.col("s_suppkey")


def _municipal(spark: SparkSession, d: str) -> DataFrame:
    return X.municipal_geometry(X.municipalities(spark, d)).where("role = 'assignment'").select("area_id", "rings")


def _text_file(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = shared_path(spark, name)
    lines.write.text(path)
    return path


# --- sources ---------------------------------------------------------------------------------


def pinned_source(spark: SparkSession, d: str) -> DataFrame:
    """Municipal shapes, one FeatureCollection file for each nation, against pins with other names, ids and too many features."""
    m = X.municipalities(spark, d).withColumn("area_id", _id("m-", "s_suppkey")).join(_municipal(spark, d).hint("merge"), "area_id", "left")
    geometry = F.when(_k() % 6 == 5, "null").otherwise(F.coalesce(G.to_geojson("rings"), F.lit("null")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(F.col("area_id").alias("code"), _id("N", "s_suppkey").alias("name"))), F.lit(',"geometry":'), geometry, F.lit("}"))
    docs = m.groupBy("s_nationkey").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value"))
    path = shared_path(spark, "features")
    docs.write.partitionBy("s_nationkey").text(path)  # a file is one document
    rows = readers.feature_collection(spark, path)
    name = F.when(_k() % 9 == 4, "other").otherwise(_id("N", "s_suppkey"))
    pins = m.select(F.when(_k() % 10 == 7, F.concat("area_id", F.lit("x"))).otherwise(F.col("area_id")).alias("id"), F.create_map(F.lit("name"), name).alias("props"))
    return readers.checked_source(rows, pins, "code", m.count() + 1)


def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of a layer of city areas, of the municipalities asked for."""
    path = shared_path(spark, "layer")
    city = X.city_slices(spark, d)
    X.city_geometry(city).join(city.select(_id("a-", "c_custkey").alias("area_id"), _id("m-", "s_suppkey").alias("parent_id"), "scheme"), "area_id").write.parquet(path)
    return readers.vector_layer(spark, path, ["area_id", "parent_id"], 10_000_000_000).where(F.col("parent_id").isin("m-1", "m-2", "m-3", "m-50"))


def transfer_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lines of a transfer file with a preamble, headings in between, and counts that are no counts."""
    k = F.col("o_orderkey")
    n = F.when(k % 7 == 0, F.concat((k % 40).cast("string"), F.lit(".5"))).when(k % 7 == 1, F.concat((k % 40).cast("string"), F.lit(".0"))).otherwise((k % 40).cast("string"))
    line = F.concat_ws(",", (F.col("o_custkey") % 100).cast("string"), (F.col("o_custkey") % 90).cast("string"), n, F.lit("2024-01-01"), F.concat(F.lit("24-"), k.cast("string")))
    head = F.when(k % 50 == 0, F.lit("Gaining,Losing,Count,Date,File Number")).when(k % 50 == 1, F.lit("Interim list,,,,"))
    lines = X.table(spark, d, "orders").select(F.explode(F.filter(F.array(head, line), lambda x: x.isNotNull())).alias("value"))
    out = readers.transfers(spark, _text_file(spark, lines, "transfers"))
    return out.groupBy("gain_id", "loss_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n"), F.count_distinct("row_id").alias("n_ids"))


def inventory_contract(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a consumer's inventory in which some rows lack a kind, an id or names."""
    s = X.table(spark, d, "supplier")
    rows = s.select(F.to_json(F.struct(F.when(_k() % 11 != 0, _id("m-", "s_suppkey")).alias("id"), F.when(_k() % 7 != 0, "municipality").alias("kind"), F.when(_k() % 5 != 0, F.array("s_name")).otherwise(F.array().cast("array<string>")).alias("names"), _id("k", "s_suppkey").alias("parent_id"))).alias("value"))
    return readers.inventory(spark, _text_file(spark, rows, "inventory")).select(F.col("parent_id").alias("row"), "foreign_id", "fault")


def paged_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of a server: some come twice, some not at all, some are new meanwhile."""
    o = X.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 20).alias("page"), F.col("o_orderkey").cast("string").alias("id"))
    pages = o.where("o_orderkey % 101 <> 0").unionByName(o.where("o_orderkey % 97 = 0"))
    before, after = o.where("o_orderkey % 103 <> 0"), o.where("o_orderkey % 107 <> 0")
    return readers.snapshot_faults(pages, before.select("id"), after.select("id"))


def name_join_faults(spark: SparkSession, d: str) -> DataFrame:
    """Customers as an inventory and as shapes, some named alike, some of one side only."""
    c = X.table(spark, d, "customer")
    a = c.where("c_custkey % 13 <> 0").select(F.concat(F.lit("n-"), F.when(F.col("c_custkey") % 17 == 0, 0).otherwise(F.col("c_custkey")).cast("string")).alias("name"))
    b = c.where("c_custkey % 19 <> 0").select(_id("n-", "c_custkey").alias("name"))
    return readers.named_join_faults(a, b)


def release_export(spark: SparkSession, d: str) -> DataFrame:
    """A release as written: rows and columns, faults against its own manifest before and after one file more, and that it cannot be written twice."""
    areas = X.areas(spark, d).where("level IN ('province', 'region', 'municipality')").withColumn("note", F.lit("internal"))
    g = _municipal(spark, d).withColumn("role", F.lit("assignment"))
    target = shared_path(spark, "release")
    readers.export_release(areas, g, target)
    try:
        readers.export_release(areas, g, target)
        again = "written"
    except AnalysisException:
        again = "refused"
    manifest = spark.read.parquet(f"{target}/manifest")
    sound = readers.release_faults(spark, target, manifest).count()
    spark.range(3).select(F.lit(None).cast("string").alias("id")).coalesce(1).write.mode("append").parquet(f"{target}/area/of_level=region/province=p-0")
    after = readers.release_faults(spark, target, manifest)
    read = spark.read.parquet(f"{target}/area").where("id IS NOT NULL")
    shown = spark.read.text(f"{target}/display").select(F.get_json_object("value", "$.properties.area_id").alias("a")).agg(F.count_distinct("a").alias("n_shown"))
    return read.groupBy("level").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(shown)).select("level", "n", "n_shown", F.lit("note" in read.columns).alias("leaks"), F.lit(again).alias("again"), F.lit(sound).cast("bigint").alias("n_faults"), F.lit(after.count()).cast("bigint").alias("n_after"))


def display_collections(spark: SparkSession, d: str) -> DataFrame:
    """Features and corners of the display documents of each province, read back from their lines."""
    g = _municipal(spark, d).withColumn("role", F.lit("assignment"))
    path = shared_path(spark, "display")
    readers.display_collections(X.areas(spark, d), g).write.partitionBy("province").text(path)
    rows = spark.read.text(path).withColumn("json", F.get_json_object("value", "$.geometry")).withColumn("rings", G.from_geojson("json"))
    return rows.groupBy("province").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(G.area("rings")), 5).alias("area"))


def website_catalogue(spark: SparkSession, d: str) -> DataFrame:
    areas = X.areas(spark, d).where("layer <> 'federal'")
    return readers.website_catalogue(areas, hierarchy.child_counts(areas))


def licence_release(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sources whose licence was reviewed; in some of them more than that has changed."""
    s = X.table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("size"), F.lit("unknown").alias("licence"))
    new = s.where(_k() % 12 != 5).withColumns({"licence": F.when(_k() % 2 == 0, "open").otherwise("closed"), "s_name": F.when(_k() % 9 == 0, "x").otherwise(F.col("s_name")), "size": F.when(_k() % 18 == 0, 0.5).otherwise(F.col("size"))})
    return readers.licence_release_faults(s, new, "s_suppkey", ["licence"])


def pending_source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows of two source families; the id is their own code or a prefix with it."""
    c = X.table(spark, d, "customer")
    rows = c.select(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("table"), _id("s", "c_nationkey").alias("source"), F.col("c_custkey").cast("string").alias("code"), F.when(F.col("c_custkey") % 3 == 0, _id("own-", "c_custkey")).alias("area_code"))
    n = X.table(spark, d, "nation")
    sources = n.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("table"), "n_nationkey").select("table", _id("s", "n_nationkey").alias("source"), F.concat("table", F.lit("-")).alias("prefix"), (F.col("n_nationkey") % 4 == 1).alias("pending"))
    return conformance.pending_sources(rows, sources)


# --- rows and values -------------------------------------------------------------------------


def value_functions(spark: SparkSession, d: str) -> DataFrame:
    """The value functions on the texts and numbers of customers."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("  É "), F.upper("c_mktsegment"), F.lit(" & no. "), k.cast("string"), F.lit("! "))
    date = F.concat(F.lit("2024-"), (k % 14).cast("string"), F.lit("-15")).alias("date")
    padded = F.format_string("2023-%02d-%02d", (k % 14).cast("int"), (k % 33).cast("int"))
    number = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".25"))).otherwise(F.concat(F.lit("n"), k.cast("string")))
    url = F.when(k % 4 == 0, "https://example.org/a").when(k % 4 == 1, "http://example.org/").when(k % 4 == 2, "https://user@example.org/").otherwise("https://example.org")
    return X.table(spark, d, "customer").select(
        "c_custkey", T.slug(text).alias("slug"), T.stable_string(number).alias("stable"), T.code(k, 4, "c").alias("code"), T.composite(k, F.col("c_nationkey")).alias("composite"),
        T.province((k % 70).cast("string")).alias("province"), T.is_date(date).alias("loose_date"), T.is_date(padded).alias("date"), T.is_public_url(url).alias("url"), T.is_integral(number).alias("integral"),
        F.array_join(T.aliases_without_name(F.array(F.col("c_mktsegment"), F.col("c_name"), F.lit("A"), F.lit("A")), F.col("c_name")), "|").alias("aliases"),
        T.valid_position(k - 200.0, k / 10.0).alias("position"), F.round(T.fraction(F.col("c_acctbal"), (k % 5).cast("double")), 6).alias("fraction"),
    )


def record_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of orders as JSON with sorted keys; a null field counts."""
    status = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    return X.table(spark, d, "orders").withColumn("status", status).select("o_orderkey", T.record_digest("status", "o_orderkey", "o_custkey").alias("digest"))


def active_municipalities(spark: SparkSession, d: str) -> DataFrame:
    a = X.areas(spark, d).where("level = 'municipality'").withColumn("lifecycle_status", F.when(F.substring("id", 3, 20).try_cast("int") % 8 == 3, "superseded").otherwise("current"))
    return catalogue.browse(a, level="municipality").select("id")


def extent_faults(spark: SparkSession, d: str) -> DataFrame:
    m = X.municipalities(spark, d)
    b = m.select(_id("m-", "s_suppkey").alias("area_id"), F.when(_k() % 9 == 2, F.col("x1")).otherwise(F.col("x0")).alias("west"), F.when(_k() % 10 == 3, -91.0).otherwise(F.col("y0")).alias("south"), F.when(_k() % 9 == 2, F.col("x0")).otherwise(F.col("x1")).alias("east"), F.when(_k() % 8 == 5, float("nan")).otherwise(F.col("y1")).alias("north"))
    return contract.extent_violations(b).select("area_id", F.array_join("violations", ",").alias("violations"))


def redistribution(spark: SparkSession, d: str) -> DataFrame:
    """Which suppliers' data may be handed on: by licence, review and open conditions."""
    s = X.table(spark, d, "supplier")
    source = F.struct(F.when(_k() % 5 != 0, "open").alias("licence"), F.when(_k() % 3 == 0, "pending").otherwise("approved").alias("status"), F.transform(F.sequence(F.lit(1), (_k() % 4).cast("int") + 1), lambda i: F.struct((i != _k() % 7).alias("met"))).alias("conditions"))
    return s.withColumn("source", source).select("s_suppkey", contract.redistribution_approved().alias("approved"))


def edition_faults(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as editions with dates, a default, a status and a link, on the first of June 2024."""
    s = X.table(spark, d, "supplier")
    e = s.select(
        _id("e-", "s_suppkey").alias("id"), F.when(_k() % 7 == 0, "2024-13-01").when(_k() % 7 == 1, "2025-01-01").when(_k() % 7 == 2, None).otherwise("2020-01-01").alias("effective_date"),
        F.when(_k() % 5 == 0, "2019-01-01").when(_k() % 5 == 1, "2022").otherwise(None).alias("valid_to"), (_k() % 2 == 0).alias("default"), F.when(_k() % 3 == 0, "historical").otherwise("current").alias("status"),
        F.when(_k() % 4 == 0, "ftp://x").when(_k() % 4 == 1, None).otherwise("https://example.org/x").alias("evidence_url"),
    )
    return contract.edition_violations(e, "2024-06-01").select("id", F.array_join("violations", ",").alias("violations"))


def coverage_listing(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of municipal coverage by province, rolled up to a histogram."""
    areas = X.areas(spark, d).where("level = 'municipality'")
    wards = X.city_slices(spark, d).where("s_suppkey % 4 <> 0").select(_id("m-", "s_suppkey").alias("authority_id"), (F.col("s_suppkey") % 3 != 0).alias("current"))
    declared = X.table(spark, d, "supplier").where("s_suppkey % 10 = 1").select(_id("m-", "s_suppkey").alias("authority_id"), F.lit("reference").alias("declared"))
    out = editions.coverage_rollup(editions.municipal_coverage(areas.select(F.col("id").alias("authority_id"), "province_id"), wards, declared))
    return out.select("province_id", "n", F.array_join(F.transform(F.array_sort(F.map_entries("by_status")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("by_status"))


def engine_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    """Both point joins on every point: how many pairs each finds, and how many only one of them."""
    g = written(_municipal(spark, d).withColumn("role", F.lit("assignment")), "municipal")
    p = X.points(spark, d)
    a, b = written(cells.cover(p, g, "point_id"), "by-cells"), written(cells.nested_loop(p, g, "point_id"), "by-boxes")
    diff = lifecycle.same_rows(a, b).count()
    return a.agg(F.count(F.lit(1)).alias("n_cells")).crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("n_boxes")))).withColumn("n_diff", F.lit(diff).cast("bigint"))


def nested_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """City areas whose box meets that of another of the same municipality and scheme."""
    city = X.city_slices(spark, d)
    g = written(X.city_geometry(city).join(city.select(_id("a-", "c_custkey").alias("area_id"), F.concat_ws("|", "s_suppkey", "scheme").alias("track")), "area_id"), "slices")
    t = lambda k: g.select(F.col("area_id").alias(k), F.col("track").alias(f"t{k}")).hint("merge")
    return cells.box_pairs(g, g).where("a <> b").join(t("a"), "a").join(t("b"), "b").where("ta = tb").groupBy("a").agg(F.count(F.lit(1)).alias("n"))


def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    out = audits.review_decisions(spark, d)
    return review.decision_counts(out)


def artefact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Comments of orders' priorities as documents: one artefact for each content, with how many share it."""
    docs = X.table(spark, d, "orders").select(_id("b-", "o_orderkey").alias("bundle_id"), F.concat("o_orderpriority", "o_orderstatus").alias("body"))
    return conformance.artefacts(docs).select("sha256", "bytes", F.size("bundles").cast("bigint").alias("n"))


def historical_counts(spark: SparkSession, d: str) -> DataFrame:
    """Superseded and historical areas by level and layer."""
    return catalogue.status_histogram(X.areas(spark, d).where("lifecycle_status <> 'current'"), "level", "layer", "lifecycle_status")


def level_histogram(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.status_histogram(X.areas(spark, d), "level", "layer", "assignment_status")


def union_areas(spark: SparkSession, d: str) -> DataFrame:
    """Five tables of different columns as one, with the columns that a table lacks left null."""
    r, n, s, c = (X.table(spark, d, t) for t in ("region", "nation", "supplier", "customer"))
    tables = [
        spark.range(1).select(F.lit("c").alias("id")), r.select(_id("p-", "r_regionkey").alias("id"), F.col("r_name").alias("name")), n.select(_id("g-", "n_nationkey").alias("id"), F.col("n_name").alias("name"), _id("p-", "n_regionkey").alias("parent_id")),
        s.select(_id("m-", "s_suppkey").alias("id"), F.col("s_acctbal").alias("size"), _id("g-", "s_nationkey").alias("parent_id")), c.select(_id("a-", "c_custkey").alias("id"), F.col("c_mktsegment").alias("kind")),
    ]
    return lifecycle.union_all(*tables).groupBy(F.substring("id", 1, 1).alias("of")).agg(F.count("id").alias("n"), F.count("name").alias("named"), F.count("parent_id").alias("with_parent"), F.count("size").alias("sized"), F.count("kind").alias("kinds"))


def document_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes as GeoJSON and back: what the round trip changes, and whether the length is that of the text."""
    g = _municipal(spark, d).withColumn("doc", G.to_geojson("rings")).withColumn("back", G.from_geojson("doc"))
    return g.select("area_id", (G.fingerprint("back") == G.fingerprint("rings")).alias("same"), F.expr("size(back) = size(rings)").alias("rings_same"), (F.octet_length("doc") == F.length("doc")).alias("ascii"))


def repair_envelopes(spark: SparkSession, d: str) -> DataFrame:
    m = X.municipalities(spark, d)
    ledger = m.select(_id("m-", "s_suppkey").alias("area_id"), (_k() % 3).alias("lost_vertices"), F.when(F.col("shape") == "multipart", 2).otherwise(1).alias("n_parts"), F.when(F.col("shape") != "unknown", F.col("x0")).alias("west"))
    return conformance.repair_envelope(ledger).select("area_id", "usable")


def edition_selection(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as editions of five layers: the defaults of each, and a choice of one layer."""
    e = X.table(spark, d, "supplier").select(_id("e-", "s_suppkey").alias("id"), F.concat(F.lit("l-"), (F.col("s_nationkey") % 5).cast("string")).alias("layer"), (_k() % 4 == 0).alias("default"))
    rows = [(layer, i) for layer in (f"l-{k}" for k in range(5)) for i in editions.selected(e, layer)]
    return spark.createDataFrame(rows, "layer string, id string")


def region_build(spark: SparkSession, d: str) -> DataFrame:
    """Regions of whole divisions and named members; divisions left out on purpose, two of which are claimed all the same."""
    m = written(X.table(spark, d, "supplier").select(_id("m-", "s_suppkey").alias("area_id"), F.col("s_nationkey").alias("division_id"), "s_suppkey"), "municipalities")
    n = X.table(spark, d, "nation")
    whole = n.where("n_nationkey % 3 = 0").select(_id("r-", "n_nationkey").alias("region_id"), F.array("n_nationkey").alias("division_ids"), F.array().cast("array<string>").alias("member_ids"))
    named = m.where("division_id % 3 = 1 AND s_suppkey % 2 = 0").groupBy(F.concat(F.lit("r-x"), F.col("division_id").cast("string")).alias("region_id")).agg(F.collect_list("area_id").alias("member_ids")).select("region_id", F.array().cast("array<int>").alias("division_ids"), "member_ids")
    membership = lifecycle.build_regions(whole.unionByName(named), m.select("area_id", "division_id"))
    return lifecycle.region_ledger(m.select("area_id", "division_id"), membership, n.where("n_nationkey % 5 = 2").select(F.col("n_nationkey").alias("division_id")))


def population_pages(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities with what is known of their population; one without a record says so."""
    s = X.table(spark, d, "supplier")
    records = s.where(_k() % 4 != 0).select(_id("m-", "s_suppkey").alias("area_id"), F.when(_k() % 4 != 1, _k() * 10).alias("population"), F.when(_k() % 4 == 1, "suppressed").alias("reason"))
    return population.with_population(s.select(_id("m-", "s_suppkey").alias("area_id")), records)


def review_application(spark: SparkSession, d: str) -> DataFrame:
    """Counts by level and status after the approval of every other candidate, and what that does to regions."""
    areas = X.areas(spark, d).where("level IN ('region', 'municipality')").withColumn("issues", F.array(F.lit("x")))
    k = F.substring("id", 3, 20).try_cast("int")
    approvals = areas.where("level = 'municipality' AND assignment_status <> 'validated_source'").select("id", (k % 2 == 0).alias("approved"))
    return review.review_report(areas, review.promote_regions(review.apply_review(areas, approvals)))


def source_registration(spark: SparkSession, d: str) -> DataFrame:
    """Sources that orders mention in two roles, each once, and which of them no area uses."""
    o = X.table(spark, d, "orders")
    title, url = F.concat(F.lit("T"), (F.col("o_custkey") % 50).cast("string")), F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("https://example.org/"), (F.col("o_custkey") % 50).cast("string")))
    reg = written(catalogue.register_sources(o.select(F.col("o_orderkey").alias("record_id"), "o_orderstatus", title.alias("title"), url.alias("url")).withColumnRenamed("o_orderstatus", "role")), "sources")
    usage = reg.where("CAST(substring(title, 2) AS INT) % 2 = 0").select(F.lit("a").alias("area_id"), "source_id")
    loose = catalogue.unscoped_sources(reg, usage).select("source_id", F.lit(True).alias("unscoped"))
    return reg.join(loose.hint("merge"), "source_id", "left").select("title", "url", F.array_join("roles", ",").alias("roles"), "n_records", F.coalesce("unscoped", F.lit(False)).alias("unscoped"))


def root_viewports(spark: SparkSession, d: str) -> DataFrame:
    """The view of each municipality's package: its own box, or that of what its bundle has."""
    m = X.municipalities(spark, d).select(_id("m-", "s_suppkey").alias("area_id"), F.col("s_nationkey").alias("bundle_id"))
    boxes = _municipal(spark, d).select("area_id", *G.bbox("rings"))
    return release.viewports(m, boxes).select("area_id", "basis", *(F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")))


def selection_summary(spark: SparkSession, d: str) -> DataFrame:
    """Layers with their limitations for one historical edition, and for none."""
    areas = X.areas(spark, d)
    one, none = release.summary(areas, ["fed-1"]).withColumn("chosen", F.lit("fed-1")), release.summary(areas, []).withColumn("chosen", F.lit(""))
    return one.unionByName(none).select("chosen", "layer", "n", "n_open", F.array_join("limitations", ",").alias("limitations"))


def scoped_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps and pending areas of two provinces, with the districts of the current edition."""
    areas = X.areas(spark, d).withColumn("assignment_status", F.when(F.col("edition") == "fed-1", "missing_geometry").otherwise(F.col("assignment_status")))
    cover = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(_id("p-", "n_regionkey").alias("province_id"), F.when(_k() % 3 == 0, "partial").otherwise("included").alias("status"))
    return release.coverage_gaps(cover, areas, areas.where("id IN ('p-1', 'p-3')").select("province_id"), ["fed-2"])


QUERIES = {
    f.__name__: f
    for f in (
        pinned_source, vector_scan, transfer_rows, inventory_contract, paged_snapshot, name_join_faults, release_export, display_collections, website_catalogue, licence_release, pending_source_rows,
        value_functions, record_digests, active_municipalities, extent_faults, redistribution, edition_faults, coverage_listing, engine_crosscheck, nested_neighbours, decision_counts, artefact_dedupe,
        historical_counts, level_histogram, union_areas, document_bytes, repair_envelopes, edition_selection, region_build, population_pages, review_application, source_registration, root_viewports,
        selection_summary, scoped_gaps,
    )
}

_FAULTS = lambda **c: "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in c.items()) + ")"
_PROVINCES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.PROVINCES.items())

ORACLES = {
    "pinned_source": f"""WITH muni AS ({MUNI}), k AS (SELECT s_suppkey AS k, {SHAPED} AND s_suppkey%6<>5 AS has FROM muni) SELECT 'm-'||k||'x' AS id, 'missing' AS fault FROM k WHERE k%10=7 UNION ALL SELECT 'm-'||k, 'unexpected' FROM k WHERE k%10=7
      UNION ALL SELECT 'm-'||k, 'properties' FROM k WHERE k%9=4 AND k%10<>7 UNION ALL SELECT 'm-'||k, 'geometry:missing' FROM k WHERE NOT has UNION ALL SELECT NULL, 'count:'||count(*) FROM k""",
    "vector_scan": f"WITH muni AS ({MUNI}), city AS ({X.CITY.format(customer='customer', muni='muni')}) SELECT 'a-'||c_custkey AS area_id, 'm-'||s_suppkey AS parent_id FROM city WHERE s_suppkey IN (1,2,3,50)",
    "transfer_rows": "SELECT CAST(o_custkey%100 AS VARCHAR) AS gain_id, CAST(o_custkey%90 AS VARCHAR) AS loss_id, count(*) AS n_rows, CAST(sum(CASE WHEN o_orderkey%7<>0 THEN o_orderkey%40 END) AS BIGINT) AS n, count(DISTINCT o_orderkey) AS n_ids FROM orders GROUP BY 1,2",
    "inventory_contract": "SELECT 'k'||s_suppkey AS row, CASE WHEN s_suppkey%11<>0 THEN 'm-'||s_suppkey END AS foreign_id, CASE WHEN s_suppkey%11=0 THEN 'id' WHEN s_suppkey%7=0 THEN 'kind' WHEN s_suppkey%5=0 THEN 'names' END AS fault FROM supplier",
    "paged_snapshot": """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey%103<>0 AS b, o_orderkey%107<>0 AS a, CAST(o_orderkey%101<>0 AS INT)+CAST(o_orderkey%97=0 AS INT) AS n FROM orders)
      SELECT id, CASE WHEN n=0 THEN 'missing' WHEN NOT b THEN 'unexpected' ELSE 'duplicate' END AS fault FROM o WHERE (b AND n<>1) OR (NOT b AND n>0) UNION ALL SELECT id, 'drift' FROM o WHERE a<>b""",
    "name_join_faults": """WITH i AS (SELECT 'n-'||CASE WHEN c_custkey%17=0 THEN 0 ELSE c_custkey END AS name, count(*) AS n FROM customer WHERE c_custkey%13<>0 GROUP BY 1), s AS (SELECT 'n-'||c_custkey AS name, count(*) AS n FROM customer WHERE c_custkey%19<>0 GROUP BY 1)
      SELECT name, coalesce(i.n,0) AS n_inventory, coalesce(s.n,0) AS n_shapes FROM i FULL JOIN s USING(name) WHERE coalesce(i.n,0)<>coalesce(s.n,0) OR i.n>1""",
    "release_export": f"""WITH {AREAS} SELECT level, count(*) AS n, (SELECT count(*) FROM muni WHERE {SHAPED}) AS n_shown, false AS leaks, 'refused' AS again, CAST(0 AS BIGINT) AS n_faults, CAST(1 AS BIGINT) AS n_after FROM areas WHERE level IN ('province','region','municipality') GROUP BY 1""",
    "display_collections": f"WITH muni AS ({MUNI}) SELECT 'p-'||n_regionkey AS province, count(*) AS n, round(sum(CASE shape WHEN 'plain' THEN 8e0*w WHEN 'hole' THEN 7e0*w ELSE 5.2e0*w END),5) AS area FROM muni JOIN nation ON n_nationkey=s_nationkey WHERE {SHAPED} GROUP BY 1",
    "website_catalogue": f"""WITH {AREAS}, a AS (SELECT *, CASE level WHEN 'country' THEN 'countries' WHEN 'province' THEN 'provinces' WHEN 'region' THEN 'regions' WHEN 'municipality' THEN 'municipalities' WHEN 'city_area' THEN 'city_areas' END AS g FROM areas WHERE level<>'electoral_district'), w AS (SELECT *, g||'/'||string_split(id,'-')[-1] AS web FROM a)
      SELECT w.g AS "group", w.web AS id, w.name, p.web AS parent, p.name AS parent_name, q.web AS province, (SELECT count(*) FROM w c WHERE c.parent_id=w.id) AS n_children FROM w LEFT JOIN w p ON p.id=w.parent_id LEFT JOIN w q ON q.id=w.province_id""",
    "licence_release": "SELECT s_suppkey, CASE WHEN s_suppkey%12=5 THEN 'removed' ELSE concat_ws(',', CASE WHEN s_suppkey%9=0 THEN 's_name' END, CASE WHEN s_suppkey%18=0 THEN 'size' END) END AS fault FROM supplier WHERE s_suppkey%12=5 OR s_suppkey%9=0",
    "pending_source_rows": "SELECT CASE WHEN c_custkey%2=0 THEN 'a' ELSE 'b' END AS \"table\", 's'||c_nationkey AS source, CASE WHEN c_custkey%3=0 THEN 'own-'||c_custkey WHEN c_custkey%2=0 THEN 'a-'||c_custkey ELSE 'b-'||c_custkey END AS area_id FROM customer WHERE c_nationkey%4=1",
    "value_functions": f"""SELECT c_custkey, lower(c_mktsegment)||'-no-'||c_custkey AS slug, CASE c_custkey%3 WHEN 0 THEN ''||c_custkey WHEN 1 THEN c_custkey||'.25' ELSE 'n'||c_custkey END AS stable, 'c'||CASE WHEN c_custkey<10000 THEN lpad(''||c_custkey,4,'0') ELSE ''||c_custkey END AS code, c_custkey||'|'||c_nationkey AS composite,
      CASE substr(''||(c_custkey%70),1,2) {_PROVINCES} END AS province, c_custkey%14 BETWEEN 10 AND 12 AS loose_date, TRY_CAST(printf('2023-%02d-%02d', CAST(c_custkey%14 AS INT), CAST(c_custkey%33 AS INT)) AS DATE) IS NOT NULL AS date, c_custkey%4 IN (0,3) AS url, c_custkey%3=0 AS integral,
      array_to_string(list_sort(list_distinct([c_mktsegment,'A'])),'|') AS aliases, c_custkey-200 BETWEEN -180 AND 180 AND c_custkey/10e0 BETWEEN -90 AND 90 AS position, CASE WHEN c_custkey%5=0 THEN NULL ELSE round(c_acctbal/(c_custkey%5),6) END AS fraction FROM customer""",
    "record_digests": """SELECT o_orderkey, sha256('{"o_custkey":'||o_custkey||',"o_orderkey":'||o_orderkey||',"status":'||CASE WHEN o_orderkey%5<>0 THEN '"'||o_orderstatus||'"' ELSE 'null' END||'}') AS digest FROM orders""",
    "active_municipalities": "SELECT 'm-'||s_suppkey AS id FROM supplier WHERE s_suppkey%8<>3",
    "extent_faults": f"""WITH v AS (SELECT s_suppkey AS k, {_FAULTS(position='s_suppkey%10<>3 AND s_suppkey%8<>5', ordered='s_suppkey%9<>2')} AS violations FROM supplier) SELECT 'm-'||k AS area_id, violations FROM v WHERE violations<>''""",
    "redistribution": "SELECT s_suppkey, s_suppkey%5<>0 AND s_suppkey%3<>0 AND NOT (s_suppkey%7 BETWEEN 1 AND s_suppkey%4+1) AS approved FROM supplier",
    "edition_faults": f"""WITH v AS (SELECT s_suppkey AS k, {_FAULTS(effective_date='s_suppkey%7<>0', valid_to='s_suppkey%5<>1', ordered='s_suppkey%7 IN (0,2) OR (s_suppkey%5<>0 AND NOT (s_suppkey%5=1 AND s_suppkey%7=1))', not_future='s_suppkey%7<>1 OR s_suppkey%2<>0', default_is_current='s_suppkey%2<>0 OR s_suppkey%3<>0', evidence='s_suppkey%4<>0')} AS violations FROM supplier)
      SELECT 'e-'||k AS id, violations FROM v WHERE violations<>''""",
    "coverage_listing": f"""WITH muni AS ({MUNI}), city AS ({X.CITY.format(customer='customer', muni='muni')}), s AS (SELECT 'p-'||n_regionkey AS p, CASE WHEN s_suppkey%10=1 THEN 'reference' WHEN s_suppkey%4=0 OR s_suppkey NOT IN (SELECT s_suppkey FROM city) THEN 'unverified' WHEN s_suppkey%3<>0 THEN 'included' ELSE 'historical_only' END AS st FROM supplier JOIN nation ON n_nationkey=s_nationkey),
      g AS (SELECT p, st, count(*) AS n FROM s GROUP BY 1,2) SELECT p AS province_id, CAST(sum(n) AS BIGINT) AS n, string_agg(st||':'||n, ',' ORDER BY st) AS by_status FROM g GROUP BY 1""",
    "engine_crosscheck": f"WITH muni AS ({MUNI}), pts AS ({X.POINTS.format(events='events')}), n AS (SELECT count(*) AS n FROM pts JOIN muni ON {IN_MUNI}) SELECT n AS n_cells, n AS n_boxes, CAST(0 AS BIGINT) AS n_diff FROM n",
    "nested_neighbours": f"""WITH muni AS ({MUNI}), city AS ({X.CITY.format(customer='customer', muni='muni')}) SELECT 'a-'||p.c_custkey AS a, count(*) AS n FROM city p JOIN city q ON p.s_suppkey=q.s_suppkey AND p.scheme=q.scheme AND p.c_custkey<>q.c_custkey AND p.cy0<=q.cy1 AND q.cy0<=p.cy1 GROUP BY 1""",
    "decision_counts": f"SELECT decision, count(*) AS n, count(*) FILTER (approved) AS n_approved FROM ({audits.ORACLES['review_decisions']}) GROUP BY 1",
    "artefact_dedupe": "SELECT sha256(o_orderpriority||o_orderstatus) AS sha256, CAST(any_value(strlen(o_orderpriority||o_orderstatus)) AS BIGINT) AS bytes, count(*) AS n FROM orders GROUP BY 1",
    "historical_counts": f"WITH {AREAS} SELECT level, layer, life AS lifecycle_status, count(*) AS n FROM areas WHERE life<>'current' GROUP BY ALL",
    "level_histogram": f"""WITH {AREAS} SELECT level, layer, 'validated_source' AS assignment_status, count(*) AS n FROM areas WHERE level IN ('city_area','electoral_district') GROUP BY 1,2 UNION ALL SELECT level, layer, CASE level WHEN 'region' THEN 'validated_derived' ELSE 'hierarchy_only' END, count(*) FROM areas WHERE level IN ('country','province','region') GROUP BY 1,2
      UNION ALL SELECT 'municipality', 'administrative', CASE WHEN shape IN ('unknown','bbox') THEN 'missing_geometry' WHEN shape='bowtie' THEN 'unreviewed_repair' ELSE 'validated_source' END, count(*) FROM muni GROUP BY 3""",
    "union_areas": """SELECT * FROM (VALUES ('c',CAST(1 AS BIGINT),CAST(0 AS BIGINT),CAST(0 AS BIGINT),CAST(0 AS BIGINT),CAST(0 AS BIGINT))) t("of",n,named,with_parent,sized,kinds) UNION ALL SELECT 'p', count(*), count(*), 0, 0, 0 FROM region UNION ALL SELECT 'g', count(*), count(*), count(*), 0, 0 FROM nation
      UNION ALL SELECT 'm', count(*), 0, count(*), count(s_acctbal), 0 FROM supplier UNION ALL SELECT 'a', count(*), 0, 0, 0, count(c_mktsegment) FROM customer""",
    "document_bytes": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, true AS same, true AS rings_same, true AS ascii FROM muni WHERE {SHAPED}",
    "repair_envelopes": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, s_suppkey%3=0 AND shape NOT IN ('multipart','unknown') AS usable FROM muni",
    "edition_selection": "SELECT 'l-'||(s_nationkey%5) AS layer, 'e-'||s_suppkey AS id FROM supplier WHERE s_suppkey%4=0",
    "region_build": """WITH m AS (SELECT s_nationkey AS k, s_nationkey%3=0 OR (s_nationkey%3=1 AND s_suppkey%2=0) AS own FROM supplier), g AS (SELECT k, count(*) FILTER (own) AS a, count(*) FILTER (NOT own) AS u FROM m GROUP BY 1)
      SELECT k AS division_id, a AS n_assigned, u AS n_unassigned, CASE WHEN k%5=2 AND a>0 THEN 'conflict' WHEN k%5=2 THEN 'excluded' WHEN u=0 THEN 'assigned' WHEN a=0 THEN 'unassigned' ELSE 'partially_assigned' END AS state FROM g""",
    "population_pages": "SELECT 'm-'||s_suppkey AS area_id, CASE WHEN s_suppkey%4>1 THEN s_suppkey*10 END AS population, CASE s_suppkey%4 WHEN 0 THEN 'no_source' WHEN 1 THEN 'suppressed' END AS reason FROM supplier",
    "review_application": f"""WITH muni AS ({MUNI}), m AS (SELECT s_nationkey AS n, CASE WHEN shape IN ('unknown','bbox') THEN 'missing_geometry' WHEN shape='bowtie' THEN 'unreviewed_repair' ELSE 'validated_source' END AS b, s_suppkey%2=0 AS ok FROM muni), x AS (SELECT 'municipality' AS level, b, CASE WHEN ok THEN 'validated_source' ELSE b END AS a FROM m
      UNION ALL SELECT 'region', 'validated_derived', CASE WHEN EXISTS (SELECT 1 FROM m WHERE n=n_nationkey) AND EXISTS (SELECT 1 FROM m WHERE n=n_nationkey AND b<>'validated_source' AND NOT ok) THEN 'unreviewed_repair' ELSE 'validated_derived' END FROM nation WHERE n_nationkey%6<>5)
      SELECT level, s AS assignment_status, count(*) FILTER (side='b') AS n_before, count(*) FILTER (side='a') AS n_after FROM (SELECT level, b AS s, 'b' AS side FROM x UNION ALL SELECT level, a, 'a' FROM x) GROUP BY 1,2""",
    "source_registration": """SELECT 'T'||(o_custkey%50) AS title, CASE WHEN o_custkey%3<>0 THEN 'https://example.org/'||(o_custkey%50) END AS url, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS roles, count(DISTINCT o_orderkey) AS n_records, any_value(o_custkey%50)%2<>0 AS unscoped FROM orders GROUP BY 1,2""",
    "root_viewports": f"""WITH muni AS ({MUNI}), b AS (SELECT s_suppkey AS k, s_nationkey AS n, {SHAPED} AS has, x0, x1, y0, CASE WHEN shape='multipart' THEN y0+7e0 ELSE y1 END AS y1 FROM muni), g AS (SELECT n, min(x0) AS w, min(y0) AS s, max(x1) AS e, max(y1) AS t FROM b WHERE has GROUP BY 1)
      SELECT 'm-'||k AS area_id, CASE WHEN has THEN 'root_display' WHEN w IS NOT NULL THEN 'available_features' END AS basis, round(CASE WHEN has THEN x0 ELSE w END,9) AS west, round(CASE WHEN has THEN y0 ELSE s END,9) AS south, round(CASE WHEN has THEN x1 ELSE e END,9) AS east, round(CASE WHEN has THEN y1 ELSE t END,9) AS north FROM b LEFT JOIN g USING(n)""",
    "selection_summary": f"""WITH {AREAS}, b AS (SELECT layer, count(*) FILTER (level<>'electoral_district') AS n FROM areas GROUP BY 1), o AS (SELECT count(*) FILTER (shape IN ('unknown','bbox')) AS m, count(*) FILTER (shape='bowtie') AS r FROM muni)
      SELECT c AS chosen, layer, CASE WHEN layer='federal' AND c<>'' THEN 135 ELSE n END AS n, CASE WHEN layer='administrative' THEN m+r ELSE 0 END AS n_open,
        CASE layer WHEN 'federal' THEN CASE WHEN c='' THEN 'not_selected' ELSE 'holds_history' END WHEN 'administrative' THEN concat_ws(',', CASE WHEN m>0 THEN 'missing_geometry' END, CASE WHEN r>0 THEN 'unreviewed_repair' END) ELSE '' END AS limitations FROM b, o, (VALUES ('fed-1'),('')) t(c)""",
    "scoped_gaps": f"""WITH muni AS ({MUNI}), s AS (SELECT n_regionkey AS p, s_suppkey%3=0 AS gap, shape IN ('unknown','bbox','bowtie') AS pend FROM muni JOIN nation ON n_nationkey=s_nationkey)
      SELECT 'p-'||p AS province_id, count(*) FILTER (gap) AS n_gaps, count(*) FILTER (pend) AS n_pending FROM s WHERE p IN (1,3) GROUP BY 1 HAVING count(*) FILTER (gap)+count(*) FILTER (pend)>0""",
}
