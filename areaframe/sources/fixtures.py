"""The reference geography that the supplied tables imply.

Areas, polygons, points and facts are derived from the tables with SQL; nothing is made up
beside them except the grid of the federal districts, which covers their extent. The texts of
``MUNI``, ``CITY``, ``POINTS`` and the grids run in Spark and in DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaframe.functions.geometry import box_rings

MUNI = """SELECT s_suppkey, s_nationkey, k, cnt, x0, x1, y0, y0+8e0 AS y1, x1-x0 AS w,
  CASE WHEN s_suppkey%17=5 THEN 'unknown' WHEN s_suppkey%13=4 THEN 'bbox' WHEN s_suppkey%11=3 THEN 'bowtie'
       WHEN s_suppkey%5=1 THEN 'multipart' WHEN s_suppkey%7=0 THEN 'hole' ELSE 'plain' END AS shape
 FROM (SELECT s_suppkey, s_nationkey, k, cnt, -130e0+(s_nationkey%5)*13e0+13e0*k/cnt AS x0,
         -130e0+(s_nationkey%5)*13e0+13e0*(k+1)/cnt AS x1, CAST(42e0+floor(s_nationkey/5)*8e0 AS DOUBLE) AS y0
       FROM (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)-1 AS k,
               count(*) OVER (PARTITION BY s_nationkey) AS cnt FROM {supplier}) a) b"""

CITY = """SELECT c_custkey, s_suppkey, scheme, x0, x1, y0+8e0*j/jj AS cy0, y0+8e0*(j+1)/jj AS cy1 FROM (
   SELECT c_custkey, s_suppkey, scheme, x0, x1, y0, row_number() OVER (PARTITION BY s_suppkey, scheme ORDER BY c_custkey)-1 AS j,
     count(*) OVER (PARTITION BY s_suppkey, scheme) AS jj FROM (
     SELECT c.c_custkey, m.s_suppkey, m.x0, m.x1, m.y0, CASE WHEN c.c_custkey%3<>0 THEN 'default' ELSE 'alt' END AS scheme
     FROM {customer} c JOIN {muni} m ON m.s_nationkey=c.c_nationkey AND m.k=c.c_custkey%m.cnt) s) r"""

#: The join of CITY by equal keys: a customer's place among the municipalities of its nation is known before
#: they meet. As CITY states it, only the nation is a key, and every customer meets every municipality of it.
_PLACED = """(SELECT /*+ BROADCAST(n) */ c.c_custkey, c.c_nationkey, c.c_custkey%n.cnt AS k
  FROM {customer} c JOIN (SELECT s_nationkey, count(*) AS cnt FROM {muni} GROUP BY s_nationkey) n ON n.s_nationkey=c.c_nationkey)"""
CITY_BY_PLACE = CITY.replace("FROM {customer} c JOIN {muni} m ON m.s_nationkey=c.c_nationkey AND m.k=c.c_custkey%m.cnt", f"FROM {_PLACED} c JOIN {{muni}} m ON m.s_nationkey=c.c_nationkey AND m.k=c.k")

POINTS = """SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id%50=0 THEN -130e0+(event_id%6)*13e0 ELSE -131e0+((event_id*7919)%67000)/1000e0 END AS x,
  CASE WHEN event_id%70=0 THEN 42e0+(event_id%6)*8e0 ELSE 41e0+((event_id*104729)%42000)/1000e0 END AS y
  FROM {events}"""

GRIDS = {"fed-2": ("f2", 4, 17, 10, "current"), "fed-1": ("f1", 5, 14, 8, "historical")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MUNI, supplier=table(spark, sf_dir, "supplier"))


def city_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CITY_BY_PLACE, customer=table(spark, sf_dir, "customer"), muni=municipalities(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each event: point_id, ts, event_type, x, y."""
    return spark.sql(POINTS, events=table(spark, sf_dir, "events")).withColumnRenamed("event_id", "point_id")


_PLAIN = f"array({box_rings('x0', 'y0', 'x1', 'y1')})"
_HOLE = f"array({box_rings('x0', 'y0', 'x1', 'y1')}, {box_rings('x0+.25D*w', 'y0+2D', 'x0+.75D*w', 'y0+4D', 0, 1)})"
_MULTI = f"array({box_rings('x0', 'y0', 'x1', 'y0+5D')}, {box_rings('x0+.4D*w', 'y0+6D', 'x0+.6D*w', 'y0+7D', 1)})"
_BOWTIE = "array(named_struct('part', 0, 'ring', 0, 'pts', array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in (("x0", "y0"), ("x1", "y1"), ("x1", "y0"), ("x0", "y1"), ("x0", "y0"))) + ")))"
_STRIP = f"array({box_rings('x1-.1D*w', 'y0', 'x1', 'y1')})"


def municipal_geometry(muni: DataFrame) -> DataFrame:
    """area_id, role, rings: assignment, candidate, bbox and review geometry of the municipalities."""
    role = F.expr("CASE shape WHEN 'unknown' THEN NULL WHEN 'bbox' THEN 'bbox' WHEN 'bowtie' THEN 'candidate' ELSE 'assignment' END")
    rings = F.expr(f"CASE shape WHEN 'plain' THEN {_PLAIN} WHEN 'bbox' THEN {_PLAIN} WHEN 'hole' THEN {_HOLE} WHEN 'multipart' THEN {_MULTI} WHEN 'bowtie' THEN {_BOWTIE} END")
    name = F.concat(F.lit("m-"), F.col("s_suppkey").cast("string")).alias("area_id")
    main = muni.select(name, role.alias("role"), rings.alias("rings")).where("role IS NOT NULL")
    strip = muni.where("s_suppkey % 19 = 6 AND shape IN ('plain', 'hole', 'multipart')")
    return main.unionByName(strip.select(name, F.lit("review").alias("role"), F.expr(_STRIP).alias("rings")))


def city_geometry(city: DataFrame) -> DataFrame:
    return city.select(F.concat(F.lit("a-"), F.col("c_custkey").cast("string")).alias("area_id"), F.lit("assignment").alias("role"), F.expr(f"array({box_rings('x0', 'cy0', 'x1', 'cy1')})").alias("rings"))


def federal_geometry(spark: SparkSession, edition: str) -> DataFrame:
    name, step, nx, ny, _ = GRIDS[edition]
    cells = spark.range(nx + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(ny))).alias("j"))
    boxes = cells.select("i", "j", F.expr(f"-132D + {step}D * i AS x0"), F.expr(f"40D + {step}D * j AS y0"))
    return boxes.select(F.format_string(f"{name}-%d-%d", "i", "j").alias("area_id"), F.lit("assignment").alias("role"), F.expr(f"array({box_rings('x0', 'y0', f'x0 + {step}D', f'y0 + {step}D')})").alias("rings"), "i", "j")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity rows of every level."""
    region, nation, muni, city = (table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), municipalities(spark, sf_dir), city_slices(spark, sf_dir))
    s = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, id_, name, level, rank, layer, parent, province, scheme=none, edition=none, status=F.lit("hierarchy_only"), life=F.lit("current")) -> DataFrame:
        return df.select(
            id_.alias("id"), name.alias("name"), F.lit(level).alias("level"), F.lit(rank).alias("level_rank"), F.lit(layer).alias("layer"), parent.alias("parent_id"),
            province.alias("province_id"), scheme.alias("scheme"), edition.alias("edition"), status.alias("assignment_status"), life.alias("lifecycle_status"),
        )

    country = rows(spark.range(1), F.lit("c"), F.lit("Country"), "country", 0, "shared", none, none)
    provinces = rows(region, F.concat(F.lit("p-"), s("r_regionkey")), F.col("r_name"), "province", 1, "shared", F.lit("c"), F.concat(F.lit("p-"), s("r_regionkey")))
    prov = F.concat(F.lit("p-"), s("n_regionkey"))
    regions = rows(nation.where("n_nationkey % 6 <> 5"), F.concat(F.lit("g-"), s("n_nationkey")), F.col("n_name"), "region", 2, "administrative", prov, prov, status=F.lit("validated_derived"))
    m = muni.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    parent = F.when(F.col("n_nationkey") % 6 != 5, F.concat(F.lit("g-"), s("n_nationkey"))).otherwise(prov)
    status = F.when(F.col("shape").isin("unknown", "bbox"), "missing_geometry").when(F.col("shape") == "bowtie", "unreviewed_repair").otherwise("validated_source")
    munis = rows(m, F.concat(F.lit("m-"), s("s_suppkey")), F.concat(F.lit("Municipalité "), s("s_suppkey")), "municipality", 3, "administrative", parent, prov, status=status)
    c = city.join(m.select("s_suppkey", "n_regionkey"), "s_suppkey")
    cities = rows(c, F.concat(F.lit("a-"), s("c_custkey")), F.concat(F.lit("Area "), s("c_custkey")), "city_area", 4, "administrative", F.concat(F.lit("m-"), s("s_suppkey")), prov, scheme=F.col("scheme"), status=F.lit("validated_source"))
    out = country.unionByName(provinces).unionByName(regions).unionByName(munis).unionByName(cities)
    for edition, (_, _, _, _, life) in GRIDS.items():
        d = federal_geometry(spark, edition)
        p = F.concat(F.lit("p-"), (F.col("i") % 5).cast("string"))
        out = out.unionByName(rows(d, F.col("area_id"), F.concat(F.lit("District "), F.col("area_id")), "electoral_district", 5, "federal", p, p, edition=F.lit(edition), status=F.lit("validated_source"), life=F.lit(life)))
    return out
