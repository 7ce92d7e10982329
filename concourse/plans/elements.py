"""Queries of the element operators; parts stand for elements, their sizes and types for the facts about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import elements, joins
from ..registry import query
from ..sources import views
from ..sources.views import table, with_views
from .geometry import POINTS, r6


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_brand", F.col("p_size").alias("size"))


ROOT = "WITH RECURSIVE e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 97 = 0 THEN p_partkey WHEN p_partkey > 2 THEN p_partkey // 3 END AS parent_id, CASE WHEN p_size % 9 = 0 THEN p_size END AS level_id FROM part), "


@query("elm3", ROOT + """up AS (SELECT id, id AS at, 0 AS depth FROM e UNION ALL SELECT up.id, k.parent_id, depth + 1 FROM up JOIN e k ON k.id = up.at WHERE k.level_id IS NULL AND k.parent_id IS NOT NULL AND k.parent_id <> k.id)
    SELECT up.id, k.level_id, depth FROM up JOIN e k ON k.id = up.at WHERE k.level_id IS NOT NULL""")
def elm3(spark: SparkSession, d: str) -> DataFrame:
    """Levels inherited from ancestors; every 97th element is its own parent, a cycle."""
    p = parts(spark, d)
    parent = F.when(F.col("id") % 97 == 0, F.col("id")).when(F.col("id") > 2, F.expr("id div 3"))
    return elements.inherited_levels(p.select("id", parent.alias("parent_id")), p.select("id", F.when(F.col("size") % 9 == 0, F.col("size")).alias("level_id")))


@query("elm4", with_views("v_cells") + """SELECT building_id, space_id AS id, coalesce(nullif(trim(CASE WHEN space_id LIKE '%1' THEN ' ' ELSE space_id END), ''), 'guid:' || min(id)) AS name,
    (min(least(x1, x2, x3)) + max(greatest(x1, x2, x3))) / 2 AS cx, (min(least(y1, y2, y3)) + max(greatest(y1, y2, y3))) / 2 AS cy, bool_or(terrain = 'stair') AS is_external FROM v_cells GROUP BY 1, 2""")
def elm4(spark: SparkSession, d: str) -> DataFrame:
    """Spaces with a name from a chain of fallbacks and the centre of their box."""
    s = boxes(spark, d).withColumn("long_name", F.when(F.col("space_id").endswith("1"), " ").otherwise(F.col("space_id"))).withColumn("guid", F.concat(F.lit("guid:"), "ordinal"))
    return s.select("building_id", F.col("space_id").alias("id"), elements.first_of("long_name", "guid").alias("name"), ((F.col("lx") + F.col("hx")) / 2).alias("cx"), ((F.col("ly") + F.col("hy")) / 2).alias("cy"), "is_external")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the spaces of the cells."""
    low, high = (lambda k: F.min(F.least(*[f"{k}{i}" for i in (1, 2, 3)]))), (lambda k: F.max(F.greatest(*[f"{k}{i}" for i in (1, 2, 3)])))
    return views.cells(spark, d).groupBy("building_id", "space_id").agg(F.min("id").alias("ordinal"), low("x").alias("lx"), low("y").alias("ly"), high("x").alias("hx"), high("y").alias("hy"), F.bool_or(F.col("terrain") == "stair").alias("is_external"))


@query("elm5", "SELECT element_id, count(*) AS n_spaces, max(CASE WHEN out THEN 1 ELSE 0 END) = 1 AS is_external FROM (SELECT l_partkey AS element_id, l_suppkey AS space_id, bool_or(l_returnflag = 'R') AS out FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def elm5(spark: SparkSession, d: str) -> DataFrame:
    """Spaces that each element bounds, over three kinds of relations, and whether it bounds the outside."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("element_id"), F.col("l_suppkey").alias("space_id"), F.when(F.col("l_returnflag") == "R", "EXTERNAL").otherwise("INTERNAL").alias("kind"), "l_returnflag")
    bounds, outer = elements.boundary_map(*[rows.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in "ANR"])
    counted = bounds.groupBy("element_id").agg(F.count("*").alias("n_spaces"))
    return counted.join(outer.withColumn("is_external", F.lit(True)), "element_id", "left").fillna({"is_external": False})


@query("elm6", "SELECT DISTINCT p_partkey AS door_id, unnest([p_partkey, l_orderkey]) AS element_id FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size % 4 = 0 AND l_linenumber = 1 UNION SELECT p_partkey, p_partkey FROM part WHERE p_size % 4 = 0")
def elm6(spark: SparkSession, d: str) -> DataFrame:
    fills = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("element_id"), F.col("l_orderkey").alias("opening_id"))
    return elements.related(parts(spark, d).where("size % 4 = 0"), fills)


DOOR = "sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z))"


@query("elm7", POINTS + f""", a AS (SELECT id AS door_id, id % 7 + k AS space_id, k AS ordinal FROM v_points, (SELECT unnest([0, 1, 2]) AS k) WHERE id % 20 = 0),
    n AS (SELECT p.id AS door_id, q.id % 11 AS space_id, min({DOOR}) AS d FROM v_points p JOIN v_points q ON p.building_id = q.building_id WHERE p.id % 10 = 0 AND p.id % 20 <> 0 AND q.id % 10 <> 0 AND {DOOR} <= 1.5 GROUP BY 1, 2)
    SELECT * FROM (SELECT door_id, space_id, row_number() OVER (PARTITION BY door_id ORDER BY ordinal, space_id) AS rank, 'authored' AS how FROM a UNION ALL SELECT door_id, space_id, row_number() OVER (PARTITION BY door_id ORDER BY d, space_id), 'near' FROM n) WHERE rank <= 2""")
def elm7(spark: SparkSession, d: str) -> DataFrame:
    """Spaces of doors: authored ones for every other door, the nearest within 1.5 m for the rest."""
    p = views.points(spark, d)
    authored = p.where("id % 20 = 0").select(F.col("id").alias("door_id"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("ordinal")).withColumn("space_id", F.col("door_id") % 7 + F.col("ordinal"))
    near = joins.near_pairs(p.where("id % 10 = 0"), p.where("id % 10 <> 0"), 1.5).groupBy(F.col("left_id").alias("door_id"), (F.col("right_id") % 11).alias("space_id")).agg(F.min("d").alias("d"))
    return elements.door_sides(authored, near)


@query("elm9", "SELECT p_partkey AS id FROM part WHERE p_size % 5 = 0 UNION SELECT p_partkey FROM part a WHERE p_size % 5 = 1 AND NOT EXISTS (SELECT 1 FROM part f WHERE f.p_size % 5 = 0 AND f.p_partkey // 4 = a.p_partkey)")
def elm9(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return elements.walked_elements(p.where("size % 5 = 0"), p.where("size % 5 = 1"), p.select(F.expr("id div 4").alias("assembly_id"), F.col("id").alias("part_id")))


@query("elm10", "SELECT DISTINCT p_partkey AS id, p_type AS class FROM part JOIN lineitem ON l_partkey = p_partkey WHERE split_part(p_type, ' ', 1) IN ('STANDARD', 'SMALL', 'ECONOMY')")
def elm10(spark: SparkSession, d: str) -> DataFrame:
    """Elements of the classes that stand fixed, each once."""
    fixed = parts(spark, d).where(F.split("p_type", " ")[0].isin("STANDARD", "SMALL", "ECONOMY"))
    return fixed.join(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), "id", "left_semi").select("id", F.col("p_type").alias("class")).distinct()


BOX = "b AS (SELECT building_id, space_id, min(id) AS ordinal, min(least(x1, x2, x3)) AS lx, min(least(y1, y2, y3)) AS ly, max(greatest(x1, x2, x3)) AS hx, max(greatest(y1, y2, y3)) AS hy FROM v_cells GROUP BY 1, 2)"


@query("elm11", with_views("v_cells", "v_points") + ", " + BOX + """SELECT b.building_id, p.id AS point_id, arg_min(space_id, (ordinal, space_id)) AS space_id FROM v_points p JOIN b ON b.building_id = p.building_id % 4
    AND p.x + 8 BETWEEN lx - 0.15 AND hx + 0.15 AND p.y + 8 BETWEEN ly - 0.15 AND hy + 0.15 GROUP BY 1, 2""")
def elm11(spark: SparkSession, d: str) -> DataFrame:
    p = views.points(spark, d).select((F.col("building_id") % 4).alias("building_id"), "id", (F.col("x") + 8).alias("x"), (F.col("y") + 8).alias("y"))
    return elements.space_of_points(p, boxes(spark, d), 0.15, 4.0)


@query("elm12", "SELECT l_suppkey AS space_id, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity / 10 > s_suppkey % 3 + 0.05 AND l_discount * 40 < s_suppkey % 3 + 1.8 - 0.05")
def elm12(spark: SparkSession, d: str) -> DataFrame:
    obstacles = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("space_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_discount") * 40).alias("z_min"), (F.col("l_quantity") / 10).alias("z_max"))
    return elements.in_pedestrian_volume(obstacles, table(spark, d, "supplier").select(F.col("s_suppkey").alias("space_id"), (F.col("s_suppkey") % 3).cast("double").alias("floor_z")), 1.8)


@query("elm13", "SELECT p_size AS building_id, p_partkey AS id FROM part s WHERE p_brand <> 'Brand#11' AND NOT EXISTS (SELECT 1 FROM part f WHERE f.p_size = s.p_size AND f.p_partkey % 60 = 0)")
def elm13(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d).withColumn("building_id", F.col("size"))
    return elements.slabs_as_floor(p.withColumn("kind", F.when(F.col("p_brand") == "Brand#11", "ROOF")), p.where("id % 60 = 0"))


@query("jn9", POINTS + f""", n AS (SELECT p.building_id, p.id, q.id % 7 AS space_id, min({DOOR}) AS d FROM v_points p JOIN v_points q ON p.building_id = q.building_id WHERE p.id % 50 = 0 AND q.id % 50 <> 0 GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY building_id, id ORDER BY d, space_id) AS k FROM n) SELECT building_id, id AS door_id, space_id, round(d, 6) AS d, k AS rank FROM r WHERE k <= 4""")
def jn9(spark: SparkSession, d: str) -> DataFrame:
    """The four nearest spaces of each door, however far."""
    p = views.points(spark, d)
    near = joins.nearest_owners(p.where("id % 50 = 0"), p.where("id % 50 <> 0").withColumn("owner", F.col("id") % 7), 4, 2.0)
    return near.select("building_id", F.col("left_id").alias("door_id"), F.col("owner").alias("space_id"), r6(F.col("d")).alias("d"), "rank")


LEVEL = with_views("v_spaces", "v_levels", "v_transitions")
LANDED = LEVEL + """, m AS (SELECT building_id, id % 7 AS component, id FROM v_spaces WHERE id % 3 = 0), k AS (SELECT t.building_id, from_id AS id, to_id AS space_id, level_id, abs(from_id - to_id) AS d FROM v_transitions t JOIN v_spaces s ON s.id = to_id AND s.building_id = t.building_id),
    f AS (SELECT m.building_id, component, level_id, arg_min(space_id, (d, space_id)) AS space_id FROM m JOIN k USING (building_id, id) GROUP BY 1, 2, 3) """


def landed(spark: SparkSession, d: str) -> DataFrame:
    s = views.spaces(spark, d)
    to = s.select("building_id", F.col("id").alias("to_id"), "level_id")
    links = views.transitions(spark, d).join(to, ["building_id", "to_id"]).select("building_id", F.col("from_id").alias("id"), F.col("to_id").alias("space_id"), "level_id", F.abs(F.col("from_id") - F.col("to_id")).alias("d"))
    return elements.landings(s.where("id % 3 = 0").select("building_id", (F.col("id") % 7).alias("component"), "id"), links)


@query("gr7", LANDED + "SELECT building_id, component, level_id, space_id FROM f")
def gr7(spark: SparkSession, d: str) -> DataFrame:
    return landed(spark, d)


@query("gr8", LANDED + f", v_open AS ({views.SQL['v_open']})" + """, o AS (SELECT f.building_id, component, space_id AS from_space_id, lead(space_id) OVER (PARTITION BY f.building_id, component ORDER BY elevation_m, level_id) AS to_space_id FROM f JOIN v_levels l ON l.id = f.level_id AND l.building_id = f.building_id)
    SELECT * FROM o WHERE to_space_id <> from_space_id AND NOT EXISTS (SELECT 1 FROM v_open t WHERE t.building_id = o.building_id AND ((from_id = from_space_id AND to_id = to_space_id) OR (to_id = from_space_id AND from_id = to_space_id)))""")
def gr8(spark: SparkSession, d: str) -> DataFrame:
    linked = views.open_transitions(spark, d).select("building_id", F.col("from_id").alias("from_space_id"), F.col("to_id").alias("to_space_id"))
    return elements.between_levels(landed(spark, d), views.levels(spark, d), linked)
