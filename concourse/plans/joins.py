"""Queries of the spatial, semantic and temporal joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins
from ..registry import query
from ..sources import views
from ..sources.views import with_views
from .geometry import EDGES3, POINTS, r6

DIST = "sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z))"
LINKS = EDGES3 + """, h AS (SELECT building_id, key, min(id) AS a, max(id) AS b FROM u GROUP BY 1, 2 HAVING count(*) = 2),
    links AS (SELECT DISTINCT h.building_id, a, b FROM h JOIN v_cells p ON p.id = a JOIN v_cells q ON q.id = b WHERE NOT (p.space_id <> q.space_id AND p.terrain = 'open' AND q.terrain = 'open')) """


@query(
    "jn1",
    POINTS + f""", d AS (SELECT p.building_id, p.id AS i, q.id AS j, {DIST} AS d FROM v_points p JOIN v_points q ON p.building_id = q.building_id AND p.id <> q.id WHERE {DIST} <= 1.25 AND {DIST} > 1e-9),
    r AS (SELECT *, row_number() OVER (PARTITION BY building_id, i ORDER BY d, j) AS k FROM d) SELECT building_id, least(i, j) AS a, greatest(i, j) AS b, round(min(d), 6) AS d FROM r WHERE k <= 8 GROUP BY 1, 2, 3""",
)
def jn1(spark: SparkSession, d: str) -> DataFrame:
    return joins.radius_edges(views.points(spark, d), 1.25, 8).withColumn("d", r6(F.col("d")))


@query(
    "jn2",
    POINTS + f""", d AS (SELECT p.building_id, p.id AS i, q.id AS j, {DIST} AS d FROM v_points p JOIN v_points q ON p.building_id = q.building_id AND p.id <> q.id WHERE {DIST} <= 1.0 AND {DIST} > 1e-9 AND NOT (p.id % 3 = 0 AND q.id % 3 = 0)),
    r AS (SELECT *, row_number() OVER (PARTITION BY building_id, i ORDER BY d, j) AS k FROM d) SELECT building_id, least(i, j) AS a, greatest(i, j) AS b, round(min(d), 6) AS d FROM r WHERE k <= 3 GROUP BY 1, 2, 3""",
)
def jn2(spark: SparkSession, d: str) -> DataFrame:
    """The radius join with a rule for pairs: no link between two ids divisible by three."""
    return joins.radius_edges(views.points(spark, d), 1.0, 3, lambda a, b: ~(a & b), F.col("id") % 3 == 0).withColumn("d", r6(F.col("d")))


@query(
    "jn3_boxes",
    with_views("v_cells") + """, s AS (SELECT building_id, id AS segment_id, x1 + 0.1 AS ax, y1 + 0.1 AS ay, x1 + 1.6 AS bx, y1 + 0.7 AS vy FROM v_cells WHERE id % 2 = 0), o AS (SELECT building_id, id AS box_id, x3 + 0.2 AS lx, y1 + 0.2 AS ly, x3 + 0.9 AS hx, y1 + 0.8 AS hy FROM v_cells WHERE id % 14 = 1),
    c AS (SELECT s.building_id, segment_id, box_id, greatest(0, least((hx - ax) / (bx - ax), (hy - ay) / (vy - ay), 1.0) - greatest((lx - ax) / (bx - ax), (ly - ay) / (vy - ay), 0.0)) * sqrt((bx-ax)*(bx-ax) + (vy-ay)*(vy-ay)) AS o FROM s JOIN o ON s.building_id = o.building_id)
    SELECT building_id, segment_id, box_id, round(o, 5) AS overlap_m FROM c WHERE o > 0.02""",
)
def jn3_boxes(spark: SparkSession, d: str) -> DataFrame:
    c = views.cells(spark, d)
    s = c.where("id % 2 = 0").select("building_id", F.col("id").alias("segment_id"), (F.col("x1") + 1.6).alias("x2"), (F.col("y1") + 0.7).alias("y2"), (F.col("x1") + 0.1).alias("x1"), (F.col("y1") + 0.1).alias("y1"))
    b = c.where("id % 14 = 1").select("building_id", F.col("id").alias("box_id"), (F.col("x3") + 0.2).alias("lx"), (F.col("y1") + 0.2).alias("ly"), (F.col("x3") + 0.9).alias("hx"), (F.col("y1") + 0.8).alias("hy"))
    return joins.segments_crossing(s, b).withColumn("overlap_m", F.round("overlap_m", 5))


@query("jn4", LINKS + "SELECT building_id, a, b FROM links")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    return joins.shared_sides(views.cells(spark, d))


@query("jn5_sides", EDGES3 + "SELECT building_id, count(*) AS n_sides, count(DISTINCT id) AS n_cells FROM (SELECT building_id, key, min(id) AS id FROM u GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1")
def jn5_sides(spark: SparkSession, d: str) -> DataFrame:
    """Boundary sides, which the seam join starts from."""
    return joins.boundary_sides(views.cells(spark, d)).groupBy("building_id").agg(F.count("*").alias("n_sides"), F.countDistinct("id").alias("n_cells"))


@query(
    "jn7",
    POINTS + f""", n AS (SELECT p.building_id, p.id, q.id % 7 AS space_id, min({DIST}) AS d FROM v_points p JOIN v_points q ON p.building_id = q.building_id WHERE p.id % 10 = 0 AND q.id % 10 <> 0 AND {DIST} <= 2.5 GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY building_id, id ORDER BY d, space_id) AS k FROM n) SELECT building_id, id AS door_id, space_id, round(d, 6) AS d, k AS rank FROM r WHERE k <= 2""",
)
def jn7(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest spaces of each door, by the least distance to a point of the space."""
    p = views.points(spark, d)
    near = joins.near_pairs(p.where("id % 10 = 0"), p.where("id % 10 <> 0"), 2.5)
    by_space = near.groupBy("building_id", F.col("left_id").alias("door_id"), (F.col("right_id") % 7).alias("space_id")).agg(F.min("d").alias("d"))
    order = Window.partitionBy("building_id", "door_id").orderBy("d", "space_id")
    return by_space.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 2").withColumn("d", r6(F.col("d")))


@query("jn8", with_views("v_spaces", "v_portals", "v_transitions") + "SELECT t.building_id, t.from_id, t.to_id, coalesce(p.to_space_id, t.to_id) AS new_to_id, s.level_id AS to_level_id FROM v_transitions t LEFT JOIN v_portals p ON p.from_space_id = t.from_id AND p.building_id = t.building_id LEFT JOIN v_spaces s ON s.id = coalesce(p.to_space_id, t.to_id)")
def jn8(spark: SparkSession, d: str) -> DataFrame:
    """Sides of repaired doors carried over to the transitions that use them."""
    p = views.portals(spark, d).select("building_id", F.col("from_space_id").alias("from_id"), "to_space_id")
    t = views.transitions(spark, d).join(p, ["building_id", "from_id"], "left").withColumn("new_to_id", F.coalesce("to_space_id", "to_id"))
    s = views.spaces(spark, d).select(F.col("id").alias("new_to_id"), F.col("level_id").alias("to_level_id"))
    return t.join(s, "new_to_id", "left").select("building_id", "from_id", "to_id", "new_to_id", "to_level_id")


@query(
    "jn11",
    with_views("v_points", "v_cells") + """, p AS (SELECT building_id, id, x + 10 AS x, y + 10 AS y FROM v_points), s AS (SELECT p.building_id, p.id AS point_id, c.id AS cell_id, (x2-x1)*(y-y1)-(y2-y1)*(x-x1) AS a, (x3-x2)*(y-y2)-(y3-y2)*(x-x2) AS b, (x1-x3)*(y-y3)-(y1-y3)*(x-x3) AS c FROM p JOIN v_cells c USING (building_id))
    SELECT building_id, point_id, min(cell_id) AS cell_id FROM s WHERE (a >= -1e-9 AND b >= -1e-9 AND c >= -1e-9) OR (a <= 1e-9 AND b <= 1e-9 AND c <= 1e-9) GROUP BY 1, 2""",
)
def jn11(spark: SparkSession, d: str) -> DataFrame:
    p = views.points(spark, d).select("building_id", "id", (F.col("x") + 10).alias("x"), (F.col("y") + 10).alias("y"))
    return joins.locate(p, views.cells(spark, d))


NEAR = "{0}, n AS (SELECT p.building_id, p.id AS point_id, q.id AS near_id, {1} AS d FROM v_points p JOIN v_points q ON p.building_id = q.building_id AND p.id <> q.id WHERE {2} AND {1} <= {3}), r AS (SELECT *, row_number() OVER (PARTITION BY building_id, point_id ORDER BY d, near_id) AS k FROM n) SELECT building_id, point_id, near_id, round(d, 6) AS d FROM r WHERE k <= {4}"


@query("jn15", NEAR.format(POINTS, DIST, "true", 3.0, 1))
def jn15(spark: SparkSession, d: str) -> DataFrame:
    p = views.points(spark, d)
    return joins.radius_nearest(p, p, 3.0, 1).withColumn("d", r6(F.col("d")))


@query("jn16", NEAR.format(POINTS, DIST, "q.id % 10 = 0", 2.0, 1))
def jn16(spark: SparkSession, d: str) -> DataFrame:
    p = views.points(spark, d)
    return joins.radius_nearest(p, p.where("id % 10 = 0"), 2.0, 1).withColumn("d", r6(F.col("d")))


DOORS = POINTS + f""", dn AS (SELECT p.building_id, p.id AS point_id, q.id AS near_id, q.id % 7 AS space_id, q.id % 7 IN (p.id // 20 % 7, (p.id // 20 + 3) % 7) AS open, {DIST} AS d FROM v_points p JOIN v_points q ON p.building_id = q.building_id WHERE p.id % 20 = 0 AND q.id % 20 <> 0),
    near AS (SELECT building_id, point_id, near_id, d FROM (SELECT *, row_number() OVER (PARTITION BY building_id, point_id, space_id ORDER BY d, near_id) AS k FROM dn WHERE open AND d <= 2.5) WHERE k <= 3),
    far AS (SELECT building_id, point_id, near_id, d FROM (SELECT *, row_number() OVER (PARTITION BY building_id, point_id ORDER BY d, near_id) AS k FROM dn x WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.building_id = x.building_id AND n.point_id = x.point_id)) WHERE k <= 6) """


@query("jn17", DOORS + "SELECT building_id, point_id, near_id, round(d, 6) AS d FROM (SELECT * FROM near UNION ALL SELECT * FROM far)")
def jn17(spark: SparkSession, d: str) -> DataFrame:
    """Doors attached to the nodes of the two spaces that they connect, else to the nearest six."""
    p = views.points(spark, d)
    number = F.expr("id div 20")
    doors = p.where("id % 20 = 0").withColumn("spaces", F.array(number % 7, (number + 3) % 7))
    return joins.attached(doors, p.where("id % 20 <> 0").withColumn("space_id", F.col("id") % 7)).withColumn("d", r6(F.col("d")))


@query("jn18", with_views("v_spaces", "v_portals", "v_transitions", "v_open") + "SELECT p.building_id, 'transition:' || p.id AS id, p.from_space_id, p.to_space_id, s.level_id AS from_level_id, t.level_id AS to_level_id FROM v_portals p LEFT JOIN v_spaces s ON s.id = p.from_space_id LEFT JOIN v_spaces t ON t.id = p.to_space_id WHERE NOT EXISTS (SELECT 1 FROM v_open x WHERE x.from_id = p.from_space_id AND x.building_id = p.building_id)")
def jn18(spark: SparkSession, d: str) -> DataFrame:
    """A transition for each door that none names yet."""
    s = views.spaces(spark, d)
    p = views.portals(spark, d).join(views.open_transitions(spark, d).select("building_id", F.col("from_id").alias("from_space_id")), ["building_id", "from_space_id"], "left_anti")
    level = lambda side: s.select(F.col("id").alias(f"{side}_space_id"), F.col("level_id").alias(f"{side}_level_id"))
    out = p.join(level("from"), "from_space_id", "left").join(level("to"), "to_space_id", "left")
    return out.select("building_id", F.concat(F.lit("transition:"), "id").alias("id"), "from_space_id", "to_space_id", "from_level_id", "to_level_id")


@query("jn20", with_views("v_spaces", "v_transitions") + "SELECT p.building_id, p.from_id AS space_id, p.to_id AS a, q.to_id AS b FROM v_transitions p JOIN v_transitions q ON p.building_id = q.building_id AND p.from_id = q.from_id AND p.to_id < q.to_id")
def jn20(spark: SparkSession, d: str) -> DataFrame:
    t = views.transitions(spark, d).select("building_id", F.col("from_id").alias("space_id"), F.col("to_id").alias("a"))
    return t.join(t.withColumnRenamed("a", "b"), ["building_id", "space_id"]).where("a < b")


@query(
    "jn21",
    with_views("v_frames") + """, f AS (SELECT run_id, time_s, frame_no, value AS v0, lead(time_s) OVER w AS t1, lead(value) OVER w AS v1 FROM v_frames WINDOW w AS (PARTITION BY run_id ORDER BY time_s, frame_no)),
    g AS (SELECT DISTINCT run_id, CAST(h AS DOUBLE) AS t FROM v_frames, (SELECT unnest(generate_series(0, 82800, 3600)) AS h)), m AS (SELECT g.run_id, g.t, f.*, row_number() OVER (PARTITION BY g.run_id, g.t ORDER BY time_s DESC, frame_no DESC) AS k FROM g JOIN f ON f.run_id = g.run_id AND f.time_s <= g.t)
    SELECT run_id, t, round(CASE WHEN t1 IS NULL OR t1 <= time_s THEN v0 ELSE v0 + (t - time_s) / (t1 - time_s) * (v1 - v0) END, 5) AS value FROM m WHERE k = 1""",
)
def jn21(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames(spark, d)
    times = f.select("run_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(82800), F.lit(3600)))).withColumn("t", F.col("t").cast("double"))
    return joins.as_of(f, times, ("run_id",), "value").withColumn("value", F.round("value", 5))


@query("jn22", with_views("v_spaces") + "SELECT a.building_id, a.id AS agent_id, e.id AS exit_id FROM v_spaces a JOIN v_spaces e ON a.building_id = e.building_id WHERE NOT a.is_exit AND e.is_exit AND e.id % 4 <> 0")
def jn22(spark: SparkSession, d: str) -> DataFrame:
    s = views.spaces(spark, d)
    blocked = s.where("id % 4 = 0").select("building_id", F.col("id").alias("exit_id"))
    exits = s.where("is_exit").select("building_id", F.col("id").alias("exit_id")).join(blocked, ["building_id", "exit_id"], "left_anti")
    return s.where("not is_exit").select("building_id", F.col("id").alias("agent_id")).join(exits, "building_id")


@query("jn23", with_views("v_spaces", "v_nodes", "v_transitions", "v_node_edges") + "SELECT building_id, count(*) AS n_known FROM v_node_edges e WHERE EXISTS (SELECT 1 FROM v_nodes n WHERE n.id = e.a AND n.building_id = e.building_id) AND NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.id = e.b AND n.kind = 'stair' AND n.building_id = e.building_id) GROUP BY 1")
def jn23(spark: SparkSession, d: str) -> DataFrame:
    e, n = views.node_edges(spark, d), views.nodes(spark, d)
    known = e.join(n.select("building_id", F.col("id").alias("a")), ["building_id", "a"], "left_semi")
    return known.join(n.where("kind = 'stair'").select("building_id", F.col("id").alias("b")), ["building_id", "b"], "left_anti").groupBy("building_id").agg(F.count("*").alias("n_known"))


@query("jn24", with_views("v_edges") + "SELECT building_id, b AS portal_id, list_sort(list(DISTINCT a))[1] AS first_space, list_sort(list(DISTINCT a))[2] AS second_space FROM v_edges GROUP BY 1, 2 HAVING count(DISTINCT a) >= 2")
def jn24(spark: SparkSession, d: str) -> DataFrame:
    sides = views.edges(spark, d).groupBy("building_id", F.col("b").alias("portal_id")).agg(F.array_sort(F.collect_set("a")).alias("s")).where(F.size("s") >= 2)
    return sides.select("building_id", "portal_id", F.col("s")[0].alias("first_space"), F.col("s")[1].alias("second_space"))


# points of spaces, some beside their surfaces
IN_SPACES = with_views("v_points", "v_cells") + """, p AS (SELECT building_id, id, 'Brand#' || (1 + id % 5) || (1 + id // 5 % 5) AS space_id, x + 10 AS x, y + 10 AS y, (id % 4) * 0.5::DOUBLE AS z FROM v_points) """


def in_spaces(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("Brand#"), (1 + F.col("id") % 5).cast("string"), (1 + F.expr("id div 5") % 5).cast("string"))
    return views.points(spark, d).select("building_id", "id", name.alias("space_id"), (F.col("x") + 10).alias("x"), (F.col("y") + 10).alias("y"), (F.col("id") % 4 * 0.5).cast("double").alias("z"))


def _on_side(i: int, j: int) -> str:
    k = f"greatest(0, least(1, ((x-x{i})*(x{j}-x{i}) + (y-y{i})*(y{j}-y{i})) / ((x{j}-x{i})*(x{j}-x{i}) + (y{j}-y{i})*(y{j}-y{i}))))"
    return f"SELECT building_id, point_id, cell_id, z, {i} AS side, x{i} + {k} * (x{j}-x{i}) AS sx, y{i} + {k} * (y{j}-y{i}) AS sy, x, y FROM c"


SNAP = IN_SPACES + f""", c AS (SELECT p.building_id, p.id AS point_id, p.x, p.y, p.z, c.id AS cell_id, x1, y1, x2, y2, x3, y3, (x2-x1)*(y-y1)-(y2-y1)*(x-x1) AS a, (x3-x2)*(y-y2)-(y3-y2)*(x-x2) AS b, (x1-x3)*(y-y3)-(y1-y3)*(x-x3) AS e FROM p JOIN v_cells c USING (building_id, space_id)),
    i AS (SELECT building_id, point_id, cell_id, false AS outside, z AS away, 0 AS side, x AS sx, y AS sy FROM c WHERE ((a >= -1e-9 AND b >= -1e-9 AND e >= -1e-9) OR (a <= 1e-9 AND b <= 1e-9 AND e <= 1e-9))),
    s AS ({_on_side(1, 2)} UNION ALL {_on_side(2, 3)} UNION ALL {_on_side(3, 1)}), o AS (SELECT building_id, point_id, cell_id, true AS outside, round(sqrt(pow(round(sqrt(pow(x-sx, 2) + pow(y-sy, 2)), 9), 2) + z*z), 9) AS away, side, sx, sy FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY building_id, point_id ORDER BY outside, away, cell_id, side) AS k FROM (SELECT * FROM i UNION ALL SELECT * FROM o)) """


@query("jn12_plane", SNAP + "SELECT building_id, point_id, round(sx, 6) + 0.0 AS x, round(sy, 6) + 0.0 AS y, cell_id, round(away, 6) + 0.0 AS distance_m FROM r WHERE k = 1 AND away <= 3 + 1e-9")
def jn12_plane(spark: SparkSession, d: str) -> DataFrame:
    """Points put on the surface of their space, within 3 m."""
    found = joins.snap(in_spaces(spark, d), views.cells(spark, d), 3.0)
    return found.select("building_id", "point_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "cell_id", r6(F.col("distance_m")).alias("distance_m"))


@query(
    "jn14",
    SNAP + """, w AS (SELECT building_id, id AS point_id, x, y, z FROM p), l AS (SELECT w.building_id, point_id, min(c.id) AS cell_id FROM w JOIN v_cells c USING (building_id) WHERE ((x2-x1)*(y-y1)-(y2-y1)*(x-x1) >= -1e-9 AND (x3-x2)*(y-y2)-(y3-y2)*(x-x2) >= -1e-9 AND (x1-x3)*(y-y3)-(y1-y3)*(x-x3) >= -1e-9) OR ((x2-x1)*(y-y1)-(y2-y1)*(x-x1) <= 1e-9 AND (x3-x2)*(y-y2)-(y3-y2)*(x-x2) <= 1e-9 AND (x1-x3)*(y-y3)-(y1-y3)*(x-x3) <= 1e-9) GROUP BY 1, 2),
    n AS (SELECT a.building_id, a.id AS point_id, b.id AS node_id, row_number() OVER (PARTITION BY a.building_id, a.id ORDER BY sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2) + pow(a.z-b.z, 2)), b.id) AS k FROM p a JOIN p b ON a.building_id = b.building_id AND a.id <> b.id AND sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2) + pow(a.z-b.z, 2)) <= 3.0)
    SELECT w.building_id, w.point_id, CASE WHEN l.cell_id IS NOT NULL THEN 'cell' WHEN r.cell_id IS NOT NULL THEN 'side' WHEN n.node_id IS NOT NULL THEN 'node' ELSE 'none' END AS found_by, coalesce(l.cell_id, r.cell_id, n.node_id) AS found_id
    FROM w LEFT JOIN l ON l.building_id = w.building_id AND l.point_id = w.point_id LEFT JOIN r ON r.building_id = w.building_id AND r.point_id = w.point_id AND r.k = 1 AND r.away <= 3 + 1e-9 LEFT JOIN n ON n.building_id = w.building_id AND n.point_id = w.point_id AND n.k = 1""",
)
def jn14(spark: SparkSession, d: str) -> DataFrame:
    """Ends of routes: the cell that holds the point, else the near side of a cell of its space, else the nearest node within 3 m."""
    p, c = in_spaces(spark, d), views.cells(spark, d)
    cell = joins.locate(p, c).select("building_id", "point_id", F.col("cell_id").alias("in_cell"))
    side = joins.snap(p, c, 3.0).select("building_id", "point_id", F.col("cell_id").alias("at_side"))
    node = joins.radius_nearest(p, p, 3.0, 1).select("building_id", "point_id", F.col("near_id").alias("node"))
    rows = p.select("building_id", F.col("id").alias("point_id"))
    for more in (cell, side, node):
        rows = rows.join(more, ["building_id", "point_id"], "left")
    how = F.when(F.col("in_cell").isNotNull(), "cell").when(F.col("at_side").isNotNull(), "side").when(F.col("node").isNotNull(), "node").otherwise("none")
    return rows.select("building_id", "point_id", how.alias("found_by"), F.coalesce("in_cell", "at_side", "node").alias("found_id"))


@query("jn13_plane", SNAP.replace("USING (building_id, space_id)", "USING (building_id)") + "SELECT building_id, point_id, cell_id, round(away, 6) + 0.0 AS distance_m FROM r WHERE k = 1")
def jn13_plane(spark: SparkSession, d: str) -> DataFrame:
    """The cell nearest to each point, whatever its space and however far."""
    found = joins.closest_cells(in_spaces(spark, d), views.cells(spark, d))
    return found.select("building_id", "point_id", "cell_id", r6(F.col("distance_m")).alias("distance_m"))


BOTH_SIDES = SNAP.replace(IN_SPACES, with_views("v_points", "v_cells") + """, p AS (SELECT building_id, id * 2 + s AS id, 'Brand#' || (1 + (id + s) % 5) || (1 + (id + s) // 5 % 5) AS space_id, x + 10 AS x, y + 10 AS y, (id % 4) * 0.5::DOUBLE AS z FROM v_points, (SELECT unnest([0, 1]) AS s)) """)


@query(
    "jn19_plane",
    BOTH_SIDES + """SELECT f.building_id, f.point_id // 2 AS id, f.cell_id AS from_cell, t.cell_id AS to_cell, round(sqrt(pow(f.sx-p.x, 2) + pow(f.sy-p.y, 2) + p.z*p.z) + sqrt(pow(t.sx-p.x, 2) + pow(t.sy-p.y, 2) + p.z*p.z), 5) + 0.0 AS length_m
    FROM r f JOIN r t ON t.building_id = f.building_id AND t.point_id = f.point_id + 1 JOIN p ON p.building_id = f.building_id AND p.id = f.point_id WHERE f.point_id % 2 = 0 AND f.k = 1 AND t.k = 1 AND f.away <= 3 + 1e-9 AND t.away <= 3 + 1e-9""",
)
def jn19_plane(spark: SparkSession, d: str) -> DataFrame:
    """Transfers between a space and the next one, anchored on the surfaces of both."""
    p = in_spaces(spark, d).withColumnRenamed("space_id", "from_space_id")
    n = F.col("id") + 1
    to = F.concat(F.lit("Brand#"), (1 + n % 5).cast("string"), (1 + F.floor(n / 5) % 5).cast("string"))
    found = joins.transfer_anchors(p.withColumn("to_space_id", to), views.cells(spark, d))
    return found.select("building_id", "id", "from_cell", "to_cell", (F.round("length_m", 5) + 0.0).alias("length_m"))


@query(
    "jn6",
    LINKS + """, sh AS (SELECT building_id, id, space_id, x1 + 0.006 * x3 AS x1, y1, x2 + 0.006 * x3 AS x2, y2, x3 + 0.006 * x3 AS x3, y3 FROM v_cells),
    se AS (SELECT id, building_id, space_id, unnest([[x1,y1,x2,y2],[x2,y2,x3,y3],[x3,y3,x1,y1]]) AS s FROM sh),
    sk AS (SELECT *, round_even(s[1] * 1000, 0)::BIGINT || ',' || round_even(s[2] * 1000, 0)::BIGINT AS p, round_even(s[3] * 1000, 0)::BIGINT || ',' || round_even(s[4] * 1000, 0)::BIGINT AS q FROM se),
    ow AS (SELECT building_id, space_id, min(id) AS id, arg_min(s, id) AS s FROM sk GROUP BY building_id, space_id, least(p, q) || '|' || greatest(p, q) HAVING count(*) = 1),
    pr AS (SELECT f.building_id, f.space_id AS space_a, t.space_id AS space_b, f.id AS a, t.id AS b, f.s AS s, t.s AS t, sqrt(pow(f.s[3]-f.s[1], 2) + pow(f.s[4]-f.s[2], 2)) AS l FROM ow f JOIN ow t ON f.building_id = t.building_id AND f.space_id < t.space_id AND abs(f.s[1] + f.s[3] - t.s[1] - t.s[3]) <= 4 AND abs(f.s[2] + f.s[4] - t.s[2] - t.s[4]) <= 4),
    un AS (SELECT *, (s[3]-s[1]) / l AS ux, (s[4]-s[2]) / l AS uy FROM pr), al AS (SELECT *, (t[1]-s[1])*ux + (t[2]-s[2])*uy AS t0, (t[3]-s[1])*ux + (t[4]-s[2])*uy AS t1, abs((t[2]-s[2])*ux - (t[1]-s[1])*uy) AS o0, abs((t[4]-s[2])*ux - (t[3]-s[1])*uy) AS o1 FROM un),
    fo AS (SELECT building_id, space_a, space_b, a, b, round(least(l, greatest(t0, t1)) - greatest(0, least(t0, t1)), 6) AS width_m, round(greatest(o0, o1), 6) AS gap_m FROM al),
    kn AS (SELECT DISTINCT links.building_id, least(p.space_id, q.space_id) AS space_a, greatest(p.space_id, q.space_id) AS space_b FROM links JOIN v_cells p ON p.id = links.a JOIN v_cells q ON q.id = links.b),
    ra AS (SELECT *, row_number() OVER (PARTITION BY building_id, space_a, space_b ORDER BY width_m DESC, gap_m, a, b) AS k FROM fo WHERE gap_m <= 0.02 AND width_m >= 0.2 AND (building_id, space_a, space_b) NOT IN (SELECT (building_id, space_a, space_b) FROM kn))
    SELECT building_id, space_a, space_b, a, b, width_m, gap_m + 0.0 AS gap_m FROM ra WHERE k = 1""",
)
def jn6(spark: SparkSession, d: str) -> DataFrame:
    """Open boundaries between the spaces of a grid whose columns lie 6 mm apart; spaces linked over stairs have a portal."""
    c = views.cells(spark, d)
    name = c.select("id", "space_id")
    linked = joins.shared_sides(c).join(name.toDF("a", "sa"), "a").join(name.toDF("b", "sb"), "b").select("building_id", F.least("sa", "sb").alias("space_a"), F.greatest("sa", "sb").alias("space_b"))
    apart = c.select("building_id", "id", "space_id", *[(F.col(f"x{i}") + 0.006 * F.col("x3")).alias(f"x{i}") for i in (1, 2, 3)], "y1", "y2", "y3")
    return joins.open_boundaries(apart, linked).drop("id").withColumn("gap_m", F.col("gap_m") + 0.0)
