"""Queries of the geometry expressions and generators, over the triangles and points of all buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import generators
from ..registry import query
from ..sources import views
from ..sources.views import with_views

CELLS, POINTS = with_views("v_cells"), with_views("v_points")


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def corners(spark: SparkSession, d: str) -> DataFrame:
    """Triangles with their corners as points; the second is lifted by id % 3."""
    lift = (F.col("id") % 3).cast("double")
    return views.cells(spark, d).select("*", g.vec("x1", "y1").alias("p"), g.vec("x2", "y2", lift).alias("q"), g.vec("x3", "y3").alias("r"))


SIDES = "(x2 - x1) AS ux, (y2 - y1) AS uy, CAST(id % 3 AS DOUBLE) AS uz, (x3 - x1) AS vx, (y3 - y1) AS vy"
NORMAL = CELLS + f", s AS (SELECT *, {SIDES} FROM v_cells), n AS (SELECT *, -uz * vy AS nx, uz * vx AS ny, ux * vy - uy * vx AS nz FROM s), m AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM n) "


@query("geo1", CELLS + "SELECT id, round(sqrt((x1-x2)*(x1-x2) + (y1-y2)*(y1-y2) + (id%3)*(id%3)), 6) AS distance_m, round(sqrt((x1-x2)*(x1-x2) + (y1-y2)*(y1-y2)), 6) AS distance_xy FROM v_cells")
def geo1(spark: SparkSession, d: str) -> DataFrame:
    return corners(spark, d).select("id", r6(g.distance(F.col("p"), F.col("q"))).alias("distance_m"), r6(g.distance_xy(F.col("p"), F.col("q"))).alias("distance_xy"))


@query("geo2", NORMAL + "SELECT id, round(nx / size, 6) + 0.0 AS nx, round(ny / size, 6) + 0.0 AS ny, round(nz / size, 6) + 0.0 AS nz FROM m")
def geo2(spark: SparkSession, d: str) -> DataFrame:
    n = g.unit_normal(F.col("p"), F.col("q"), F.col("r"))
    return corners(spark, d).select("id", r6(n["x"]).alias("nx"), r6(n["y"]).alias("ny"), r6(n["z"]).alias("nz"))


@query("geo3", NORMAL + "SELECT id, round(size / 2, 6) AS area, round(abs(nz) / 2, 6) AS area_xy FROM m")
def geo3(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(k) for k in "pqr"]
    return corners(spark, d).select("id", r6(g.area(*c)).alias("area"), r6(g.area_xy(*c)).alias("area_xy"))


@query("geo4", CELLS + "SELECT id, round((x1+x2+x3)/3, 6) AS x, round((y1+y2+y3)/3, 6) AS y, round(CAST(id%3 AS DOUBLE)/3, 6) AS z FROM v_cells")
def geo4(spark: SparkSession, d: str) -> DataFrame:
    m = g.centroid(F.col("p"), F.col("q"), F.col("r"))
    return corners(spark, d).select("id", r6(m["x"]).alias("x"), r6(m["y"]).alias("y"), r6(m["z"]).alias("z"))


@query(
    "geo5",
    CELLS + """, t AS (SELECT *, x3 + 0.3 AS px, y1 + 0.6 AS py FROM v_cells), s AS (SELECT id, (x2-x1)*(py-y1)-(y2-y1)*(px-x1) AS a, (x3-x2)*(py-y2)-(y3-y2)*(px-x2) AS b, (x1-x3)*(py-y3)-(y1-y3)*(px-x3) AS c FROM t)
    SELECT id, (a >= -1e-9 AND b >= -1e-9 AND c >= -1e-9) OR (a <= 1e-9 AND b <= 1e-9 AND c <= 1e-9) AS inside FROM s""",
)
def geo5(spark: SparkSession, d: str) -> DataFrame:
    p = g.vec(F.col("x3") + 0.3, F.col("y1") + 0.6)
    return corners(spark, d).select("id", g.in_triangle_xy(p, F.col("p"), F.col("q"), F.col("r")).alias("inside"))


_SEG = lambda n, u, v: f"(SELECT {{'d': round(sqrt(pow(ox - x, 2) + pow(oy - y, 2) + pow(oz - z, 2)), 12), 'n': {n}, 'x': x, 'y': y, 'z': z}} FROM (SELECT {u}x + t * ({v}x-{u}x) AS x, {u}y + t * ({v}y-{u}y) AS y, {u}z + t * ({v}z-{u}z) AS z FROM (SELECT greatest(0, least(1, ((ox-{u}x)*({v}x-{u}x) + (oy-{u}y)*({v}y-{u}y) + (oz-{u}z)*({v}z-{u}z)) / (pow({v}x-{u}x, 2) + pow({v}y-{u}y, 2) + pow({v}z-{u}z, 2)))) AS t)))"
_LEFT = lambda u, v: f"((({v}y-{u}y)*(fz-{u}z) - ({v}z-{u}z)*(fy-{u}y)) * nx + (({v}z-{u}z)*(fx-{u}x) - ({v}x-{u}x)*(fz-{u}z)) * ny + (({v}x-{u}x)*(fy-{u}y) - ({v}y-{u}y)*(fx-{u}x)) * nz >= 0)"


@query(
    "geo6",
    CELLS + """, t AS (SELECT id, x1 - 0.7 AS ox, y1 + 0.4 AS oy, 0.5::DOUBLE AS oz, x1 AS ax, y1 AS ay, 0.0::DOUBLE AS az, x2 AS ex, y2 AS ey, CAST(id % 3 AS DOUBLE) AS ez, x3 AS cx, y3 AS cy, 0.0::DOUBLE AS cz FROM v_cells),
    n AS (SELECT *, (ey-ay)*(cz-az) - (ez-az)*(cy-ay) AS nx, (ez-az)*(cx-ax) - (ex-ax)*(cz-az) AS ny, (ex-ax)*(cy-ay) - (ey-ay)*(cx-ax) AS nz FROM t),
    k AS (SELECT *, ((ox-ax)*nx + (oy-ay)*ny + (oz-az)*nz) / (nx*nx + ny*ny + nz*nz) AS k FROM n), f AS (SELECT *, ox - k*nx AS fx, oy - k*ny AS fy, oz - k*nz AS fz FROM k),
    """ + f"w AS (SELECT id, ox, oy, oz, CASE WHEN {_LEFT('a', 'e')} AND {_LEFT('e', 'c')} AND {_LEFT('c', 'a')} THEN {{'d': 0.0::DOUBLE, 'n': 0, 'x': fx, 'y': fy, 'z': fz}} ELSE least({_SEG(0, 'a', 'e')}, {_SEG(1, 'e', 'c')}, {_SEG(2, 'c', 'a')}) END AS p FROM f) "
    + "SELECT id, round(p.x, 6) + 0.0 AS x, round(p.y, 6) + 0.0 AS y, round(p.z, 6) + 0.0 AS z, round(sqrt(pow(ox - p.x, 2) + pow(oy - p.y, 2) + pow(oz - p.z, 2)), 6) + 0.0 AS distance_m FROM w",
)
def geo6(spark: SparkSession, d: str) -> DataFrame:
    p = g.vec(F.col("x1") - 0.7, F.col("y1") + 0.4, F.lit(0.5))
    rows = corners(spark, d).select("id", p.alias("o"), g.closest_on_triangle(p, F.col("p"), F.col("q"), F.col("r")).alias("c"))
    return rows.select("id", r6(F.col("c.x")).alias("x"), r6(F.col("c.y")).alias("y"), r6(F.col("c.z")).alias("z"), r6(g.distance(F.col("o"), F.col("c"))).alias("distance_m"))


@query(
    "geo8",
    CELLS + """, t AS (SELECT *, x1 - 0.25 AS px, y3 + 0.5 AS py FROM v_cells), s AS (SELECT *, greatest(0.0, least(1.0, ((px-x1)*(x2-x1) + (py-y1)*(y2-y1)) / ((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)))) AS k FROM t)
    SELECT id, round(x1 + k * (x2 - x1), 6) + 0.0 AS x, round(y1 + k * (y2 - y1), 6) + 0.0 AS y FROM s""",
)
def geo8(spark: SparkSession, d: str) -> DataFrame:
    c = g.closest_on_segment_xy(g.vec(F.col("x1") - 0.25, F.col("y3") + 0.5), F.col("p"), F.col("q"))
    return corners(spark, d).select("id", r6(c["x"]).alias("x"), r6(c["y"]).alias("y"))


@query(
    "geo9",
    CELLS + """, b AS (SELECT building_id, space_id, min(least(x1,x2,x3)) AS lx, min(least(y1,y2,y3)) AS ly, max(greatest(x1,x2,x3)) AS hx, max(greatest(y1,y2,y3)) AS hy FROM v_cells GROUP BY 1, 2)
    SELECT building_id, space_id, lx, ly, hx, hy, round(sqrt(pow(greatest(lx-25, 0, 25-hx), 2) + pow(greatest(ly-3, 0, 3-hy), 2)), 6) AS distance_m, 25 BETWEEN lx - 6 AND hx + 6 AND 3 BETWEEN ly - 6 AND hy + 6 AS near FROM b""",
)
def geo9(spark: SparkSession, d: str) -> DataFrame:
    low = [F.min(F.least(f"{k}1", f"{k}2", f"{k}3")).alias(f"l{k}") for k in "xy"]
    high = [F.max(F.greatest(f"{k}1", f"{k}2", f"{k}3")).alias(f"h{k}") for k in "xy"]
    b = views.cells(spark, d).groupBy("building_id", "space_id").agg(*low, *high)
    p, lo, hi = g.vec(F.lit(25.0), F.lit(3.0)), g.vec("lx", "ly"), g.vec("hx", "hy")
    return b.select("*", r6(g.box_distance(p, lo, hi)).alias("distance_m"), g.in_padded_box(p, lo, hi, 6.0).alias("near"))


def polylines(spark: SparkSession, d: str) -> DataFrame:
    """A polyline through the first corners of each space's triangles, by id."""
    c = corners(spark, d)
    return c.groupBy("building_id", "space_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda s: s["p"]).alias("points"))


LEGS = CELLS + """, o AS (SELECT building_id, space_id, id, x1 AS x, y1 AS y, lag(x1) OVER w AS px, lag(y1) OVER w AS py FROM v_cells WINDOW w AS (PARTITION BY building_id, space_id ORDER BY id)),
    l AS (SELECT *, coalesce(sqrt((x-px)*(x-px) + (y-py)*(y-py)), 0) AS leg FROM o), t AS (SELECT building_id, space_id, sum(leg) AS total, count(*) AS n, sum(CASE WHEN px IS NULL OR leg > 1e-9 THEN 1 ELSE 0 END) AS kept FROM l GROUP BY 1, 2) """


@query("geo11", LEGS + "SELECT building_id, space_id, round(total, 6) AS length_m FROM t")
def geo11(spark: SparkSession, d: str) -> DataFrame:
    return polylines(spark, d).select("building_id", "space_id", r6(g.polyline_length(F.col("points"))).alias("length_m"))


@query("geo12", LEGS + "SELECT building_id, space_id, n, CAST(kept AS BIGINT) AS kept FROM t")
def geo12(spark: SparkSession, d: str) -> DataFrame:
    return polylines(spark, d).select("building_id", "space_id", F.size("points").cast("long").alias("n"), F.size(g.without_repeats(F.col("points"))).cast("long").alias("kept"))


@query(
    "geo13",
    LEGS + """, c AS (SELECT l.*, total, sum(leg) OVER (PARTITION BY l.building_id, l.space_id ORDER BY id) AS upto FROM l JOIN t USING (building_id, space_id)),
    h AS (SELECT *, row_number() OVER (PARTITION BY building_id, space_id ORDER BY id) AS k FROM c WHERE px IS NOT NULL AND leg > 1e-9 AND upto >= total / 3)
    SELECT building_id, space_id, round(px + (total / 3 - (upto - leg)) / leg * (x - px), 4) + 0.0 AS x, round(py + (total / 3 - (upto - leg)) / leg * (y - py), 4) + 0.0 AS y FROM h WHERE k = 1""",
)
def geo13(spark: SparkSession, d: str) -> DataFrame:
    rows = polylines(spark, d).withColumn("total", g.polyline_length(F.col("points"))).where("total > 0")
    at = g.point_at(F.col("points"), F.col("total") / 3)
    rows = rows.select("building_id", "space_id", at.alias("at"))
    return rows.select("building_id", "space_id", (F.round("at.x", 4) + 0.0).alias("x"), (F.round("at.y", 4) + 0.0).alias("y"))


@query("geo15", LEGS + "SELECT building_id, space_id, round(least(total, total / 2 + 4 * 1.3), 6) AS travelled_m, round(least(total, total / 2 + 4 * 1.3) / total, 6) AS progress, total / 2 + 4 * 1.3 >= total AS finished FROM t WHERE total > 0")
def geo15(spark: SparkSession, d: str) -> DataFrame:
    rows = polylines(spark, d).withColumn("total", g.polyline_length(F.col("points"))).where("total > 0")
    return generators.advanced(rows, F.col("total"), F.col("total") / 2, F.lit(4.0), F.lit(1.3)).select("building_id", "space_id", r6(F.col("travelled_m")).alias("travelled_m"), r6(F.col("progress")).alias("progress"), "finished")


@query("geo17")
def geo17(spark: SparkSession, d: str) -> DataFrame:
    kept = g.without_collinear(g.without_repeats(F.col("points")))
    return polylines(spark, d).select("building_id", "space_id", F.size("points").alias("n"), F.size(kept).alias("kept"), r6(g.polyline_length(kept)).alias("length_m"))


EDGES3 = CELLS + """, e AS (SELECT id, building_id, space_id, terrain, unnest([[x1,y1,x2,y2],[x2,y2,x3,y3],[x3,y3,x1,y1]]) AS s FROM v_cells),
    k AS (SELECT *, round_even(s[1] * 1000, 0)::BIGINT || ',' || round_even(s[2] * 1000, 0)::BIGINT AS p, round_even(s[3] * 1000, 0)::BIGINT || ',' || round_even(s[4] * 1000, 0)::BIGINT AS q FROM e),
    u AS (SELECT *, least(p, q) || '|' || greatest(p, q) AS key FROM k) """


@query("geo18", EDGES3 + "SELECT building_id, count(DISTINCT key) AS n_edges, count(*) AS n_sides FROM u GROUP BY 1")
def geo18(spark: SparkSession, d: str) -> DataFrame:
    flat = views.cells(spark, d).select("building_id", g.vec("x1", "y1").alias("p"), g.vec("x2", "y2").alias("q"), g.vec("x3", "y3").alias("r"))
    keys = flat.select("building_id", F.explode(F.array(*[g.edge_key(F.col(a), F.col(b)) for a, b in ("pq", "qr", "rp")])).alias("k"))
    return keys.groupBy("building_id").agg(F.countDistinct("k").alias("n_edges"), F.count("*").alias("n_sides"))


@query("geo19", POINTS + "SELECT building_id, CAST(floor(x / 1.25) AS BIGINT) AS gx, CAST(floor(y / 1.25) AS BIGINT) AS gy, count(*) AS n FROM v_points GROUP BY 1, 2, 3")
def geo19(spark: SparkSession, d: str) -> DataFrame:
    return views.points(spark, d).groupBy("building_id", F.floor(F.col("x") / 1.25).alias("gx"), F.floor(F.col("y") / 1.25).alias("gy")).agg(F.count("*").alias("n"))


@query("geo20", CELLS + "SELECT id, " + " + ".join(f"(((x1::BIGINT >> {i}) & 1) << {3 * i}) + (((y1::BIGINT >> {i}) & 1) << {3 * i + 1})" for i in range(6)) + " AS key FROM v_cells")
def geo20(spark: SparkSession, d: str) -> DataFrame:
    return views.cells(spark, d).select("id", g.morton(F.col("x1"), F.col("y1"), F.lit(0), 6).alias("key"))


@query("geo21", CELLS + "SELECT id, x2 AS vx, CAST(id % 3 AS DOUBLE) AS vy, -y2 + 0.0 AS vz, x2 * 100 AS ux, -y2 * 100 + 0.0 AS uy, (id % 3) * 100.0::DOUBLE AS uz FROM v_cells")
def geo21(spark: SparkSession, d: str) -> DataFrame:
    v, u = g.to_y_up(F.col("q")), g.to_mirrored_cm(F.col("q"))
    return corners(spark, d).select("id", v["x"].alias("vx"), v["y"].alias("vy"), (v["z"] + 0.0).alias("vz"), u["x"].alias("ux"), (u["y"] + 0.0).alias("uy"), u["z"].alias("uz"))


@query("gen1", NORMAL + ", w AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY id) - 1 AS k FROM m WHERE nz / size >= cos(radians(50))) SELECT building_id, 'walk:' || k AS walk_id, id FROM w")
def gen1(spark: SparkSession, d: str) -> DataFrame:
    return generators.walkable(corners(spark, d), 50.0)


@query(
    "gen2",
    CELLS + """, e AS (SELECT building_id, unnest([[x1,y1,x2,y2],[x2,y2,x3,y3],[x3,y3,x1,y1]]) AS s FROM v_cells), l AS (SELECT *, CAST(ceil(sqrt(pow(s[3]-s[1],2) + pow(s[4]-s[2],2)) / 0.5) AS BIGINT) AS n FROM e),
    p AS (SELECT building_id, s, n, unnest(generate_series(0, n)) AS i FROM l), q AS (SELECT DISTINCT building_id, round_even((s[1] + i * (s[3]-s[1]) / n) * 1000, 0) AS x, round_even((s[2] + i * (s[4]-s[2]) / n) * 1000, 0) AS y FROM p)
    SELECT building_id, count(*) AS n_points FROM q GROUP BY 1""",
)
def gen2(spark: SparkSession, d: str) -> DataFrame:
    return generators.edge_samples(corners(spark, d), 0.5).groupBy("building_id").agg(F.count("*").alias("n_points"))


@query(
    "gen3",
    CELLS + """, i AS (SELECT unnest(generate_series(1, 6)) AS i), j AS (SELECT unnest(generate_series(1, 6)) AS j)
    SELECT id, i, j, round((i * x1 + j * x2 + (8 - i - j) * x3) / 8, 6) AS x, round((i * y1 + j * y2 + (8 - i - j) * y3) / 8, 6) AS y FROM v_cells, i, j WHERE i + j < 8""",
)
def gen3(spark: SparkSession, d: str) -> DataFrame:
    return generators.lattice(corners(spark, d), 8).select("id", "i", "j", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("gen4")
def gen4(spark: SparkSession, d: str) -> DataFrame:
    return generators.population(corners(spark, d).where("terrain = 'open'"), 200, seed=7)


@query(
    "gen5",
    CELLS + """, i AS (SELECT unnest(generate_series(1, 6)) AS i), j AS (SELECT unnest(generate_series(1, 6)) AS j), sp AS (SELECT building_id, id, i, j, (i * x1 + j * x2 + (8 - i - j) * x3) / 8 AS x, (i * y1 + j * y2 + (8 - i - j) * y3) / 8 AS y FROM v_cells, i, j WHERE i + j < 8),
    c AS (SELECT building_id, x, y, row_number() OVER (PARTITION BY building_id ORDER BY round(sqrt(x * x + y * y), 9), id, i, j) AS o FROM sp),
    tk AS (SELECT building_id, CAST(1 AS BIGINT) AS pick, x, y, o, [{'x': x, 'y': y}] AS had FROM c WHERE o = 1 UNION ALL
        SELECT t.building_id, t.pick + 1, arg_min(c.x, c.o), arg_min(c.y, c.o), min(c.o), list_append(any_value(t.had), {'x': arg_min(c.x, c.o), 'y': arg_min(c.y, c.o)}) FROM tk t JOIN c ON c.building_id = t.building_id AND c.o > t.o AND len(list_filter(t.had, lambda p: round(sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)), 9) < 1)) = 0 WHERE t.pick < 20 GROUP BY t.building_id, t.pick)
    SELECT building_id, pick, x, y, max(pick) OVER (PARTITION BY building_id) < 20 AS short FROM tk""",
)
def gen5(spark: SparkSession, d: str) -> DataFrame:
    """Twenty spots of each building, a metre apart, from its corner on."""
    spots = generators.lattice(corners(spark, d), 8).select("building_id", "id", "i", "j", "x", "y")
    return generators.thinned(spots, count=20, spacing=1.0)


@query(
    "gen6",
    with_views("v_frames") + """, o AS (SELECT run_id, frame_no, row_number() OVER (PARTITION BY run_id ORDER BY frame_no) - 1 AS k, count(*) OVER (PARTITION BY run_id) - 1 AS last FROM v_frames),
    w AS (SELECT DISTINCT run_id, CAST(round_even(i * last / 9.0::DOUBLE, 0) AS BIGINT) AS k FROM (SELECT DISTINCT run_id, last FROM o), (SELECT unnest(generate_series(0, 9)) AS i)) SELECT run_id, frame_no FROM o JOIN w USING (run_id, k)""",
)
def gen6(spark: SparkSession, d: str) -> DataFrame:
    return generators.evenly(views.frames(spark, d).select("run_id", "frame_no"), "run_id", "frame_no", 10)




@query(
    "geo10",
    NORMAL + """SELECT a.id, greatest(abs(a.nx * (b.x1 - a.x1) + a.ny * (b.y1 - a.y1)), abs(a.nx * (b.x2 - a.x1) + a.ny * (b.y2 - a.y1) + a.nz * (b.id % 3)), abs(a.nx * (b.x3 - a.x1) + a.ny * (b.y3 - a.y1))) / a.size <= 0.001 AS coplanar
    FROM m a JOIN m b ON b.id = a.id + 1 WHERE a.id % 2 = 0""",
)
def geo10(spark: SparkSession, d: str) -> DataFrame:
    """Whether the two triangles of a square lie in one plane (1 mm)."""
    c = corners(spark, d).select("id", "p", "q", "r")
    two = c.where("id % 2 = 0").join(c.select((F.col("id") - 1).alias("id"), F.struct("p", "q", "r").alias("o")), "id")
    return two.select("id", (g.off_plane(F.col("p"), F.col("q"), F.col("r"), F.col("o.p"), F.col("o.q"), F.col("o.r")) <= 0.001).alias("coplanar"))


@query(
    "geo14",
    LEGS + """, c AS (SELECT l.*, total, sum(leg) OVER (PARTITION BY l.building_id, l.space_id ORDER BY id) AS upto FROM l JOIN t USING (building_id, space_id))
    SELECT building_id, space_id, count(*) FILTER (WHERE upto > total * 0.37) + 1 AS n_points, round(max(total) * 0.63, 6) AS left_m FROM c WHERE total > 0 GROUP BY 1, 2""",
)
def geo14(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a polyline after 37 percent of its length."""
    rows = polylines(spark, d).withColumn("total", g.polyline_length(F.col("points"))).where("total > 0")
    rows = rows.withColumn("left", g.remaining(F.col("points"), F.col("total") * 0.37))
    return rows.select("building_id", "space_id", F.size("left").cast("long").alias("n_points"), r6(g.polyline_length(F.col("left"))).alias("left_m"))


@query(
    "geo7",
    CELLS + """, s AS (SELECT id, x1, y1, x2 - x1 AS ux, y2 - y1 AS uy, CAST(id % 3 AS DOUBLE) AS uz, x1 + 0.4 AS cx, y1 - 0.3 AS cy, 0.5 AS cz, x2 - 0.2 - (x1 + 0.4) AS vx, y3 + 0.6 - (y1 - 0.3) AS vy, id % 5 * 0.25 - 0.5 AS vz FROM v_cells),
    m AS (SELECT *, ux*ux+uy*uy+uz*uz AS uu, vx*vx+vy*vy+vz*vz AS vv, ux*vx+uy*vy+uz*vz AS uv, ux*(x1-cx)+uy*(y1-cy)-uz*cz AS uw, vx*(x1-cx)+vy*(y1-cy)-vz*cz AS vw FROM s),
    o AS (SELECT *, CASE WHEN abs(uu*vv - uv*uv) > 1e-12 THEN greatest(0, least(1, (uv*vw - uw*vv) / (uu*vv - uv*uv))) ELSE 0 END AS s0 FROM m), w AS (SELECT *, (uv*s0 + vw) / vv AS t0, greatest(0, least(1, (uv*s0 + vw) / vv)) AS t FROM o),
    e AS (SELECT *, CASE WHEN t0 = t THEN s0 ELSE greatest(0, least(1, (uv*t - uw) / uu)) END AS s FROM w)
    SELECT id, round(x1 + ux*s, 6) + 0.0 AS x, round(y1 + uy*s, 6) + 0.0 AS y, round(uz*s, 6) + 0.0 AS z, round(sqrt(pow(x1+ux*s-cx-vx*t, 2) + pow(y1+uy*s-cy-vy*t, 2) + pow(uz*s-cz-vz*t, 2)), 6) + 0.0 AS distance_m FROM e""",
)
def geo7(spark: SparkSession, d: str) -> DataFrame:
    """Where a side of each triangle is closest to a segment beside it."""
    c, e = g.vec(F.col("x1") + 0.4, F.col("y1") - 0.3, F.lit(0.5)), g.vec(F.col("x2") - 0.2, F.col("y3") + 0.6, F.col("id") % 5 * 0.25)
    rows = corners(spark, d).select("id", g.closest_of_segments(F.col("p"), F.col("q"), c, e).alias("near"))
    return rows.select("id", *[r6(F.col(f"near.one.{k}")).alias(k) for k in "xyz"], r6(g.distance(F.col("near.one"), F.col("near.two"))).alias("distance_m"))


@query("geo16", CELLS + "SELECT id, round(CASE WHEN id % 3 > 0 THEN x1 + (x2 - x1) * 0.75 / (id % 3) ELSE x1 END, 6) + 0.0 AS x, round(CASE WHEN id % 3 > 0 THEN y1 + (y2 - y1) * 0.75 / (id % 3) ELSE y1 END, 6) + 0.0 AS y, 0.75::DOUBLE AS z FROM v_cells")
def geo16(spark: SparkSession, d: str) -> DataFrame:
    """The point at 0.75 m on the way along two sides of each triangle."""
    at = g.point_at_elevation(F.array("p", "q", "r"), F.lit(0.75))
    return corners(spark, d).select("id", at.alias("at")).select("id", r6(F.col("at.x")).alias("x"), r6(F.col("at.y")).alias("y"), F.col("at.z").alias("z"))


@query(
    "gen8",
    LEGS + """, r AS (SELECT l.*, terrain, sum(leg) OVER (PARTITION BY l.building_id, l.space_id ORDER BY id ROWS UNBOUNDED PRECEDING) - leg AS begin_m FROM l JOIN v_cells c USING (id))
    SELECT building_id, space_id, 'transition:' || id AS gate_id, terrain AS kind, round(begin_m, 6) + 0.0 AS distance_m, 0.6::DOUBLE AS capacity_pps, false AS is_exit FROM r WHERE terrain = 'stair'
    UNION ALL SELECT building_id, space_id, 'exit:' || space_id, 'exit', round(total, 6) + 0.0, 1.3::DOUBLE, true FROM t""",
)
def gen8(spark: SparkSession, d: str) -> DataFrame:
    """Gates of each space's polyline as a route: where a stair begins, and the exit at its end."""
    rows = generators.gates(route_legs(spark, d), ["building_id", "space_id"], "id", F.col("terrain") == "stair")
    name = F.when(F.col("is_exit"), F.concat(F.lit("exit:"), "space_id")).otherwise(F.concat(F.lit("transition:"), F.col("id").cast("string")))
    return rows.select("building_id", "space_id", name.alias("gate_id"), F.when(F.col("is_exit"), "exit").otherwise(F.col("terrain")).alias("kind"), r6(F.col("distance_m")).alias("distance_m"), F.when(F.col("is_exit"), 1.3).otherwise(0.6).alias("capacity_pps"), "is_exit")


@query(
    "gen8b",
    LEGS + """, r AS (SELECT l.*, terrain, sum(leg) OVER (PARTITION BY l.building_id, l.space_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto FROM l JOIN v_cells c USING (id))
    SELECT building_id, space_id, id, round(upto - leg, 6) + 0.0 AS start_m, round(upto, 6) + 0.0 AS end_m, CASE WHEN terrain = 'stair' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS factor, round(leg / greatest(0.05, 1.4 * CASE WHEN terrain = 'stair' THEN 0.6 ELSE 1 END), 6) + 0.0 AS free_s FROM r""",
)
def gen8b(spark: SparkSession, d: str) -> DataFrame:
    """Speed regions of the same routes, with the free travel time of each."""
    rows = generators.regions(route_legs(spark, d), ["building_id", "space_id"], "id")
    factor = F.when(F.col("terrain") == "stair", 0.6).otherwise(1.0)
    return rows.select("building_id", "space_id", "id", r6(F.col("start_m")).alias("start_m"), r6(F.col("end_m")).alias("end_m"), factor.alias("factor"), r6((F.col("end_m") - F.col("start_m")) / F.greatest(F.lit(0.05), 1.4 * factor)).alias("free_s"))


def route_legs(spark: SparkSession, d: str) -> DataFrame:
    """The legs of each space's polyline: from the corner before, by id."""
    w = generators.Window.partitionBy("building_id", "space_id").orderBy("id")
    c = views.cells(spark, d).withColumns({"px": F.lag("x1").over(w), "py": F.lag("y1").over(w)})
    return c.select("building_id", "space_id", "id", "terrain", F.coalesce(F.sqrt((F.col("x1") - F.col("px")) ** 2 + (F.col("y1") - F.col("py")) ** 2), F.lit(0.0)).alias("length_m"))
