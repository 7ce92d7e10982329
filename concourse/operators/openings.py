"""Openings between spaces that no door names: where floors of one storey meet and no wall stands between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import surface
from .benchmarks import edges_through_obstacles
from .graph import settle

LEAST = 0.1  # metres of overlap from which an opening is a span; below, it is the point midway between the closest points


def _inside(at: Column, centre: Column, depth: float) -> Column:
    """The point `depth` metres from `at` towards the centre, at most there."""
    long = g.distance(at, centre)
    part = F.when(long > 1e-9, F.least(F.lit(depth), long) / long).otherwise(0.0)
    return g.vec(*[at[k] + (centre[k] - at[k]) * part for k in "xyz"])


def _span(p: Column, q: Column, r: Column, s: Column, one: Column, two: Column) -> Column:
    """struct<p, q, width>: the part of p-q beside which r-s runs, at the mean height of the closest points one and two."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    long = F.sqrt(dx * dx + dy * dy)
    along = lambda v: ((v["x"] - p["x"]) * dx + (v["y"] - p["y"]) * dy) / long
    low, high = F.greatest(F.lit(0.0), F.least(along(r), along(s))), F.least(long, F.greatest(along(r), along(s)))
    z = (one["z"] + two["z"]) / 2
    at = lambda t: g.vec(p["x"] + dx / long * t, p["y"] + dy / long * t, z)
    middle = g.vec(*[(one[k] + two[k]) / 2 for k in "xyz"])
    wide = (long > 1e-9) & (high - low >= LEAST)
    return F.struct(F.when(wide, at(low)).otherwise(middle).alias("p"), F.when(wide, at(high)).otherwise(middle).alias("q"), F.when(wide, high - low).otherwise(0.0).alias("width"))


def open_portals(cells: DataFrame, known: DataFrame, walls: DataFrame, gap: float = 0.2, rise: float = 0.1, depth: float = 0.2, size: float = 1.0) -> DataFrame:
    """(building_id, id, from_space_id, to_space_id, level_id, a, b, p, q, width_m, gap_m): one portal for each two spaces whose open floors meet without a wall.

    Cells are triangles in space with level_id; only open ones of a space take part. Sides that one triangle of a space
    owns alone meet sides of other spaces that are at most `gap` away, `rise` of it in height, on the same level or where
    one level is null. A probe leads from `depth` inside the one triangle to as far inside the other: where it runs
    through a wall (building_id, obstacle_id, ring, z_min, z_max), the two sides don't count. Of the others the widest
    makes the portal, then the one of the smallest gap (both to the nanometre), then the smallest ids; a is a triangle of
    the space of the smaller name, b of the other, and p to q is the opening along the side of a. Pairs of spaces in
    known (building_id, from_space_id, to_space_id), in either order, have a portal and go. The id is that of the level
    and the two spaces. Sides meet in the cubes of a grid that their boxes touch, one box widened by the gap.
    """
    floor = cells.where("terrain = 'open' and space_id is not null")
    more = floor.select("building_id", "id", "level_id", surface.centre().alias("centre"))
    lone = surface._sides(floor).groupBy("building_id", "space_id", "key").agg(F.count("*").alias("n"), F.min(F.struct("id", F.col("n").alias("side"), F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))).alias("s")).where("n = 1")
    lone = settle(lone.select("building_id", "space_id", "s.*").join(more, ["building_id", "id"]))

    def cubes(pad: float, name: str) -> DataFrame:
        reach = lambda k, r: F.sequence(F.floor((F.least(f"p.{k}", f"q.{k}") - r) / size), F.floor((F.greatest(f"p.{k}", f"q.{k}") + r) / size))
        out = lone.select("building_id", F.struct(*[c for c in lone.columns if c != "building_id"]).alias(name), "p", "q")
        return out.withColumn("gx", F.explode(reach("x", pad))).withColumn("gy", F.explode(reach("y", pad))).withColumn("gz", F.explode(reach("z", pad))).drop("p", "q")

    met = cubes(0.0, "s").join(cubes(gap + 1e-6, "t"), ["building_id", "gx", "gy", "gz"]).where("s.space_id < t.space_id and (s.level_id = t.level_id or s.level_id is null or t.level_id is null)")
    # names of the two spaces, smaller first, as in known
    both = known.where("from_space_id is not null and to_space_id is not null").select("building_id", F.least("from_space_id", "to_space_id").alias("from_space_id"), F.greatest("from_space_id", "to_space_id").alias("to_space_id")).distinct()
    met = met.withColumns({"from_space_id": F.col("s.space_id"), "to_space_id": F.col("t.space_id")}).join(both, ["building_id", "from_space_id", "to_space_id"], "left_anti")
    met = met.dropDuplicates(["building_id", "s", "t"])
    near = met.withColumn("c", g.closest_of_segments(F.col("s.p"), F.col("s.q"), F.col("t.p"), F.col("t.q")))
    near = near.withColumn("gap_m", F.round(g.distance(F.col("c.one"), F.col("c.two")), 9)).where((F.col("gap_m") <= gap) & (F.abs(F.col("c.one.z") - F.col("c.two.z")) <= rise))
    near = near.withColumn("segment_id", F.struct(F.col("s.id").alias("a"), F.col("s.side").alias("m"), F.col("t.id").alias("b"), F.col("t.side").alias("n")))
    near = settle(near.drop("gx", "gy", "gz"), lone)
    probes = near.select("building_id", "segment_id", _inside(F.col("c.one"), F.col("s.centre"), depth).alias("p"), _inside(F.col("c.two"), F.col("t.centre"), depth).alias("q"))
    shut = edges_through_obstacles(probes, walls).select("building_id", "segment_id").distinct()
    clear = near.join(shut, ["building_id", "segment_id"], "left_anti")
    clear = clear.withColumn("x", _span(F.col("s.p"), F.col("s.q"), F.col("t.p"), F.col("t.q"), F.col("c.one"), F.col("c.two")))
    clear = clear.withColumn("level_id", F.coalesce("s.level_id", "t.level_id"))
    best = clear.groupBy("building_id", "from_space_id", "to_space_id").agg(F.min(F.struct(F.round(-F.col("x.width"), 9).alias("width"), "gap_m", "segment_id", "level_id", "x.p", "x.q")).alias("x"))
    name = F.concat(F.lit("open:"), F.substring(F.sha1(F.concat_ws("|", F.coalesce(F.col("x.level_id").cast("string"), F.lit("")), "from_space_id", "to_space_id")), 1, 16))
    return best.select("building_id", name.alias("id"), "from_space_id", "to_space_id", "x.level_id", "x.segment_id.a", "x.segment_id.b", "x.p", "x.q", (-F.col("x.width")).alias("width_m"), "x.gap_m")


def opened_links(portals: DataFrame) -> DataFrame:
    """(building_id, a, b, portal_id, p, q): the links between triangles that the portals of open_portals add to a surface."""
    return portals.select("building_id", "a", "b", F.col("id").alias("portal_id"), "p", "q")
