"""What is done with routes: arcs of corridors, stitched legs, profiles, far pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .joins import side_middles


def corridor_arcs(cells: DataFrame, links: DataFrame, stair: float = 1.25, ramp: float = 1.1) -> DataFrame:
    """Arcs (building_id, a, b, cost) between linked triangles: centroid distance times the terrain cost of the one entered."""
    middle = g.centroid(*[g.vec(f"x{i}", f"y{i}") for i in (1, 2, 3)])
    c = cells.select("building_id", "id", middle.alias("m"), F.when(F.col("terrain") == "stair", stair).when(F.col("terrain") == "ramp", ramp).otherwise(1.0).alias("f"))
    both = links.select("building_id", "a", "b").unionByName(links.select("building_id", F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(c.select("building_id", F.col("id").alias("a"), F.col("m").alias("ma")), ["building_id", "a"]).join(c.select("building_id", F.col("id").alias("b"), F.col("m").alias("mb"), "f"), ["building_id", "b"])
    return met.select("building_id", "a", "b", F.round(g.distance(F.col("ma"), F.col("mb")) * F.col("f"), 9).alias("cost"))


def stitched(legs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per route: its points in order of seq, without repeats, the number of legs and the length."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda s: s["p"])
    rows = legs.groupBy(*keys).agg(points.alias("raw"))
    return rows.select(*keys, F.size("raw").alias("n_legs"), g.without_repeats(F.col("raw")).alias("points"), g.polyline_length(F.col("raw")).alias("length_m"))


def open_portals(portals: DataFrame, profiles: DataFrame) -> DataFrame:
    """Doors with each profile (profile, least_m) that they are wide enough for. Profiles are a handful of policies, given by the caller as rows."""
    rules = profiles.agg(F.collect_list(F.struct("profile", "least_m")).alias("rules")).first()["rules"]
    each = portals.withColumn("q", F.explode(F.array(*[F.struct(F.lit(r["profile"]).alias("profile"), F.lit(r["least_m"]).alias("least_m")) for r in rules])))
    return each.where(F.col("width_m") >= F.col("q.least_m")).select("q.profile", *portals.columns)


def diameter_pairs(points: DataFrame) -> DataFrame:
    """(building_id, a, b, d): the point farthest from each building's first one, and the point farthest from that."""
    p = points.select("building_id", "id", g.vec("x", "y").alias("p"))

    def farthest(start: DataFrame) -> DataFrame:
        """start (building_id, a, pa) with the farthest point; ties to the smaller id."""
        met = p.join(start, "building_id").select("building_id", "a", F.struct((-g.distance_xy(F.col("p"), F.col("pa"))).alias("d"), "id", "p").alias("x"))
        return met.groupBy("building_id", "a").agg(F.min("x").alias("x"))

    first = p.groupBy("building_id").agg(F.min(F.struct("id", "p")).alias("x")).select("building_id", F.col("x.id").alias("a"), F.col("x.p").alias("pa"))
    one = farthest(first).select("building_id", F.col("x.id").alias("a"), F.col("x.p").alias("pa"))
    return farthest(one).select("building_id", "a", F.col("x.id").alias("b"), (-F.col("x.d")).alias("d"))


def midpoint_routes(corridors: DataFrame, cells: DataFrame) -> DataFrame:
    """(building_id, source, id, points, length_m) of corridors (building_id, source, id, path) of cells: from the middle of the first cell over the middles of the sides that are crossed to that of the last, without points on a straight line.

    The legs of all corridors meet the sides in one join; a corridor is put together again from its own legs only.
    """
    key = ["building_id", "source", "id"]
    middle = cells.select("building_id", F.col("id").alias("cell"), g.centroid(*[g.vec(f"x{i}", f"y{i}") for i in (1, 2, 3)]).alias("p"))
    last = F.size("path") - 1
    ends = corridors.select(*key, F.explode(F.array(F.struct(F.lit(-1).alias("seq"), F.col("path")[0].alias("cell")), F.struct(last.alias("seq"), F.element_at("path", -1).alias("cell")))).alias("e"))
    ends = ends.select(*key, "e.seq", "e.cell").join(middle, ["building_id", "cell"]).select(*key, "seq", "p")
    steps = F.transform(F.slice("path", 1, last), lambda a, i: F.struct(i.alias("seq"), a.alias("a"), F.get("path", i + 1).alias("b")))
    legs = corridors.where(last > 0).select(*key, F.explode(steps).alias("s")).select(*key, "s.*")
    legs = legs.join(side_middles(cells), ["building_id", "a", "b"]).select(*key, "seq", F.col("m").alias("p"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda s: s["p"])
    raw = ends.unionByName(legs).groupBy(*key).agg(g.without_repeats(points).alias("raw"))
    return raw.select(*key, g.without_collinear(F.col("raw")).alias("points"), g.polyline_length(F.col("raw")).alias("length_m"))
