"""Lifts as parts of the metric graph: footprints meet doors, doors compete on each level, and what is served becomes nodes and edges."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import surface
from .graph import settle


class Connectors(NamedTuple):
    nodes: DataFrame  # building_id, id, kind, space_id, level_id, x, y, z
    edges: DataFrame  # building_id, a, b, distance_m, kind, portal_id; from each lift node to its landing, then from level to level
    withdrawn: DataFrame  # building_id, id: doors of landings, which are no exits
    rejected: DataFrame  # building_id, id: lifts with fewer than two levels
    stats: DataFrame  # building_id, detected, connected, landings, rejected


def connectors(lifts: DataFrame, doors: DataFrame, nodes: DataFrame, levels: DataFrame, reach: float = 1.0, walk: float = 2.5) -> Connectors:
    """Lifts (building_id, id, lx, ly, hx, hy) joined to the graph where at least two levels have a door and a node.

    A door (building_id, id, x, y, z, level_id, from_space_id, to_space_id) serves a lift if it lies within `reach` of
    the footprint in the plane, and a walk node of its level and of a space that it opens to lies within `walk` of it.
    On each level the door nearest to the footprint wins, then that of the nearest node, then the smaller id. Lifts
    with a null bound and doors without a level take no part; levels (building_id, id, elevation_m) give the order.
    """
    size = 2 * max(reach, 0.5)
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - reach) / size), F.floor((F.col(hi) + reach) / size)))
    whole = lifts.where("lx is not null and ly is not null and hx is not null and hy is not null")
    box = whole.withColumn("gx", span("lx", "hx")).withColumn("gy", span("ly", "hy")).withColumnRenamed("id", "lift")
    known = doors.join(levels.select("building_id", F.col("id").alias("level_id")), ["building_id", "level_id"], "left_semi")
    at = known.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)}).withColumnRenamed("id", "door")
    gap = lambda k: F.greatest(F.col(f"l{k}") - F.col(k), F.lit(0.0), F.col(k) - F.col(f"h{k}"))
    met = box.join(at, ["building_id", "gx", "gy"]).withColumn("off", F.round(F.sqrt(gap("x") ** 2 + gap("y") ** 2), 9)).where(F.col("off") <= reach)
    met = settle(met.select("building_id", "lift", "door", "level_id", "off", "x", "y", "z", F.array_distinct(F.array_compact(F.array("from_space_id", "to_space_id"))).alias("spaces")))
    # the nearest node of each door that any lift is near to
    asked = met.select("building_id", "level_id", F.col("door").alias("id"), F.explode("spaces").alias("space_id"), "x", "y", "z").distinct()
    feet = nodes.where("kind = 'walk' and level_id is not null and space_id is not null")
    near = surface.near_points(asked, feet, walk, ["building_id", "level_id", "space_id"]).groupBy("building_id", F.col("left_id").alias("door")).agg(F.min(F.struct("d", "right_id")).alias("n"))
    served = met.join(near, ["building_id", "door"]).groupBy("building_id", "lift", "level_id").agg(F.min(F.struct("off", "n.d", "door", F.col("n.right_id").alias("node"))).alias("x"))
    served = settle(served.select("building_id", "lift", "level_id", "x.door", "x.node"), met)
    enough = served.groupBy("building_id", "lift").agg(F.count("*").alias("n")).where("n >= 2").select("building_id", "lift")
    spot = feet.select("building_id", F.col("id").alias("node"), F.struct("x", "y", "z").alias("foot"))
    middle = whole.select("building_id", F.col("id").alias("lift"), ((F.col("lx") + F.col("hx")) / 2).alias("x"), ((F.col("ly") + F.col("hy")) / 2).alias("y"))
    stops = served.join(enough, ["building_id", "lift"]).join(spot, ["building_id", "node"]).join(middle, ["building_id", "lift"]).join(levels.select("building_id", F.col("id").alias("level_id"), "elevation_m"), ["building_id", "level_id"])
    stops = settle(stops.select("building_id", "lift", "level_id", "elevation_m", "door", "node", "foot", F.concat_ws(":", F.lit("elevator"), "lift", "level_id").alias("id"), "x", "y", F.col("foot.z").alias("z")), served)
    here = g.vec("x", "y", "z")
    new = stops.select("building_id", "id", F.lit("elevator").alias("kind"), F.lit(None).cast("string").alias("space_id"), "level_id", "x", "y", "z")
    landing = stops.select("building_id", F.col("id").alias("a"), F.col("node").alias("b"), g.distance(here, F.col("foot")).alias("distance_m"), F.lit("elevator").alias("kind"), F.col("door").alias("portal_id"))
    up = Window.partitionBy("building_id", "lift").orderBy("elevation_m", "level_id")
    shaft = stops.select("building_id", F.col("id").alias("a"), F.lead("id").over(up).alias("b"), g.distance(here, F.lead(here).over(up)).alias("distance_m"), F.lit("elevator").alias("kind"), F.lit(None).cast("string").alias("portal_id")).where("b is not null")
    lost = lifts.select("building_id", "id").join(stops.select("building_id", F.col("lift").alias("id")), ["building_id", "id"], "left_anti")
    n = lambda t, name: t.groupBy("building_id").agg(F.count("*").alias(name))
    stats = n(lifts, "detected").join(n(stops.select("building_id", "lift").distinct(), "connected"), "building_id", "left").join(n(stops, "landings"), "building_id", "left").join(n(lost, "rejected"), "building_id", "left").fillna(0)
    return Connectors(new, landing.unionByName(shaft), stops.select("building_id", F.col("door").alias("id")).distinct(), lost, stats)
