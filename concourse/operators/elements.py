"""Operators over raw building elements: ancestry, boundaries, openings, obstacles, points in boxes, vertical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle


def inherited_levels(parents: DataFrame, levels: DataFrame) -> DataFrame:
    """(id, level_id, depth): the level of each element or of its nearest ancestor that has one.

    parents (id, parent_id), levels (id, level_id), ids unique in both. Each round climbs one step for elements still
    without a level; who comes back to its own start is in a cycle and gets none, like those whose ancestry ends. Who
    stands on an element that has given up gives up too, so a cycle costs no more rounds than it has members.
    """
    climbing = settle(parents.where("id is not null").select("id", F.col("id").alias("at"), F.lit(0).alias("depth")))
    above = parents.select(F.col("id").alias("at"), F.col("parent_id").alias("up"))
    known = levels.where("level_id is not null").select(F.col("id").alias("at"), "level_id")
    done = None
    while True:
        found = climbing.join(known, "at").select("id", "level_id", "depth")
        done = settle(found if done is None else done.unionByName(found))
        rest = climbing.join(known, "at", "left_anti").join(above, "at").where("up is not null and up <> id")
        hopeful = climbing.select(F.col("id").alias("at")).unionByName(done.select(F.col("id").alias("at")))
        climbing = settle(rest.select("id", F.col("up").alias("at"), (F.col("depth") + 1).alias("depth")).join(hopeful, "at", "left_semi"))
        if climbing.isEmpty():
            return done


def first_of(*names: str) -> Column:
    """The first of the columns that holds more than an empty text."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])


def boundary_map(*relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (element_id, space_id) of all boundary relations (element_id, space_id, kind), and the elements that bound the outside."""
    rows = relations[0]
    for r in relations[1:]:
        rows = rows.unionByName(r)
    return rows.select("element_id", "space_id").distinct(), rows.where("kind = 'EXTERNAL'").select("element_id").distinct()


def related(doors: DataFrame, fills: DataFrame) -> DataFrame:
    """(door_id, element_id): each door itself and the opening that it fills; fills (element_id, opening_id)."""
    opened = doors.select(F.col("id").alias("element_id")).join(fills, "element_id").select(F.col("element_id").alias("door_id"), F.col("opening_id").alias("element_id"))
    return doors.select(F.col("id").alias("door_id"), F.col("id").alias("element_id")).unionByName(opened).distinct()


def door_sides(explicit: DataFrame, near: DataFrame) -> DataFrame:
    """(door_id, space_id, rank, how): a door's first two authored spaces, else its two nearest; explicit (door_id, space_id, ordinal), near (door_id, space_id, d)."""
    first = lambda *by: F.row_number().over(Window.partitionBy("door_id").orderBy(*by, "space_id"))
    authored = explicit.withColumn("rank", first("ordinal")).where("rank <= 2").select("door_id", "space_id", "rank", F.lit("authored").alias("how"))
    rest = near.join(explicit.select("door_id").distinct(), "door_id", "left_anti")
    return authored.unionByName(rest.withColumn("rank", first("d")).where("rank <= 2").select("door_id", "space_id", "rank", F.lit("near").alias("how")))


def walked_elements(flights: DataFrame, assemblies: DataFrame, parts: DataFrame) -> DataFrame:
    """All flights, and assemblies without a flight among their parts (assembly_id, part_id)."""
    split = parts.join(flights.select(F.col("id").alias("part_id")), "part_id", "left_semi").select(F.col("assembly_id").alias("id"))
    return flights.select("id").unionByName(assemblies.select("id").join(split, "id", "left_anti")).distinct()


def space_of_points(points: DataFrame, boxes: DataFrame, pad: float, cell: float) -> DataFrame:
    """(building_id, point_id, space_id): the first box by ordinal that holds the point within the padding; boxes (building_id, space_id, ordinal, lx, ly, hx, hy).

    Boxes are copied to the grid cells that they touch, so this is an equi-join.
    """
    at = lambda c: F.floor(c / cell)
    spread = lambda lo, hi: F.explode(F.sequence(at(F.col(lo) - pad), at(F.col(hi) + pad)))
    tiles = boxes.withColumn("gx", spread("lx", "hx")).withColumn("gy", spread("ly", "hy"))
    p = points.select("building_id", F.col("id").alias("point_id"), "x", "y", at(F.col("x")).alias("gx"), at(F.col("y")).alias("gy"))
    met = p.join(tiles, ["building_id", "gx", "gy"]).where(F.col("x").between(F.col("lx") - pad, F.col("hx") + pad) & F.col("y").between(F.col("ly") - pad, F.col("hy") + pad))
    return met.groupBy("building_id", "point_id").agg(F.min_by("space_id", F.struct("ordinal", "space_id")).alias("space_id"))


def in_pedestrian_volume(obstacles: DataFrame, floors: DataFrame, height: float, slack: float = 0.05) -> DataFrame:
    """Obstacles (space_id, id, z_min, z_max) that reach into the walking volume over the floor (space_id, floor_z) of their space."""
    met = obstacles.join(floors, "space_id")
    return met.where((F.col("z_max") > F.col("floor_z") + slack) & (F.col("z_min") < F.col("floor_z") + height - slack)).select("space_id", "id")


def slabs_as_floor(slabs: DataFrame, floors: DataFrame) -> DataFrame:
    """Slabs other than roofs (building_id, id, kind), of buildings in which no space has given a floor."""
    return slabs.where("kind is distinct from 'ROOF'").join(floors.select("building_id").distinct(), "building_id", "left_anti").select("building_id", "id")


def landings(members: DataFrame, links: DataFrame) -> DataFrame:
    """(building_id, component, level_id, space_id): for each level that a vertical component (members: building_id, component, id) touches, the nearest adjacent space; links (building_id, id, space_id, level_id, d)."""
    met = members.join(links, ["building_id", "id"])
    return met.groupBy("building_id", "component", "level_id").agg(F.min_by("space_id", F.struct("d", "space_id")).alias("space_id"))


def between_levels(found: DataFrame, levels: DataFrame, linked: DataFrame) -> DataFrame:
    """(building_id, component, from_space_id, to_space_id): landings on adjacent served levels, by elevation; pairs of spaces that are linked (building_id, from_space_id, to_space_id) in either direction already are left out."""
    order = Window.partitionBy("building_id", "component").orderBy("elevation_m", "level_id")
    up = found.join(levels.select("building_id", F.col("id").alias("level_id"), "elevation_m"), ["building_id", "level_id"])
    pairs = up.select("building_id", "component", F.col("space_id").alias("from_space_id"), F.lead("space_id").over(order).alias("to_space_id")).where("to_space_id is not null and to_space_id <> from_space_id")
    both = linked.unionByName(linked.select("building_id", F.col("to_space_id").alias("from_space_id"), F.col("from_space_id").alias("to_space_id")))
    return pairs.join(both.distinct(), ["building_id", "from_space_id", "to_space_id"], "left_anti").select("building_id", "component", "from_space_id", "to_space_id")
