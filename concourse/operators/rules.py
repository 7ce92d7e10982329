"""Validation rules: each is a DataFrame of issues (building_id, code, severity, entity_id); a report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("building_id", "code", "severity", "entity_id")


def issues(rows: DataFrame, code: str, severity: str, entity: str | Column) -> DataFrame:
    entity = F.col(entity) if isinstance(entity, str) else entity
    return rows.select("building_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), entity.cast("string").alias("entity_id"))


def without(rows: DataFrame, known: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """Rows whose non-null reference is not among the known ids of their building."""
    ids = known.select("building_id", F.col(id_column).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(ids, ["building_id", column], "left_anti")


def edge_id() -> Column:
    return F.concat_ws("-", "a", "b")


def missing_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = (nodes.select("building_id", F.col("id").alias(k), F.lit(True).alias(f"has_{k}")).distinct() for k in "ab")
    met = edges.join(a, ["building_id", "a"], "left").join(b, ["building_id", "b"], "left")
    return issues(met.where("has_a is null or has_b is null"), "EDGE_MISSING_NODE", "error", edge_id())


def self_edges(edges: DataFrame) -> DataFrame:
    return issues(edges.where("a = b"), "SELF_EDGE", "warning", edge_id())


def negative_lengths(edges: DataFrame) -> DataFrame:
    return issues(edges.where("distance_m < 0"), "NEGATIVE_DISTANCE", "error", edge_id())


def isolated_nodes(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    ends = edges.select("building_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    lone = nodes.join(ends, ["building_id", "id"], "left_anti")
    first = lone.withColumn("k", F.row_number().over(Window.partitionBy("building_id").orderBy("id"))).where(F.col("k") <= most)
    return issues(first, "ISOLATED_NODE", "warning", "id")


def empty_graphs(buildings: DataFrame, nodes: DataFrame) -> DataFrame:
    return issues(buildings.join(nodes.select("building_id").distinct(), "building_id", "left_anti"), "NO_NODES", "error", "building_id")


def unknown_portals(edges: DataFrame, portals: DataFrame) -> DataFrame:
    return issues(without(edges, portals, "portal_id"), "UNKNOWN_PORTAL", "error", edge_id())


def duplicates(rows: DataFrame, code: str, key: str, order: str) -> DataFrame:
    """Each repeat of a key after the first."""
    w = Window.partitionBy("building_id", key).orderBy(order)
    return issues(rows.withColumn("k", F.row_number().over(w)).where("k > 1"), code, "error", key)


def sides_differ(transitions: DataFrame, portals: DataFrame) -> DataFrame:
    """Transitions whose ends are not the two sides of the portal that they name, in any order."""
    sides = lambda a, b: F.array_sort(F.array_distinct(F.array_compact(F.array(a, b))))
    p = portals.select("building_id", F.col("id").alias("portal_id"), sides("from_space_id", "to_space_id").alias("of_portal"))
    met = transitions.join(p, ["building_id", "portal_id"])
    return issues(met.where(sides("from_id", "to_id") != F.col("of_portal")), "TRANSITION_PORTAL_MISMATCH", "error", F.concat_ws("-", "from_id", "to_id"))


def level_differs(transitions: DataFrame, spaces: DataFrame, end: str) -> DataFrame:
    s = spaces.select("building_id", F.col("id").alias(f"{end}_id"), "level_id")
    met = transitions.join(s, ["building_id", f"{end}_id"]).where(F.col(f"{end}_level_id").isNotNull() & F.col("level_id").isNotNull())
    return issues(met.where(F.col(f"{end}_level_id") != F.col("level_id")), f"TRANSITION_{end.upper()}_LEVEL_MISMATCH", "error", F.concat_ws("-", "from_id", "to_id"))


def no_exit(portals: DataFrame) -> DataFrame:
    none = portals.groupBy("building_id").agg(F.count_if("is_exit").alias("exits")).where("exits = 0")
    return issues(none, "NO_EXIT", "warning", "building_id")


def unmet(rows: DataFrame, used: DataFrame, code: str, column: str) -> DataFrame:
    """Rows (building_id, id) that no row of used (building_id, column) names."""
    ids = used.select("building_id", F.col(column).alias("id")).where("id is not null").distinct()
    return issues(rows.join(ids, ["building_id", "id"], "left_anti"), code, "warning", "id")


def missing_sides(portals: DataFrame, attached: DataFrame) -> DataFrame:
    """Portals with a side that no attached space (building_id, portal_id, space_id) covers."""
    have = attached.groupBy("building_id", F.col("portal_id").alias("id")).agg(F.collect_set("space_id").alias("have"))
    met = portals.join(have, ["building_id", "id"], "left")
    expected = F.array_compact(F.array("from_space_id", "to_space_id"))
    lack = F.array_except(expected, F.coalesce("have", F.array().cast("array<bigint>")))
    return issues(met.where(F.size(lack) > 0), "PORTAL_MISSING_SIDE", "warning", "id")


def vertical_unused(levels: DataFrame, nodes: DataFrame, transitions: DataFrame) -> DataFrame:
    """Buildings of several levels with vertical nodes, of which no transition joins two levels."""
    many = levels.groupBy("building_id").agg(F.count("*").alias("n")).where("n > 1").select("building_id")
    tall = nodes.where("kind in ('stair', 'elevator', 'ramp', 'escalator')").select("building_id").distinct()
    crossing = transitions.where("from_level_id <> to_level_id").select("building_id").distinct()
    return issues(many.join(tall, "building_id", "left_semi").join(crossing, "building_id", "left_anti"), "VERTICAL_NO_TRANSITION", "warning", "building_id")


def asymmetric(links: DataFrame) -> DataFrame:
    back = links.select("building_id", F.col("b").alias("a"), F.col("a").alias("b"))
    return issues(links.join(back, ["building_id", "a", "b"], "left_anti"), "SURFACE_ASYMMETRIC_ADJACENCY", "error", edge_id())


def crossings(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Links between open cells of different spaces."""
    c = cells.select("building_id", "id", "space_id", "terrain")
    met = links.join(c.toDF("building_id", "a", "sa", "ta"), ["building_id", "a"]).join(c.toDF("building_id", "b", "sb", "tb"), ["building_id", "b"])
    return issues(met.where("sa <> sb and ta = 'open' and tb = 'open'"), "SURFACE_UNAUTHORIZED_SPACE_CROSSING", "error", edge_id())


def report(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def verdicts(buildings: DataFrame, found: DataFrame) -> DataFrame:
    """Issue counts of each building, and whether it is valid and free of warnings."""
    counts = found.groupBy("building_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = buildings.join(counts, "building_id", "left").select("building_id", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), F.coalesce("warnings", F.lit(0)).cast("long").alias("warnings"))
    return out.select("*", (F.col("errors") == 0).alias("valid"), ((F.col("errors") == 0) & (F.col("warnings") == 0)).alias("navigation_ready"))


def evacuation_gate(frames: DataFrame) -> DataFrame:
    """(run_id, evacuated, active, clearance_s, passed) by the last status of each agent; frames (run_id, agent_id, frame_no, time_s, status)."""
    last = frames.groupBy("run_id", "agent_id").agg(F.max_by("status", F.struct("time_s", "frame_no")).alias("status"), F.max(F.when(F.col("status") == "evacuated", F.col("time_s"))).alias("out_s"))
    counted = last.groupBy("run_id").agg(F.count_if(F.col("status") == "evacuated").alias("evacuated"), F.count_if(F.col("status") != "evacuated").alias("active"), F.max("out_s").alias("clearance_s"))
    return counted.withColumn("passed", (F.col("active") == 0) & (F.coalesce("clearance_s", F.lit(0.0)) > 0))


def unknown_crossing_portals(crossed: DataFrame, portals: DataFrame) -> DataFrame:
    """Surface crossings (building_id, a, portal_id) that name no known portal."""
    return issues(without(crossed, portals, "portal_id"), "SURFACE_UNKNOWN_PORTAL", "error", "a")


def sides(first: Column, second: Column) -> Column:
    """The set of one or two sides, without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(first, second))))


def crossing_sides_differ(crossed: DataFrame, portals: DataFrame) -> DataFrame:
    """Crossings (building_id, portal_id, sa, sb) whose spaces aren't the sides of their portal."""
    known = portals.select("building_id", F.col("id").alias("portal_id"), sides(F.col("from_space_id"), F.col("to_space_id")).alias("named"))
    met = crossed.join(known, ["building_id", "portal_id"]).where(F.col("named") != sides(F.col("sa"), F.col("sb")))
    return issues(met, "SURFACE_PORTAL_SPACE_MISMATCH", "error", "portal_id")


def portals_without_crossing(crossed: DataFrame, portals: DataFrame, surfaced: DataFrame) -> DataFrame:
    """Portals between two surfaced spaces (building_id, space) that no crossing of theirs joins."""
    p = portals.withColumn("pair", sides(F.col("from_space_id"), F.col("to_space_id"))).where(F.size("pair") == 2)
    for side in ("from_space_id", "to_space_id"):
        p = p.join(surfaced.withColumnRenamed("space", side), ["building_id", side], "left_semi")
    seen = crossed.select("building_id", F.col("portal_id").alias("id"), sides(F.col("sa"), F.col("sb")).alias("pair"))
    return issues(p.join(seen, ["building_id", "id", "pair"], "left_anti"), "SURFACE_PORTAL_MISSING_SIDE", "warning", "id")


def gates(stats: DataFrame, least: dict[str, float]) -> DataFrame:
    """(building_id, metric, actual, least, passed): a row for each threshold of a report row per building; a null statistic fails."""
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("actual"), F.lit(float(v)).alias("least")) for m, v in least.items()]))
    return stats.select("building_id", named.alias("g")).select("building_id", "g.*", F.coalesce(F.col("g.actual") >= F.col("g.least"), F.lit(False)).alias("passed"))
