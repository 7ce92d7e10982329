"""Queries of the validation rules, over a model with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, joins, rules
from ..registry import query
from ..sources import views
from ..sources.views import with_views
from .graphs import LOCAL, TRANS
from .joins import LINKS

MODEL = with_views("v_levels", "v_spaces", "v_transitions", "v_nodes", "v_node_edges", "v_portals", "v_open", "v_open_edges")
UND = ", und AS (SELECT building_id, a, b FROM v_open_edges UNION SELECT building_id, b, a FROM v_open_edges), kn AS (SELECT u.* FROM und u JOIN v_nodes p ON p.id = u.a AND p.building_id = u.building_id JOIN v_nodes q ON q.id = u.b AND q.building_id = u.building_id), reached AS (SELECT building_id, id AS u, id AS v FROM v_nodes UNION SELECT r.building_id, r.u, k.b FROM reached r JOIN kn k ON k.building_id = r.building_id AND k.a = r.v), label AS (SELECT building_id, u AS id, min(v) AS component FROM reached GROUP BY 1, 2) "
EDGE = "a || '-' || b"


def issue(code: str, severity: str, entity: str, rest: str, building: str = "building_id") -> str:
    return f"SELECT {building} AS building_id, '{code}' AS code, '{severity}' AS severity, CAST({entity} AS VARCHAR) AS entity_id FROM {rest}"


def lacks(code: str, severity: str, entity: str, table: str, column: str, known: str, known_id: str = "id", more: str = "") -> str:
    return issue(code, severity, entity, f"{table} x WHERE {column} IS NOT NULL {more} AND NOT EXISTS (SELECT 1 FROM {known} k WHERE k.building_id = x.building_id AND k.{known_id} = x.{column})")


def known_edges(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    return views.open_edges(spark, d).join(n.select("building_id", F.col("id").alias("a")), ["building_id", "a"], "left_semi").join(n.select("building_id", F.col("id").alias("b")), ["building_id", "b"], "left_semi")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(views.nodes(spark, d), known_edges(spark, d))


def named_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Transitions that name a portal and levels, some of them wrong."""
    t = views.transitions(spark, d)
    return t.withColumns({"portal_id": F.concat(F.lit("d"), F.col("from_id").cast("string")), "from_level_id": F.col("from_id") % 25, "to_level_id": F.when(F.col("to_id") % 2 == 0, F.col("to_id") % 25)})


NAMED = MODEL + ", named AS (SELECT *, 'd' || from_id AS portal_id, from_id % 25 AS from_level_id, CASE WHEN to_id % 2 = 0 THEN to_id % 25 END AS to_level_id FROM v_transitions) "


@query("v1", MODEL + issue("EDGE_MISSING_NODE", "error", EDGE, "v_node_edges x WHERE NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.id = x.a AND n.building_id = x.building_id) OR NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.id = x.b AND n.building_id = x.building_id)"))
def v1(spark: SparkSession, d: str) -> DataFrame:
    return rules.missing_nodes(views.node_edges(spark, d), views.nodes(spark, d))


@query("v2", MODEL + issue("SELF_EDGE", "warning", EDGE, "v_node_edges WHERE a = b"))
def v2(spark: SparkSession, d: str) -> DataFrame:
    return rules.self_edges(views.node_edges(spark, d))


@query("v3", MODEL + issue("NEGATIVE_DISTANCE", "error", EDGE, "v_node_edges WHERE distance_m < 0"))
def v3(spark: SparkSession, d: str) -> DataFrame:
    return rules.negative_lengths(views.node_edges(spark, d))


@query("v4", MODEL + ", lone AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY id) AS k FROM v_nodes n WHERE NOT EXISTS (SELECT 1 FROM v_open_edges e WHERE e.building_id = n.building_id AND n.id IN (e.a, e.b))) " + issue("ISOLATED_NODE", "warning", "id", "lone WHERE k <= 100"))
def v4(spark: SparkSession, d: str) -> DataFrame:
    return rules.isolated_nodes(views.nodes(spark, d), views.open_edges(spark, d))


@query("v5", MODEL + issue("NO_NODES", "error", "building_id", "(SELECT DISTINCT building_id FROM v_levels) b WHERE NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.building_id = b.building_id AND n.kind = 'stair' AND n.is_exit)"))
def v5(spark: SparkSession, d: str) -> DataFrame:
    """Buildings without a node where a stair leads out."""
    return rules.empty_graphs(views.levels(spark, d).select("building_id").distinct(), views.nodes(spark, d).where("kind = 'stair' and is_exit"))


@query("v6", MODEL + UND + issue("DISCONNECTED_GRAPH", "warning", "building_id", "label GROUP BY building_id HAVING count(DISTINCT component) > 1"))
def v6(spark: SparkSession, d: str) -> DataFrame:
    several = labelled(spark, d).groupBy("building_id").agg(F.countDistinct("component").alias("n")).where("n > 1")
    return rules.issues(several, "DISCONNECTED_GRAPH", "warning", "building_id")


@query("v7", MODEL + lacks("UNKNOWN_PORTAL", "error", EDGE, "v_node_edges", "portal_id", "v_portals"))
def v7(spark: SparkSession, d: str) -> DataFrame:
    return rules.unknown_portals(views.node_edges(spark, d), views.portals(spark, d))


@query("v8", MODEL + ", r AS (SELECT building_id, from_id, row_number() OVER (PARTITION BY building_id, from_id ORDER BY to_id) AS k FROM v_transitions) " + issue("DUPLICATE_TRANSITION", "error", "from_id", "r WHERE k > 1"))
def v8(spark: SparkSession, d: str) -> DataFrame:
    return rules.duplicates(views.transitions(spark, d), "DUPLICATE_TRANSITION", "from_id", "to_id")


@query("v9", MODEL + lacks("TRANSITION_UNKNOWN_FROM_SPACE", "error", "from_id || '-' || to_id", "v_transitions", "from_id", "v_nodes"))
def v9(spark: SparkSession, d: str) -> DataFrame:
    return rules.issues(rules.without(views.transitions(spark, d), views.nodes(spark, d), "from_id"), "TRANSITION_UNKNOWN_FROM_SPACE", "error", F.concat_ws("-", "from_id", "to_id"))


@query("v10", MODEL + lacks("TRANSITION_UNKNOWN_TO_SPACE", "error", "from_id || '-' || to_id", "v_transitions", "to_id", "v_nodes"))
def v10(spark: SparkSession, d: str) -> DataFrame:
    return rules.issues(rules.without(views.transitions(spark, d), views.nodes(spark, d), "to_id"), "TRANSITION_UNKNOWN_TO_SPACE", "error", F.concat_ws("-", "from_id", "to_id"))


@query("v11", NAMED + lacks("TRANSITION_UNKNOWN_PORTAL", "error", "from_id || '-' || to_id", "named", "portal_id", "v_portals"))
def v11(spark: SparkSession, d: str) -> DataFrame:
    return rules.issues(rules.without(named_transitions(spark, d), views.portals(spark, d), "portal_id"), "TRANSITION_UNKNOWN_PORTAL", "error", F.concat_ws("-", "from_id", "to_id"))


@query("v12", NAMED + issue("TRANSITION_PORTAL_MISMATCH", "error", "from_id || '-' || to_id", "named n JOIN v_portals p ON p.id = n.portal_id AND p.building_id = n.building_id WHERE NOT (p.to_space_id IS NOT NULL AND ((from_id = from_space_id AND to_id = to_space_id) OR (from_id = to_space_id AND to_id = from_space_id)))", "n.building_id"))
def v12(spark: SparkSession, d: str) -> DataFrame:
    return rules.sides_differ(named_transitions(spark, d), views.portals(spark, d))


@query("v13", NAMED + issue("TRANSITION_FROM_LEVEL_MISMATCH", "error", "from_id || '-' || to_id", "named n JOIN v_spaces s ON s.id = n.from_id AND s.building_id = n.building_id WHERE s.level_id <> n.from_level_id", "n.building_id"))
def v13(spark: SparkSession, d: str) -> DataFrame:
    return rules.level_differs(named_transitions(spark, d), views.spaces(spark, d), "from")


@query("v14", NAMED + issue("TRANSITION_TO_LEVEL_MISMATCH", "error", "from_id || '-' || to_id", "named n JOIN v_spaces s ON s.id = n.to_id AND s.building_id = n.building_id WHERE s.level_id <> n.to_level_id", "n.building_id"))
def v14(spark: SparkSession, d: str) -> DataFrame:
    return rules.level_differs(named_transitions(spark, d), views.spaces(spark, d), "to")


@query("v15", MODEL + issue("NO_EXIT", "warning", "building_id", "v_portals GROUP BY building_id HAVING count(*) FILTER (WHERE is_exit) = 0"))
def v15(spark: SparkSession, d: str) -> DataFrame:
    return rules.no_exit(views.portals(spark, d))


@query("v16", MODEL + issue("PORTAL_NO_NODE", "warning", "id", "v_portals x WHERE NOT EXISTS (SELECT 1 FROM v_open_edges k WHERE k.building_id = x.building_id AND k.portal_id = x.id)"))
def v16(spark: SparkSession, d: str) -> DataFrame:
    return rules.unmet(views.portals(spark, d), views.open_edges(spark, d), "PORTAL_NO_NODE", "portal_id")


@query("v17", MODEL + issue("PORTAL_DISCONNECTED", "warning", "id", "v_portals x WHERE NOT EXISTS (SELECT 1 FROM v_node_edges k WHERE k.building_id = x.building_id AND k.portal_id = x.id AND k.a <> k.b)"))
def v17(spark: SparkSession, d: str) -> DataFrame:
    return rules.unmet(views.portals(spark, d), views.node_edges(spark, d).where("a <> b"), "PORTAL_DISCONNECTED", "portal_id")


@query("v18", MODEL + ", att AS (SELECT building_id, portal_id, a AS space_id FROM v_node_edges UNION SELECT building_id, portal_id, b FROM v_node_edges) " + issue("PORTAL_MISSING_SIDE", "warning", "id", "v_portals x WHERE (from_space_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM att k WHERE k.building_id = x.building_id AND k.portal_id = x.id AND k.space_id = x.from_space_id)) OR (to_space_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM att k WHERE k.building_id = x.building_id AND k.portal_id = x.id AND k.space_id = x.to_space_id))"))
def v18(spark: SparkSession, d: str) -> DataFrame:
    e = views.node_edges(spark, d).where("portal_id is not null")
    return rules.missing_sides(views.portals(spark, d), e.select("building_id", "portal_id", F.explode(F.array("a", "b")).alias("space_id")).distinct())


@query("v19", MODEL + issue("SPACE_NO_NAV", "warning", "id", "v_spaces x WHERE NOT EXISTS (SELECT 1 FROM v_nodes k WHERE k.building_id = x.building_id AND k.id = x.id)"))
def v19(spark: SparkSession, d: str) -> DataFrame:
    return rules.unmet(views.spaces(spark, d), views.nodes(spark, d), "SPACE_NO_NAV", "id")


@query("v20", MODEL + UND + issue("SPACE_SPLIT_COMPONENTS", "warning", "n.space_id", "label l JOIN v_nodes n ON n.id = l.id AND n.building_id = l.building_id GROUP BY l.building_id, n.space_id HAVING count(DISTINCT component) > 1", "l.building_id"))
def v20(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d).select("building_id", "id", "space_id")
    split = labelled(spark, d).join(n, ["building_id", "id"]).groupBy("building_id", "space_id").agg(F.countDistinct("component").alias("n")).where("n > 1")
    return rules.issues(split, "SPACE_SPLIT_COMPONENTS", "warning", "space_id")


@query("v21", MODEL + issue("LEVEL_NO_NAV", "warning", "id", "v_levels x WHERE NOT EXISTS (SELECT 1 FROM v_nodes k WHERE k.building_id = x.building_id AND k.level_id = x.id AND k.kind <> 'walk')"))
def v21(spark: SparkSession, d: str) -> DataFrame:
    return rules.unmet(views.levels(spark, d), views.nodes(spark, d).where("kind <> 'walk'"), "LEVEL_NO_NAV", "level_id")


@query("v22", MODEL + UND + issue("NODES_CANNOT_REACH_EXIT", "warning", "count(*)", "label l WHERE NOT EXISTS (SELECT 1 FROM label m JOIN v_nodes n ON n.id = m.id AND n.building_id = m.building_id WHERE n.is_exit AND m.building_id = l.building_id AND m.component = l.component) GROUP BY building_id"))
def v22(spark: SparkSession, d: str) -> DataFrame:
    label = labelled(spark, d)
    good = label.join(views.nodes(spark, d).where("is_exit").select("building_id", "id"), ["building_id", "id"], "left_semi").select("building_id", "component").distinct()
    lost = label.join(good, ["building_id", "component"], "left_anti").groupBy("building_id").agg(F.count("*").alias("n"))
    return rules.issues(lost, "NODES_CANNOT_REACH_EXIT", "warning", "n")


@query("v23", NAMED + issue("VERTICAL_NO_TRANSITION", "warning", "building_id", "(SELECT building_id FROM v_levels GROUP BY 1 HAVING count(*) > 1) b WHERE EXISTS (SELECT 1 FROM v_nodes n WHERE n.building_id = b.building_id AND kind IN ('stair', 'elevator')) AND NOT EXISTS (SELECT 1 FROM named t JOIN v_open o USING (building_id, from_id, to_id) WHERE t.building_id = b.building_id AND from_level_id <> to_level_id AND t.bidirectional AND from_id % 10 = 3)"))
def v23(spark: SparkSession, d: str) -> DataFrame:
    return rules.vertical_unused(views.levels(spark, d), views.nodes(spark, d), named_transitions(spark, d).join(views.open_transitions(spark, d).select("building_id", "from_id", "to_id"), ["building_id", "from_id", "to_id"], "left_semi").where("bidirectional and from_id % 10 = 3"))


CELLS = with_views("v_cells")


@query("v24", CELLS + issue("SURFACE_DUPLICATE_CELL_ID", "error", "count(*) - count(DISTINCT id // 3)", "v_cells GROUP BY building_id HAVING count(*) > count(DISTINCT id // 3)"))
def v24(spark: SparkSession, d: str) -> DataFrame:
    c = views.cells(spark, d).withColumn("id", F.expr("id div 3"))
    repeats = c.groupBy("building_id").agg((F.count("*") - F.countDistinct("id")).alias("n")).where("n > 0")
    return rules.issues(repeats, "SURFACE_DUPLICATE_CELL_ID", "error", "n")


@query("v25", LINKS + issue("SURFACE_UNKNOWN_NEIGHBOR", "error", EDGE, "links x WHERE b % 50 = 0"))
def v25(spark: SparkSession, d: str) -> DataFrame:
    """Links to cells that are not there; every fiftieth cell is taken out first."""
    c = views.cells(spark, d)
    gone = rules.without(joins.shared_sides(c), c.where("id % 50 <> 0"), "b")
    return rules.issues(gone, "SURFACE_UNKNOWN_NEIGHBOR", "error", rules.edge_id())


@query("v26", LINKS + ", w AS (SELECT building_id, a, b FROM links UNION ALL SELECT building_id, b, a FROM links WHERE a % 40 <> 0) " + issue("SURFACE_ASYMMETRIC_ADJACENCY", "error", EDGE, "w x WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.a = x.b AND y.b = x.a AND y.building_id = x.building_id)"))
def v26(spark: SparkSession, d: str) -> DataFrame:
    links = joins.shared_sides(views.cells(spark, d))
    both = links.unionByName(links.where("a % 40 <> 0").select("building_id", F.col("b").alias("a"), F.col("a").alias("b")))
    return rules.asymmetric(both)


@query("v27", LINKS + issue("SURFACE_PORTAL_ID_MISMATCH", "error", EDGE, "links WHERE a % 6 <> b % 6 AND a % 6 <> 0 AND b % 6 <> 0"))
def v27(spark: SparkSession, d: str) -> DataFrame:
    """Links whose two directions name different portals; the portal of a direction is its start modulo six, none for 0."""
    links = joins.shared_sides(views.cells(spark, d))
    named = lambda a, b: links.select("building_id", F.col(a).alias("a"), F.col(b).alias("b"), F.nullif(F.col(a) % 6, F.lit(0)).alias("portal"))
    both = named("a", "b").join(named("b", "a").select("building_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("portal").alias("back")), ["building_id", "a", "b"])
    return rules.issues(both.where("portal <> back"), "SURFACE_PORTAL_ID_MISMATCH", "error", rules.edge_id())


@query("v28", LINKS + issue("SURFACE_UNAUTHORIZED_SPACE_CROSSING", "error", EDGE, "h JOIN v_cells p ON p.id = a JOIN v_cells q ON q.id = b WHERE p.space_id <> q.space_id AND p.terrain = 'open' AND q.terrain = 'open'", "h.building_id"))
def v28(spark: SparkSession, d: str) -> DataFrame:
    c = views.cells(spark, d)
    sides = joins.triangle_sides(c).groupBy("building_id", "key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2")
    return rules.crossings(sides, c)


@query("v31", LOCAL + issue("SURFACE_SPACE_SPLIT_COMPONENTS", "warning", "space_id", "label l JOIN v_cells c ON c.id = l.id GROUP BY c.building_id, space_id HAVING count(DISTINCT component) > 1", "c.building_id"))
def v31(spark: SparkSession, d: str) -> DataFrame:
    from .graphs import gr3

    return rules.issues(gr3(spark, d).where("split"), "SURFACE_SPACE_SPLIT_COMPONENTS", "warning", "space_id")


SEEN = with_views("v_spaces", "v_transitions", "v_open") + ", arcs AS (SELECT building_id, from_id AS a, to_id AS b FROM v_open UNION SELECT building_id, to_id, from_id FROM v_open WHERE bidirectional), seen AS (SELECT building_id, id FROM v_spaces WHERE is_exit UNION SELECT a.building_id, a.a FROM seen s JOIN arcs a ON a.building_id = s.building_id AND a.b = s.id), lost AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY id) AS k FROM v_spaces x WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.building_id = x.building_id AND s.id = x.id)) "


@query("v35", SEEN + issue("SURFACE_SPACE_CANNOT_REACH_EXIT", "warning", "id", "lost WHERE k <= 25") + " UNION ALL " + issue("SURFACE_SPACES_CANNOT_REACH_EXIT", "warning", "count(*)", "lost GROUP BY building_id"))
def v35(spark: SparkSession, d: str) -> DataFrame:
    back = graph.space_arcs(views.open_transitions(spark, d)).select("building_id", F.col("b").alias("a"), F.col("a").alias("b"))
    lost = views.spaces(spark, d).join(graph.reachable(views.spaces(spark, d).where("is_exit"), back), ["building_id", "id"], "left_anti")
    first = rules.Window.partitionBy("building_id").orderBy("id")
    named = lost.withColumn("k", F.row_number().over(first)).where("k <= 25")
    total = lost.groupBy("building_id").agg(F.count("*").alias("n"))
    return rules.issues(named, "SURFACE_SPACE_CANNOT_REACH_EXIT", "warning", "id").unionByName(rules.issues(total, "SURFACE_SPACES_CANNOT_REACH_EXIT", "warning", "n"))


@query("v37", MODEL + ", f AS (SELECT building_id, 'error' AS severity FROM v_node_edges WHERE distance_m < 0 UNION ALL SELECT building_id, 'warning' FROM v_node_edges WHERE a = b), c AS (SELECT building_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM f GROUP BY 1) SELECT b.building_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) = 0 AND coalesce(warnings, 0) = 0 AS navigation_ready FROM (SELECT DISTINCT building_id FROM v_levels) b LEFT JOIN c USING (building_id)")
def v37(spark: SparkSession, d: str) -> DataFrame:
    found = rules.report(v2(spark, d), v3(spark, d))
    return rules.verdicts(views.levels(spark, d).select("building_id").distinct(), found)


@query("v38", CELLS + "SELECT building_id, 'FLAT_CELL' AS code, 'error' AS severity, CAST(id AS VARCHAR) AS entity_id FROM v_cells WHERE abs((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1)) / 2 <= CASE WHEN id % 9 = 0 THEN 1 ELSE 1e-10 END")
def v38(spark: SparkSession, d: str) -> DataFrame:
    """Triangles too small for the export; every ninth has to be larger than one square metre."""
    from ..functions import geometry as g

    c = views.cells(spark, d)
    size = g.area_xy(*[g.vec(f"x{i}", f"y{i}") for i in (1, 2, 3)])
    return rules.issues(c.where(size <= F.when(F.col("id") % 9 == 0, 1.0).otherwise(1e-10)), "FLAT_CELL", "error", "id")


@query("v34", MODEL + issue("SURFACE_EXIT_UNBOUND", "warning", "building_id", "(SELECT DISTINCT building_id FROM v_spaces WHERE is_exit) b WHERE NOT EXISTS (SELECT 1 FROM v_spaces s JOIN v_nodes n ON n.id = s.id AND n.building_id = s.building_id WHERE s.is_exit AND s.building_id = b.building_id AND n.kind = 'stair' AND n.level_id % 5 = 0)"))
def v34(spark: SparkSession, d: str) -> DataFrame:
    """Buildings with exits of which none lies on a space with a surface; stairs on every fifth level stand for surfaces."""
    exits = views.spaces(spark, d).where("is_exit").select("building_id", "id")
    bound = exits.join(views.nodes(spark, d).where("kind = 'stair' and level_id % 5 = 0").select("building_id", "id"), ["building_id", "id"], "left_semi")
    lost = exits.select("building_id").distinct().join(bound, "building_id", "left_anti")
    return rules.issues(lost, "SURFACE_EXIT_UNBOUND", "warning", "building_id")


@query("v36", MODEL + issue("SURFACE_NO_CROSS_LEVEL_TRANSITION", "warning", "building_id", "(SELECT building_id FROM v_levels GROUP BY 1 HAVING count(*) > 1) b WHERE NOT EXISTS (SELECT 1 FROM v_transitions t JOIN v_spaces p ON p.id = from_id JOIN v_spaces q ON q.id = to_id WHERE t.building_id = b.building_id AND p.level_id <> q.level_id AND from_id % 70 = 1)"))
def v36(spark: SparkSession, d: str) -> DataFrame:
    """Buildings of several levels without a transition from one to another, among those from every seventieth space."""
    level = lambda end: views.spaces(spark, d).select(F.col("id").alias(f"{end}_id"), F.col("level_id").alias(f"{end}_level"))
    across = views.transitions(spark, d).where("from_id % 70 = 1").join(level("from"), "from_id").join(level("to"), "to_id").where("from_level <> to_level")
    several = views.levels(spark, d).groupBy("building_id").agg(F.count("*").alias("n")).where("n > 1")
    return rules.issues(several.join(across, "building_id", "left_anti"), "SURFACE_NO_CROSS_LEVEL_TRANSITION", "warning", "building_id")


@query("v41", with_views("v_frames") + """, last AS (SELECT run_id, agent_id, arg_max(status, (time_s, frame_no)) AS status, max(CASE WHEN status = 'evacuated' THEN time_s END) AS out_s FROM v_frames GROUP BY 1, 2)
    SELECT run_id, count(*) FILTER (WHERE status = 'evacuated') AS evacuated, count(*) FILTER (WHERE status <> 'evacuated') AS active, max(out_s) AS clearance_s, count(*) FILTER (WHERE status <> 'evacuated') = 0 AND coalesce(max(out_s), 0) > 0 AS passed FROM last GROUP BY 1""")
def v41(spark: SparkSession, d: str) -> DataFrame:
    """The evacuation gate: all are out at their last frame, and it took time."""
    return rules.evacuation_gate(views.frames(spark, d))


# crossings of the surface between spaces, with the portal that each names; spaces by the number of their brand
CROSSED = LINKS + f""", v_spaces AS ({views.SQL["v_spaces"]}), v_portals AS ({views.SQL["v_portals"]}),
    x AS (SELECT h.building_id, a, b, 'd' || (a % 60) AS portal_id, CAST(substr(p.space_id, 7) AS BIGINT) AS sa, CAST(substr(q.space_id, 7) AS BIGINT) AS sb FROM h JOIN v_cells p ON p.id = a JOIN v_cells q ON q.id = b WHERE p.space_id <> q.space_id) """


def crossed(spark: SparkSession, d: str) -> DataFrame:
    c = views.cells(spark, d)
    number = lambda end, side: c.select(F.col("id").alias(end), F.substring("space_id", 7, 9).cast("long").alias(side))
    both = joins.triangle_sides(c).groupBy("building_id", "key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2")
    return both.join(number("a", "sa"), "a").join(number("b", "sb"), "b").where("sa <> sb").select("building_id", "a", "b", F.concat(F.lit("d"), (F.col("a") % 60).cast("string")).alias("portal_id"), "sa", "sb")


@query("v29", CROSSED + issue("SURFACE_UNKNOWN_PORTAL", "error", "a", "x WHERE NOT EXISTS (SELECT 1 FROM v_portals p WHERE p.id = x.portal_id AND p.building_id = x.building_id)"))
def v29(spark: SparkSession, d: str) -> DataFrame:
    return rules.unknown_crossing_portals(crossed(spark, d), views.portals(spark, d))


@query("v30", CROSSED + issue("SURFACE_PORTAL_SPACE_MISMATCH", "error", "portal_id", "x JOIN v_portals p ON p.id = x.portal_id AND p.building_id = x.building_id WHERE NOT (to_space_id IS NOT NULL AND ((from_space_id = sa AND to_space_id = sb) OR (from_space_id = sb AND to_space_id = sa)))", "x.building_id"))
def v30(spark: SparkSession, d: str) -> DataFrame:
    return rules.crossing_sides_differ(crossed(spark, d), views.portals(spark, d))


@query(
    "v32",
    CROSSED + ", f AS (SELECT DISTINCT building_id, CAST(substr(space_id, 7) AS BIGINT) AS space FROM v_cells) " + issue("SURFACE_PORTAL_MISSING_SIDE", "warning", "id", "v_portals p WHERE from_space_id <> to_space_id AND EXISTS (SELECT 1 FROM f WHERE f.building_id = p.building_id AND space = from_space_id) AND EXISTS (SELECT 1 FROM f WHERE f.building_id = p.building_id AND space = to_space_id) AND NOT EXISTS (SELECT 1 FROM x WHERE x.building_id = p.building_id AND x.portal_id = p.id AND ((from_space_id = sa AND to_space_id = sb) OR (from_space_id = sb AND to_space_id = sa)))"),
)
def v32(spark: SparkSession, d: str) -> DataFrame:
    surfaced = views.cells(spark, d).select("building_id", F.substring("space_id", 7, 9).cast("long").alias("space")).distinct()
    return rules.portals_without_crossing(crossed(spark, d), views.portals(spark, d), surfaced)


FAULTS = ", faults AS (SELECT building_id, count(*) FILTER (WHERE s = 'error') AS errors, count(*) FILTER (WHERE s = 'warning') AS warnings FROM (SELECT building_id, 'error' AS s FROM v_node_edges WHERE distance_m < 0 UNION ALL SELECT building_id, 'warning' FROM v_node_edges WHERE a = b) GROUP BY 1) "
LEAST = {"nodes": 10, "edges": 50, "portals": 8, "exits": 1, "spaces": 15}


@query(
    "v39",
    MODEL + ", b AS (SELECT DISTINCT building_id FROM v_levels), m AS (" + " UNION ALL ".join(f"SELECT b.building_id, '{m}' AS metric, (SELECT count(*) FROM {v} x WHERE x.building_id = b.building_id{w})::DOUBLE AS actual, {float(LEAST[m])}::DOUBLE AS least FROM b" for m, v, w in (("nodes", "v_nodes", ""), ("edges", "v_node_edges", ""), ("portals", "v_portals", ""), ("exits", "v_portals", " AND is_exit"), ("spaces", "v_spaces", ""))) + ") SELECT *, actual >= least AS passed FROM m",
)
def v39(spark: SparkSession, d: str) -> DataFrame:
    """The reference gate: a row for each threshold on the statistics of a building."""
    from .aggregates import agg1

    return rules.gates(agg1(spark, d), LEAST)


@query(
    "v42",
    MODEL.rstrip() + TRANS[TRANS.index(", arcs AS") :] + ", seen AS (SELECT building_id, id FROM v_spaces WHERE is_exit UNION SELECT a.building_id, a.a FROM seen s JOIN arcs a ON a.building_id = s.building_id AND a.b = s.id), lost AS (SELECT building_id, count(*) AS n FROM v_spaces s WHERE id % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM seen x WHERE x.building_id = s.building_id AND x.id = s.id) GROUP BY 1)" + FAULTS + "SELECT b.building_id, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) = 0 AND coalesce(warnings, 0) = 0 AS ready, coalesce(n, 0) AS unreachable, coalesce(errors, 0) = 0 AND coalesce(warnings, 0) = 0 AND coalesce(n, 0) = 0 AS passed FROM (SELECT DISTINCT building_id FROM v_levels) b LEFT JOIN faults USING (building_id) LEFT JOIN lost USING (building_id)",
)
def v42(spark: SparkSession, d: str) -> DataFrame:
    """The build gate: valid, ready, and no space that needs a way out lacks one; every ninth space is outside and needs none."""
    from .graphs import gr9

    lost = views.spaces(spark, d).where("id % 9 <> 0").select("building_id", "id").join(gr9(spark, d), ["building_id", "id"], "left_anti").groupBy("building_id").agg(F.count("*").alias("n"))
    out = v37(spark, d).join(lost, "building_id", "left").select("building_id", "valid", F.col("navigation_ready").alias("ready"), F.coalesce("n", F.lit(0)).cast("long").alias("unreachable"))
    return out.withColumn("passed", F.col("valid") & F.col("ready") & (F.col("unreachable") == 0))
