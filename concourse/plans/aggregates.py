"""Queries of the aggregations: validation counts, evacuation summaries, corpus roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import evacuation
from ..registry import query
from ..sources import views
from ..sources.views import with_views
from .graphs import GR1, gr1
from .rules import MODEL

FRAMES, RESULTS = with_views("v_frames"), with_views("v_results")
LAST = FRAMES + ", a AS (SELECT run_id, agent_id, arg_max(status, (time_s, frame_no)) AS last, min(time_s) FILTER (WHERE status = 'evacuated') AS out_s FROM v_frames GROUP BY 1, 2) "


@query("agg1", MODEL + "SELECT b.building_id, (SELECT count(*) FROM v_nodes n WHERE n.building_id = b.building_id) AS nodes, (SELECT count(*) FROM v_node_edges n WHERE n.building_id = b.building_id) AS edges, (SELECT count(*) FROM v_portals n WHERE n.building_id = b.building_id) AS portals, (SELECT count(*) FROM v_portals n WHERE n.building_id = b.building_id AND is_exit) AS exits, (SELECT count(*) FROM v_spaces n WHERE n.building_id = b.building_id) AS spaces FROM (SELECT DISTINCT building_id FROM v_levels) b")
def agg1(spark: SparkSession, d: str) -> DataFrame:
    out = views.levels(spark, d).select("building_id").distinct()
    for name, rows, n in (("nodes", views.nodes, F.count("*")), ("edges", views.node_edges, F.count("*")), ("portals", views.portals, F.count("*")), ("exits", views.portals, F.count_if("is_exit")), ("spaces", views.spaces, F.count("*"))):
        out = out.join(rows(spark, d).groupBy("building_id").agg(n.alias(name)), "building_id", "left").fillna(0, [name])
    return out


@query("agg2", MODEL + ", f AS (SELECT building_id, 'error' AS s FROM v_node_edges WHERE distance_m < 0 UNION ALL SELECT building_id, 'warning' FROM v_node_edges WHERE a = b) SELECT building_id, count(*) FILTER (WHERE s = 'error') AS error, count(*) FILTER (WHERE s = 'warning') AS warning FROM f GROUP BY 1")
def agg2(spark: SparkSession, d: str) -> DataFrame:
    from .rules import v2, v3

    found = v2(spark, d).unionByName(v3(spark, d))
    return found.groupBy("building_id").pivot("severity", ["error", "warning"]).count().fillna(0, ["error", "warning"])


@query("agg3", with_views("v_cells") + "SELECT building_id, terrain, count(*) AS n_cells, count(DISTINCT space_id) AS n_spaces FROM v_cells GROUP BY 1, 2")
def agg3(spark: SparkSession, d: str) -> DataFrame:
    return views.cells(spark, d).groupBy("building_id", "terrain").agg(F.count("*").alias("n_cells"), F.countDistinct("space_id").alias("n_spaces"))


@query("agg4", GR1 + ", c AS (SELECT building_id, component, count(*) AS n FROM label GROUP BY 1, 2) SELECT building_id, count(*) AS n_components, max(n) AS largest, round(max(n) / sum(n), 6) AS ratio FROM c GROUP BY 1")
def agg4(spark: SparkSession, d: str) -> DataFrame:
    sizes = gr1(spark, d).groupBy("building_id", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("building_id").agg(F.count("*").alias("n_components"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("ratio"))


EGRESS = with_views("v_levels", "v_spaces", "v_transitions") + ", acc AS (SELECT building_id, from_id AS id FROM v_transitions UNION SELECT building_id, to_id FROM v_transitions), k AS (SELECT s.building_id, s.id, CASE WHEN s.id % 9 = 0 THEN 'external' WHEN a.id IS NULL AND list_contains(string_split(translate(lower(trim(l.name)), '/-_', '   '), ' '), 'china') THEN 'service' ELSE 'required' END AS domain FROM v_spaces s JOIN v_levels l ON l.id = s.level_id LEFT JOIN acc a ON a.building_id = s.building_id AND a.id = s.id) "


@query("agg5", EGRESS + "SELECT building_id, domain, count(*) AS n FROM k GROUP BY 1, 2")
def agg5(spark: SparkSession, d: str) -> DataFrame:
    """External spaces, service spaces (on a level of a given name, and without a transition), and those that must have a way out."""
    t = views.transitions(spark, d)
    used = t.select("building_id", F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("used", F.lit(True))
    level = views.levels(spark, d).select(F.col("id").alias("level_id"), F.col("name").alias("level_name"))
    words = F.split(F.translate(F.lower(F.trim("level_name")), "/-_", "   "), "\\s+")
    s = views.spaces(spark, d).join(level, "level_id").join(used, ["building_id", "id"], "left")
    domain = F.when(F.col("id") % 9 == 0, "external").when(F.col("used").isNull() & F.array_contains(words, "china"), "service").otherwise("required")
    return s.groupBy("building_id", domain.alias("domain")).agg(F.count("*").alias("n"))


@query("agg6", EGRESS + "SELECT k.building_id, count(*) AS spaces, count(a.id) AS surfaced, count(*) FILTER (WHERE domain = 'required' AND a.id IS NOT NULL) AS required FROM k LEFT JOIN acc a ON a.building_id = k.building_id AND a.id = k.id GROUP BY 1")
def agg6(spark: SparkSession, d: str) -> DataFrame:
    t = views.transitions(spark, d)
    used = t.select("building_id", F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("used", F.lit(True))
    s = views.spaces(spark, d).join(used, ["building_id", "id"], "left")
    return s.groupBy("building_id").agg(F.count("*").alias("spaces"), F.count("used").alias("surfaced"), F.count_if((F.col("id") % 9 != 0) & F.col("used").isNotNull()).alias("required"))


CAP = "greatest(coalesce(nullif(width_m, 0), 0.9) * CASE id[2:]::BIGINT % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.2 ELSE 1.3 END, 0.01)"


@query("agg7", with_views("v_spaces", "v_portals") + f"SELECT building_id, id, round({CAP}, 6) AS capacity FROM v_portals")
def agg7(spark: SparkSession, d: str) -> DataFrame:
    p = views.portals(spark, d)
    n = F.substring("id", 2, 20).cast("long") % 5
    kind = F.when(n == 0, "stair").when(n == 1, "ramp").otherwise("door")
    return p.select("building_id", "id", F.round(evacuation.capacity(F.col("width_m"), kind), 6).alias("capacity"))


@query("agg8", FRAMES + "SELECT run_id, agent_id, round(sum(value / greatest(0.05, 1.2 * CASE WHEN status = 'transfer' THEN 0.6 ELSE 1.0 END)), 4) AS free_s FROM v_frames GROUP BY 1, 2")
def agg8(spark: SparkSession, d: str) -> DataFrame:
    factor = F.when(F.col("status") == "transfer", 0.6).otherwise(1.0)
    return views.frames(spark, d).groupBy("run_id", "agent_id").agg(F.round(F.sum(evacuation.free_time(F.col("value"), F.lit(1.2), factor)), 4).alias("free_s"))


@query("agg9", LAST + ", s AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE last = 'evacuated') AS evacuated, count(*) FILTER (WHERE last <> 'evacuated') AS active, count(*) FILTER (WHERE last IN ('waiting', 'elevator_waiting')) AS waiting, round(avg(out_s), 4) AS mean_out_s, max(out_s) AS o FROM a GROUP BY 1) SELECT run_id, total, evacuated, active, waiting, mean_out_s, CASE WHEN active = 0 THEN o END AS clearance_s FROM s")
def agg9(spark: SparkSession, d: str) -> DataFrame:
    return evacuation.summary(views.frames(spark, d))


@query("agg10", FRAMES + "SELECT run_id, agent_id % 5 AS exit_id, count(DISTINCT agent_id) AS used FROM v_frames WHERE status = 'evacuated' GROUP BY 1, 2")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    out = views.frames(spark, d).where("status = 'evacuated'").select("run_id", "agent_id").distinct()
    return out.groupBy("run_id", (F.col("agent_id") % 5).alias("exit_id")).agg(F.count("*").alias("used"))


@query("agg11", RESULTS + "SELECT tier, status, count(*) AS total, sum(size)::BIGINT AS size FROM v_results GROUP BY ROLLUP (tier, status)")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    return views.results(spark, d).rollup("tier", "status").agg(F.count("*").alias("total"), F.sum("size").alias("size"))


CATS = "list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN status = 'fail' THEN 'quality' END, CASE WHEN size < 200 THEN 'short' END], lambda x: x IS NOT NULL)"


def categories() -> Column:
    return F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("status") == "fail", "quality"), F.when(F.col("size") < 200, "short")))


@query("agg12", RESULTS + f"SELECT category, count(*) AS n FROM (SELECT unnest({CATS}) AS category FROM v_results) GROUP BY 1")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    return views.results(spark, d).select(F.explode(categories()).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("agg13", RESULTS + "SELECT case_id, tier, status, CASE WHEN size > 3000 THEN 'multi' WHEN size > 500 THEN 'local' ELSE 'none' END AS route FROM v_results")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    route = F.when(F.col("size") > 3000, "multi").when(F.col("size") > 500, "local").otherwise("none")
    return views.results(spark, d).select("case_id", "tier", "status", route.alias("route"))


@query("agg14", RESULTS + f"SELECT case_id, array_to_string({CATS}, ',') AS failures, CASE WHEN source = 'src0' THEN CASE WHEN status = 'fail' THEN 'EXPECTED-REJECT' ELSE 'UNEXPECTED-PASS' END WHEN len({CATS}) > 0 THEN 'FAIL' ELSE 'PASS' END AS outcome FROM v_results")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    """Expectations of each case and its outcome; cases of one source are expected to be rejected."""
    c = categories()
    turned = F.when(F.col("status") == "fail", "EXPECTED-REJECT").otherwise("UNEXPECTED-PASS")
    return views.results(spark, d).select("case_id", F.array_join(c, ",").alias("failures"), F.when(F.col("source") == "src0", turned).when(F.size(c) > 0, "FAIL").otherwise("PASS").alias("outcome"))


@query("agg15", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN 'legal' END, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'numbers' END, CASE WHEN regexp_matches(text, '@') THEN 'contact' END], lambda x: x IS NOT NULL))), ',') AS labels FROM documents")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    """Categories of messages by patterns in their text."""
    t = F.col("text")
    found = F.array_compact(F.array(F.when(F.lower(t).rlike("license|copyright"), "legal"), F.when(t.rlike("[0-9]{3}"), "numbers"), F.when(t.rlike("@"), "contact")))
    return views.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("labels"))


@query("agg16", "SELECT event_type AS run_id, count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_disc(value, 0.5), 6) AS median_ms, round(quantile_disc(value, 0.95), 6) AS p95_ms, round(1000 / avg(value), 6) AS rate FROM events WHERE value > 0 AND isfinite(value) GROUP BY 1")
def agg16(spark: SparkSession, d: str) -> DataFrame:
    """Frame times: nearest-rank percentiles, not interpolated."""
    e = views.table(spark, d, "events").where("value > 0 and not isnan(value) and value < double('infinity')")
    at = lambda p: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)"), 6)
    return e.groupBy(F.col("event_type").alias("run_id")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_ms"), at(0.5).alias("median_ms"), at(0.95).alias("p95_ms"), F.round(1000 / F.avg("value"), 6).alias("rate"))


LOAD = FRAMES + ", l AS (SELECT run_id, agent_id % 5 AS gate, count(*) AS load FROM v_frames GROUP BY 1, 2) "


@query("agg17", LOAD + "SELECT run_id, round(sum(load / greatest((gate + 1) * 0.4, 0.01)), 5) AS delay_s FROM l GROUP BY 1")
def agg17(spark: SparkSession, d: str) -> DataFrame:
    load = views.frames(spark, d).groupBy("run_id", (F.col("agent_id") % 5).alias("gate")).agg(F.count("*").alias("load"))
    return load.groupBy("run_id").agg(F.round(F.sum(F.col("load") / F.greatest((F.col("gate") + 1) * 0.4, F.lit(0.01))), 5).alias("delay_s"))


@query("agg18", FRAMES + "SELECT run_id, sum(greatest(1, least(5000, floor(value + 0.5))))::BIGINT + count(DISTINCT agent_id) AS planned FROM v_frames GROUP BY 1")
def agg18(spark: SparkSession, d: str) -> DataFrame:
    size = F.greatest(F.lit(1), F.least(F.lit(5000), F.floor(F.col("value") + 0.5)))
    return views.frames(spark, d).groupBy("run_id").agg((F.sum(size) + F.countDistinct("agent_id")).cast("long").alias("planned"))


@query("agg19", with_views("v_cells") + "SELECT building_id, space_id, round(sum(abs((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1)) / 2), 6) AS area_m2, sum(abs((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1)) / 2) > 30 AS walkable FROM v_cells GROUP BY 1, 2")
def agg19(spark: SparkSession, d: str) -> DataFrame:
    size = g.area_xy(*[g.vec(f"x{i}", f"y{i}") for i in (1, 2, 3)])
    return views.cells(spark, d).groupBy("building_id", "space_id").agg(F.round(F.sum(size), 6).alias("area_m2"), (F.sum(size) > 30).alias("walkable"))
