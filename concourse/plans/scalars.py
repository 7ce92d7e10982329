"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import evacuation
from ..registry import query
from ..sources import views
from ..sources.views import with_views

FRAMES = with_views("v_frames")


@query("fn1", "SELECT s_suppkey AS id, 'elevator:' || s_suppkey || ':' || s_name AS made, s_suppkey::VARCHAR AS key, s_name AS rest FROM supplier")
def fn1(spark: SparkSession, d: str) -> DataFrame:
    made = scalars.composite(F.lit("elevator"), F.col("s_suppkey").cast("string"), F.col("s_name"))
    p = scalars.parsed(F.col("made"))
    return views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), made.alias("made")).select("id", "made", p["key"].alias("key"), p["rest"].alias("rest"))


@query("fn2", "SELECT s_suppkey AS id, 'open:' || substr(sha1(s_nationkey || '|' || s_name), 1, 16) AS made FROM supplier")
def fn2(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), scalars.hash_id("open", F.col("s_nationkey").cast("string"), F.col("s_name")).alias("made"))


NAMES = {"building": "high", "machinery": "low", "automobile": "low"}


@query("fn3", "SELECT c_custkey AS id, CASE translate(lower(trim(c_mktsegment)), ' -', '__') WHEN 'building' THEN 'high' WHEN 'machinery' THEN 'low' WHEN 'automobile' THEN 'low' ELSE 'default' END AS profile FROM customer")
def fn3(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), scalars.alias(F.col("c_mktsegment"), NAMES, "default").alias("profile"))


@query("fn4", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS name, CASE WHEN p_size % 10 <> 0 THEN p_size % 10 END::DOUBLE AS width FROM part")
def fn4(spark: SparkSession, d: str) -> DataFrame:
    blank = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("  ")
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), scalars.named(blank, F.col("p_brand")).alias("name"), F.nullif((F.col("p_size") % 10).cast("double"), F.lit(0.0)).alias("width"))


@query("fn5", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + 1 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS n, round(value, 4) AS value FROM events")
def fn5(spark: SparkSession, d: str) -> DataFrame:
    raw = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("count"), F.when(F.col("event_id") % 3 == 0, "7").otherwise("many"), F.lit("clear"), F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise("NaN"))
    kept = scalars.finite_numbers(raw, ("clear",))
    return views.table(spark, d, "events").select(F.col("event_id").alias("id"), kept.alias("m")).select("id", F.size("m").alias("n"), F.round(F.col("m")["value"], 4).alias("value"))


@query("fn6", "SELECT page_id AS id, CASE WHEN length(url) > 28 THEN substr(url, 1, 12) || '…' || right(url, 10) ELSE url END AS label FROM pages")
def fn6(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select(F.col("page_id").alias("id"), scalars.short(F.col("url")).alias("label"))


@query("fn7", with_views("v_spaces") + ", l AS (SELECT building_id, list_sort(list(name)) AS n FROM v_spaces GROUP BY 1) SELECT building_id, array_to_string(n[1:4], ', ') || CASE WHEN len(n) > 4 THEN ' (+' || (len(n) - 4) || ' more)' ELSE '' END AS message FROM l")
def fn7(spark: SparkSession, d: str) -> DataFrame:
    return views.spaces(spark, d).groupBy("building_id").agg(F.array_sort(F.collect_list("name")).alias("n")).select("building_id", scalars.listed(F.col("n"), 4).alias("message"))


@query("fn8", FRAMES + "SELECT run_id, CASE WHEN status IN ('waiting', 'elevator_waiting') THEN 'waiting' WHEN status IN ('moving', 'transfer', 'elevator') THEN 'moving' ELSE status END AS status, count(*) AS n FROM v_frames GROUP BY 1, 2")
def fn8(spark: SparkSession, d: str) -> DataFrame:
    return views.frames(spark, d).groupBy("run_id", evacuation.status_group(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


@query("fn9", "WITH t AS (SELECT user_id AS id, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('click', 'error')) SELECT t.id, t.action AS last_action, (SELECT count(*) FROM events e WHERE e.user_id = t.id AND e.event_type = 'click') % 2 = 1 AS toggled FROM t WHERE k = 1")
def fn9(spark: SparkSession, d: str) -> DataFrame:
    """Live toggles: a click turns the state over, and the last of clicks and errors wins the key."""
    e = views.table(spark, d, "events").where("event_type in ('click', 'error')")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_action"), (F.count_if(F.col("event_type") == "click") % 2 == 1).alias("toggled"))


@query("fn10", with_views("v_levels") + "SELECT p.building_id, p.id AS a, q.id AS b, round(abs(q.elevation_m - p.elevation_m) / 1.5 + 3 + 3 + p.elevation_m / 1.5, 6) AS trip_s FROM v_levels p JOIN v_levels q ON p.building_id = q.building_id AND p.id < q.id")
def fn10(spark: SparkSession, d: str) -> DataFrame:
    """Trip time between two levels, the car coming from the ground."""
    lv = views.levels(spark, d)
    other = lv.select("building_id", F.col("id").alias("b"), F.col("elevation_m").alias("eb"))
    return lv.join(other, "building_id").where("id < b").select("building_id", F.col("id").alias("a"), "b", F.round(scalars.trip_time(F.col("eb") - F.col("elevation_m"), F.col("elevation_m"), 1.5, 3.0), 6).alias("trip_s"))


@query("fn11", "SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([p_brand, p_size::VARCHAR, 'x'])), ' ') AS ids, CASE WHEN p_size >= 1 THEN 1 ELSE 0 END AS n_costs FROM part")
def fn11(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("p_brand"), F.lit(", x;"), F.col("p_size").cast("string"), F.lit("  x"))
    cost = F.concat(F.lit("a="), F.col("p_size").cast("string"), F.lit(" b=0.5; c=none"))
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(scalars.id_list(text), " ").alias("ids"), F.size(scalars.costs(cost)).alias("n_costs"))


