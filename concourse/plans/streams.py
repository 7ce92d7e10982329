"""Queries of the streaming operators: each runs over the events as a stream and gives what a batch would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..registry import query
from ..sources import views
from ..sources.views import STATUS, with_views
from ..streaming import live
from .graphs import TRANS

FRAMES = with_views("v_frames")


def frames(spark: SparkSession, d: str) -> DataFrame:
    status = F.create_map(*[F.lit(v) for pair in STATUS.items() for v in pair])
    return live.events_stream(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("user_id").alias("agent_id"), F.get_json_object("props", "$.k").alias("space_id"), status[F.col("event_type")].alias("status"), F.to_timestamp(F.col("ts")).alias("ts"), "value", "event_id")


def text_time(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("st1", "SELECT user_id AS portal_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def st1(spark: SparkSession, d: str) -> DataFrame:
    """Latest state of each door."""
    e = live.events_stream(spark, d)
    latest = e.groupBy(F.col("user_id").alias("portal_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return live.run_to_rows(latest, "portal_id")


@query(
    "st1_scenario",
    with_views("v_spaces")
    + """, c AS (SELECT s.building_id, CASE WHEN s.is_exit THEN 'portal' ELSE 'space' END AS kind, s.id, {'ts': e.ts, 'n': e.event_id} AS moment, e.event_type AS t, e.value FROM events e JOIN v_spaces s ON s.id = e.user_id),
    gone AS (SELECT building_id, max(moment) AS moment FROM c WHERE t = 'signup' AND value > 50 GROUP BY 1),
    said AS (SELECT c.*, g.moment IS NULL OR c.moment > g.moment AS counts FROM c LEFT JOIN gone g ON g.building_id = c.building_id WHERE t IN ('error', 'click', 'view'))
    SELECT building_id, kind, id, coalesce(arg_max(t, moment) FILTER (WHERE t IN ('error', 'click') AND counts) = 'error', false) AS blocked, coalesce(arg_max(greatest(1.0, value / 10), moment) FILTER (WHERE t = 'view' AND counts), 1.0) AS multiplier FROM said GROUP BY 1, 2, 3""",
)
def st1_scenario(spark: SparkSession, d: str) -> DataFrame:
    """What stands of a stream of commands: an error blocks a portal (ways out) or space, a click opens it, a view sets its multiplier, and a signup of more than 50 clears its building."""
    s = views.spaces(spark, d).select("id", "building_id", F.when(F.col("is_exit"), "portal").otherwise("space").alias("kind"))
    t = F.col("event_type")
    action = F.when(t == "error", "block").when(t == "click", "unblock").when(t == "view", "multiplier").when((t == "signup") & (F.col("value") > 50), "clear")
    e = live.events_stream(spark, d).select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("at"), action.alias("action"), (F.col("value") / 10).alias("multiplier"))
    return live.standing(live.run_to_rows(live.scenario_facts(e.join(s, "id")), "building_id", "kind", "id", "fact"))


@query("st2", FRAMES + "SELECT run_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) FILTER (WHERE status IN ('moving', 'transfer', 'elevator')) AS moving, count(*) FILTER (WHERE status IN ('waiting', 'elevator_waiting')) AS waiting, count(*) FILTER (WHERE status = 'evacuated') AS evacuated FROM v_frames GROUP BY 1, 2")
def st2(spark: SparkSession, d: str) -> DataFrame:
    return text_time(live.run_to_rows(live.window_counts(frames(spark, d)), "run_id", "start"))


@query("st3", "WITH w AS (SELECT date_trunc('hour', ts) - to_hours(h) AS start, props ->> '$.k' AS space_id, user_id, value FROM events, (SELECT unnest([0, 1]) AS h)) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, space_id, count(DISTINCT user_id) AS agents, count(*) AS n, max(value) AS most FROM w GROUP BY 1, 2")
def st3(spark: SparkSession, d: str) -> DataFrame:
    """Distinct agents of each space in sliding windows."""
    return text_time(live.occupancy(live.run_to_rows(live.sliding_presence(frames(spark, d)), "start", "space_id", "agent_id")))


@query("st4", FRAMES + ", o AS (SELECT agent_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY agent_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM v_frames WHERE status IN ('waiting', 'elevator_waiting')), s AS (SELECT agent_id, ts, sum(fresh) OVER (PARTITION BY agent_id ORDER BY ts) AS k FROM o) SELECT agent_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY agent_id, k")
def st4(spark: SparkSession, d: str) -> DataFrame:
    found = live.run_to_rows(live.waiting_episodes(frames(spark, d)), "agent_id", "us").where("n > 0")
    return text_time(found.select("agent_id", F.timestamp_micros("us").alias("start"), "n"))


@query("st6", FRAMES + "SELECT run_id, agent_id, min(time_s) AS out_s FROM v_frames WHERE status = 'evacuated' GROUP BY 1, 2")
def st6(spark: SparkSession, d: str) -> DataFrame:
    """First moment at which each agent was out, by run."""
    first = live.run_to_rows(live.first_out(frames(spark, d)), "start", "agent_id").where("out is not null")
    seconds = (F.hour("out") * 3600 + F.minute("out") * 60 + F.second("out")).cast("double")
    return first.select(F.date_format("start", "yyyy-MM-dd").alias("run_id"), "agent_id", seconds.alias("out_s"))


@query("st6_clearance", FRAMES + ", o AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, agent_id, min(ts) FILTER (WHERE status = 'evacuated') AS out FROM v_frames GROUP BY 1, 2) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS agents, count(*) - count(out) AS active, CASE WHEN count(out) = count(*) THEN strftime(max(out), '%Y-%m-%d %H:%M:%S.%f') END AS clearance FROM o GROUP BY 1")
def st6_clearance(spark: SparkSession, d: str) -> DataFrame:
    """Runs of ten minutes: the moment at which none of its agents was active any more."""
    runs = live.clearances(live.run_to_rows(live.first_out(frames(spark, d), "10 minutes"), "start", "agent_id"))
    return text_time(runs.select("start", "agents", "active", F.date_format("clearance", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("clearance")))


@query("st5", "WITH q AS (SELECT user_id AS gate_id, ts, event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('click', 'purchase')) SELECT gate_id, CAST(arg_max(n, (ts, event_id)) AS BIGINT) AS length, CAST(greatest(max(n), 0) AS BIGINT) AS longest FROM q GROUP BY 1")
def st5(spark: SparkSession, d: str) -> DataFrame:
    """Length of the queue at each gate and the longest that it has been; a click joins it, a purchase leaves it."""
    e = live.events_stream(spark, d).where("event_type in ('click', 'purchase')")
    ts = F.to_timestamp(F.col("ts"))
    changes = e.select(F.col("user_id").cast("long").alias("gate_id"), F.unix_micros(ts).alias("us"), "event_id", F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("step"))
    # a row for each batch in which a gate changed; the events are one file, so one batch
    return live.run_to_table(live.longest_queues(changes), "update")


@query("st9", "WITH m AS (SELECT user_id AS agent_id, event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT agent_id, event_id, epoch_us(ts) AS us FROM m WHERE before IS NULL OR ts > before")
def st9(spark: SparkSession, d: str) -> DataFrame:
    """Frames that advance the time of their agent."""
    f = frames(spark, d).withColumn("agent_id", F.col("agent_id").cast("long"))
    return live.run_to_table(live.advancing(f), "append")


@query("st7", TRANS + ", latest AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) = 'error' AS blocked FROM events GROUP BY 1), ways AS (SELECT * FROM arcs WHERE b NOT IN (SELECT id FROM latest WHERE blocked)), seen AS (SELECT building_id, id FROM v_spaces WHERE is_exit UNION SELECT w.building_id, w.a FROM seen s JOIN ways w ON w.building_id = s.building_id AND w.b = s.id) SELECT building_id, id FROM seen")
def st7(spark: SparkSession, d: str) -> DataFrame:
    """Spaces with a way out, kept up to date while events block spaces (errors) and open them (all others)."""
    s = views.spaces(spark, d)
    e = live.events_stream(spark, d).select(F.col("user_id").alias("id"), F.struct(F.unix_micros(F.to_timestamp(F.col("ts"))).alias("us"), "event_id").alias("at"), (F.col("event_type") == "error").alias("blocked"))
    changes = e.join(s.select("id", "building_id"), "id")
    return live.refreshed_reach(changes, s.where("is_exit"), graph.space_arcs(views.transitions(spark, d)))


@query("st8", "WITH m AS (SELECT user_id AS agent_id, event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT agent_id, event_id, epoch_us(ts) AS us, coalesce(ts < before - INTERVAL 1 DAY, false) AS late FROM m")
def st8(spark: SparkSession, d: str) -> DataFrame:
    """Frames with a mark on those that come more than a day late."""
    f = frames(spark, d).withColumn("agent_id", F.col("agent_id").cast("long"))
    return live.run_to_table(live.split_late(f, 86_400_000_000), "append")
