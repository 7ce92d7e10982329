"""Occupant telemetry and live door state as Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evacuation import WAITING, status_group
from ..operators.graph import reachable, shared_dir


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def window_counts(frames: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Frames of each run by status group in tumbling windows of event time. For update mode: windows behind the watermark leave the state, and rows that come later than that are dropped."""
    g = status_group(F.col("status"))
    w = frames.withWatermark("ts", late).groupBy("run_id", F.window("ts", width).alias("w"))
    return w.agg(F.count_if(g == "moving").alias("moving"), F.count_if(g == "waiting").alias("waiting"), F.count_if(g == "evacuated").alias("evacuated")).select("run_id", F.col("w.start").alias("start"), "moving", "waiting", "evacuated")


def sliding_presence(frames: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, space_id, agent_id, n, most) in sliding windows of event time, for update mode; the state holds each agent of a window once, until the window is behind the watermark."""
    w = frames.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "space_id", "agent_id")
    return w.agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "space_id", "agent_id", "n", "most")


def occupancy(presence: DataFrame) -> DataFrame:
    """(start, space_id, agents, n, most) of a table of sliding_presence: distinct agents, exactly."""
    return presence.groupBy("start", "space_id").agg(F.count("*").alias("agents"), F.sum("n").alias("n"), F.max("most").alias("most"))


def _joined(episodes: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Episodes (first, last, n) of which those less than the gap apart are one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(episodes):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def waiting_episodes(frames: DataFrame, gap_us: int = 6 * 3_600_000_000, late: str = "30 days") -> DataFrame:
    """(agent_id, us, n): episodes of waiting that begin at us, split where nothing is heard for the gap; an episode that another one takes in comes with n = 0.

    For update mode. The state holds the episodes of an agent that a row which is not late could still reach, and goes
    with the last of them; rows behind the watermark are dropped. Rows of one agent are folded chunk by chunk.
    """

    def keep(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = list(zip(*state.get)) if state.exists else []
        now = was
        for chunk in chunks:
            us = np.sort(chunk["us"].to_numpy())
            cut = np.flatnonzero(np.diff(us) >= gap_us) + 1
            now = _joined([*now, *((int(x[0]), int(x[-1]), len(x)) for x in np.split(us, cut) if len(x))], gap_us)
        mark = state.getCurrentWatermarkMs() * 1000
        still = [x for x in now if x[1] + gap_us > mark]
        if still:
            state.update(tuple(map(list, zip(*still))))
            state.setTimeoutTimestamp((max(x[1] for x in still) + gap_us) // 1000 + 1)
        elif state.exists:
            state.remove()
        counts, old = {x[0]: x[2] for x in now}, {x[0]: x[2] for x in was}
        rows = [(first, n) for first, n in counts.items() if old.get(first) != n] + [(first, 0) for first in old if first not in counts]
        if rows:
            yield pd.DataFrame({"agent_id": key[0], "us": [r[0] for r in rows], "n": [r[1] for r in rows]})

    rows = frames.where(F.col("status").isin(*WAITING)).withWatermark("ts", late).select(F.col("agent_id").cast("long"), "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("agent_id").applyInPandasWithState(keep, "agent_id long, us long, n long", "first array<long>, last array<long>, n array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def first_out(frames: DataFrame, run: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, agent_id, out): the first moment of each agent of a run as evacuated, null while it is active. A run is a window of event time, so its state ends with the watermark. For update mode."""
    w = frames.withWatermark("ts", late).groupBy(F.window("ts", run).alias("w"), "agent_id")
    return w.agg(F.min(F.when(F.col("status") == "evacuated", F.col("ts"))).alias("out")).select(F.col("w.start").alias("start"), "agent_id", "out")


def clearances(outs: DataFrame) -> DataFrame:
    """(start, agents, active, clearance) of each run of a table of first_out: the moment at which its last agent was out, null while some are active."""
    runs = outs.groupBy("start").agg(F.count("*").alias("agents"), F.count_if(F.col("out").isNull()).alias("active"), F.max("out").alias("last"))
    return runs.select("start", "agents", "active", F.when(F.col("active") == 0, F.col("last")).alias("clearance"))


def scenario_facts(commands: DataFrame) -> DataFrame:
    """(building_id, kind, id, fact, at, value): the latest word on each fact of a portal or space, from commands (building_id, kind, id, at, action, multiplier). For update mode; a row of state for each fact.

    block and unblock set `blocked`; multiplier sets `multiplier`, 1 at least; clear takes back all earlier ones of its
    building. Other actions, and a multiplier that is null, say nothing. at is a struct that orders commands.
    """
    a = F.col("action")
    fact = F.when(a.isin("block", "unblock"), "blocked").when(a == "multiplier", F.when(F.col("multiplier").isNotNull(), "multiplier")).when(a == "clear", "clear")
    value = F.when(a == "block", 1.0).when(a == "multiplier", F.greatest(F.lit(1.0), "multiplier")).otherwise(0.0)
    all_ = F.col("fact") == "clear"
    said = commands.select("building_id", "kind", "id", "at", fact.alias("fact"), value.alias("value")).where("fact is not null")
    said = said.withColumns({"kind": F.when(all_, "").otherwise(F.col("kind")), "id": F.when(all_, 0).otherwise(F.col("id"))})
    return said.groupBy("building_id", "kind", "id", "fact").agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value"))


def standing(facts: DataFrame) -> DataFrame:
    """(building_id, kind, id, blocked, multiplier) of every portal and space that a table of scenario_facts names; facts before the last clear of the building don't count."""
    clear = facts.where("fact = 'clear'").select("building_id", F.col("at").alias("cleared"))
    said = facts.where("fact <> 'clear'").join(clear, "building_id", "left")
    value = F.when(F.col("cleared").isNull() | (F.col("at") > F.col("cleared")), F.col("value"))
    found = lambda fact: F.max(F.when(F.col("fact") == fact, value))
    return said.groupBy("building_id", "kind", "id").agg((F.coalesce(found("blocked"), F.lit(0.0)) > 0).alias("blocked"), F.coalesce(found("multiplier"), F.lit(1.0)).alias("multiplier"))


def run_to_rows(stream: DataFrame, *keys: str) -> DataFrame:
    """Run a stream in update mode over all that is there now; of the rows of a key that of the last batch stands.

    Each batch writes the rows that it changed to a folder of its own: one that is run again writes the same rows again.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{at}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def run_to_table(stream: DataFrame, mode: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there now and return its last state; state and output live in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        (shape(batch) if shape else batch).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def advancing(frames: DataFrame) -> DataFrame:
    """(agent_id, event_id, ts) of frames whose time is later than all before them of that agent, in order of event_id; the state is the last time."""

    def keep(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values("event_id", kind="stable")
        last = state.get[0] if state.exists else -(2**63)
        before = rows["us"].cummax().shift(fill_value=last).clip(lower=last)
        state.update((max(int(last), int(rows["us"].max())),))
        yield rows.loc[rows["us"] > before, ["agent_id", "event_id", "us"]]

    rows = frames.select("agent_id", "event_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("agent_id").applyInPandasWithState(keep, "agent_id long, event_id long, us long", "last long", "append", GroupStateTimeout.NoTimeout)


def longest_queues(changes: DataFrame) -> DataFrame:
    """(gate_id, length, longest) after each batch of changes (gate_id, us, event_id, step); the state outlives replans and restarts."""

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps = pd.concat(list(chunks)).sort_values(["us", "event_id"], kind="stable")["step"].cumsum()
        length, longest = state.get if state.exists else (0, 0)
        longest, length = max(longest, length + int(steps.max())), length + int(steps.iloc[-1])
        state.update((length, longest))
        yield pd.DataFrame({"gate_id": [key[0]], "length": [length], "longest": [longest]})

    return changes.groupBy("gate_id").applyInPandasWithState(run, "gate_id long, length long, longest long", "length long, longest long", "update", GroupStateTimeout.NoTimeout)


def split_late(frames: DataFrame, delay_us: int) -> DataFrame:
    """(agent_id, event_id, us, late) of every frame: late, if its time lies more than delay_us behind the latest before it of that agent, in order of event_id; the state is that latest time.

    A late frame goes to a table of its own by `late`; it moves no state.
    """

    def keep(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values("event_id", kind="stable")
        last = state.get[0] if state.exists else -(2**62)
        before = rows["us"].cummax().shift(fill_value=last).clip(lower=last)
        state.update((max(int(last), int(rows["us"].max())),))
        yield rows.assign(late=rows["us"] < before - delay_us)[["agent_id", "event_id", "us", "late"]]

    rows = frames.select("agent_id", "event_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("agent_id").applyInPandasWithState(keep, "agent_id long, event_id long, us long, late boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def refreshed_reach(changes: DataFrame, exits: DataFrame, arcs: DataFrame) -> DataFrame:
    """(building_id, id) from which an exit (building_id, id) can be reached, after a stream of changes (building_id, id, at, blocked) of spaces.

    Each batch keeps the latest change of a space, and walks back from the exits only in buildings in which what is
    blocked has changed; the others keep their rows. No way enters a blocked space. A batch that is run again writes the
    same folder again, and the one before it stays until the stream ends.
    """
    spark = changes.sparkSession
    at = f"{shared_dir(spark)}/reach-{uuid.uuid4().hex}"
    back = arcs.select("building_id", F.col("b").alias("a"), F.col("a").alias("b"))
    reachable(exits, back).write.parquet(f"{at}/reach-now=-1")
    last = [-1]

    def refresh(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("building_id", "id").agg(F.max(F.struct("at", "blocked")).alias("x")).select("building_id", "id", "x.at", "x.blocked")
        before = spark.read.parquet(f"{at}/state-now={number - 1}") if number else new.limit(0)
        state = before.unionByName(new).groupBy("building_id", "id").agg(F.max(F.struct("at", "blocked")).alias("x")).select("building_id", "id", "x.at", "x.blocked")
        state.write.mode("overwrite").parquet(f"{at}/state-now={number}")
        state = spark.read.parquet(f"{at}/state-now={number}")
        shut, was = state.where("blocked").select("building_id", "id"), before.where("blocked").select("building_id", "id")
        changed = shut.exceptAll(was).unionByName(was.exceptAll(shut)).select("building_id").distinct()
        # backwards a way enters the space that an arc leads from: it is the arc's end that must be open
        ways = back.join(changed, "building_id", "left_semi").join(shut.withColumnRenamed("id", "a"), ["building_id", "a"], "left_anti")
        fresh = reachable(exits.join(changed, "building_id", "left_semi"), ways)
        kept = spark.read.parquet(f"{at}/reach-now={number - 1}").join(changed, "building_id", "left_anti")
        kept.unionByName(fresh).write.mode("overwrite").parquet(f"{at}/reach-now={number}")
        last[0] = number

    changes.writeStream.option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(refresh).start().awaitTermination()
    return spark.read.parquet(f"{at}/reach-now={last[0]}")
