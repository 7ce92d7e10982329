"""Streams of several batches against plain Python over all rows, with state that ends."""

from __future__ import annotations

import os
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from concourse.streaming import live

SCHEMA = "run_id string, agent_id long, status string, ts timestamp, value double, event_id long, space_id string"
ORIGIN = datetime(2024, 3, 1)
STATUSES = ["moving", "transfer", "elevator", "waiting", "elevator_waiting", "evacuated"]


def streamed(spark, folder, batches, schema):
    """A stream whose batches are the given lists of rows, one file each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b={i}")
        for name in os.listdir(f"{folder}/in/b={i}"):
            os.utime(f"{folder}/in/b={i}/{name}", (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/b=*")


def made(seed=1, n=240, hours=60):
    """Rows in order of arrival, up to four hours out of order in event time; agent 1 has a third of them."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = ORIGIN + timedelta(hours=hours * i / n - r.random() * 4 + 4, microseconds=i)
        rows.append((f"{at:%Y-%m-%d}", 1 if r.random() < 0.33 else r.randint(2, 9), r.choice(STATUSES), at, float(r.randint(0, 50)), i, r.choice(["a", "b", None])))
    return rows


@pytest.fixture
def parts():
    rows = made()
    return rows, [rows[:80], rows[80:81], rows[81:160], rows[160:]]


def test_window_counts_of_several_batches(spark, tmp_path, parts):
    rows, batches = parts
    want = defaultdict(lambda: [0, 0, 0])
    group = {"moving": 0, "transfer": 0, "elevator": 0, "waiting": 1, "elevator_waiting": 1, "evacuated": 2}
    for run, _, status, at, *_ in rows:
        want[run, at.replace(minute=0, second=0, microsecond=0)][group[status]] += 1
    found = live.run_to_rows(live.window_counts(streamed(spark, tmp_path, batches, SCHEMA)), "run_id", "start").collect()
    assert {(x["run_id"], x["start"]): [x["moving"], x["waiting"], x["evacuated"]] for x in found} == dict(want)


def test_rows_behind_the_watermark_are_dropped_and_their_windows_left_alone(spark, tmp_path):
    row = lambda hours, i: ("r", 1, "moving", ORIGIN + timedelta(hours=hours), 0.0, i, "a")
    # the mark by which rows are late is that of the batch before
    batches = [[row(0, 0), row(0, 1)], [row(100, 2)], [row(100, 5)], [row(0, 3), row(99, 4)]]
    stream = streamed(spark, tmp_path, batches, SCHEMA)
    found = live.run_to_rows(live.window_counts(stream), "run_id", "start").collect()
    assert {(x["start"] - ORIGIN) // timedelta(hours=1): x["moving"] for x in found} == {0: 2, 100: 2, 99: 1}
    found = live.run_to_rows(live.first_out(stream), "start", "agent_id").collect()
    assert len(found) == 2 and all(x["out"] is None for x in found)


def test_occupancy_counts_distinct_agents(spark, tmp_path, parts):
    rows, batches = parts
    want = defaultdict(list)
    for _, agent, _, at, value, _, space in rows:
        hour = at.replace(minute=0, second=0, microsecond=0)
        for start in (hour, hour - timedelta(hours=1)):
            want[start, space].append((agent, value))
    found = live.occupancy(live.run_to_rows(live.sliding_presence(streamed(spark, tmp_path, batches, SCHEMA)), "start", "space_id", "agent_id")).collect()
    assert {(x["start"], x["space_id"]): (x["agents"], x["n"], x["most"]) for x in found} == {k: (len({a for a, _ in v}), len(v), max(x for _, x in v)) for k, v in want.items()}


def test_waiting_episodes_join_over_batches(spark, tmp_path):
    rows = made(4, hours=200)
    # episodes of one batch are bridged by a row of a later one
    bridge = [("r", 50, "waiting", ORIGIN + timedelta(hours=h), 0.0, 1000 + h, "a") for h in (0, 9, 5)]
    batches = [[*rows[:100], *bridge[:2]], [*rows[100:180], bridge[2]], rows[180:]]
    times = defaultdict(list)
    for _, agent, status, at, *_ in [*rows, *bridge]:
        if status in ("waiting", "elevator_waiting"):
            times[agent].append(at)
    want = {}
    for agent, ats in times.items():
        start, before = None, None
        for at in sorted(ats):
            if before is None or at - before >= timedelta(hours=6):
                start = at
            want[agent, start] = want.get((agent, start), 0) + 1
            before = at
    found = live.run_to_rows(live.waiting_episodes(streamed(spark, tmp_path, batches, SCHEMA)), "agent_id", "us").where("n > 0").select("agent_id", F.timestamp_micros("us").alias("start"), "n").collect()
    assert {(x["agent_id"], x["start"]): x["n"] for x in found} == want
    assert want[50, ORIGIN] == 3


def test_episodes_leave_the_state_behind_the_watermark(spark, tmp_path):
    row = lambda hours, i: ("r", i, "waiting", ORIGIN + timedelta(hours=hours), 0.0, i, "a")
    stream = streamed(spark, tmp_path, [[row(0, 1), row(1, 2)], [row(100, 3)], [row(101, 3)], [row(0.5, 1), row(102, 3)]], SCHEMA)
    seen = []
    out = live.waiting_episodes(stream, late="1 hour").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).foreachBatch(lambda b, i: seen.append([tuple(x) for x in b.collect()])).start()
    out.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in out.recentProgress if p["stateOperators"]]
    assert held[-1] == 1 and max(held) >= 2
    found = {}
    for batch in seen:
        found |= {x[0]: x[2] for x in batch}
    assert found == {1: 1, 2: 1, 3: 3}  # the late row of agent 1 is dropped


def test_clearance_of_runs(spark, tmp_path, parts):
    rows, batches = parts
    runs = defaultdict(dict)
    for _, agent, status, at, *_ in rows:
        start = at.replace(minute=at.minute // 10 * 10, second=0, microsecond=0)
        old = runs[start].setdefault(agent, None)
        if status == "evacuated":
            runs[start][agent] = min(old or at, at)
    found = live.clearances(live.run_to_rows(live.first_out(streamed(spark, tmp_path, batches, SCHEMA), "10 minutes"), "start", "agent_id")).collect()
    got = {x["start"]: (x["agents"], x["active"], x["clearance"]) for x in found}
    assert got == {k: (len(v), sum(x is None for x in v.values()), None if None in v.values() else max(v.values())) for k, v in runs.items()}
    assert any(x[2] for x in got.values()) and any(x[1] for x in got.values())


def test_scenario_state_with_clear(spark, tmp_path):
    schema = "building_id long, kind string, id long, at struct<us: long>, action string, multiplier double"
    say = lambda b, kind, i, us, action, m=None: (b, kind, i, (us,), action, m)
    batches = [
        [say(1, "portal", 1, 1, "block"), say(1, "space", 1, 2, "multiplier", 3.0), say(2, "portal", 9, 1, "block"), say(1, "portal", 4, 1, "block")],
        [say(1, "portal", 1, 5, "unblock"), say(1, None, None, 4, "clear"), say(1, "space", 2, 6, "multiplier", 0.2)],
        # comes late: said before the clear
        [say(1, "space", 3, 3, "block"), say(1, "portal", 1, 7, "block"), say(1, "portal", 1, 6, "unblock"), say(1, "space", 2, 8, "multiplier"), say(1, "space", 2, 9, None)],
    ]
    found = live.standing(live.run_to_rows(live.scenario_facts(streamed(spark, tmp_path, batches, schema)), "building_id", "kind", "id", "fact")).collect()
    assert {(x["building_id"], x["kind"], x["id"]): (x["blocked"], x["multiplier"]) for x in found} == {
        (1, "portal", 1): (True, 1.0), (1, "space", 1): (False, 1.0), (2, "portal", 9): (True, 1.0), (1, "portal", 4): (False, 1.0), (1, "space", 2): (False, 1.0), (1, "space", 3): (False, 1.0)}


def test_reach_is_refreshed_batch_by_batch(spark, tmp_path):
    """A row of spaces 1-2-3-4 with the exit at 1, and a second building that no change touches."""
    arcs = spark.createDataFrame([(b, i + 1, i) for b in (1, 2) for i in (1, 2, 3)], "building_id long, a long, b long")
    exits = spark.createDataFrame([(1, 1), (2, 1)], "building_id long, id long")
    say = lambda i, us, blocked: (1, i, (us,), blocked)
    run = lambda name, batches: {(x["building_id"], x["id"]) for x in live.refreshed_reach(streamed(spark, tmp_path / name, batches, "building_id long, id long, at struct<us: long>, blocked boolean"), exits, arcs).collect()}
    other = {(2, i) for i in (1, 2, 3, 4)}
    shut, opened, again = [say(2, 1, True)], [say(2, 3, False)], [say(3, 4, True), say(2, 2, True)]
    assert run("one", [shut]) == other | {(1, 1), (1, 2)}
    assert run("two", [shut, opened]) == other | {(1, i) for i in (1, 2, 3, 4)}
    assert run("three", [shut, opened, again]) == other | {(1, 1), (1, 2), (1, 3)}


def test_no_rows_give_no_rows(spark, tmp_path):
    stream = streamed(spark, tmp_path, [[]], SCHEMA)
    assert live.run_to_rows(live.window_counts(stream), "run_id", "start").count() == 0
    assert live.run_to_rows(live.waiting_episodes(stream), "agent_id", "us").count() == 0
