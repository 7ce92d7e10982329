"""Lifts, obstacles, stretch, representative routes, steps, files and the graph loops, on small tables with known answers."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import functions as F

from concourse.operators import benchmarks, elevators, graph
from concourse.sources import files

POINT = "struct<x:double,y:double,z:double>"


# ---- graph loops


def test_components_of_chains_stars_and_lone_nodes(spark):
    r = random.Random(1)
    chain = [(1, i, i + 1) for i in range(300)]  # the worst case of moving to the least neighbour
    star = [(1, 1000, 1001 + i) for i in range(50)] + [(1, 1050, 1050)]
    odd = [(2, a, b) for a, b in ((5, 3), (3, 9), (9, 5), (7, 8), (8, 7))]
    shuffled = [e if r.random() < 0.5 else (e[0], e[2], e[1]) for e in chain + star + odd]
    nodes = {(b, n) for b, x, y in shuffled for n in (x, y)} | {(2, 77)}
    got = {(x["building_id"], x["id"]): x["component"] for x in graph.components(spark.createDataFrame(sorted(nodes), "building_id long, id long"), spark.createDataFrame(shuffled, "building_id long, a long, b long")).collect()}
    assert got == {(b, n): (0 if n <= 300 else 1000) if b == 1 else {5: 3, 3: 3, 9: 3, 7: 7, 8: 7, 77: 77}[n] for b, n in nodes}
    none = graph.components(spark.createDataFrame([(1, 4)], "building_id long, id long"), spark.createDataFrame([], "building_id long, a long, b long"))
    assert [tuple(x) for x in none.collect()] == [(1, 4, 4)]


def test_cheapest_ways_and_their_nodes(spark):
    r = random.Random(7)
    arcs = [(1, a, b, float(r.randint(1, 9))) for a in range(25) for b in r.sample(range(25), 3) if a != b]
    t = spark.createDataFrame(arcs, "building_id long, a long, b long, cost double")
    cost = {0: 0.0, 12: 2.0}  # one source that starts at two nodes
    for _ in range(25):
        for _, a, b, c in arcs:
            if a in cost:
                cost[b] = min(cost.get(b, math.inf), cost[a] + c)
    starts = spark.createDataFrame([(1, 99, 0, 0.0), (1, 99, 12, 2.0)], "building_id long, source long, id long, cost double")
    best = graph.cheapest(starts, t, steps=2)
    assert {x["id"]: x["cost"] for x in best.collect()} == cost
    goals = spark.createDataFrame([(1, 99, g) for g in cost], "building_id long, source long, id long")
    ways = {}
    for x in graph.ways(graph.predecessors(best, t), goals).collect():
        ways.setdefault(x["goal"], {})[x["back"]] = x["id"]
    least = {(a, b): min(c for _, p, q, c in arcs if (p, q) == (a, b)) for _, a, b, _ in arcs}
    for goal, back in ways.items():
        line = [back[i] for i in range(len(back) - 1, -1, -1)]
        assert line[-1] == goal and cost[line[0]] + sum(least[e] for e in zip(line, line[1:])) == cost[goal] and cost[line[0]] in (0.0, 2.0)
    # a search that ends at its goal still finds it, and the nearest of several
    near = sorted(cost, key=cost.get)[6]
    some = graph.cheapest(starts, t, goals=goals.where(F.col("id") == near), steps=1)
    assert {x["id"]: x["cost"] for x in some.collect()}[near] == cost[near]
    any_ = graph.cheapest(starts, t, goals=goals.where(F.col("id").isin(near, 20)).withColumn("extra", F.lit(0.5)), nearest=True, steps=1)
    assert min(x["cost"] for x in any_.collect() if x["id"] in (near, 20)) == min(cost[near], cost.get(20, math.inf))


# ---- lifts


def test_lifts_join_levels_with_a_door_and_a_node(spark):
    lifts = spark.createDataFrame([(1, "A", 0.0, 0.0, 2.0, 2.0), (1, "one level", 20.0, 0.0, 22.0, 2.0), (1, "far", 50.0, 0.0, 52.0, 2.0), (1, "null", None, 0.0, 1.0, 1.0), (1, "no node", 80.0, 0.0, 82.0, 2.0)], "building_id long, id string, lx double, ly double, hx double, hy double")
    doors = [("d0", 2.5, 1.0, 0.0, "L0", "r0", None), ("d0far", 2.9, 1.0, 0.0, "L0", "r0", None), ("d1", 2.5, 1.0, 3.0, "L1", None, "r1"), ("d2", 2.5, 1.0, 6.0, "L2", "r2", "other"), ("e0", 22.2, 1.0, 0.0, "L0", "r0", None), ("n0", 82.5, 1.0, 0.0, "L0", "r0", None), ("n1", 82.5, 1.0, 3.0, "L1", "r1", None), ("unknown", 2.5, 1.0, 9.0, "L9", "r9", None)]
    nodes = [("w0", "walk", "r0", "L0", 3.0, 1.0, 0.0), ("w1", "walk", "r1", "L1", 3.5, 1.0, 3.0), ("w2", "walk", "r2", "L2", 3.0, 1.0, 6.0), ("near but other room", "walk", "rx", "L0", 2.5, 1.0, 0.0), ("we", "walk", "r0", "L0", 23.0, 1.0, 0.0), ("s", "stair", "r1", "L1", 2.5, 1.0, 3.0)]
    d = spark.createDataFrame([(1, *x) for x in doors], "building_id long, id string, x double, y double, z double, level_id string, from_space_id string, to_space_id string")
    n = spark.createDataFrame([(1, *x) for x in nodes], "building_id long, id string, kind string, space_id string, level_id string, x double, y double, z double")
    levels = spark.createDataFrame([(1, "L0", 0.0), (1, "L1", 3.0), (1, "L2", 6.0)], "building_id long, id string, elevation_m double")
    made = elevators.connectors(lifts, d, n, levels)
    assert sorted((x["id"], x["x"], x["y"], x["z"], x["level_id"], x["kind"]) for x in made.nodes.collect()) == [(f"elevator:A:L{i}", 1.0, 1.0, 3.0 * i, f"L{i}", "elevator") for i in range(3)]
    got = {(x["a"], x["b"]): (round(x["distance_m"], 6), x["portal_id"]) for x in made.edges.collect()}
    assert got == {("elevator:A:L0", "w0"): (2.0, "d0"), ("elevator:A:L1", "w1"): (2.5, "d1"), ("elevator:A:L2", "w2"): (2.0, "d2"), ("elevator:A:L0", "elevator:A:L1"): (3.0, None), ("elevator:A:L1", "elevator:A:L2"): (3.0, None)}
    assert {x["id"] for x in made.withdrawn.collect()} == {"d0", "d1", "d2"} and {x["id"] for x in made.rejected.collect()} == {"one level", "far", "null", "no node"}
    assert tuple(made.stats.first()) == (1, 5, 1, 3, 4)


# ---- obstacles


def test_edges_are_cut_by_convex_rings(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    rings = {"square": square, "turned": square[::-1], "triangle": [(4, 0), (6, 0), (5, 2)], "flat": [(8, 0), (9, 0), (8.5, 0)]}
    o = spark.createDataFrame([(1, k, [(float(x), float(y)) for x, y in r], 0.0, 2.0) for k, r in rings.items()], "building_id long, obstacle_id string, ring array<struct<x:double,y:double>>, z_min double, z_max double")
    lines = {"through": ((-1, 1, 1), (7, 1, 1)), "over": ((-1, 1, 2.2), (7, 1, 2.3)), "graze": ((-1, 1.995, 1), (0.01, 1.995, 1)), "beside": ((-1, 2.5, 1), (7, 2.5, 1)), "inside": ((0.5, 0.5, 1), (1.5, 0.5, 1)), "point": ((1, 1, 1), (1, 1, 1)), "just above": ((-1, 1, 2.05), (1, 1, 2.4))}
    s = spark.createDataFrame([(1, k, tuple(map(float, p)), tuple(map(float, q))) for k, (p, q) in lines.items()], f"building_id long, segment_id string, p {POINT}, q {POINT}")
    got = {(x["segment_id"], x["obstacle_id"]): round(x["overlap_m"], 9) for x in benchmarks.edges_through_obstacles(s, o).collect()}
    both = lambda k, v: {(k, "square"): v, (k, "turned"): v}
    assert got == both("through", 2.0) | {("through", "triangle"): 1.0} | both("inside", 1.0) | both("just above", 1.0)


# ---- stretch


def test_farthest_pairs_are_exact(spark, monkeypatch):
    monkeypatch.setattr(benchmarks, "CHUNK", 16)
    r = random.Random(3)
    groups = {1: [(r.uniform(0, 9), r.uniform(0, 5)) for _ in range(200)], 2: [(math.cos(i / 8 * math.pi), math.sin(i / 8 * math.pi)) for i in range(16)], 3: [(float(i), 0.0) for i in range(40)], 4: [(0.0, 0.0), (0.0, 0.0), (0.5, 0.0)], 5: [(float(i % 7), float(i // 7)) for i in range(49)]}
    rows = [(g, i, *p) for g, ps in groups.items() for i, p in enumerate(ps)]
    got = {x["g"]: (x["a"], x["b"], x["d"]) for x in benchmarks.farthest_pairs(spark.createDataFrame(rows, "g int, id int, x double, y double"), ("g",)).collect()}
    expected = {}
    for g, ps in groups.items():
        d, a, b = min((-round(math.dist(ps[i], ps[j]), 9), i, j) for i in range(len(ps)) for j in range(i + 1, len(ps)))
        if -d >= 1:
            expected[g] = (a, b, -d)
    assert got == expected and 4 not in got


def test_the_first_candidate_with_a_route_is_taken(spark):
    rows = [(b, c, f"{o:02d}", f"class {c}", f"{b}-{c}-{o}", 0.0, 0.0, 0.0, 1.0, 1.0, 3.0) for b, n in ((1, (1, 1, 1)), (2, (0, 5, 2)), (3, (2, 2, 1)), (4, (0, 0, 1))) for c in (1, 2, 3) for o in range(n[c - 1])]
    good = {(1, 1), (2, 4), (2, 6), (3, 5)}
    calls = []

    def route(asked):
        calls.append(sorted((x["building_id"], x["id"]) for x in asked.collect()))
        ok = F.array_contains(F.array(*[F.lit(f"{b}/{n}") for b, n in good]), F.concat_ws("/", "building_id", "id"))
        return asked.select("building_id", "id", F.when(~ok, "no route").alias("reason"), F.lit(2.0).alias("length_m"), F.lit(2.0).alias("cost"))

    c = spark.createDataFrame(rows, "building_id long, class int, ordinal string, source string, subject string, x double, y double, z double, gx double, gy double, gz double")
    got = {x["building_id"]: (x["subject"], x["rise_m"], x["tried"]) for x in benchmarks.representative_routes(c, route).collect()}
    assert got == {1: ("1-1-0", 3.0, 1), 2: ("2-2-3", 3.0, 4), 3: ("3-3-0", 3.0, 5), 4: (None, None, 1)}
    assert not any(b == 1 for call in calls[1:] for b, _ in call)  # a building leaves with its first route


def test_steps_of_routes_and_what_they_lack(spark):
    line = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
    leg = lambda i, seq, kind, a, b, t=None: (1, i, seq, kind, a, b, t, None, line, 1.0, 1.0)
    legs = [leg(1, 0, "local", "A", "A"), leg(1, 1, "door", "A", "B", "t:d"), leg(1, 2, "local", "B", "B"), leg(1, 3, "elevator", "C", "B", "t:e"), leg(2, 0, "door", "A", "B", "t:gone"), leg(3, 0, "door", "A", "B", "t:nogate"), leg(4, 0, "local", "A", "A"), leg(5, 0, "elevator", "A", "B", "t:flat")]
    t = spark.createDataFrame(legs, f"building_id long, id long, seq int, kind string, from_space_id string, to_space_id string, transition_id string, portal_id string, points array<{POINT}>, length_m double, cost double")
    transitions = spark.createDataFrame([(1, "t:d", "A", "L0", "L0", None), (1, "t:e", "B", "L0", "L1", "lift"), (1, "t:nogate", "A", "L0", "L0", None), (1, "t:flat", "A", None, "L1", None)], "building_id long, id string, from_space_id string, from_level_id string, to_level_id string, resource_id string")
    gates = spark.createDataFrame([(1, "t:d", "g:d")], "building_id long, transition_id string, gate_id string")
    exits = spark.createDataFrame([(1, i, "out") for i in (1, 2, 3, 5)], "building_id long, id long, gate_id string")
    spaces = spark.createDataFrame([(1, "A", "L0"), (1, "B", "L0")], "building_id long, space_id string, level_id string")
    steps, errors = benchmarks.route_steps(t, transitions, gates, exits, spaces)
    got = sorted(((x["id"], x["step"], x["kind"], x["gate_id"], x["resource_id"], x["from_level_id"], x["to_level_id"], x["level_id"]) for x in steps.collect()), key=str)
    assert got == [(1, 0, "level", None, None, None, None, "L0"), (1, 1, "gate", "g:d", "t:d", None, None, None), (1, 2, "transfer", None, "t:d", None, None, None), (1, 3, "level", None, None, None, None, "L0"), (1, 4, "elevator", None, "lift", "L1", "L0", None), (1, 5, "gate", "out", None, None, None, None)]
    assert sorted(tuple(x)[1:] for x in errors.collect()) == [(2, "MISSING_TRANSITION", "t:gone"), (3, "MISSING_GATE", "t:nogate"), (4, "NO_EXIT_GATE", None), (5, "UNRESOLVED_LEVELS", "t:flat")]


# ---- files


def test_documents_are_read_from_files_and_broken_ones_are_reported(spark):
    good = json.dumps({"schema": "concourse.nav/1", "levels": [{"id": 1, "name": "L", "elevation_m": 0.0}], "spaces": [{"id": 2, "name": "S", "level_id": 1, "is_exit": True, "more": 1}]}, indent=2)  # spans lines
    d = spark.createDataFrame([(1, good), (2, '{"schema": "x", "spaces": ['), (3, "{}")], "building_id long, document string")
    rows = {x["building_id"]: x for x in files.read_documents(spark, files.write_documents(d)).collect()}
    assert len(rows) == 3 and rows[1]["broken"] is None and rows[1]["spaces"][0]["name"] == "S" and rows[1]["transitions"] == []
    assert rows[2]["broken"] is not None and rows[2]["spaces"] == [] and rows[3]["schema"] == "concourse.nav/0" and rows[1]["file"].endswith(".txt")


def test_playbacks_requests_and_manifests(spark, tmp_path):
    frames = [("r1", 1, 10, "moving", 0.5), ("r1", 1, 11, "waiting", 0.5), ("r2", 1, 10, "evacuated", 1.0)]
    path = files.write_playback(spark.createDataFrame(frames, "run_id string, frame_no long, agent_id long, status string, time_s double"))
    assert sorted(tuple(x) for x in files.read_playback(spark, path).collect()) == sorted(frames)
    other = tmp_path / "play" / "run_id=r3"
    other.mkdir(parents=True)
    (other / "a.json").write_text('{"schema": "else/1", "frame_no": 1, "agents": []}\nnot json\n')
    assert files.read_playback(spark, f"file://{tmp_path}/play").count() == 0

    lines = ['{"id": 1, "speed": 0.01, "agents": [{"count": 2}, {"count": 3}]}', '{"id": 2, "multiplier": 0.5, "backend": "crowd", "agents": [{"count": 5000}]}', '{"id": 3, "agents": []}', '{"id": 4, "agents": [{"count": 5001}]}', '{"id": 5, "agents": [{}]}', '{"id": 6, "backend": "guess", "agents": [{"count": 1}]}', '{"id": 7, "agents": [', '{"id": 8}']
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "q.json").write_text("\n".join(lines))
    good, bad = files.read_requests(spark, f"file://{tmp_path}/q")
    assert sorted(tuple(x) for x in good.collect()) == [(1, 0.05, 1.0, "planner", 5), (2, 0.05, 1.0, "crowd", 5000)]
    assert sorted((x["reason"] for x in bad.collect())) == ["backend", "broken", "count", "count", "no agents", "no agents"]

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "m.json").write_text('{"id": 1, "tiers": ["a", "b"], "options": {"x": 7}}\n{"id": 2, "tiers": ["c"]}\n')
    chosen, missing = files.read_manifest(spark, f"file://{tmp_path}/m", {"x": 1, "y": 2}, ["b"])
    assert [(x["id"], x["options"]) for x in chosen.collect()] == [(1, {"x": 7, "y": 2})] and missing.count() == 0
    chosen, missing = files.read_manifest(spark, f"file://{tmp_path}/m", {"x": 1}, [], spark.createDataFrame([(2,), (5,)], "id long"))
    assert [x["id"] for x in chosen.collect()] == [2] and [x["id"] for x in missing.collect()] == [5]


def test_element_tables_are_pruned_and_catalogued(spark):
    e = spark.createDataFrame([("DOOR", 1), ("DOOR", 2), ("SLAB", 3)], "kind string, id long")
    path = files.write_elements(e)
    doors = files.read_elements(spark, path, "DOOR")
    assert {x["id"] for x in doors.collect()} == {1, 2} and "PartitionFilters: [isnotnull(kind" in doors._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [" in doors._jdf.queryExecution().executedPlan().toString()
    assert files.read_elements(spark, path).count() == 3
    found = files.catalogue(spark, path)
    assert {x["kind"] for x in found.collect()} == {"DOOR", "SLAB"} and all(x["size_bytes"] > 0 for x in found.collect()) and "content" not in found.columns
