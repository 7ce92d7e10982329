"""Steps whose memory, rows or rounds grew faster than their input."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from concourse import registry
from concourse.operators import evacuation, graph, joins, surface
from concourse.plans import buildings, graphs, windows
from concourse.sources import views


@pytest.mark.parametrize("name", ["jn11", "jn12_plane", "jn14"])
def test_cells_dealt_to_squares_are_not_broadcast(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == str(registry.FILED)


def test_rounds_of_a_search_are_short_in_dense_graphs(spark):
    arcs = lambda pairs: spark.createDataFrame([(1, a, b, 1.0) for a, b in pairs], "building_id int, a int, b int, cost double")
    dense, chain = arcs([(a, b) for a in range(70) for b in range(70)]), arcs([(a, a + 1) for a in range(70)])
    assert graph._steps(dense, ["building_id"], 8) == 1 and graph._steps(chain, ["building_id"], 8) == 8 and graph._steps(chain.limit(0), ["building_id"], 8) == 8
    start = spark.createDataFrame([(1, 0, 0, 0.0)], "building_id int, source int, id int, cost double")
    assert {r["id"]: r["cost"] for r in graph.cheapest(start, chain.unionByName(arcs([(0, b) for b in range(1, 70, 9)]))).collect()}[70] == 7.0


def test_neighbours_of_crowded_points_make_no_pairs_of_all(spark):
    # a crowd within a thousandth, ten copies of one place, and a lone pair
    rows = [(1, i, (i % 37) * 1e-4, (i // 37) * 1e-4, 0.0) for i in range(1000)] + [(1, 2000 + i, 9.0, 9.0, 0.0) for i in range(10)] + [(1, 3000, 20.0, 20.0, 0.0), (1, 3001, 21.5, 21.5, 0.0)]
    p = spark.createDataFrame(rows, "building_id int, id int, x double, y double, z double")
    got = {}
    for r in joins.k_nearest(p, p, 3.0, 2).collect():
        got.setdefault(r["left_id"], []).append((r["d"], r["right_id"]))
    want = {i: sorted((((x - u) ** 2 + (y - v) ** 2 + 0.0) ** 0.5, j) for _, j, u, v, _ in rows if j != i and abs(x - u) <= 3 and abs(y - v) <= 3)[:2] for _, i, x, y, _ in rows if i % 50 == 0 or i > 1000}
    assert all([j for _, j in sorted(got[i])] == [j for d, j in w if d <= 3] for i, w in want.items())
    assert joins._halvings(p, 3.0) > 5


def test_costs_of_gr11_lead_to_every_node(spark, tmp_path):
    # orders and parts of one building in a chain: o100 p1 o2 p2 o3 p3 o4 p4
    line = [(100, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 3), (4, 4)]
    spark.createDataFrame([(o, p, 20, 10.0) for o, p in line], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["source"], r["id"]): r["cost"] for r in registry.QUERIES["gr11"](spark, str(tmp_path)).collect()}
    assert got == {("o100", n): float(i) for i, n in enumerate(["o100", "p1", "o2", "p2", "o3", "p3", "o4", "p4"])}


def test_best_exits_are_found_without_all_pairs(spark):
    all_, few = windows.candidates(spark, "/root/testdata/sf0.01"), windows.near_candidates(spark, "/root/testdata/sf0.01")
    assert set(evacuation.best_exits(all_).collect()) == set(evacuation.best_exits(few).collect())
    agents = few.select("agent_id").distinct().count()
    assert few.groupBy("agent_id").count().where("count > 14").isEmpty() and agents == all_.select("agent_id").distinct().count()


def test_parts_of_one_file_are_dealt_before_they_grow(spark):
    tasks = lambda t: t.selectExpr("spark_partition_id() AS n").distinct().count()
    assert tasks(spark.read.parquet("/root/testdata/sf0.01/part.parquet")) == 1 and tasks(views.cells(spark, "/root/testdata/sf0.01")) == 4


def test_only_cells_of_buildings_with_points_are_dealt_to_squares(spark):
    cells = views.cells(spark, "/root/testdata/sf0.01")
    p = spark.createDataFrame([(1, 7, "Brand#11", 3.5, 3.5, 0.0)], "building_id long, id long, space_id string, x double, y double, z double")
    assert cells.select("building_id").distinct().count() > 1 and {r["building_id"] for r in joins.of_buildings(cells, p).collect()} == {1}
    assert [r["point_id"] for r in joins.locate(p, cells).collect()] == [7]


def test_points_of_one_place_search_as_one(spark, monkeypatch):
    cells = spark.createDataFrame([(1, i, "s", float(i), 0.0, 0.0, i + 1.0, 0.0, 0.0, float(i), 1.0, 0.0) for i in range(30)], "building_id int, id int, space_id string, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, x3 double, y3 double, z3 double")
    points = spark.createDataFrame([(1, i, 3.25 if i % 2 else 29.0, 0.25, 40.0 * (i % 2)) for i in range(400)] + [(1, 900, None, 0.0, 0.0), (2, 901, 0.0, 0.0, 0.0)], "building_id int, id int, x double, y double, z double")
    asked, met = [], surface._met
    monkeypatch.setattr(surface, "_met", lambda p, *more: asked.append(p.count()) or met(p, *more))
    got = {r["point_id"]: (r["cell_id"], r["distance_m"]) for r in surface.nearest_cells(points, cells).collect()}
    assert max(asked) == 2 and len(got) == 400
    assert all(got[i] == ((3, 40.0) if i % 2 else (29, 0.0) if got[i][0] == 29 else (28, 0.25)) for i in range(400))


def test_nodes_are_numbered_in_the_order_of_their_names(spark, tmp_path):
    keys = [(0, 1), (1, 10), (10, 2), (2, 100), (99999999999999999, 11), (100, 12345678901234567), (11, 0)]
    spark.createDataFrame([(o, p, 20) for o, p in keys], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = graphs.ends(views.coded_edges(spark, str(tmp_path))).select("id", views.named("id").alias("name")).orderBy("id").collect()
    assert [r["name"] for r in rows] == sorted([f"o{o}" for o, _ in keys] + [f"p{p}" for _, p in keys])
    spark.createDataFrame([(-1, 10**17, 20, 1.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/odd/lineitem.parquet")
    assert views.coded_edges(spark, f"{tmp_path}/odd") is None
    assert {(r["id"], r["component"]) for r in graphs.gr1(spark, f"{tmp_path}/odd").collect()} == {("o-1", "o-1"), (f"p{10**17}", "o-1")}


def test_no_plan_of_components_joins_the_moves_over_and_over(spark, monkeypatch):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(20)] + [(2, 0, i) for i in range(1, 5)], "building_id long, a long, b long")
    joined, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda t, *spent: joined.append(t._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or settle(t, *spent))
    got = {(r["building_id"], r["id"]): r["component"] for r in graph.components(graphs.ends(edges), edges).collect()}
    assert max(joined) <= 2 and len(got) == 26 and set(got.values()) == {0}


def test_sides_of_any_slope_run_beside_each_other_without_heavy_joins(spark):
    # in each building two triangles of two spaces; a side of the second runs a centimetre beside one of the first, turned by up to a hundredth
    rows, far = [], 40.3
    for b in range(36):
        way, turned = math.radians(10 * b), math.radians(10 * b) + 0.01 * (b % 3 - 1)
        at = lambda t, n, w: (far + t * math.cos(w) - n * math.sin(w), far + t * math.sin(w) + n * math.cos(w))
        rows.append((b, 1, "s", *at(0.0, 0.0, way), *at(3.0, 0.0, way), *at(1.0, -2.0, way)))
        rows.append((b, 2, "t", *at(2.0, 0.01, turned), *at(2.9, 0.01, turned), *at(2.0, 2.0, turned)))
    cells = spark.createDataFrame(rows, "building_id int, id int, space_id string, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    none = spark.createDataFrame([], "building_id int, space_a string, space_b string")
    found = joins.open_boundaries(cells, none, tolerance=0.05)
    assert {r["building_id"]: round(r["width_m"], 2) for r in found.collect()} == dict.fromkeys(range(36), 0.9)
    joined = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joined and not any("SQRT" in line for line in joined)


def test_seams_are_looked_for_outside_the_join_of_cubes(spark):
    cells = spark.createDataFrame([(1, i, "s", 0, "open", *(1.05 * i + x for x in (0.0, 1.0, 0.0)), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0) for i in range(3)], "building_id int, id int, space_id string, level_id int, terrain string, x1 double, x2 double, x3 double, y1 double, y2 double, y3 double, z1 double, z2 double, z3 double")
    found = surface.seam_links(cells, surface.shared_links(cells))
    assert {(r["a"], r["b"]) for r in found.collect()} == {(0, 1), (1, 2)}
    joined = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joined and not any("lambda" in line for line in joined)


def test_all_ways_of_a_dense_graph_are_found_without_a_row_for_each_arc_tried(spark, monkeypatch):
    """Costs and paths equal those of the search by joins, with sources of one building dealt to several tasks; only arcs and sources are shuffled."""
    r = random.Random(5)
    arcs = [(b, x, y, r.randint(1, 3)) for b in (1, 2) for x in range(40) for y in r.sample(range(40), 3) if x != y] + [(1, 90, 91, 1)]
    arcs = spark.createDataFrame(arcs, "building_id long, a long, b long, cost int")
    sources = spark.createDataFrame([(b, s) for b in (1, 2) for s in range(9)] + [(1, 90), (1, 500)], "building_id long, source long")
    monkeypatch.setattr(graph, "BATCH", 4)
    got = graph.cheapest_in_tasks(sources, arcs, paths=True)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    costs = arcs.withColumn("cost", F.col("cost").cast("double"))
    best = graph.cheapest(sources.select("building_id", "source", F.col("source").alias("id"), F.lit(0.0).alias("cost")), costs)
    rows = {(x["building_id"], x["source"], x["id"]): x for x in got.collect()}
    assert {k: float(x["cost"]) for k, x in rows.items()} == {(x["building_id"], x["source"], x["id"]): x["cost"] for x in best.collect()}
    for x in graph.predecessors(best, costs).collect():
        one, before = rows[x["building_id"], x["source"], x["id"]], rows[x["building_id"], x["source"], x["before"]]
        assert one["path"] == f"{before['path']}>{x['id']}"
    assert rows[1, 500, 500]["path"] == "500" and rows[1, 90, 91]["path"] == "90>91"


def test_shuffle_files_of_a_state_go_as_it_is_written(spark, monkeypatch):
    seen, key = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(spark.conf.get(key, "false")), write(self, *a, **k))[1])
    before = spark.conf.get(key, "false")
    graph.settle(spark.range(9).groupBy((F.col("id") % 2).alias("k")).count())
    assert seen == ["true"] and spark.conf.get(key, "false") == before


def test_agents_choose_among_all_exits_without_a_row_for_each(spark):
    """WIN4 equals the choice among all pairs and joins none; a building without exits gives no row."""
    c = windows.candidates(spark, "/root/testdata/sf0.01")
    caps = c.select("building_id", "exit_id").distinct().withColumn("capacity", (F.col("exit_id") % 3 + 1) * 0.02)
    got = registry.QUERIES["win4"](spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evacuation.assign_in_turn(c, caps).collect()))
    spread = spark.createDataFrame([(1, a, float(a % 7)) for a in range(50)], "building_id long, agent_id long, weight double")
    assert evacuation.assign_by_weight(spread, spark.createDataFrame([(2, 1, 1.0, 1.0)], "building_id long, exit_id long, weight double, capacity double")).isEmpty()


def test_gr11_searches_only_what_its_sources_reach(spark, monkeypatch):
    seen, search = [], graph.cheapest
    monkeypatch.setattr(graph, "cheapest", lambda sources, arcs, *a, **k: (seen.append(arcs.count()), search(sources, arcs, *a, **k))[1])
    registry.QUERIES["gr11"](spark, "/root/testdata/sf0.01")
    assert 0 < seen[0] < views.edges(spark, "/root/testdata/sf0.01").count() / 2


def test_equal_requests_are_asked_once_and_only_their_buildings_are_made(spark):
    asked = spark.createDataFrame([(3, 1, 0.5), (1, 1, 0.5), (2, 1, None), (5, 1, None), (4, 2, 0.5)], "id long, building_id long, x double")
    once, same = buildings._once(asked, "building_id", "x")
    assert sorted(r["id"] for r in once.collect()) == [1, 2, 4]
    assert {r["id"]: r["first"] for r in same.collect()} == {1: 1, 3: 1, 2: 2, 5: 2, 4: 4}
    cells, links = buildings._surface(spark, "/root/testdata/sf0.01", spark.createDataFrame([(3,)], "building_id long"))
    assert {r["building_id"] for t in (cells, links) for r in t.select("building_id").distinct().collect()} == {3}
