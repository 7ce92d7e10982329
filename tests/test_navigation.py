"""Golden models for graphs and geometry, and registered queries against their SQL."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from concourse import registry
from concourse.functions import geometry as g
from concourse.operators import elements, evacuation, graph, joins, routes, rules

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_diamond_paths(spark):
    e = spark.createDataFrame([(1, "A", "B", 1.0), (1, "B", "C", 1.0), (1, "A", "D", 1.4), (1, "D", "C", 1.4)], "building_id int, a string, b string, cost double")
    arcs = graph.undirected(e, "cost")
    source = spark.createDataFrame([(1, "A")], "building_id int, source string")
    to = {r["id"]: r["path"] for r in graph.shortest(source, arcs).collect()}
    assert to["C"] == ["A", "B", "C"]
    shut = graph.under_scenario(arcs, spark.createDataFrame([(1, "B")], "building_id int, id string"), spark.createDataFrame([], "building_id int, id string, multiplier double"))
    assert {r["id"]: r["path"] for r in graph.shortest(source, shut).collect()}["C"] == ["A", "D", "C"]


def test_components_keep_buildings_apart(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 9), (1, 7, 7)], "building_id int, a int, b int")
    n = spark.createDataFrame([(1, i) for i in (1, 2, 3, 7)] + [(2, 1), (2, 9)], "building_id int, id int")
    assert {(r["building_id"], r["id"]): r["component"] for r in graph.components(n, e).collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 7): 7, (2, 1): 1, (2, 9): 1}


def test_polyline(spark):
    p = F.array(*[g.vec(*[F.lit(float(v)) for v in q]) for q in ((0, 0, 0), (3, 0, 4), (3, 4, 4))])
    r = spark.range(1).select(g.polyline_length(p).alias("n"), g.point_at(p, F.lit(2.5)).alias("at")).first()
    assert r["n"] == pytest.approx(9) and (r["at"]["x"], r["at"]["y"], r["at"]["z"]) == pytest.approx((1.5, 0, 2))


def test_closest_on_triangle_is_never_beaten_by_a_sample(spark):
    a, b, c = (0.0, 0.0, 0.0), (2.0, 0.0, 1.0), (0.0, 1.5, 0.0)
    points = [(x * 0.7 - 1, y * 0.6 - 1, z - 1.0) for x in range(5) for y in range(5) for z in range(3)]
    rows = spark.createDataFrame(points, "x double, y double, z double")
    corner = [g.vec(*[F.lit(v) for v in q]) for q in (a, b, c)]
    out = rows.select("x", "y", "z", g.closest_on_triangle(g.vec("x", "y", "z"), *corner).alias("q")).collect()
    for r in out:
        mine = math.dist((r["x"], r["y"], r["z"]), tuple(r["q"]))
        best = min(math.dist((r["x"], r["y"], r["z"]), tuple(sum(w * k[i] for w, k in zip((u / 40, v / 40, (40 - u - v) / 40), (a, b, c))) for i in range(3))) for u in range(41) for v in range(41 - u))
        assert mine <= best + 1e-9


def test_levels_are_inherited_and_cycles_end(spark):
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 6), (6, 4), (7, 4), (8, 8), (9, 8)], "id long, parent_id long")
    levels = spark.createDataFrame([(1, 10), (3, None), (9, 30)], "id long, level_id long")
    assert {r["id"]: (r["level_id"], r["depth"]) for r in elements.inherited_levels(parents, levels).collect()} == {1: (10, 0), 2: (10, 1), 3: (10, 2), 9: (30, 0)}


def test_queue_leaves_one_by_one(spark):
    rows = spark.createDataFrame([(1, i, 0.0, 1.0) for i in range(3)], "gate int, id int, arr double, capacity double")
    served = evacuation.departures(rows)
    assert sorted(r["dep"] for r in served.collect()) == [0.0, 1.0, 2.0]
    assert evacuation.queue_lengths(served).first()["max_queue"] == 2


def test_agents_split_between_exits(spark):
    c = spark.createDataFrame([(1, a, e, 1.0) for a in range(4) for e in (1, 2)], "building_id long, agent_id long, exit_id long, free_s double")
    caps = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0)], "building_id long, exit_id long, capacity double")
    out = [r["exit_id"] for r in evacuation.assign_in_turn(c, caps).collect()]
    assert sorted(out) == [1, 1, 2, 2]


CELLS = "building_id int, id int, space_id string, terrain string, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"


def square(first: int, space: str, x: float, wide: float = 1.0) -> list[tuple]:
    """Two triangles of a square with its lower left corner at (x, 0)."""
    return [(1, first, space, "open", x, 0.0, x + wide, 0.0, x, 1.0), (1, first + 1, space, "open", x + wide, 0.0, x + wide, 1.0, x, 1.0)]


def test_a_gap_of_six_millimetres_is_one_open_boundary(spark):
    c = spark.createDataFrame(square(1, "a", 0.0) + square(3, "b", 1.006, 0.994) + square(5, "c", 2.1), CELLS)
    none = spark.createDataFrame([], "building_id int, space_a string, space_b string")
    found = joins.open_boundaries(c, none).collect()
    assert [(r["space_a"], r["space_b"], r["a"], r["b"], r["width_m"], r["gap_m"]) for r in found] == [("a", "b", 2, 3, 1.0, 0.006)]
    assert found[0]["id"].startswith("open:") and len(found[0]["id"]) == 21
    assert joins.open_boundaries(c, spark.createDataFrame([(1, "a", "b")], none.schema)).isEmpty()
    assert joins.open_boundaries(c.where("false"), none).isEmpty()


def test_the_closest_cell_is_found_at_any_distance(spark):
    c = spark.createDataFrame(square(1, "a", 0.0), CELLS)
    p = spark.createDataFrame([(1, 1, 0.2, 0.2, 0.5), (1, 2, 40.0, 1.0, 0.0), (1, 3, -1.0, 0.5, 0.0), (2, 4, 0.0, 0.0, 0.0)], "building_id int, id int, x double, y double, z double")
    got = {r["point_id"]: (r["cell_id"], round(r["distance_m"], 6)) for r in joins.closest_cells(p, c).collect()}
    assert got == {1: (1, 0.5), 2: (2, 39.0), 3: (1, 1.0)}
    assert joins.closest_cells(p.where("false"), c).isEmpty()


def test_routes_over_middles_lose_points_on_a_straight_line(spark):
    c = spark.createDataFrame(square(1, "a", 0.0) + square(3, "a", 1.0), CELLS)
    way = spark.createDataFrame([(1, 1, 4, [1, 2, 3, 4]), (1, 1, 1, [1])], "building_id int, source int, id int, path array<int>")
    got = {r["id"]: ([(round(q["x"], 6), round(q["y"], 6)) for q in r["points"]], r["length_m"]) for r in routes.midpoint_routes(way, c).collect()}
    third = 1 / 3
    full = [(third, third), (0.5, 0.5), (1.0, 0.5), (1.5, 0.5), (1 + 2 * third, 2 * third)]
    assert got[4][1] == pytest.approx(sum(math.dist(a, b) for a, b in zip(full, full[1:])))
    assert got[4][0] == [(round(x, 6), round(y, 6)) for x, y in full if (x, y) != (1.0, 0.5)]
    assert len(got[1][0]) == 1 and got[1][1] == 0


def test_gates_fail_on_null(spark):
    s = spark.createDataFrame([(1, 3, None)], "building_id int, nodes int, edges int")
    assert {r["metric"]: r["passed"] for r in rules.gates(s, {"nodes": 3, "edges": 1}).collect()} == {"nodes": True, "edges": False}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["jn1", "jn4", "gr9", "gr11", "v18", "agg9", "win5", "fn11", "src1", "chk1", "st4", "elm3", "elm7", "elm11", "jn9", "gr8", "geo10", "geo14", "v41", "snk2", "st5", "st9", "jn6", "jn13", "jn17", "jn19", "rt3", "v39", "v42", "st7", "st8"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = registry.QUERIES[name](spark, SF)
    cols = sorted(mine.columns)
    theirs = c.sql(registry.ORACLES[name])
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    a = sorted((tuple(plain(r[k]) for k in cols) for r in mine.collect()), key=repr)
    b = sorted((tuple(plain(v) for v in r) for r in theirs.select(*[duckdb.ColumnExpression(k) for k in cols]).fetchall()), key=repr)
    assert a == b
