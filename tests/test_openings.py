"""Openings between spaces without doors, on two storeys with known answers."""

from __future__ import annotations

import hashlib

from concourse import registry
from concourse.operators import openings

CELLS = "building_id int, id int, space_id string, level_id int, terrain string, " + ", ".join(f"{k}{i} double" for i in (1, 2, 3) for k in "xyz")
KNOWN = "building_id int, from_space_id string, to_space_id string"
WALLS = "building_id int, obstacle_id int, ring array<struct<x: double, y: double>>, z_min double, z_max double"


def square(first, space, x, y=0.0, z=0.0, level=0, terrain="open"):
    """Two triangles of a square of one metre; its left side is the first one's, its right side the second one's."""
    at = lambda *corners: [v for dx, dy in corners for v in (x + dx, y + dy, z)]
    return [(1, first, space, level, terrain, *at((0, 0), (1, 0), (0, 1))), (1, first + 1, space, level, terrain, *at((1, 0), (1, 1), (0, 1)))]


def found(spark, cells, known=(), walls=()):
    rows = openings.open_portals(spark.createDataFrame(cells, CELLS), spark.createDataFrame(list(known), KNOWN), spark.createDataFrame(list(walls), WALLS)).collect()
    return {(r["from_space_id"], r["to_space_id"]): r for r in rows}


def test_rooms_meet_on_their_own_storey_only(spark):
    cells = square(1, "a", 0.0) + square(3, "b", 1.05) + square(5, "c", 0.0, z=3.0, level=1) + square(7, "d", 1.05, z=3.0, level=1) + square(9, "e", 2.1, z=0.05, level=1)
    got = found(spark, cells)
    # e lies beside b within the rise, but on another level
    assert {k: (r["a"], r["b"], r["level_id"], r["width_m"], r["gap_m"]) for k, r in got.items()} == {("a", "b"): (2, 3, 0, 1.0, 0.05), ("c", "d"): (6, 7, 1, 1.0, 0.05)}
    one = got["a", "b"]
    assert one["id"] == "open:" + hashlib.sha1(b"0|a|b").hexdigest()[:16]
    assert [tuple(round(v, 9) for v in p) for p in (one["p"], one["q"])] == [(1.0, 0.0, 0.0), (1.0, 1.0, 0.0)]
    links = openings.opened_links(openings.open_portals(spark.createDataFrame(cells, CELLS), spark.createDataFrame([], KNOWN), spark.createDataFrame([], WALLS)))
    assert sorted((r["a"], r["b"]) for r in links.collect()) == [(2, 3), (6, 7)]


def test_an_unknown_level_meets_any_and_steps_and_gaps_part(spark):
    level = [(*r[:3], None, *r[4:]) for r in square(3, "b", 1.05)]
    assert found(spark, square(1, "a", 0.0, level=7) + level)["a", "b"]["level_id"] == 7
    assert not found(spark, square(1, "a", 0.0) + square(3, "b", 1.25))
    assert not found(spark, square(1, "a", 0.0) + square(3, "b", 1.05, z=0.15))
    assert not found(spark, square(1, "a", 0.0) + square(3, "b", 1.05, terrain="stair"))
    assert not found(spark, square(1, "a", 0.0) + square(3, None, 1.05))
    assert not found(spark, square(1, "a", 0.0) + square(3, "a", 1.05))


def test_walls_shut_a_side_and_the_next_widest_opens(spark):
    cells = square(1, "a", 0.0) + square(3, "a", 0.0, y=1.0) + square(5, "b", 1.05) + square(7, "b", 1.05, y=1.5)
    assert (found(spark, cells)["a", "b"]["a"], found(spark, cells)["a", "b"]["width_m"]) == (2, 1.0)
    wall = lambda y, z: (1, 1, [(0.98, y), (1.07, y), (1.07, y + 0.95), (0.98, y + 0.95)], z, z + 2.5)
    shut = found(spark, cells, walls=[wall(0.0, 0.0)])["a", "b"]
    assert (shut["a"], shut["b"], shut["width_m"]) == (4, 7, 0.5)
    # a wall of the storey above is no matter
    assert found(spark, cells, walls=[wall(0.0, 3.0)])["a", "b"]["a"] == 2
    assert not found(spark, square(1, "a", 0.0) + square(3, "b", 1.05), walls=[wall(0.0, 0.0)])


def test_known_pairs_go_in_either_order_and_corners_open_as_points(spark):
    cells = square(1, "a", 0.0) + square(3, "b", 1.05)
    assert not found(spark, cells, [(1, "b", "a")]) and found(spark, cells, [(2, "a", "b"), (1, "a", None)])
    corner = found(spark, square(1, "a", 0.0) + square(3, "b", 1.05, y=1.05))["a", "b"]
    assert corner["width_m"] == 0.0 and corner["p"] == corner["q"] and round(corner["p"]["x"], 6) == 1.025
    assert not found(spark, [])


def test_the_query_of_storeys_gives_spans_only(spark, tmp_path):
    # rooms are walled off from each other but at the corner above a wall's end, beside a pillar
    size = lambda k: 1 if k % 5 != 4 else 7 if k % 200 // 20 == 5 else 6
    spark.createDataFrame([(k, size(k)) for k in range(400)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert registry.QUERIES["jn6_storeys"](spark, str(tmp_path)).collect() == []
