"""The surface in space: links, doors, seams, pulled routes, stairs and routes through whole buildings, on small buildings with known answers."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from concourse.operators import hierarchy, surface

CELL = "building_id long, id string, space_id string, level_id string, terrain string, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, x3 double, y3 double, z3 double"


def room(space, x0, y0, x1, y1, z=0.0, level="L1", holes=(), size=1.0, building=1):
    """Two triangles for each square of a room; holes are squares left out."""
    out = []
    for i, j in itertools.product(range(round((x1 - x0) / size)), range(round((y1 - y0) / size))):
        if (i, j) in holes:
            continue
        a, b, c, d = [(x0 + (i + u) * size, y0 + (j + v) * size, z) for u, v in ((0, 0), (1, 0), (1, 1), (0, 1))]
        out += [triangle(f"cell:{space}:{i:02d}:{j:02d}:0", space, (a, b, d), level, "open", building), triangle(f"cell:{space}:{i:02d}:{j:02d}:1", space, (b, c, d), level, "open", building)]
    return out


def triangle(id_, space, corners, level="L1", terrain="open", building=1):
    return (building, id_, space, level, terrain, *[float(v) for c in corners for v in c])


def table(spark, cells):
    return spark.createDataFrame(cells, CELL)


def vec(*p):
    return F.struct(*[F.lit(float(v)).alias(k) for v, k in zip(p, "xyz")])


def surface_route(spark, cells, start, goal, links=None):
    """Points and length of the way over the surface between two points."""
    c = table(spark, cells)
    links = surface.shared_links(c) if links is None else links
    ends = spark.createDataFrame([(1, "s", *map(float, start)), (1, "t", *map(float, goal))], "building_id long, id string, x double, y double, z double")
    near = {r["point_id"]: r for r in surface.nearest_cells(ends, c).collect()}
    pair = spark.createDataFrame([(1, near["s"]["cell_id"], near["t"]["cell_id"])], "building_id long, source string, goal string")
    legs = surface.corridors(pair, surface.corridor_arcs(links, c)).withColumn("id", F.lit(1)).drop("source", "goal")
    ends = spark.range(1).select(F.lit(1).cast("long").alias("building_id"), F.lit(1).alias("id"), vec(*near["s"]["at"]).alias("start"), vec(*near["t"]["at"]).alias("goal"))
    return surface.pulled_routes(legs, ends, c, links, ("building_id", "id")).first()


def test_way_through_an_open_room_is_straight(spark):
    got = surface_route(spark, room("A", 0, 0, 10, 4), (0.5, 2.1, 0), (9.5, 2.1, 0))
    assert abs(got["length_m"] - 9.0) < 1e-9


def test_way_around_an_obstacle_touches_its_corners(spark):
    outer, inner = [(0, 0, 0), (10, 0, 0), (10, 4, 0), (0, 4, 0)], [(4, 1, 0), (6, 1, 0), (6, 3, 0), (4, 3, 0)]
    ring = [t for i in range(4) for j in [(i + 1) % 4] for t in ((outer[i], outer[j], inner[i]), (outer[j], inner[j], inner[i]))]
    got = surface_route(spark, [triangle(f"r{i}", "A", t) for i, t in enumerate(ring)], (1, 2, 0), (9, 2, 0))
    assert abs(got["length_m"] - (2 * math.sqrt(10) + 2)) < 1e-6 and len(got["points"]) == 4


def test_pulled_ways_equal_the_shortest_over_visible_corners(spark):
    """Random strips of triangles: every way is as short as the best over corners that see each other through all portals between them."""
    r, cells, expected, asked = random.Random(4), [], {}, []
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for n in range(25):
        low, high, strip = [(0.0, 0.0)], [(0.0, 1.0)], []
        for i in range(r.randint(3, 14)):
            strip.append((low[-1], high[-1]))
            lift = round(r.uniform(-2.5, 2.5) + (0 if i % 2 == 0 else r.uniform(0.3, 2.0)), 3)
            (low if i % 2 == 0 else high).append((1.0 + i, lift))
            if min(turn(low[-2], low[-1], high[-1]) if i % 2 == 0 else turn(low[-1], high[-1], high[-2]), 1) <= 1e-3:
                (low if i % 2 == 0 else high).pop()
                strip.pop()
                break
            tri = (strip[-1][0], low[-1] if i % 2 == 0 else high[-1], strip[-1][1])
            cells.append(triangle(f"{n:02d}-{i:02d}", "A", [(*p, 0.0) for p in tri], building=n))
        last = (low[-1], high[-1])
        if len(strip) < 3:
            cells = [c for c in cells if c[0] != n]
            continue
        mid = lambda s: ((s[0][0] + s[1][0]) / 2, (s[0][1] + s[1][1]) / 2)
        start, goal, portals = mid(strip[0]), mid(last), strip[1:]
        spots = [(0, start)] + [(k + 1, p) for k, s in enumerate(portals) for p in s] + [(len(portals) + 1, goal)]
        best = {0: 0.0}
        for j in range(1, len(spots)):
            ways = []
            for i in range(j):
                (k, p), (m, q) = spots[i], spots[j]
                if k < m and i in best and all(turn(p, q, s[0]) <= 1e-9 and turn(p, q, s[1]) >= -1e-9 for s in portals[k : m - 1]):
                    ways.append(best[i] + math.dist(p, q))
            if ways:
                best[j] = min(ways)
        expected[n] = best[len(spots) - 1]
        asked.append((n, start, goal, f"{n:02d}-00", f"{n:02d}-{len(strip) - 1:02d}"))
    c = table(spark, cells)
    links = surface.shared_links(c)
    pairs = spark.createDataFrame([(n, s, t) for n, _, _, s, t in asked], "building_id long, source string, goal string")
    legs = surface.corridors(pairs, surface.corridor_arcs(links, c)).select("building_id", "seq", "a", "b")
    ends = spark.createDataFrame([(n, (*s, 0.0), (*t, 0.0)) for n, s, t, _, _ in asked], "building_id long, start struct<x:double,y:double,z:double>, goal struct<x:double,y:double,z:double>")
    got = {r["building_id"]: r["length_m"] for r in surface.pulled_routes(legs, ends, c, links, ("building_id",)).collect()}
    assert len(expected) > 10 and set(got) == set(expected)
    assert max(abs(got[n] - expected[n]) for n in expected) < 1e-7


def treads():
    """Three flat steps, each 20 cm above the one before, that touch nowhere."""
    return [triangle("tread:0", None, ((0, 1, 0), (1, 1, 0), (0.5, 0, 0)), terrain="stair"), triangle("tread:1", None, ((0, 1, 0.2), (1, 1, 0.2), (0.5, 2, 0.2)), terrain="stair"), triangle("tread:2", None, ((0, 2, 0.4), (1, 2, 0.4), (0.5, 3, 0.4)), terrain="stair")]


def test_way_over_steps_leaves_the_surface_nowhere(spark):
    point = "struct<x:double,y:double,z:double>"
    rows = [(1, "tread:0", "tread:1", None, (0.2, 1.0, 0.1), (0.8, 1.0, 0.1)), (1, "tread:1", "tread:2", None, (0.2, 2.0, 0.3), (0.8, 2.0, 0.3))]
    links = spark.createDataFrame(rows, f"building_id long, a string, b string, portal_id string, p {point}, q {point}")
    got = surface_route(spark, treads(), (0.5, 0.25, 0.0), (0.5, 2.75, 0.4), links)
    rises = [abs(b["z"] - a["z"]) for a, b in zip(got["points"], got["points"][1:])]
    assert len(got["points"]) >= 6 and got["points"][0]["z"] == 0 and got["points"][-1]["z"] == 0.4 and max(rises) <= 0.2 + 1e-9
    assert got["length_m"] > math.dist((0.5, 0.25, 0.0), (0.5, 2.75, 0.4)) + 0.1


def test_way_up_a_tilted_flight_is_pulled_in_its_plane(spark):
    v = [(0, 0, 0), (1, 0, 0), (0, 1, 1), (1, 1, 1), (0, 2, 2), (1, 2, 2)]
    cells = [triangle(f"cell:stair:G:{n}", None, [v[i] for i in t], terrain="stair") for n, t in enumerate([(0, 1, 2), (1, 3, 2), (2, 3, 4), (3, 5, 4)])]
    got = surface_route(spark, cells, (0.2, 0.1, 0.1), (0.8, 1.9, 1.9))
    assert abs(got["length_m"] - math.dist((0.2, 0.1, 0.1), (0.8, 1.9, 1.9))) < 1e-9


def test_seams_link_once_and_not_between_rooms(spark):
    near = [triangle("a", "A", ((0, 0, 0), (1, 0, 0), (0, 1, 0))), triangle("b", "A", ((1.1, 0, 0.1), (2, 0, 0.1), (1.1, 1, 0.1))), triangle("c", "C", ((-0.1, 0, 0), (-0.1, 1, 0), (-1, 0, 0))), triangle("d", None, ((0, 0, 3), (1, 0, 3), (0, 1, 3)), terrain="stair")]
    c = table(spark, near)
    got = surface.seam_links(c, surface.shared_links(c)).collect()
    assert [(r["a"], r["b"]) for r in got] == [("a", "b")]
    assert math.dist(got[0]["p"], got[0]["q"]) <= 0.2 + 1e-9
    # a pair that links already is left alone, and a gap that is too wide or too high is none
    assert surface.seam_links(c, spark.createDataFrame([(1, "a", "b")], "building_id long, a string, b string")).count() == 0
    assert surface.seam_links(c, surface.shared_links(c), gap=0.1).count() == 0 and surface.seam_links(c, surface.shared_links(c), rise=0.05).count() == 0


def doors(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "building_id long, id string, x double, y double, z double, from_space_id string, to_space_id string, level_id string, width_m double")


def square(id_, x, y, space, level="L1"):
    return triangle(id_, space, ((x, y, 0), (x + 0.9, y, 0), (x, y + 0.7, 0)), level)


def test_doors_get_pairs_of_their_own(spark):
    c = table(spark, [square("a:0", 0.0, 0.0, "a"), square("a:1", 0.0, 0.8, "a"), square("b:0", 1.0, 0.0, "b"), square("b:1", 1.0, 0.8, "b")])
    none = surface.shared_links(c)
    # both doors are nearest to a:0 and b:0
    both = doors(spark, [("door:first", 0.95, 0.25, 0.0, "a", "b", "L1", None), ("door:second", 0.95, 0.35, 0.0, "a", "b", "L1", 0.1), ("lone", 0.95, 0.3, 0.0, "a", None, "L1", None), ("far", 9.0, 9.0, 0.0, "a", "b", "L1", None)])
    got = surface.door_links(both, c, none)
    rows = {r["portal_id"]: r for r in got.collect()}
    assert set(rows) == {"door:first", "door:second"} and (rows["door:first"]["a"], rows["door:first"]["b"]) == ("a:0", "b:0") and len({(r["a"], r["b"]) for r in rows.values()}) == 2
    assert abs(math.dist(rows["door:first"]["p"], rows["door:first"]["q"]) - 0.9) < 1e-9 and abs(math.dist(rows["door:second"]["p"], rows["door:second"]["q"]) - 0.2) < 1e-9
    # again, on its own links: nothing changes; a pair of another portal is taken
    again = {r["portal_id"]: (r["a"], r["b"]) for r in surface.door_links(both, c, got).collect()}
    assert again == {k: (r["a"], r["b"]) for k, r in rows.items()}
    taken = got.where("portal_id = 'door:first'").withColumn("portal_id", F.lit("other"))
    moved = {r["portal_id"]: (r["a"], r["b"]) for r in surface.door_links(both, c, taken).collect()}
    assert len(moved) == 2 and ("a:0", "b:0") not in moved.values()


def test_many_doors_equal_asking_one_by_one(spark):
    r = random.Random(3)
    left = [square(f"a:{i}", -0.9, 0.4 * i, "a") for i in range(6)]
    right = [square(f"b:{i}", 0.1, 0.4 * i, "b") for i in range(6)]
    c = table(spark, left + right)
    rows = [(f"d{i:02d}", r.uniform(-0.3, 0.3), r.uniform(0.5, 1.5), 0.0, "a", "b", "L1", 0.9) for i in range(7)]
    got = {x["portal_id"]: (x["a"], x["b"]) for x in surface.door_links(doors(spark, rows), c, surface.shared_links(c)).collect()}

    def gap(p, cell):
        a, b, q = [cell[5 + 3 * i : 8 + 3 * i] for i in range(3)]
        inside = lambda u, v, w: (v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0])
        if all(inside(u, v, p) >= 0 for u, v in ((a, b), (b, q), (q, a))):
            return 0.0
        best = 9.0
        for u, v in ((a, b), (b, q), (q, a)):
            t = max(0, min(1, sum((p[k] - u[k]) * (v[k] - u[k]) for k in range(3)) / sum((v[k] - u[k]) ** 2 for k in range(3))))
            best = min(best, math.dist(p, [u[k] + t * (v[k] - u[k]) for k in range(3)]))
        return best

    taken, expected = set(), {}
    for id_, x, y, z, *_ in rows:
        pairs = sorted((round(round(gap((x, y, z), a), 9) + round(gap((x, y, z), b), 9), 9), max(gap((x, y, z), a), gap((x, y, z), b)), a[1], b[1]) for a in left for b in right if max(gap((x, y, z), a), gap((x, y, z), b)) <= 2.5)
        pair = next((p[2:] for p in pairs if p[2:] not in taken), None)
        if pair:
            taken.add(pair)
            expected[id_] = pair
    assert got == expected and len(got) == 7


def test_points_are_told_apart_by_storey(spark):
    c = table(spark, room("low", 0, 0, 4, 4) + room("high", 0, 0, 4, 4, 3.0, "L2"))
    p = spark.createDataFrame([(1, "a", 1.2, 1.3, 0.1), (1, "b", 1.2, 1.3, 2.9), (1, "c", 1.2, 1.3, 1.5), (1, "d", None, 1.0, 0.0), (1, "e", 4.5, 2.0, 3.0)], "building_id long, id string, x double, y double, z double")
    assert {r["point_id"]: r["space_id"] for r in surface.located(p, c).collect()} == {"a": "low", "b": "high"}
    near = {r["point_id"]: r for r in surface.nearest_cells(p.unionByName(spark.createDataFrame([(1, "f", 90.0, 0.0, 40.0)], p.schema)), c, 1.0).collect()}
    assert set(near) == {"a", "b", "c", "e", "f"} and near["b"]["cell_id"].startswith("cell:high") and abs(near["e"]["distance_m"] - 0.5) < 1e-9 and near["f"]["cell_id"].startswith("cell:high")
    on = {r["point_id"]: r for r in surface.snapped(p.withColumn("space_id", F.lit("high")), c).collect()}
    assert set(on) == {"a", "b", "c", "e"} and on["c"]["at"]["z"] == 3.0 and on["e"]["at"]["x"] == 4.0 and abs(on["a"]["distance_m"] - 2.9) < 1e-9


# ---- whole buildings

NODE = "building_id long, id string, kind string, space_id string, level_id string, x double, y double, z double"
EDGE = "building_id long, a string, b string, distance_m double"


def whole(spark, cells, door_rows, asked, nodes, edges, transitions, **scenario):
    """Legs and rows by request of routes through buildings with doors and a metric graph."""
    c, d = table(spark, cells), spark.createDataFrame(door_rows, "building_id long, id string, x double, y double, z double, from_space_id string, to_space_id string, level_id string, width_m double")
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    t = hierarchy.door_transitions(d)
    more = spark.createDataFrame(transitions, t.schema)
    passages = hierarchy.transfers(t.unionByName(more), d, hierarchy.node_transfers(more, n, e), c, n)
    rows = spark.createDataFrame([(b, i, s, *map(float, p), *map(float, q)) for i, (b, s, p, q) in asked.items()], "building_id long, id string, scenario string, x double, y double, z double, gx double, gy double, gz double")
    made = {k: spark.createDataFrame(v, f"scenario string, building_id long, {kind}") for k, (v, kind) in scenario.items()}
    legs, out = hierarchy.routes(rows, passages, c, surface.shared_links(c), n, e, **made)
    legs = legs.collect()
    return {i: sorted((r for r in legs if r["id"] == i), key=lambda r: r["seq"]) for i in asked}, {r["id"]: r for r in out.collect()}


def test_routes_through_buildings(spark):
    cells = room("A", 0, 0, 5, 10) + room("B", 5, 0, 10, 10)
    cells += room("A", 0, 0, 4, 8, building=2) + room("B", 4, 0, 8, 4, building=2) + room("D", 4, 4, 8, 8, building=2) + room("C", 8, 0, 12, 8, building=2)
    cells += room("lower", 0, 0, 4, 4, building=3) + room("upper", 0, 0, 4, 4, 3.0, "L2", building=3)
    door_rows = [(1, "door:near", 5.0, 1.0, 0.0, "A", "B", "L1", 0.9), (1, "door:far", 5.0, 9.0, 0.0, "A", "B", "L1", 0.9)]
    door_rows += [(2, f"door:{a}{b}", x, y, 0.0, a, b, "L1", None) for a, b, x, y in (("A", "B", 4.0, 2.0), ("B", "C", 8.0, 2.0), ("A", "D", 4.0, 6.0), ("D", "C", 8.0, 6.0))]
    nodes = [(3, "lower-landing", "walk", "lower", "L1", 2.0, 2.0, 0.0), (3, "stair-0", "stair", None, None, 2.0, 2.0, 0.2), (3, "stair-1", "stair", None, None, 2.0, 2.0, 2.8), (3, "upper-landing", "walk", "upper", "L2", 2.0, 2.0, 3.0)]
    edges = [(3, "lower-landing", "stair-0", 0.2), (3, "stair-0", "stair-1", 2.6), (3, "stair-1", "upper-landing", 0.2)]
    stair = [(3, "t", "stair", "lower", "upper", None, "L1", "L2", True, "metric_vertical_touch", None)]
    asked = {
        "near": (1, "now", (1, 1, 0), (9, 1, 0)), "inside": (1, "now", (1, 1, 0), (1, 5, 0)), "nowhere": (1, "now", (1, 1, 0), (50, 1, 0)), "from nowhere": (1, "now", (77, 1, 0), (1, 1, 0)),
        "far": (1, "near shut", (1, 1, 0), (9, 1, 0)), "no way": (1, "doors shut", (1, 1, 0), (9, 1, 0)),
        "into": (1, "B shut", (1, 1, 0), (9, 1, 0)), "out of": (1, "B shut", (9, 9, 0), (1, 3, 0)), "within": (1, "B shut", (9, 9, 0), (9, 1, 0)),
        "usual": (2, "now", (1, 2, 0), (11, 2, 0)), "dear": (2, "dear", (1, 2, 0), (11, 2, 0)), "around": (2, "B shut", (1, 2, 0), (11, 2, 0)),
        "up": (3, "now", (1, 2, 0), (3, 2, 3)), "down": (3, "now", (3, 2, 3), (1, 2, 0)),
    }
    shut = [("near shut", 1, "door:near"), ("doors shut", 1, "door:near"), ("doors shut", 1, "door:far")]
    legs, rows = whole(spark, cells, door_rows, asked, nodes, edges, stair, blocked_portals=(shut, "portal_id string"), blocked_spaces=([("B shut", 1, "B"), ("B shut", 2, "B")], "space_id string"), multipliers=([("dear", 2, "B", 10.0)], "space_id string, multiplier double"))
    long = lambda i: rows[i]["length_m"]
    spaces = lambda i: [g["to_space_id"] for g in legs[i] if g["transition_id"]]
    assert {i: r["reason"] for i, r in rows.items() if r["reason"]} == {"nowhere": "goal off surface", "from nowhere": "start off surface", "into": "goal blocked", "no way": "no route"}
    assert [g["transition_id"] for g in legs["near"]] == [None, "transition:door:near", None] and [g["kind"] for g in legs["near"]] == ["local", "door", "local"] and abs(long("near") - 8) < 1e-6
    assert len(legs["inside"]) == len(legs["within"]) == 1 and abs(long("inside") - 4) < 1e-6
    assert legs["far"][1]["portal_id"] == "door:far" and legs["out of"][1]["portal_id"] == "door:far" and long("far") >= 2 * math.sqrt(80) - 1e-6
    assert spaces("usual") == ["B", "C"] and spaces("dear") == spaces("around") == ["D", "C"] and long("usual") < long("dear") and rows["dear"]["cost"] < 43
    assert [g["kind"] for g in legs["up"]] == ["local", "stair", "local"] and [round(p["z"], 6) for p in legs["up"][1]["points"]] == [0.0, 0.2, 2.8, 3.0] and abs(long("up") - 5) < 1e-6
    assert [round(p["z"], 6) for p in legs["down"][1]["points"]] == [3.0, 2.8, 0.2, 0.0] and abs(long("down") - 5) < 1e-6
    # points of the legs fit together, and legs add up
    for i, own in legs.items():
        assert all(math.dist(a["points"][-1], b["points"][0]) < 1e-9 for a, b in zip(own, own[1:])) and rows[i]["n_legs"] == len(own) and abs(sum(g["length_m"] for g in own) - (long(i) or 0)) < 1e-9


def test_storeys_are_joined_over_the_surface_of_a_stair(spark):
    low, high = (0, 0, 0), (0, 2, 3)
    a, b = (1, 1, 1.5), (-1, 1, 1.5)
    cells = [triangle("floor:lower", "lower", ((-2, -1, 0), (2, -1, 0), low)), triangle("cell:stair:G:0", None, (low, a, b), "L1", "stair"), triangle("cell:stair:G:1", None, (a, b, high), "L2", "stair"), triangle("floor:upper", "upper", (high, (-2, 3, 3), (2, 3, 3)), "L2")]
    point = "struct<x:double,y:double,z:double>"
    f = lambda p: tuple(map(float, p))
    rows = [(1, "cell:stair:G:0", "floor:lower", None, f(low), f(low)), (1, "cell:stair:G:0", "cell:stair:G:1", None, f(a), f(b)), (1, "cell:stair:G:1", "floor:upper", None, f(high), f(high))]
    links = spark.createDataFrame(rows, f"building_id long, a string, b string, portal_id string, p {point}, q {point}")
    c = table(spark, cells)
    parts, at = hierarchy.landings(c, links)
    assert {(r["level_id"], r["space_id"], r["resource_id"]) for r in at.collect()} == {("L1", "lower", "surface:stair:G"), ("L2", "upper", "surface:stair:G")} and parts.count() == 2
    levels = spark.createDataFrame([(1, "L1", 0.0), (1, "L2", 3.0)], "building_id long, id string, elevation_m double")
    over = hierarchy.surface_transitions(at, levels)
    (t,) = over.collect()
    assert (t["kind"], t["source"], t["from_space_id"], t["to_space_id"], t["from_level_id"], t["to_level_id"]) == ("stair", "surface_vertical_touch", "lower", "upper", "L1", "L2")
    assert hierarchy.surface_transitions(at, levels, over).count() == 0
    (way,) = hierarchy.surface_transfers(over, at, parts, c, links).collect()
    assert way["cells"] == ["cell:stair:G:0", "cell:stair:G:1"] and way["points"][0]["z"] == 0 and way["points"][-1]["z"] == 3 and way["length_m"] > 3
    d = doors(spark, [])
    passages = hierarchy.transfers(over, d, hierarchy.surface_transfers(over, at, parts, c, links), c)
    asked = spark.createDataFrame([(1, 1, "now", 0.0, -0.5, 0.0, 0.0, 2.5, 3.0)], "building_id long, id long, scenario string, x double, y double, z double, gx double, gy double, gz double")
    legs, rows = hierarchy.routes(asked, passages, c, links)
    got = sorted(legs.collect(), key=lambda r: r["seq"])
    assert [g["kind"] for g in got] == ["local", "stair", "local"] and got[1]["points"][0]["z"] == 0 and got[1]["points"][-1]["z"] == 3 and rows.first()["reason"] is None


def test_local_ways_fall_back_to_nodes(spark):
    # two islands of one room, joined by nodes only
    cells = room("A", 0, 0, 2, 2) + room("A", 6, 0, 8, 2)
    cells = [(*c[:1], f"{c[1]}:{i}", *c[2:]) for i, c in enumerate(cells)]
    c = table(spark, cells)
    nodes = spark.createDataFrame([(1, "n0", "walk", "A", "L1", 1.0, 1.0, 0.0), (1, "n1", "walk", "A", "L1", 4.0, 1.0, 0.0), (1, "n2", "walk", "A", "L1", 7.0, 1.0, 0.0), (1, "m", "walk", "B", "L1", 4.0, 0.0, 0.0)], NODE)
    edges = spark.createDataFrame([(1, "n0", "n1", 3.0), (1, "n1", "n2", 3.0), (1, "n0", "m", 0.1), (1, "m", "n2", 0.1)], EDGE)
    p = "struct<x:double,y:double,z:double>"
    asked = spark.createDataFrame([(1, "A", 1, (0.5, 1.0, 0.0), (1.5, 1.0, 0.0)), (1, "A", 2, (0.5, 1.0, 0.0), (7.5, 1.0, 0.0)), (1, "A", 3, (0.5, 1.0, 0.0), (30.0, 1.0, 0.0))], f"building_id long, space_id string, id int, start {p}, goal {p}")
    got = {r["id"]: r for r in hierarchy.local_routes(asked, c, surface.shared_links(c), nodes, edges).collect()}
    assert set(got) == {1, 2} and got[1]["how"] == "surface" and abs(got[1]["length_m"] - 1) < 1e-9 and got[2]["how"] == "metric" and abs(got[2]["length_m"] - 7) < 1e-9 and len(got[2]["points"]) == 5


def test_ways_may_go_through_the_corner_at_which_a_corridor_comes_back(spark):
    """Two pillars touch in (1, 1): the corridor leads around the larger one, the shortest way through that point."""
    cells = table(spark, room("A", 0, 0, 3, 4, holes={(0, 0), (1, 1), (1, 2)}))
    asked = spark.range(1).select(F.lit(1).cast("long").alias("building_id"), F.lit("A").alias("space_id"), F.lit("r").alias("id"), vec(0.6, 1.4, 0).alias("start"), vec(1.45, 0.2, 0).alias("goal"))
    got = hierarchy.local_routes(asked, cells, surface.shared_links(cells)).first()
    assert abs(got["length_m"] - math.hypot(0.4, 0.4) - math.hypot(0.45, 0.8)) < 1e-9 and len(got["points"]) == 3
