"""The walkable surface in space: triangles (building_id, id, space_id, level_id, terrain, x1 y1 z1 to x3 y3 z3) and the links between them.

A link is (building_id, a, b, portal_id, p, q): two triangles, a before b, and the segment at which one crosses from
one to the other. Storeys lie above each other, so all keys and tests know z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import funnel
from ..functions import geometry as g
from . import graph
from .graph import settle

SCALE = 1e5  # corners within a hundredth of a millimetre are one


def corners(prefix: str = "") -> list[Column]:
    return [g.vec(*[F.col(f"{prefix}{k}{i}") for k in "xyz"]) for i in (1, 2, 3)]


def centre(prefix: str = "") -> Column:
    return g.centroid(*corners(prefix))


def mean_z(prefix: str = "") -> Column:
    return sum((F.col(f"{prefix}z{i}") for i in (2, 3)), F.col(f"{prefix}z1")) / 3


def _sides(cells: DataFrame) -> DataFrame:
    """(building_id, id, space_id, terrain, n, p, q, key) of each side n of each triangle."""
    c = corners()
    point = lambda v: F.struct(*[g.quantised(v[k], SCALE).alias(k) for k in "xyz"])
    each = [(c[i], c[(i + 1) % 3]) for i in range(3)]
    sides = F.array(*[F.struct(F.lit(i).alias("n"), p.alias("p"), q.alias("q"), F.struct(F.least(point(p), point(q)).alias("p"), F.greatest(point(p), point(q)).alias("q")).alias("key")) for i, (p, q) in enumerate(each)])
    return cells.select("building_id", "id", "space_id", "terrain", F.explode(sides).alias("s")).select("building_id", "id", "space_id", "terrain", "s.*")


def shared_links(cells: DataFrame) -> DataFrame:
    """Links of triangles that share a side of exactly two owners; open triangles of two different spaces don't link. Of several shared sides the one of least key."""
    owner = F.struct("id", "space_id", "terrain")
    two = _sides(cells).groupBy("building_id", "key").agg(F.count("*").alias("n"), F.min(owner).alias("a"), F.max(owner).alias("b")).where("n = 2 and a.id <> b.id")
    barred = (F.col("a.space_id") != F.col("b.space_id")) & (F.col("a.terrain") == "open") & (F.col("b.terrain") == "open")
    at = lambda e: g.vec(*[F.col(f"key.{e}.{k}") / SCALE for k in "xyz"]).alias(e)
    found = two.where(~F.coalesce(barred, F.lit(False))).select("building_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "key", at("p"), at("q"))
    return found.groupBy("building_id", "a", "b").agg(F.min_by(F.struct("p", "q"), "key").alias("s")).select("building_id", "a", "b", F.lit(None).cast("string").alias("portal_id"), "s.p", "s.q")


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("building_id", "a", "b", "portal_id", "p", "q").unionByName(links.select("building_id", F.col("b").alias("a"), F.col("a").alias("b"), "portal_id", "p", "q"))


def seam_links(cells: DataFrame, links: DataFrame, gap: float = 0.2, rise: float = 0.3, size: float = 1.0) -> DataFrame:
    """Links over seams: sides of one owner each, of triangles that don't link yet, at most `gap` apart and `rise` in height; open triangles of two spaces don't link.

    A pair of triangles links once, at its first two sides (by id, then by number of the side). The crossing lies midway
    between the closest points, along the first side, a quarter of its length and 10 cm at most to each side. Sides meet
    in the cubes of a grid that their boxes touch, one of the two boxes widened by the gap.
    """
    lone = _sides(cells).groupBy("building_id", "key").agg(F.count("*").alias("n"), F.min(F.struct("id", F.col("n").alias("side"), "space_id", "terrain", "p", "q")).alias("s")).where("n = 1").select("building_id", "s")

    def cubes(pad: float, name: str) -> DataFrame:
        # the grid is shifted by half a cube, as sides on whole metres would touch twice as many; the first cube of each axis is kept
        out = lone
        for k in "xyz":
            low, high = (F.floor((f(f"s.p.{k}", f"s.q.{k}") + r) / size + 0.5) for f, r in ((F.least, -pad), (F.greatest, pad)))
            out = out.withColumn(f"{name}{k}", low).withColumn(f"g{k}", F.explode(F.sequence(F.col(f"{name}{k}"), high)))
        return out.withColumnRenamed("s", name)

    low, high = (lambda e, k: F.least(f"{e}.p.{k}", f"{e}.q.{k}")), (lambda e, k: F.greatest(f"{e}.p.{k}", f"{e}.q.{k}"))
    met = cubes(0.0, "s").join(cubes(gap + 1e-6, "t"), ["building_id", "gx", "gy", "gz"]).where("s.id < t.id")
    for k in "xyz":  # boxes that come so near are tested in the first cube that they share, and there alone
        met = met.where((F.col(f"g{k}") == F.greatest(f"s{k}", f"t{k}")) & (low("s", k) - high("t", k) <= gap + 1e-6) & (low("t", k) - high("s", k) <= gap + 1e-6))
    met = met.where(~((F.col("s.terrain") == "open") & (F.col("t.terrain") == "open") & ~F.col("s.space_id").eqNullSafe(F.col("t.space_id"))))
    # exploded, the closest points are worked out once, and not within the join for every pair of a cube
    closest = F.array(g.closest_of_segments(F.col("s.p"), F.col("s.q"), F.col("t.p"), F.col("t.q")))
    near = met.select("building_id", "s", "t", F.explode(F.filter(closest, lambda c: (F.abs(c["one"]["z"] - c["two"]["z"]) <= rise) & (g.distance(c["one"], c["two"]) <= gap))).alias("c"))
    near = near.select("building_id", F.col("s.id").alias("a"), F.col("t.id").alias("b"), F.struct("s.side", F.col("t.side").alias("other"), "s.p", "s.q", "c").alias("x")).join(links.select("building_id", "a", "b"), ["building_id", "a", "b"], "left_anti")
    first = near.groupBy("building_id", "a", "b").agg(F.min(F.struct("x.side", "x.other", "x.p", "x.q", "x.c")).alias("x"))
    long = g.distance(F.col("x.p"), F.col("x.q"))
    first = first.withColumns({"long": long, "half": F.least(0.25 * long, F.lit(0.1))})
    end = lambda sign: g.vec(*[(F.col(f"x.c.one.{k}") + F.col(f"x.c.two.{k}")) / 2 + sign * F.when(F.col("long") > 1e-9, (F.col(f"x.q.{k}") - F.col(f"x.p.{k}")) / F.col("long") * F.col("half")).otherwise(0.0) for k in "xyz"])
    return first.select("building_id", "a", "b", F.lit(None).cast("string").alias("portal_id"), end(-1).alias("p"), end(1).alias("q"))


def door_links(doors: DataFrame, cells: DataFrame, links: DataFrame, radius: float = 2.5, size: float = 2.5, first: int = 3) -> DataFrame:
    """Links of doors (building_id, id, x, y, z, from_space_id, to_space_id, level_id, width_m): each door gets one pair of triangles of its two spaces, each pair one door.

    Pairs are ranked by the sum of both distances, then the larger one, then the ids; triangles within the radius on the
    door's level count, those of other levels only where that level has none at all. Of doors that want one pair, the
    one of the smallest id gets it, and the others take their next. Doors propose in rounds until nobody is refused;
    that gives what asking the doors one by one in order would. Pairs that a link of another portal holds are taken, so
    running it again on its own links changes nothing. Doors without sides or without a pair give no row.

    A door first looks at the `first` nearest triangles of each side, and doubles that only when it is refused all
    pairs of which it is certain, so that doors on fine meshes don't make all their pairs.
    """
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("space_id")) for n, c in enumerate(("from_space_id", "to_space_id"))])
    wanted = doors.where("from_space_id is not null and to_space_id is not null and from_space_id <> to_space_id")
    asks = wanted.select("building_id", F.col("id").alias("door"), g.vec("x", "y", "z").alias("at"), "level_id", F.explode(sides).alias("s")).select("building_id", "door", "at", "level_id", "s.*")
    # a space without a triangle on the door's level is taken as a whole
    levels = cells.select("building_id", "space_id", "level_id").distinct()
    fits = F.col("level_id").isNull() | F.col("cell_level").isNull() | (F.col("level_id") == F.col("cell_level"))
    on_level = asks.join(levels.withColumnRenamed("level_id", "cell_level"), ["building_id", "space_id"]).groupBy("building_id", "door", "side").agg(F.max(F.coalesce(fits, F.lit(False))).alias("exact"))
    grid = lambda k: F.sequence(F.floor((F.least(*[f"{k}{i}" for i in (1, 2, 3)]) - radius) / size), F.floor((F.greatest(*[f"{k}{i}" for i in (1, 2, 3)]) + radius) / size))
    spread = cells.withColumn("gx", F.explode(grid("x"))).withColumn("gy", F.explode(grid("y"))).withColumnsRenamed({"id": "cell", "level_id": "cell_level"})
    at = asks.join(on_level, ["building_id", "door", "side"]).withColumns({"gx": F.floor(F.col("at.x") / size), "gy": F.floor(F.col("at.y") / size)})
    met = at.join(spread, ["building_id", "space_id", "gx", "gy"]).where(~F.col("exact") | fits)
    met = met.select("building_id", "door", "side", "cell", centre().alias("c"), "at", g.closest_on_triangle(F.col("at"), *corners()).alias("foot")).withColumn("d", F.round(g.distance(F.col("at"), F.col("foot")), 9))
    order = Window.partitionBy("building_id", "door", "side").orderBy("d", "cell")
    ranked = settle(met.where(F.col("d") <= radius).select("*", F.row_number().over(order).alias("rank"), F.lead("d").over(order).alias("next")))
    n = ranked.groupBy("building_id", "door").agg(F.max("rank").alias("n"), F.max(F.when(F.col("side") == 0, 1)).alias("l"), F.max(F.when(F.col("side") == 1, 1)).alias("r"))
    state = settle(n.where("l = 1 and r = 1").select("building_id", "door", "n", F.lit(first).alias("k")))
    held = links.where("portal_id is not null").select("building_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "portal_id")
    # what others hold already is refused from the start
    refused = settle(state.select("building_id", "door").join(held, "building_id").where("door <> portal_id").select("building_id", "door", "a", "b")) if not held.isEmpty() else settle(state.select("building_id", "door", F.lit(None).cast(dict(cells.dtypes)["id"]).alias("a"), F.lit(None).cast(dict(cells.dtypes)["id"]).alias("b")).limit(0))
    while True:
        own = ranked.join(state, ["building_id", "door"]).where("rank <= k")
        edge = F.max(F.when(F.col("rank") == F.col("k"), F.col("next"))).over(Window.partitionBy("building_id", "door", "side"))
        low = F.min("d").over(Window.partitionBy("building_id", "door", "side"))
        own = own.withColumns({"edge": edge, "low": low})
        side = lambda i: own.where(F.col("side") == i).select("building_id", "door", "k", "n", F.struct("d", "cell", "c", "foot", "edge", "low").alias(f"s{i}"))
        pairs = side(0).join(side(1).drop("k", "n"), ["building_id", "door"]).where("s0.cell <> s1.cell")
        total = F.round(F.col("s0.d") + F.col("s1.d"), 9)
        far = float("inf")
        beyond = F.least(F.coalesce(F.col("s0.edge"), F.lit(far)) + F.col("s1.low"), F.coalesce(F.col("s1.edge"), F.lit(far)) + F.col("s0.low"))
        pairs = pairs.select("building_id", "door", F.struct(total.alias("total"), F.greatest("s0.d", "s1.d").alias("most"), F.col("s0.cell").alias("one"), F.col("s1.cell").alias("two"), F.col("s0.c").alias("c0"), F.col("s1.c").alias("c1"), F.col("s0.foot").alias("f0"), F.col("s1.foot").alias("f1")).alias("pair"), F.least("s0.cell", "s1.cell").alias("a"), F.greatest("s0.cell", "s1.cell").alias("b"), (total < F.round(beyond, 9)).alias("sure"))
        free = pairs.where("sure").join(refused, ["building_id", "door", "a", "b"], "left_anti")
        best = settle(free.groupBy("building_id", "door").agg(F.min(F.struct("pair", "a", "b")).alias("x")).select("building_id", "door", "x.pair", "x.a", "x.b"))
        winner = best.groupBy("building_id", "a", "b").agg(F.min("door").alias("winner"))
        lost = settle(best.join(winner, ["building_id", "a", "b"]).where("door <> winner").select("building_id", "door", "a", "b"))
        more = settle(state.join(best, ["building_id", "door"], "left_anti").where("k < n").select("building_id", "door", "n", (F.col("k") * 2).alias("k")))
        if lost.isEmpty() and more.isEmpty():
            break
        refused = settle(refused.unionByName(lost), refused)
        state = settle(state.join(more.select("building_id", "door"), ["building_id", "door"], "left_anti").unionByName(more), state)
    at = doors.select("building_id", F.col("id").alias("door"), g.vec("x", "y", "z").alias("at"), "width_m")
    return best.join(at, ["building_id", "door"]).select("building_id", "a", "b", F.col("door").alias("portal_id"), *_doorway())


def _doorway() -> list[Column]:
    """p and q of a door at `at` between the triangles of `pair`: across the way from the one centroid to the other, as wide as the door and 20 cm at least (90 where that is unknown)."""
    dx, dy = F.col("pair.c1.x") - F.col("pair.c0.x"), F.col("pair.c1.y") - F.col("pair.c0.y")
    long = F.sqrt(dx * dx + dy * dy)
    flat = long <= 1e-9
    tx, ty = F.when(flat, 0.0).otherwise(-dy / long), F.when(flat, 1.0).otherwise(dx / long)
    half = F.greatest(F.lit(0.2), F.coalesce(F.nullif("width_m", F.lit(0.0)), F.lit(0.9))) / 2
    mid = [(F.col(f"pair.f0.{k}") + F.col(f"pair.f1.{k}") + 2 * F.col(f"at.{k}")) / 4 for k in "xy"]
    z = (F.col("pair.f0.z") + F.col("pair.f1.z")) / 2
    return [g.vec(mid[0] + sign * tx * half, mid[1] + sign * ty * half, z).alias(n) for n, sign in (("p", -1), ("q", 1))]


def near_points(left: DataFrame, right: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Pairs (keys, left_id, right_id, d) of points (keys, id, x, y, z) at most `radius` apart in space; the right ones are copied to the cubes around theirs."""
    cube = lambda k: F.floor(F.col(k) / radius)
    around = lambda k: F.explode(F.sequence(cube(k) - 1, cube(k) + 1))
    a = left.select(*keys, F.col("id").alias("left_id"), g.vec("x", "y", "z").alias("p"), *[cube(k).alias(f"g{k}") for k in "xyz"])
    b = right.select(*keys, F.col("id").alias("right_id"), "x", "y", "z").withColumn("gx", around("x")).withColumn("gy", around("y")).withColumn("gz", around("z"))
    met = a.join(b, [*keys, "gx", "gy", "gz"])
    return met.select(*keys, "left_id", "right_id", F.round(g.distance(F.col("p"), g.vec("x", "y", "z")), 9).alias("d")).where(F.col("d") <= radius)


def _met(points: DataFrame, cells: DataFrame, keys: list[str], radius: float, size: float) -> DataFrame:
    """Points (keys, id, x, y, z) with the triangles whose box, widened by the radius, touches their square of a grid; corners and centre of the triangle, `flat`, and whether it holds the point in the plane."""
    low = lambda k: F.floor((F.least(*[f"{k}{i}" for i in (1, 2, 3)]) - radius) / size)
    high = lambda k: F.floor((F.greatest(*[f"{k}{i}" for i in (1, 2, 3)]) + radius) / size)
    spread = cells.select(*keys, F.col("id").alias("cell_id"), *([] if "space_id" in keys else ["space_id"]), *[f"{k}{i}" for i in (1, 2, 3) for k in "xyz"])
    spread = spread.withColumn("gx", F.explode(F.sequence(low("x"), high("x")))).withColumn("gy", F.explode(F.sequence(low("y"), high("y"))))
    at = points.where("x is not null and y is not null and z is not null").select(*keys, F.col("id").alias("point_id"), g.vec("x", "y", "z").alias("at"), F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy"))
    return at.join(spread, [*keys, "gx", "gy"]).withColumn("inside", g.in_triangle_xy(F.col("at"), *corners()))


def located(points: DataFrame, cells: DataFrame, tolerance: float | None = 0.75, keys: tuple[str, ...] = ("building_id",)) -> DataFrame:
    """(keys, point_id, cell_id, space_id, z), space_id once: the triangle that holds each point in the plane and is nearest to it in height, within the tolerance; ties go to the smaller id. Points with a null coordinate lie nowhere."""
    k = list(keys)
    met = _met(points, cells, k, 0.0, 2.0).where("inside").select(*k, "point_id", F.struct(F.round(F.abs(mean_z() - F.col("at.z")), 9).alias("off"), "cell_id", "space_id", mean_z().alias("z")).alias("x"))
    best = met.groupBy(*k, "point_id").agg(F.min("x").alias("x"))
    if tolerance is not None:
        best = best.where(F.col("x.off") <= tolerance)
    return best.select(*k, "point_id", "x.cell_id", *([] if "space_id" in k else ["x.space_id"]), "x.z")


def snapped(points: DataFrame, cells: DataFrame, radius: float = 3.0, size: float = 3.0) -> DataFrame:
    """(building_id, space_id, point_id, cell_id, at, distance_m): each point (building_id, space_id, id, x, y, z) on the surface of its space.

    Of the triangles that hold it in the plane, the one nearest in height takes the point at its own height, if that is
    within the radius; else the nearest side of a triangle does, at that triangle's height. Points without either give
    no row; ties go to the smaller id.
    """
    keys = ["building_id", "space_id"]
    met = _met(points, cells, keys, radius, size)
    c, z = corners(), mean_z()
    level = lambda p: g.vec(p["x"], p["y"], z)
    on = [level(g.closest_on_segment_xy(F.col("at"), c[i], c[(i + 1) % 3])) for i in range(3)]
    ways = F.array(F.struct(F.lit(1).alias("outside"), F.round(g.distance(F.col("at"), on[0]), 9).alias("far"), F.lit(0).alias("n"), on[0].alias("p")), *[F.struct(F.lit(1).alias("outside"), F.round(g.distance(F.col("at"), on[i]), 9).alias("far"), F.lit(i).alias("n"), on[i].alias("p")) for i in (1, 2)])
    over = F.struct(F.lit(0).alias("outside"), F.round(F.abs(z - F.col("at.z")), 9).alias("far"), F.lit(0).alias("n"), level(F.col("at")).alias("p"))
    each = F.concat(F.when(F.col("inside"), F.array(over)).otherwise(F.array().cast("array<struct<outside:int,far:double,n:int,p:struct<x:double,y:double,z:double>>>")), ways)
    found = met.select(*keys, "point_id", "cell_id", F.explode(each).alias("w")).where(F.col("w.far") <= radius + 1e-9)
    best = found.groupBy(*keys, "point_id").agg(F.min(F.struct("w.outside", "w.far", "cell_id", "w.n", "w.p")).alias("x"))
    return best.select(*keys, "point_id", "x.cell_id", F.col("x.p").alias("at"), F.col("x.far").alias("distance_m"))


def nearest_cells(points: DataFrame, cells: DataFrame, radius: float = 2.0, keys: tuple[str, ...] = ("building_id",)) -> DataFrame:
    """(keys, point_id, cell_id, at, distance_m): the triangle nearest in space to each point, however far; ties go to the smaller id.

    The radius and with it the grid double for points that have met nothing within it. Points with a null coordinate and
    those of buildings without triangles give no row, so each remaining point ends once the radius spans the building.
    Points of one place search as one, and places are dealt over tasks: they are few bytes, but each is much work.
    """
    k, at = list(keys), ["x", "y", "z"]
    asked = points.where("x is not null and y is not null and z is not null").join(cells.select(*k).distinct(), k, "left_semi").select(*k, "id", *[(F.col(c) + 0.0).alias(c) for c in at])
    places = settle(asked.select(*k, *at).distinct().withColumn("id", F.monotonically_increasing_id()))
    dealt = lambda t: t.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    own = settle(cells.join(places.select(*k).distinct(), k, "left_semi"))
    todo, done = places, []
    while True:
        met = _met(dealt(todo), own, k, radius, 2 * radius)
        # a box that is farther away holds nothing near
        low, high = (g.vec(*[f(*[f"{c}{i}" for i in (1, 2, 3)]) for c in at]) for f in (F.least, F.greatest))
        met = met.where(g.box_distance(F.col("at"), low, high) <= radius + 1e-6)
        found = met.select(*k, "point_id", "at", "cell_id", g.closest_on_triangle(F.col("at"), *corners()).alias("foot"))
        found = found.select(*k, "point_id", F.struct(F.round(g.distance(F.col("at"), F.col("foot")), 9).alias("d"), "cell_id", "foot").alias("x")).where(F.col("x.d") <= radius)
        done.append(settle(found.groupBy(*k, "point_id").agg(F.min("x").alias("x")).select("point_id", "x.cell_id", F.col("x.foot").alias("at"), F.col("x.d").alias("distance_m"))))
        todo = settle(todo.join(done[-1].select(F.col("point_id").alias("id")), "id", "left_anti"))
        if todo.isEmpty():
            break
        radius *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    named = asked.withColumnRenamed("id", "point_id").join(places.join(out, F.col("id") == F.col("point_id")).drop("id", "point_id"), [*k, *at])
    return named.select(*k, "point_id", "cell_id", "at", "distance_m")


def corridor_arcs(links: DataFrame, cells: DataFrame, costs: DataFrame | None = None, flat: bool = False) -> DataFrame:
    """(building_id, a, b, cost, portal_id), both ways: the distance of the centroids (in the plane, if flat) times the cost of the terrain entered, which costs (terrain, cost) gives and is 1 at least."""
    c = cells.select("building_id", "id", "terrain", centre().alias("m"))
    met = both_ways(links).join(c.select("building_id", F.col("id").alias("a"), F.col("m").alias("ma")), ["building_id", "a"]).join(c.select("building_id", F.col("id").alias("b"), F.col("m").alias("mb"), "terrain"), ["building_id", "b"])
    long = (g.distance_xy if flat else g.distance)(F.col("ma"), F.col("mb"))
    if costs is not None:
        met = met.join(costs.select("terrain", F.col("cost").alias("factor")), "terrain", "left")
        long = long * F.greatest(F.lit(1.0), F.coalesce("factor", F.lit(1.0)))
    return met.select("building_id", "a", "b", F.round(long, 6).alias("cost"), "portal_id")


def corridors(pairs: DataFrame, arcs: DataFrame, keys: tuple[str, ...] = ("building_id",)) -> DataFrame:
    """(keys, source, goal, seq, a, b): the crossings, in rising order of seq, of the cheapest corridor of each pair of triangles (keys, source, goal); pairs of one triangle and those without a corridor give no row.

    All pairs of a source are one search, which ends at the farthest of them. Of corridors of equal cost the one whose
    triangles have the smaller ids from the goal back is taken.
    """
    k = list(keys)
    goals = settle(pairs.where("source <> goal").select(*k, "source", F.col("goal").alias("id")).distinct())
    sources = goals.select(*k, "source", F.col("source").alias("id"), F.lit(0.0).alias("cost")).distinct()
    best = graph.cheapest(sources, arcs, keys, goals)
    before = settle(graph.predecessors(best, arcs, keys))
    way = graph.ways(before, goals, keys)
    legs = way.join(before, [*k, "source", "id"]).select(*k, "source", "goal", (-F.col("back")).alias("seq"), F.col("before").alias("a"), F.col("id").alias("b"))
    return settle(legs, best, before, way, goals)


def _plane(c: list[Column]) -> Column:
    """struct<o, u, v>: a triangle's first corner and two unit vectors along its plane, the first one along its first side."""

    def frame(o: Column, along: Column, n: Column) -> Column:
        unit = lambda w: F.transform(F.array(w), lambda w: g.vec(w["x"] / g.norm(w), w["y"] / g.norm(w), w["z"] / g.norm(w)))[0]
        return g.bound(lambda o, u, n: F.struct(o.alias("o"), u.alias("u"), g.cross(n, u).alias("v")), o, unit(along), n)

    return g.bound(frame, c[0], g.minus(c[1], c[0]), g.unit_normal(*c))


def pulled_routes(legs: DataFrame, ends: DataFrame, cells: DataFrame, links: DataFrame, keys: tuple[str, ...], flat: bool = False, tolerance: float = 1e-3) -> DataFrame:
    """(keys, points, length_m): the shortest way through the crossings of each corridor.

    ends (keys, start, goal): the ends of each route; legs (keys, seq, a, b): its crossings in order; keys begin with
    building_id. A route without legs is a straight line. On a flat surface, in the plane of x and y, the way is pulled
    tight as a whole. Else the corridor is cut at its folds, which are the crossings between triangles that don't lie in
    one plane (to a millimetre): each run is pulled tight in its own plane, and at a fold the way goes through the
    point of each triangle that is nearest to the middle of the crossing, so it never leaves the surface. A run that
    comes back to a corner, around a pillar that touches another one, may be cut short through that corner.
    """
    k = list(keys)
    face = lambda end: cells.select("building_id", F.col("id").alias(end), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(corners())]).alias(f"f{end}"))
    met = legs.select(*k, "seq", "a", "b").join(both_ways(links).drop("portal_id"), ["building_id", "a", "b"]).join(face("a"), ["building_id", "a"]).join(face("b"), ["building_id", "b"])
    fa, fb = ([F.col(f"f{e}.c{i}") for i in range(3)] for e in "ab")
    bent = lambda *c: (g.area(*c[:3]) <= 5e-10) | (g.off_plane(*c) > tolerance)
    fold = F.lit(False) if flat else g.bound(bent, *fa, *fb)
    before = Window.partitionBy(*k).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("fold", fold).withColumn("run", F.coalesce(F.sum(F.col("fold").cast("int")).over(before), F.lit(0)).cast("int"))
    level = F.struct(g.vec(F.lit(0.0), F.lit(0.0)).alias("o"), g.vec(F.lit(1.0), F.lit(0.0)).alias("u"), g.vec(F.lit(0.0), F.lit(1.0)).alias("v"))
    met = settle(met.select(*k, "seq", "fold", "run", "p", "q", g.centroid(*fa).alias("ma"), g.centroid(*fb).alias("mb"), F.when(~F.col("fold"), level if flat else _plane(fa)).alias("plane"), *[(F.lit(None).cast(g.POINT) if flat else F.when(F.col("fold"), g.closest_on_triangle(g.centroid(F.col("p"), F.col("q")), *f))).alias(n) for n, f in (("out", fa), ("in", fb))]))
    point, item = g.POINT, dict(met.select(F.struct("seq", "p", "q", "ma", "mb", "plane").alias("i")).dtypes)["i"]
    row = lambda run, **given: [*k, run.cast("int").alias("run"), *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("start", point), ("stop", point), ("item", item))]]
    folds = met.where("fold")
    last = ends.join(folds.groupBy(*k).agg(F.count("*").alias("n")), k, "left")
    rows = ends.select(*row(F.lit(0), start=F.col("start"))).unionByName(last.select(*row(F.coalesce("n", F.lit(0)), stop=F.col("goal"))))
    rows = rows.unionByName(folds.select(*row(F.col("run"), stop=F.col("out")))).unionByName(folds.select(*row(F.col("run") + 1, start=F.col("in"))))
    rows = rows.unionByName(met.where("not fold").select(*row(F.col("run"), item=F.struct("seq", "p", "q", "ma", "mb", "plane"))))
    runs = rows.groupBy(*k, "run").agg(F.max("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list("item")).alias("items")).where("start is not null and stop is not null")

    def tight(start: Column, stop: Column, items: Column, plane: Column) -> Column:
        on = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), g.dot(g.minus(p, plane["o"]), plane["u"]).alias("u"), g.dot(g.minus(p, plane["o"]), plane["v"]).alias("v"))

        def portal(p: Column, q: Column, a: Column, b: Column) -> Column:
            left = funnel.turn(a, b, F.struct((a["u"] + p["u"] - q["u"]).alias("u"), (a["v"] + p["v"] - q["v"]).alias("v"))) >= 0
            return F.struct(F.when(left, p).otherwise(q).alias("l"), F.when(left, q).otherwise(p).alias("r"))

        portals = F.transform(items, lambda e: g.bound(portal, on(e["p"]), on(e["q"]), on(e["ma"]), on(e["mb"])))
        return F.transform(g.bound(funnel.pulled_through_points, on(start), portals, on(stop)), lambda p: g.vec(p["x"], p["y"], p["z"]))

    ways = runs.select(*k, "run", F.when(F.size("items") == 0, F.array("start", "stop")).otherwise(g.bound(tight, F.col("start"), F.col("stop"), F.col("items"), F.col("items")[0]["plane"])).alias("way"))
    whole = ways.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("run", "way"))).alias("ways"))
    points = g.without_repeats(F.flatten(F.transform("ways", lambda w: w["way"])))
    return whole.select(*k, points.alias("points")).withColumn("length_m", g.polyline_length(F.col("points")))
