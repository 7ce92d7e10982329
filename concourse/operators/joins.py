"""Spatial and temporal joins. Nearness is an equi-join on grid cells with an exact test after it, never a cross join."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .graph import settle


def _spread(size: float, radius: float) -> Column:
    reach = int(-(-radius // size))
    return F.sequence(F.lit(-reach), F.lit(reach))


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = ("building_id",)) -> DataFrame:
    """Pairs (keys, left_id, right_id, d) of points (keys, id, x, y, z) at most `radius` apart; the right side is copied to the cells around it."""
    grid = lambda c: F.floor(F.col(c) / radius)
    a = left.select(*keys, F.col("id").alias("left_id"), g.vec("x", "y", "z").alias("p"), grid("x").alias("gx"), grid("y").alias("gy"))
    b = right.select(*keys, F.col("id").alias("right_id"), g.vec("x", "y", "z").alias("q"), grid("x").alias("hx"), grid("y").alias("hy"))
    b = b.withColumn("i", F.explode(_spread(radius, radius))).withColumn("j", F.explode(_spread(radius, radius)))
    b = b.select(*keys, "right_id", "q", (F.col("hx") + F.col("i")).alias("gx"), (F.col("hy") + F.col("j")).alias("gy"))
    return a.join(b, [*keys, "gx", "gy"]).select(*keys, "left_id", "right_id", g.distance(F.col("p"), F.col("q")).alias("d")).where(F.col("d") <= radius)


def _places(points: DataFrame, most: int) -> DataFrame:
    """(building_id, x, y, z, kind, ids): places of points, each with its `most` smallest ids in order."""
    at = ["building_id", "x", "y", "z", "kind"]
    kept = points.withColumn("n", F.row_number().over(Window.partitionBy(*at).orderBy("id"))).where(F.col("n") <= most)
    return kept.groupBy(*at).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _halvings(places: DataFrame, radius: float, most: int = 20) -> int:
    """How often the radius is halved until a square of that width holds four places or fewer on average."""
    squares = [F.approx_count_distinct(F.struct("building_id", *[F.floor(F.col(c) / (radius / 2**i)) for c in "xy"])).alias(f"n{i}") for i in range(most + 1)]
    n = places.agg(F.count("*").alias("n"), *squares).first()
    return next((i for i in range(most + 1) if n["n"] <= 4 * n[f"n{i}"]), most)


def k_nearest(left: DataFrame, right: DataFrame, radius: float, k: int, apart: bool = False, kind: Column | None = None, allowed: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(building_id, left_id, right_id, d): the k nearest other right points (building_id, id, x, y, z) of each left one within the radius, ties by id.

    apart: points of one place (to 1e-9) aren't neighbours. allowed filters pairs by the kinds of the two points. Points
    of one place and kind search as one, and offer as many ids as can be asked for, so copies make no pairs. Places
    first search a radius at which they are few in a square; those that find enough are done, the others go on with
    twice the radius up to the asked one. So dense places don't make all their pairs, and no neighbour is lost.
    """
    most = k if apart else k + 1  # a point may meet itself
    kind = F.lit(0) if kind is None else kind
    label = lambda p: p.where("x is not null and y is not null and z is not null").select("building_id", "id", "x", "y", "z", kind.alias("kind"))
    at = ["building_id", "x", "y", "z", "kind"]
    spots = settle(_places(label(right), most))
    asked = settle(label(left).select(*at).distinct().withColumn("place", F.monotonically_increasing_id()))
    todo, done = asked, []
    for i in range(_halvings(spots, radius), -1, -1):
        near, r = F.lit(True), radius / 2**i
        a = todo.select("building_id", "place", g.vec("x", "y", "z").alias("p"), F.col("kind").alias("ka"), *[F.floor(F.col(c) / r).alias(f"g{c}") for c in "xy"])
        b = spots.select("building_id", "ids", g.vec("x", "y", "z").alias("q"), F.col("kind").alias("kb"), F.floor(F.col("x") / r).alias("hx"), F.floor(F.col("y") / r).alias("hy"))
        b = b.withColumn("i", F.explode(_spread(r, r))).withColumn("j", F.explode(_spread(r, r))).select("building_id", "ids", "q", "kb", (F.col("hx") + F.col("i")).alias("gx"), (F.col("hy") + F.col("j")).alias("gy"))
        if allowed is not None:
            near = near & allowed(F.col("ka"), F.col("kb"))
        met = a.join(b, ["building_id", "gx", "gy"]).where(near).select("place", "ids", g.distance(F.col("p"), F.col("q")).alias("d")).where(F.col("d") <= r)
        if apart:
            met = met.where("d > 1e-9")
        # each place offers an id at least, so the nearest `most` places hold the nearest `most` ids
        order = Window.partitionBy("place").orderBy("d", F.col("ids")[0])
        best = met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
        found = best.groupBy("place").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct(F.col("d"), x.alias("id")))))), 1, most).alias("near"))
        done.append(settle(found if i == 0 else found.where(F.size("near") >= most)))
        if i:
            todo = settle(todo.join(done[-1].select("place"), "place", "left_anti"))
            if todo.isEmpty():
                break
    near = reduce(DataFrame.unionByName, done)
    own = label(left).join(asked, at).join(near, "place")
    others = F.slice(F.filter("near", lambda x: F.lit(True) if apart else x["id"] != F.col("id")), 1, k)
    return own.select("building_id", F.col("id").alias("left_id"), F.explode(others).alias("x")).select("building_id", "left_id", F.col("x.id").alias("right_id"), "x.d")


def radius_edges(points: DataFrame, radius: float, k: int, allowed: Callable[[Column, Column], Column] | None = None, kind: Column | None = None) -> DataFrame:
    """(building_id, a, b, d): each point's k nearest others within the radius, joined from both sides; `allowed` filters pairs before they are ranked, by their ids or, if given, by their kinds."""
    best = k_nearest(points, points, radius, k, True, F.col("id") if kind is None and allowed is not None else kind, allowed)
    return best.groupBy("building_id", F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).agg(F.min("d").alias("d"))


def nearest(left: DataFrame, right: DataFrame, radius: float, k: int = 1) -> DataFrame:
    """(building_id, left_id, right_id, d, rank): the k nearest of the right points within the radius; ties by id."""
    order = Window.partitionBy("building_id", "left_id").orderBy("d", "right_id")
    return near_pairs(left, right, radius).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def triangle_sides(cells: DataFrame) -> DataFrame:
    """A row for each side of each triangle: the cell's columns and the key of the side."""
    c = [g.vec(f"x{i}", f"y{i}") for i in (1, 2, 3)]
    keys = F.array(*[g.edge_key(c[i], c[(i + 1) % 3]) for i in range(3)])
    return cells.select("building_id", "id", "space_id", "terrain", F.explode(keys).alias("key"))


def shared_sides(cells: DataFrame) -> DataFrame:
    """(building_id, a, b) of triangles that share a side of exactly two owners; open cells of different spaces do not link."""
    sides = triangle_sides(cells)
    owner = F.struct("id", "space_id", "terrain")
    two = sides.groupBy("building_id", "key").agg(F.count("*").alias("n"), F.min(owner).alias("a"), F.max(owner).alias("b")).where("n = 2")
    barred = (F.col("a.space_id") != F.col("b.space_id")) & (F.col("a.terrain") == "open") & (F.col("b.terrain") == "open")
    return two.where(~barred).select("building_id", F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def boundary_sides(cells: DataFrame) -> DataFrame:
    """Sides of one owner."""
    sides = triangle_sides(cells)
    return sides.groupBy("building_id", "key").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("building_id", "key", "id")


def of_buildings(cells: DataFrame, points: DataFrame) -> DataFrame:
    """The cells of buildings that hold points: others meet none, and would be dealt to squares for nothing."""
    return cells.join(points.select("building_id").distinct(), "building_id", "left_semi")


def locate(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(building_id, point_id, cell_id): the triangle with the least id that holds each point; triangles are met by the unit squares that they touch."""
    lo = lambda k: F.floor(F.least(f"{k}1", f"{k}2", f"{k}3"))
    hi = lambda k: F.floor(F.greatest(f"{k}1", f"{k}2", f"{k}3"))
    c = of_buildings(cells, points).withColumn("gx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("gy", F.explode(F.sequence(lo("y"), hi("y"))))
    c = c.select("building_id", F.col("id").alias("cell_id"), *[g.vec(f"x{i}", f"y{i}").alias(f"c{i}") for i in (1, 2, 3)], "gx", "gy")
    p = points.select("building_id", F.col("id").alias("point_id"), g.vec("x", "y").alias("p"), F.floor("x").alias("gx"), F.floor("y").alias("gy"))
    met = p.join(c, ["building_id", "gx", "gy"]).where(g.in_triangle_xy(F.col("p"), F.col("c1"), F.col("c2"), F.col("c3")))
    return met.groupBy("building_id", "point_id").agg(F.min("cell_id").alias("cell_id"))


def as_of(frames: DataFrame, times: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Value of each key at each asked time (keys, t): between the frames around it, held after the last; no row before the first.

    Frames and times are one ordered stream per key, so the join is a single sort and no pair is made.
    """
    k = list(keys)
    lead = Window.partitionBy(*k).orderBy("time_s", "frame_no")
    f = frames.select(*k, "time_s", "frame_no", F.col(value).alias("v0"), F.lead("time_s").over(lead).alias("t1"), F.lead(value).over(lead).alias("v1"))
    both = f.select(*k, F.col("time_s").alias("at"), F.lit(0).alias("side"), "frame_no", F.struct("time_s", "v0", "t1", "v1").alias("f")).unionByName(
        times.select(*k, F.col("t").alias("at"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("frame_no"), F.lit(None).cast("struct<time_s:double,v0:double,t1:double,v1:double>").alias("f"))
    )
    upto = Window.partitionBy(*k).orderBy("at", "side", "frame_no").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("f", F.last("f", ignorenulls=True).over(upto)).where("side = 1 and f is not null")
    share = (F.col("at") - F.col("f.time_s")) / (F.col("f.t1") - F.col("f.time_s"))
    out = F.when(F.col("f.t1").isNull() | (F.col("f.t1") <= F.col("f.time_s")), F.col("f.v0")).otherwise(F.col("f.v0") + share * (F.col("f.v1") - F.col("f.v0")))
    return met.select(*k, F.col("at").alias("t"), out.alias("value"))


def segments_crossing(segments: DataFrame, boxes: DataFrame, cell: float = 2.0, least: float = 0.02) -> DataFrame:
    """(building_id, segment_id, box_id, overlap_m) of segments (x1 y1 x2 y2) whose part inside a box (lx ly hx hy) is longer than `least`; met on grid cells, cut by the four sides."""
    cells_of = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    s = segments.withColumn("gx", F.explode(cells_of(F.least("x1", "x2"), F.greatest("x1", "x2")))).withColumn("gy", F.explode(cells_of(F.least("y1", "y2"), F.greatest("y1", "y2"))))
    b = boxes.withColumn("gx", F.explode(cells_of(F.col("lx"), F.col("hx")))).withColumn("gy", F.explode(cells_of(F.col("ly"), F.col("hy"))))
    met = s.join(b, ["building_id", "gx", "gy"]).dropDuplicates(["building_id", "segment_id", "box_id"])

    def window(k: str) -> tuple[Column, Column, Column]:
        """Entry and exit share of the segment in one axis, and whether it can enter at all."""
        d = F.col(f"{k}2") - F.col(f"{k}1")
        t0, t1 = (F.col(f"l{k}") - F.col(f"{k}1")) / d, (F.col(f"h{k}") - F.col(f"{k}1")) / d
        flat = F.abs(d) < 1e-12
        return F.when(flat, 0.0).otherwise(F.least(t0, t1)), F.when(flat, 1.0).otherwise(F.greatest(t0, t1)), ~flat | F.col(f"{k}1").between(F.col(f"l{k}"), F.col(f"h{k}"))

    (ax, bx, okx), (ay, by, oky) = window("x"), window("y")
    inside = F.greatest(F.lit(0.0), F.least(bx, by, F.lit(1.0)) - F.greatest(ax, ay, F.lit(0.0)))
    size = g.distance_xy(g.vec("x1", "y1"), g.vec("x2", "y2"))
    return met.where(okx & oky).select("building_id", "segment_id", "box_id", (inside * size).alias("overlap_m")).where(F.col("overlap_m") > least)


def radius_nearest(left: DataFrame, right: DataFrame, radius: float, k: int) -> DataFrame:
    """(building_id, point_id, near_id, d): the k nearest other points within the radius."""
    best = k_nearest(left, right, radius, k)
    return best.select("building_id", F.col("left_id").alias("point_id"), F.col("right_id").alias("near_id"), "d")


def nearest_owners(left: DataFrame, right: DataFrame, k: int, radius: float) -> DataFrame:
    """(building_id, left_id, owner, d, rank): the k nearest owners of right points (building_id, id, owner, x, y, z) of each left point, however far.

    The radius doubles for points that have met fewer than k owners; those whose building has no more owners to offer
    are done too, so the last rounds end once a radius spans everything.
    """
    owners = right.groupBy("building_id").agg(F.least(F.countDistinct("owner"), F.lit(k)).alias("wanted"))
    todo, done = settle(left.join(owners, "building_id").select("building_id", "id", "x", "y", "z", "wanted")), None
    names = right.select("building_id", F.col("id").alias("right_id"), "owner")
    order = Window.partitionBy("building_id", "left_id").orderBy("d", "owner")
    while not todo.isEmpty():
        met = near_pairs(todo, right, radius).join(names, ["building_id", "right_id"]).groupBy("building_id", "left_id", "owner").agg(F.min("d").alias("d"))
        ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        full = ranked.join(todo.select("building_id", F.col("id").alias("left_id"), "wanted"), ["building_id", "left_id"])
        full = settle(full.withColumn("n", F.count("*").over(Window.partitionBy("building_id", "left_id"))).where("n = wanted").select("building_id", "left_id", "owner", "d", "rank"))
        done = full if done is None else done.unionByName(full)
        todo = settle(todo.join(full.select("building_id", F.col("left_id").alias("id")).distinct(), ["building_id", "id"], "left_anti"))
        radius *= 2
    return done if done is not None else near_pairs(left, right, radius).select("building_id", "left_id", F.col("right_id").alias("owner"), "d", F.lit(0).alias("rank")).limit(0)


def snap(points: DataFrame, cells: DataFrame, radius: float, size: float = 4.0) -> DataFrame:
    """(building_id, point_id, x, y, cell_id, distance_m): each point (building_id, id, space_id, x, y, z) on the surface of its space.

    Cells lie at z = 0. A cell that contains the point takes it at the cell's height if that is within the radius; else
    the nearest side of a cell within the radius does; points that find neither give no row. Points meet only cells
    whose box, widened by the radius, touches their square of a grid. Ties go to the smaller cell id.
    """
    low = lambda k: F.floor((F.least(f"{k}1", f"{k}2", f"{k}3") - radius) / size)
    high = lambda k: F.floor((F.greatest(f"{k}1", f"{k}2", f"{k}3") + radius) / size)
    spread = of_buildings(cells, points).withColumn("gx", F.explode(F.sequence(low("x"), high("x")))).withColumn("gy", F.explode(F.sequence(low("y"), high("y")))).withColumnRenamed("id", "cell_id")
    at = points.select("building_id", "space_id", F.col("id").alias("point_id"), "x", "y", "z", F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy"))
    p, corner = g.vec("x", "y"), [g.vec(f"x{i}", f"y{i}") for i in (1, 2, 3)]
    near = F.array_min(F.array(*[F.struct(F.round(g.distance_xy(p, c), 9).alias("far"), F.lit(i).alias("i"), c["x"].alias("x"), c["y"].alias("y")) for i, c in enumerate(g.closest_on_segment_xy(p, corner[i], corner[(i + 1) % 3]) for i in range(3))]))
    within = g.in_triangle_xy(p, *corner) & (F.abs("z") <= radius + 1e-9)
    met = at.join(spread, ["building_id", "space_id", "gx", "gy"]).select("building_id", "point_id", "cell_id", "x", "y", "z", within.alias("within"), near.alias("near"))
    away = F.when(F.col("within"), F.abs("z")).otherwise(F.round(F.sqrt(F.col("near.far") ** 2 + F.col("z") ** 2), 9))
    met = met.select("building_id", "point_id", F.struct((~F.col("within")).alias("outside"), away.alias("distance_m"), "cell_id", F.when(F.col("within"), F.col("x")).otherwise(F.col("near.x")).alias("x"), F.when(F.col("within"), F.col("y")).otherwise(F.col("near.y")).alias("y")).alias("best"))
    best = met.groupBy("building_id", "point_id").agg(F.min("best").alias("best")).where(F.col("best.distance_m") <= radius + 1e-9)
    return best.select("building_id", "point_id", "best.x", "best.y", "best.cell_id", "best.distance_m")


def closest_cells(points: DataFrame, cells: DataFrame, radius: float = 2.0) -> DataFrame:
    """(building_id, point_id, x, y, cell_id, distance_m): the cell nearest to each point of any space, however far; points of buildings without cells and points with a null coordinate give no row.

    The radius doubles, and with it the squares of the grid, for points that have met no cell yet.
    """
    all_ = cells.withColumn("space_id", F.lit(""))
    held = points.where("x is not null and y is not null and z is not null").join(cells.select("building_id").distinct(), "building_id", "left_semi")
    todo, done = settle(held.select("building_id", "id", F.lit("").alias("space_id"), "x", "y", "z")), None
    none = snap(todo, all_, radius)
    while not todo.isEmpty():
        found = settle(snap(todo, all_, radius, 2 * radius))
        done = found if done is None else done.unionByName(found)
        todo = settle(todo.join(found.select("building_id", F.col("point_id").alias("id")), ["building_id", "id"], "left_anti"))
        radius *= 2
    return done if done is not None else none


def attached(doors: DataFrame, nodes: DataFrame, radius: float = 2.5, k: int = 3, fallback: int = 6) -> DataFrame:
    """(building_id, point_id, near_id, d): nodes to which each door (building_id, id, x, y, z, spaces) is attached: the k nearest of each space that it connects within the radius; a door without any takes the nearest `fallback` nodes (building_id, id, x, y, z, space_id) of its building, however far."""
    space = nodes.select("building_id", F.col("id").alias("right_id"), "space_id")
    open_to = doors.select("building_id", F.col("id").alias("left_id"), F.explode(F.array_distinct("spaces")).alias("space_id"))
    pairs = near_pairs(doors, nodes, radius).join(space, ["building_id", "right_id"]).join(open_to, ["building_id", "left_id", "space_id"], "left_semi")
    order = Window.partitionBy("building_id", "left_id", "space_id").orderBy("d", "right_id")
    near = settle(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("building_id", F.col("left_id").alias("point_id"), F.col("right_id").alias("near_id"), "d"))
    lone = doors.join(near.select("building_id", F.col("point_id").alias("id")).distinct(), ["building_id", "id"], "left_anti")
    far = nearest_owners(lone, nodes.withColumn("owner", F.col("id")), fallback, radius)
    return near.unionByName(far.select("building_id", F.col("left_id").alias("point_id"), F.col("owner").alias("near_id"), "d"))


def transfer_anchors(transfers: DataFrame, cells: DataFrame, radius: float = 3.0) -> DataFrame:
    """(building_id, id, from_cell, to_cell, points, length_m): transfers (building_id, id, x, y, z, from_space_id, to_space_id) through a portal at x, y, z, anchored on the surfaces of both spaces.

    The points lead from the one anchor over the portal to the other, without repeats. A transfer that finds no surface
    within the radius on either side gives no row.
    """
    at = transfers.select("building_id", "id", "x", "y", "z", F.explode(F.array(*[F.struct(F.lit(end).alias("end"), F.col(f"{end}_space_id").alias("space_id")) for end in ("from", "to")])).alias("s"))
    found = snap(at.select("building_id", F.struct("id", "s.end").alias("id"), "s.space_id", "x", "y", "z"), cells, radius)
    side = lambda end: found.where(F.col("point_id.end") == end).select("building_id", F.col("point_id.id").alias("id"), F.col("cell_id").alias(f"{end}_cell"), g.vec("x", "y").alias(f"{end}_p"))
    met = transfers.join(side("from"), ["building_id", "id"]).join(side("to"), ["building_id", "id"])
    points = g.without_repeats(F.array("from_p", g.vec("x", "y", "z"), "to_p"))
    return met.select("building_id", "id", "from_cell", "to_cell", points.alias("points"), g.polyline_length(F.array("from_p", g.vec("x", "y", "z"), "to_p")).alias("length_m"))


def side_middles(cells: DataFrame) -> DataFrame:
    """(building_id, a, b, m): the middle of the side that two triangles share, both ways; of several sides the one of least key."""
    c = [g.vec(f"x{i}", f"y{i}") for i in (1, 2, 3)]
    ends = [(c[i], c[(i + 1) % 3]) for i in range(3)]
    sides = cells.select("building_id", "id", F.explode(F.array(*[F.struct(g.edge_key(p, q).alias("key"), g.vec((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2).alias("m")) for p, q in ends])).alias("s"))
    two = sides.groupBy("building_id", "s.key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.first("s.m").alias("m")).where("n = 2 and a <> b")
    one = two.groupBy("building_id", "a", "b").agg(F.min_by("m", "key").alias("m"))
    return one.unionByName(one.select("building_id", F.col("b").alias("a"), F.col("a").alias("b"), "m"))


def open_boundaries(cells: DataFrame, known: DataFrame, tolerance: float = 0.02, least: float = 0.2, size: float = 2.0) -> DataFrame:
    """(building_id, id, space_a, space_b, a, b, width_m, gap_m): where two spaces lie open to each other without a portal.

    Sides that one triangle of a space owns alone meet sides of other spaces that run beside them, at most `tolerance`
    away at both ends, along at least `least` metres. Each pair of spaces keeps its widest such place (then the smallest
    gap, then the ids); pairs in known (building_id, space_a, space_b), smaller name first, have a portal and go. Sides
    meet in the strips of a grid that they touch, long along x for flat sides and along y for steep ones; walls are not
    looked for.
    """
    c = [g.vec(f"x{i}", f"y{i}") for i in (1, 2, 3)]
    sides = F.array(*[F.struct(g.edge_key(c[i], c[(i + 1) % 3]).alias("key"), c[i].alias("p"), c[(i + 1) % 3].alias("q")) for i in range(3)])
    own = cells.select("building_id", "space_id", "id", F.explode(sides).alias("s")).groupBy("building_id", "space_id", "s.key").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "s.p", "s.q"), "id").alias("s")).where("n = 1")
    pad = tolerance + 1e-6
    # sides that run beside each other that far turn by an angle of this tangent at most; so one that is flatter than 45 degrees meets sides up to `steepest`
    turn = 2 * pad / (least - 1e-6) if least > 1e-6 else math.inf
    steepest = (1 + turn) / (1 - turn) * (1 + 1e-9) if turn < 1 else math.inf
    lines = own.select("building_id", "space_id", "s.id", *[F.col(f"s.{e}.{k}").alias(f"{e}{k}") for e in "pq" for k in "xy"])
    lines = lines.withColumns({f"{n}{k}": f(f"p{k}", f"q{k}") for n, f in (("l", F.least), ("h", F.greatest)) for k in "xy"})
    across, up = (F.abs(F.col(f"q{k}") - F.col(f"p{k}")) for k in "xy")
    within = lambda a, b: F.lit(True) if steepest == math.inf else a <= steepest * b

    def strips(lines: DataFrame, flat: Column, r: float, name: str) -> DataFrame:
        # the grid is shifted by half a strip, as sides on whole metres would touch twice as many; the first strip of each axis is kept
        out = lines.withColumn("flat", F.explode(flat))
        for k, width in (("x", F.when(F.col("flat"), size).otherwise(size / 8)), ("y", F.when(F.col("flat"), size / 8).otherwise(size))):
            at = lambda c: F.floor(c / width + 0.5)  # noqa: B023, E731
            out = out.withColumn(f"f{k}", at(F.col(f"l{k}") - r)).withColumn(f"g{k}", F.explode(F.sequence(F.col(f"f{k}"), at(F.col(f"h{k}") + r))))
        met_by = ("building_id", "flat", "gx", "gy")
        return out.select(*met_by, *[F.col(c).alias(f"{name}_{c}") for c in out.columns if c not in met_by])

    # what the test needs of the first side is worked out before the join, so that what is left for each pair is little
    long = F.sqrt((F.col("qx") - F.col("px")) ** 2 + (F.col("qy") - F.col("py")) ** 2)
    first = lines.withColumn("long", long).where("long > 0").withColumns({f"u{k}": (F.col(f"q{k}") - F.col(f"p{k}")) / F.col("long") for k in "xy"})
    one = strips(first, F.array(up <= across), 0.0, "a")
    two = strips(lines, F.filter(F.array(F.when(within(up, across), True), F.when(within(across, up), False)), lambda f: f.isNotNull()), pad, "b")
    pairs = one.join(two, ["building_id", "flat", "gx", "gy"])
    for k in "xy":  # boxes that come so near are tested in the first strip that they share, and there alone
        pairs = pairs.where((F.col(f"g{k}") == F.greatest(f"a_f{k}", f"b_f{k}")) & (F.col(f"a_l{k}") - F.col(f"b_h{k}") <= pad) & (F.col(f"b_l{k}") - F.col(f"a_h{k}") <= pad))
    pairs = pairs.where("a_space_id < b_space_id")
    along = lambda e: (F.col(f"b_{e}x") - F.col("a_px")) * F.col("a_ux") + (F.col(f"b_{e}y") - F.col("a_py")) * F.col("a_uy")
    off = lambda e: F.abs((F.col(f"b_{e}y") - F.col("a_py")) * F.col("a_ux") - (F.col(f"b_{e}x") - F.col("a_px")) * F.col("a_uy"))
    width = F.least(F.col("a_long"), F.greatest(along("p"), along("q"))) - F.greatest(F.lit(0.0), F.least(along("p"), along("q")))
    found = pairs.select("building_id", F.col("a_space_id").alias("space_a"), F.col("b_space_id").alias("space_b"), F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(width, 6).alias("width_m"), F.round(F.greatest(off("p"), off("q")), 6).alias("gap_m"))
    found = found.where((F.col("gap_m") <= tolerance) & (F.col("width_m") >= least)).join(known.select("building_id", "space_a", "space_b").distinct(), ["building_id", "space_a", "space_b"], "left_anti")
    best = found.groupBy("building_id", "space_a", "space_b").agg(F.min(F.struct((-F.col("width_m")).alias("w"), "gap_m", "a", "b")).alias("x"))
    name = F.concat(F.lit("open:"), F.substring(F.sha1(F.concat_ws("|", "building_id", "space_a", "space_b", "x.a", "x.b")), 1, 16))
    return best.select("building_id", name.alias("id"), "space_a", "space_b", "x.a", "x.b", (-F.col("x.w")).alias("width_m"), "x.gap_m")
