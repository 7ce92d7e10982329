"""Geometry as column expressions over struct<x, y, z> columns; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
POINT = "struct<x:double,y:double,z:double>"


def vec(x: Column | str, y: Column | str, z: Column | str | None = None) -> Column:
    c = [F.col(v) if isinstance(v, str) else v for v in (x, y)]
    return F.struct(c[0].alias("x"), c[1].alias("y"), (F.lit(0.0) if z is None else F.col(z) if isinstance(z, str) else z).alias("z"))


def minus(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def distance_xy(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def unit_normal(a: Column, b: Column, c: Column) -> Column:
    """Unit normal of a triangle; zero if it has no area."""
    n = cross(minus(b, a), minus(c, a))
    size = norm(n)
    flat = size <= 1e-12
    part = lambda v: F.when(flat, 0.0).otherwise(v / size)
    return vec(part(n["x"]), part(n["y"]), part(n["z"]))


def area(a: Column, b: Column, c: Column) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) * 0.5


def area_xy(a: Column, b: Column, c: Column) -> Column:
    return F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])) * 0.5


def centroid(*corners: Column) -> Column:
    mean = lambda k: reduce(lambda a, b: a + b, [c[k] for c in corners]) / len(corners)
    return vec(mean("x"), mean("y"), mean("z"))


def side(p: Column, a: Column, b: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def in_triangle_xy(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Whether p lies in the triangle or on its edge, in either winding; never for a triangle without area."""
    s = [side(p, a, b), side(p, b, c), side(p, c, a)]
    left, right = reduce(lambda u, v: u & v, [x >= -EPS for x in s]), reduce(lambda u, v: u & v, [x <= EPS for x in s])
    return (F.abs(side(c, a, b)) > 1e-12) & (left | right)


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def closest_on_segment_xy(p: Column, a: Column, b: Column) -> Column:
    """Closest point to p on the segment, by its XY projection; height is interpolated."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size <= 1e-18, 0.0).otherwise(clamp(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / size))
    return vec(a["x"] + t * dx, a["y"] + t * dy, a["z"] + t * (b["z"] - a["z"]))


def bound(body: Callable[..., Column], *values: Column) -> Column:
    """body of the values, each computed once; without this a plan repeats a nested value wherever the body names it."""
    one = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.transform(one, lambda s: body(*[s[f"v{i}"] for i in range(len(values))]))[0]


def closest_on_triangle(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Closest point to p of a triangle in space: its plane's if that lies inside, else the nearest of the three edges'."""

    def on(u: Column, v: Column, p: Column) -> Column:
        def at(u: Column, d: Column, p: Column) -> Column:
            size = dot(d, d)
            return bound(lambda t, u, d: vec(u["x"] + t * d["x"], u["y"] + t * d["y"], u["z"] + t * d["z"]), F.when(size <= 1e-18, 0.0).otherwise(clamp(dot(minus(p, u), d) / size)), u, d)

        return bound(at, u, minus(v, u), p)

    def from_normal(p: Column, a: Column, b: Column, c: Column, n: Column) -> Column:
        size = dot(n, n)

        def decide(foot: Column, ways: Column) -> Column:
            best = F.array_min(F.transform(ways, lambda w, i: F.struct(distance(p, w).alias("d"), i.alias("i"), w.alias("q"))))["q"]
            within = reduce(lambda x, y: x & y, [dot(cross(minus(v, u), minus(foot, u)), n) >= 0 for u, v in ((a, b), (b, c), (c, a))])
            return F.when((size > 1e-24) & within, foot).otherwise(best)

        k = F.when(size > 1e-24, dot(minus(p, a), n) / size).otherwise(0.0)
        foot = bound(lambda k: vec(p["x"] - k * n["x"], p["y"] - k * n["y"], p["z"] - k * n["z"]), k)
        return bound(decide, foot, F.array(on(a, b, p), on(b, c, p), on(c, a, p)))

    return bound(lambda p, a, b, c: bound(from_normal, p, a, b, c, cross(minus(b, a), minus(c, a))), p, a, b, c)


def box_distance(p: Column, lo: Column, hi: Column) -> Column:
    gap = lambda k: F.greatest(lo[k] - p[k], F.lit(0.0), p[k] - hi[k])
    return F.sqrt(gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z"))


def in_padded_box(p: Column, lo: Column, hi: Column, pad: float) -> Column:
    return reduce(lambda u, v: u & v, [p[k].between(lo[k] - pad, hi[k] + pad) for k in "xyz"])


def polyline_length(points: Column) -> Column:
    """Length of an array of points; 0 for fewer than two."""
    legs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), distance)
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(legs, F.lit(0.0), lambda a, v: a + v))


def without_repeats(points: Column, kind: str = "array<struct<x:double,y:double,z:double>>") -> Column:
    """The points without those that lie on the one before."""
    step = lambda acc, p: F.when((F.size(acc) > 0) & (distance(F.element_at(acc, -1), p) <= EPS), acc).otherwise(F.concat(acc, F.array(p)))
    return F.aggregate(points, F.array().cast(kind), step)


def point_at(points: Column, travelled: Column) -> Column:
    """Position after a distance along a polyline, held at its ends."""
    zero = F.struct(F.lit(0.0).alias("d"), F.element_at(points, 1).alias("at"), F.element_at(points, 1).alias("last"))

    def step(acc: Column, p: Column) -> Column:
        leg = distance(acc["last"], p)
        t = F.when(leg <= EPS, 0.0).otherwise(clamp((travelled - acc["d"]) / leg))
        here = vec(acc["last"]["x"] + t * (p["x"] - acc["last"]["x"]), acc["last"]["y"] + t * (p["y"] - acc["last"]["y"]), acc["last"]["z"] + t * (p["z"] - acc["last"]["z"]))
        return F.struct((acc["d"] + leg).alias("d"), F.when(travelled >= acc["d"], here).otherwise(acc["at"]).alias("at"), p.alias("last"))

    return F.aggregate(points, zero, step)["at"]


def without_collinear(points: Column, kind: str = "array<struct<x:double,y:double,z:double>>") -> Column:
    """The polyline without inner points that lie on the straight line between the kept one before and the next."""
    n = F.size(points)
    keep = F.transform(points, lambda p, i: F.struct(p.alias("p"), F.get(points, i + 1).alias("next"), (i == n - 1).alias("end")))

    def step(acc: Column, e: Column) -> Column:
        last = F.element_at(acc, -1)
        bent = norm(cross(minus(e["p"], last), minus(e["next"], e["p"]))) > EPS
        return F.when((F.size(acc) == 0) | e["end"] | bent, F.concat(acc, F.array(e["p"]))).otherwise(acc)

    return F.aggregate(keep, F.array().cast(kind), step)


def quantised(v: Column, scale: float) -> Column:
    return F.bround(v * scale).cast("long")


def edge_key(a: Column, b: Column, scale: float = 1000.0) -> Column:
    """Key of a segment in the plane that does not depend on its direction."""
    p, q = (F.struct(quantised(v["x"], scale).alias("x"), quantised(v["y"], scale).alias("y")) for v in (a, b))
    return F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))


def morton(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """Interleaved bits of three whole numbers."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, v in enumerate((x, y, z)):
            out = out + F.shiftleft(F.shiftright(v.cast("long"), i).bitwiseAND(F.lit(1)), 3 * i + k)
    return out


def to_y_up(p: Column) -> Column:
    return vec(p["x"], p["z"], -p["y"])


def to_mirrored_cm(p: Column) -> Column:
    return vec(p["x"] * 100, -p["y"] * 100, p["z"] * 100)


def remaining(points: Column, travelled: Column, kind: str = "array<struct<x:double,y:double,z:double>>") -> Column:
    """The polyline from the position after a distance on: that position, then the corners that lie further."""
    zero = F.struct(F.lit(0.0).alias("d"), F.element_at(points, 1).alias("last"), F.array().cast(kind).alias("ahead"))

    def step(acc: Column, p: Column) -> Column:
        upto = acc["d"] + distance(acc["last"], p)
        return F.struct(upto.alias("d"), p.alias("last"), F.when(upto > travelled, F.concat(acc["ahead"], F.array(p))).otherwise(acc["ahead"]).alias("ahead"))

    return F.concat(F.array(point_at(points, travelled)), F.aggregate(points, zero, step)["ahead"])


def off_plane(a: Column, b: Column, c: Column, *others: Column) -> Column:
    """The greatest distance of the other points from the plane of a triangle; triangles are coplanar if it is within a tolerance."""
    n = unit_normal(a, b, c)
    return F.greatest(*[F.abs(dot(n, minus(p, a))) for p in others])


def closest_of_segments(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<one, two>: where the segments a-b and c-d are closest; a segment without length is its first point."""
    along = lambda p, way, k: vec(p["x"] + way["x"] * k, p["y"] + way["y"] * k, p["z"] + way["z"] * k)

    def first(a: Column, c: Column, u: Column, v: Column, uu: Column, vv: Column, uv: Column, uw: Column, vw: Column) -> Column:
        cut = uu * vv - uv * uv
        s = F.when((uu > 1e-12) & (F.abs(cut) > 1e-12), clamp((uv * vw - uw * vv) / cut)).otherwise(0.0)
        return bound(second, a, c, u, v, uu, vv, uv, uw, vw, s)

    def second(a: Column, c: Column, u: Column, v: Column, uu: Column, vv: Column, uv: Column, uw: Column, vw: Column, s: Column) -> Column:
        free = F.when(vv > 1e-12, (uv * s + vw) / vv).otherwise(0.0)
        return bound(third, a, c, u, v, uu, vv, uv, uw, s, free, clamp(free))

    def third(a: Column, c: Column, u: Column, v: Column, uu: Column, vv: Column, uv: Column, uw: Column, s: Column, free: Column, t: Column) -> Column:
        # where the second point had to move to an end of its segment, the first follows it
        moved = F.when(uu <= 1e-12, 0.0).when((vv > 1e-12) & (free == t), s).otherwise(clamp((uv * t - uw) / uu))
        return F.struct(along(a, u, moved).alias("one"), along(c, v, t).alias("two"))

    ways = lambda a, c, u, v, w: bound(first, a, c, u, v, dot(u, u), dot(v, v), dot(u, v), dot(u, w), dot(v, w))
    return bound(lambda a, b, c, d: bound(ways, a, c, minus(b, a), minus(d, c), minus(a, c)), a, b, c, d)


def point_at_elevation(points: Column, z: Column) -> Column:
    """The first point of a polyline at elevation z; if no leg passes it, the point nearest to it in height, put at z. Null for an empty polyline."""
    legs = F.zip_with(points, F.slice(points, F.lit(2), F.greatest(F.lit(0), F.size(points) - 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    passes = lambda leg: leg["q"].isNotNull() & (F.abs(leg["q"]["z"] - leg["p"]["z"]) > EPS) & z.between(F.least(leg["p"]["z"], leg["q"]["z"]) - EPS, F.greatest(leg["p"]["z"], leg["q"]["z"]) + EPS)
    leg = F.get(F.filter(legs, passes), 0)
    k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (z - leg["p"]["z"]) / (leg["q"]["z"] - leg["p"]["z"])))
    hit = vec(leg["p"]["x"] + (leg["q"]["x"] - leg["p"]["x"]) * k, leg["p"]["y"] + (leg["q"]["y"] - leg["p"]["y"]) * k, z)
    near = F.array_min(F.transform(points, lambda p, i: F.struct(F.abs(p["z"] - z).alias("far"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    return F.when(F.size(points) > 0, F.when(leg.isNotNull(), hit).otherwise(vec(near["x"], near["y"], z)))
