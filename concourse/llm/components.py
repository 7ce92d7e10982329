"""Connected components: of an edge table, by alternating large-star and small-star rounds, and of candidate buckets, by pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import settle

SMALL = 128  # members of a bucket that may all meet one another
TILE, SIZES = 2048, 1 << 21  # members of one side of a tile, and the sum of their sizes, where larger buckets are screened as a whole


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: link neighbours to the smallest member of their neighbourhood. Minima are pre-aggregated, and hot centres join by a splittable sort-merge join."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:  # hot centres: written first, so that the join can split them
        low = settle(low)
    joined = sides.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    out = joined.where("v > u" if large else "true").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id that an edge names; component is the smallest reachable id. Self-edges, repeats and null ends add nothing; an empty edge table gives an empty result."""
    now = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
        now = settle(_star(_star(now, large=True), large=False), now)
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def shared_buckets(keyed: DataFrame) -> DataFrame:
    """(k, id, n, met) for each bucket k that two ids or more of keyed (id, n, keys) share; met: how full the buckets of the id are together."""
    flat = keyed.select(F.explode("keys").alias("k"), "id", "n")
    # counts are written before they are joined back, so that the join can split hot buckets
    many = settle(flat.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"))
    members = settle(flat.join(many, "k"), many)
    met = settle(members.groupBy("id").agg(F.sum("m").alias("met")))
    return settle(members.join(met, "id").select("k", "id", "n", "met"), members, met)


def bucket_components(members: DataFrame, keyed: DataFrame, ratio: float, verify: Callable[[DataFrame], DataFrame], screen: Callable[[DataFrame], DataFrame] | None = None, tile: int = 0, pivots: int = 0) -> DataFrame:
    """(id, component) for ids that have links: components of the verified pairs among members (k, id, n, met) of a bucket.

    verify keeps the true pairs of (a, b); a is a pivot and may be in many pairs, so b should be joined last. Pairs whose sizes n differ by more than the ratio can't link and aren't made.
    A bucket's pivot, the member whose own buckets are the fullest (the text from which the others of a group were
    made), meets the others and is then taken out: in a first step each member meets the best of its pivots only, so a
    group of copies costs one pair a member, and buckets that then lie in one component are closed. With `pivots`, so
    many members of a larger bucket meet the others once more, which joins groups whose members are near one another but
    not near one of them. What is left of a
    bucket of up to SMALL members meets in pairs, and what is left of a larger one is cut into tiles
    (k, lo, hi, t, id, n, c): each two parts of about `tile` members, or of sizes that sum up to about SIZES, meet in one
    task. With screen, screen(tiles) gives true pairs (a, b) that connect every two components c with a link in the tile,
    so that no row is made for a pair that isn't a link; without it the pairs of the tiles are verified like others. No
    pair that shares a bucket is lost, but for those that screen or verify drop.
    """
    label = None
    members = members.withColumn("c", F.col("id"))
    step = 0
    while True:
        if step:  # before the first links every shared bucket is open
            members = _open(members, label)
        if members.isEmpty():
            return label if label is not None else keyed.select("id", F.col("id").alias("component")).where(F.lit(False))
        last = step > 1 + (pivots > 0)
        if step == 2 and not last:
            meet, part = members.where(F.col("m") > SMALL), F.pmod(F.xxhash64("id"), F.lit(pivots))
            last = meet.isEmpty()
        else:
            meet, part = members, F.lit(0).cast("long")
        if last:
            small = members.where(F.col("m") <= SMALL).select("k", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("t"), "id", "n", "c")
            large = _tiles(members.where(F.col("m") > SMALL), tile or TILE)
            met = small if screen is not None else small.unionByName(large)
            pairs = settle(tile_pairs(met, ratio).select("a", "b").distinct())
            links = verify(_dealt(pairs))
            return _merged(label, settle(links if screen is None else links.unionByName(screen(large)), pairs))
        chosen = settle(meet.groupBy("k", part.alias("p")).agg(F.min(F.struct((-F.col("met")).alias("far"), "id", "c", "n")).alias("x")).select("k", F.col("x.id").alias("pid"), F.col("x.c").alias("pc"), F.col("x.n").alias("pn"), F.col("x.far").alias("far")))
        pairs = meet.join(chosen, "k").where((F.col("c") != F.col("pc")) & (F.least("n", "pn") >= ratio * F.greatest("n", "pn") - 1e-9))
        if step == 0:
            pairs = pairs.groupBy("id").agg(F.min(F.struct("far", "pid")).alias("x")).select("id", "x.pid")
        pairs = settle(pairs.select(F.col("pid").alias("a"), F.col("id").alias("b")).distinct())
        found = settle(verify(_dealt(pairs)), pairs)
        label = _merged(label, found)
        if step:
            members = settle(members.join(chosen.select("k", F.col("pid").alias("id")), ["k", "id"], "left_anti"), members, chosen)
        step += 1


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs are few bytes, but each row is work: without a count of partitions they would be read as one."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b")


def _tiles(members: DataFrame, tile: int) -> DataFrame:
    """(k, lo, hi, t, id, n, c): members of bucket k by parts t; each two parts, and each part with itself, make a tile."""
    whole = settle(members.groupBy("k").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / SIZES)).cast("int").alias("parts")))
    cut = members.join(whole, "k")
    cut = cut.withColumn("t", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    each = cut.select("k", "id", "n", "c", "t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("u"))
    return each.select("k", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"), "t", "id", "n", "c")


def tile_pairs(tiles: DataFrame, ratio: float, *more: str) -> DataFrame:
    """(k, a, b) and each of `more` of both, with suffixes _a and _b, for the pairs of a tile's two parts in different components whose sizes n allow a link; what is asked of them further is tested within the join."""
    end = lambda x: tiles.where(F.col("t") == F.col("lo" if x == "a" else "hi")).select("k", "lo", "hi", F.col("id").alias(x), *[F.col(y).alias(f"{y}_{x}") for y in ("c", "n", *more)])
    both = end("a").join(end("b"), ["k", "lo", "hi"])
    return both.where(((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b"))) & (F.col("c_a") != F.col("c_b")) & (F.least("n_a", "n_b") >= ratio * F.greatest("n_a", "n_b") - 1e-9))


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members with their component c, of buckets that lie in more than one component; m: the bucket's members."""
    now = settle(members.drop("m", "c").join(label.select("id", F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id")), members)
    several = settle(now.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("k", "m"))
    return settle(now.join(several, "k"), now, several)


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels with new links: components of the links between old components, carried over to their members. A round without links leaves the labels as they are."""
    if label is not None and links.isEmpty():
        return label
    if label is None:
        return settle(connected_components(links, "a", "b"))
    old = lambda end: label.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    raised = links.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = settle(connected_components(raised, "a", "b")).select(F.col("id").alias("component"), F.col("component").alias("top"))
    known = label.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    fresh = above.select(F.col("component").alias("id"), F.col("top").alias("component")).join(label.select("id"), "id", "left_anti")
    return settle(known.unionByName(fresh))
