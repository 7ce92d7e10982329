"""Graph operators over edge tables of many buildings: components, reachability, shortest paths.

All are frontier or label loops of joins with pre-aggregated minima; state is written between rounds, so plans stay
short and a lost executor costs one round.
"""

from __future__ import annotations

import math
import tempfile
import uuid
import warnings
import weakref
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SETTLED: dict[int, str] = {}
BATCH = 512  # sources that search one copy of their building's arcs
WAYS = 1 << 12  # ways from one node that a round follows without a look at what is known


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        warnings.warn("spark.checkpoint.dir is unset: states go to a folder of this machine, which a cluster's executors don't share", stacklevel=3)
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back; lineage ends there, and the shuffle files of the write go as it ends. spent: settled tables that nothing reads after this; they are deleted."""
    path = f"{shared_dir(df.sparkSession)}/state-{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(CLEANUP, "false")
    df.sparkSession.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(CLEANUP, before)
    for old in spent:
        discard(old)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _SETTLED[id(out)] = path
    weakref.finalize(out, _SETTLED.pop, id(out), None)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table."""
    spark, path = df.sparkSession, _SETTLED.get(id(df))
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(building_id, id, component) of every node: the smallest id that undirected edges (building_id, a, b) connect it to.

    Each round every node moves to the smallest of itself and its neighbours, then up to seven moves further along
    theirs, and the edges move along: those that have become loops or repeats go, so the graph shrinks to nothing in a
    few rounds, long chains included. The moves are written by round and put together from the last, smallest one back.
    Nodes without edges are components of their own.
    """

    def onward(move: DataFrame) -> DataFrame:
        return move.join(move.select("building_id", F.col("id").alias("up"), F.col("up").alias("top")), ["building_id", "up"]).select("building_id", "id", F.col("top").alias("up"))

    now = settle(edges.where("a <> b").select("building_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves = []
    while not now.isEmpty():
        ends = now.select("building_id", F.col("a").alias("id"), F.col("a").alias("low")).unionByName(now.select("building_id", F.col("b").alias("id"), F.col("a").alias("low")))
        first = settle(ends.groupBy("building_id", "id").agg(F.min("low").alias("up")))
        for _ in range(3):  # written each time, as a plan of all three would join the whole table seven times
            first = settle(onward(first), first)
        moves.append(first)
        to = lambda end: moves[-1].select("building_id", F.col("id").alias(end), F.col("up").alias(f"u{end}"))
        moved = now.join(to("a"), ["building_id", "a"]).join(to("b"), ["building_id", "b"]).where("ua <> ub")
        now = settle(moved.select("building_id", F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), now)
    label = None
    for move in reversed(moves):
        top = move if label is None else move.join(label.select("building_id", F.col("id").alias("up"), F.col("up").alias("top")), ["building_id", "up"], "left").select("building_id", "id", F.coalesce("top", "up").alias("up"))
        label = settle(top, move, *([] if label is None else [label]))
    every = nodes.select("building_id", "id").distinct()
    if label is None:
        return settle(every.withColumn("component", F.col("id")))
    return settle(every.join(label, ["building_id", "id"], "left").select("building_id", "id", F.coalesce("up", "id").alias("component")), label)


def reachable(starts: DataFrame, arcs: DataFrame) -> DataFrame:
    """(building_id, id) of all that arcs (building_id, a, b) lead to from starts (building_id, id), starts included. Each round writes only what it is the first to reach."""
    arcs = settle(arcs.select("building_id", "a", "b").distinct())
    found = [settle(starts.select("building_id", "id").distinct())]
    while not found[-1].isEmpty():
        step = found[-1].join(arcs.withColumnRenamed("a", "id"), ["building_id", "id"]).select("building_id", F.col("b").alias("id")).distinct()
        found.append(settle(step.join(reduce(DataFrame.unionByName, found), ["building_id", "id"], "left_anti")))
    return settle(reduce(DataFrame.unionByName, found), arcs, *found)


def shortest(sources: DataFrame, arcs: DataFrame, keys: tuple[str, ...] = ("building_id",), hops: int | None = None) -> DataFrame:
    """(keys, source, id, cost, hops, path) of the cheapest way from each source (keys, source) to every node; arcs (keys, a, b, cost).

    Frontier relaxation: only rows that improved go on, and one run serves all goals of a source. Ties go to the smaller
    path, node by node. hops bounds the number of arcs of a way.
    """
    k = list(keys)
    arcs = settle(arcs.select(*k, "a", "b", "cost").groupBy(*k, "a", "b").agg(F.min("cost").alias("cost")))
    best = settle(sources.select(*k, "source", F.col("source").alias("id"), F.lit(0.0).alias("cost"), F.array("source").alias("path")).distinct())
    frontier, rounds = best, 0
    while (hops is None or rounds < hops) and not frontier.isEmpty():
        rounds += 1
        way = frontier.withColumnRenamed("cost", "so_far").join(arcs.withColumnRenamed("a", "id"), [*k, "id"])
        new = way.select(*k, "source", F.col("b").alias("id"), F.struct(F.round(F.col("so_far") + F.col("cost"), 9).alias("cost"), F.concat("path", F.array("b")).alias("path")).alias("w"))
        new = new.groupBy(*k, "source", "id").agg(F.min("w").alias("w")).select(*k, "source", "id", "w.cost", "w.path")
        old = best.select(*k, "source", "id", F.col("cost").alias("had"))
        frontier = settle(new.join(old, [*k, "source", "id"], "left").where("had is null or cost < had").drop("had"))
        best = settle(best.join(frontier.select(*k, "source", "id"), [*k, "source", "id"], "left_anti").unionByName(frontier))
    return best.select(*k, "source", "id", "cost", (F.size("path") - 1).alias("hops"), "path")


def _steps(moves: DataFrame, keys: list[str], most: int) -> int:
    """How many arcs a round may take before what is known already is taken out: as long as a node's ways, by the mean degree of the ends of arcs, stay within WAYS; in dense graphs one."""
    n = moves.groupBy(*keys, "a").agg(F.count("*").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("d")).first()["d"]
    return most if n is None or n <= 1 else max(1, min(most, int(math.log(WAYS, n))))


def cheapest(sources: DataFrame, arcs: DataFrame, keys: tuple[str, ...] = ("building_id",), goals: DataFrame | None = None, nearest: bool = False, steps: int = 8) -> DataFrame:
    """(keys, source, id, cost): the least cost from each source to every node that it reaches over arcs (keys, a, b, cost).

    sources (keys, source, id, cost) may start one source at several nodes, each at a cost of its own. A round takes
    up to `steps` arcs at once, fewer the more arcs a node has (see _steps), and writes only what has become cheaper;
    ways are not carried, see predecessors. goals (keys,
    source, id, and extra if nearest) end a search: nodes no nearer than the farthest goal of their source go no further,
    or, if nearest, than the goal that is nearest with its extra cost; sources without goals don't start. Costs are
    rounded to nine decimals, so that equal sums are equal.
    """
    k = list(keys)
    arcs = arcs.groupBy(*k, "a", "b").agg(F.min("cost").alias("cost"))
    kind = dict(arcs.dtypes)["cost"]
    ends = arcs.select(*k, "a").unionByName(arcs.select(*k, F.col("b").alias("a"))).distinct()
    moves = settle(arcs.unionByName(ends.select(*k, "a", F.col("a").alias("b"), F.lit(0).cast(kind).alias("cost"))))
    fresh = settle(sources.groupBy(*k, "source", "id").agg(F.min(F.col("cost").cast(kind)).alias("cost")))
    found, steps = [fresh], _steps(moves, k, steps)

    def known() -> DataFrame:
        return reduce(DataFrame.unionByName, found).groupBy(*k, "source", "id").agg(F.min("cost").alias("cost"))

    while not fresh.isEmpty():
        if goals is not None:
            met = goals.select(*k, "source", "id", *(["extra"] if nearest else [])).distinct().join(known(), [*k, "source", "id"], "left").groupBy(*k, "source")
            # a goal that hasn't been met yet is no bound
            bound = met.agg(F.min(F.col("cost") + F.col("extra")).alias("most"), (F.count("cost") == 0).alias("open")) if nearest else met.agg(F.max("cost").alias("most"), (F.count("cost") < F.count("*")).alias("open"))
            fresh = fresh.join(bound, [*k, "source"]).where("open or cost < most").select(*k, "source", "id", "cost")
        for _ in range(steps):
            way = fresh.withColumnRenamed("cost", "so_far").join(moves.withColumnRenamed("a", "id"), [*k, "id"])
            fresh = way.groupBy(*k, "source", F.col("b").alias("id")).agg(F.min(F.round(F.col("so_far") + F.col("cost"), 9)).alias("cost"))
        had = known().withColumnRenamed("cost", "had")
        fresh = settle(fresh.join(had, [*k, "source", "id"], "left").where("had is null or cost < had").select(*k, "source", "id", "cost"))
        found.append(fresh)
    return settle(known(), moves, *found)


def _searches(paths: bool):
    """Rows (building_id, batch, kind, a, b, cost), sorted, as least costs: the arcs of a building (kind 0), then the sources of a batch (kind 1). Results are given source by source."""

    def graph_of(arcs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, cost = (np.concatenate([x[i] for x in arcs]) if arcs else np.empty(0, np.int64) for i in range(3))
        ids = np.unique(np.concatenate([a, b]))
        a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
        order = np.argsort(a, kind="stable")
        return ids, np.r_[0, np.cumsum(np.bincount(a, minlength=len(ids)))], b[order], cost[order]

    def found(graph: tuple[np.ndarray, ...], source: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids, costs, paths) of what the source reaches. Nodes are settled in order of their costs, those of one cost at once, the smaller id first, so the first one that leads on to a node at its cost is the smallest."""
        ids, start, to, cost = graph
        s = int(np.searchsorted(ids, source))
        if s == len(ids) or ids[s] != source:
            return np.array([source]), np.zeros(1, np.int64), [str(source)]
        far = np.iinfo(np.int64).max
        best, before, settled = np.full(len(ids), far), np.full(len(ids), len(ids)), np.zeros(len(ids), bool)
        best[s], rounds, waiting = 0, [], np.array([s])
        while len(waiting):
            now = waiting[best[waiting] == best[waiting].min()]
            settled[now] = True
            rounds.append(now)
            n = start[now + 1] - start[now]
            at = np.repeat(start[now] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            node, way, last = to[at], np.repeat(best[now], n) + cost[at], np.repeat(now, n)
            good = way <= best[node]
            node, way, last = node[good], way[good], last[good]
            new = best.copy()
            np.minimum.at(new, node, way)
            if paths:
                before[new < best] = len(ids)
                tied = way == new[node]
                np.minimum.at(before, node[tied], last[tied])
            best = new
            waiting = np.flatnonzero(~settled & (best < far))
        order = np.concatenate(rounds)
        if not paths:
            return ids[order], best[order], []
        line: dict[int, str] = {}
        for i, name, b in zip(order.tolist(), ids[order].tolist(), before[order].tolist()):
            line[i] = f"{line[b]}>{name}" if i != s else str(name)
        return ids[order], best[order], list(line.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, arcs, graph = None, [], None
        for batch in batches:
            c = [batch.column(i).to_numpy() for i in range(6)]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in c[:3]], axis=0)) + 1 if batch.num_rows > 1 else np.empty(0, int)
            for i, j in zip(np.r_[0, cut], np.r_[cut, batch.num_rows]):
                if i == j:
                    continue
                if (c[0][i], c[1][i]) != key:
                    key, arcs, graph = (c[0][i], c[1][i]), [], None
                if c[2][i] == 0:
                    arcs.append(tuple(x[i:j].copy() for x in c[3:]))
                    continue
                if graph is None:
                    graph, arcs = graph_of(arcs), []
                for source in c[3][i:j].tolist():
                    ids, cost, lines = found(graph, source)
                    columns = {"building_id": np.full(len(ids), key[0]), "source": np.full(len(ids), source), "id": ids, "cost": cost} | ({"path": lines} if paths else {})
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def cheapest_in_tasks(sources: DataFrame, arcs: DataFrame, paths: bool = False) -> DataFrame:
    """(building_id, source, id, cost), and with paths path: the least cost, and the nodes from the source on joined by >, from each source (building_id, source) to every node that it reaches.

    For dense graphs, where the ways of a round are many times what they lead to: ids and costs are whole numbers, costs
    above 0. Of paths of equal cost the one whose nodes have the smaller ids from the end back. Up to about BATCH sources
    of a building meet one copy of its arcs in a task, which holds them and the state of one source; nothing but arcs and
    sources is shuffled.
    """
    s = sources.select(F.col("building_id").cast("long").alias("building_id"), F.col("source").cast("long").alias("a")).distinct()
    s = settle(s)
    n = settle(s.groupBy("building_id").agg(F.ceil(F.count("*") / BATCH).cast("long").alias("n")))
    batch = s.join(n, "building_id").select("building_id", F.pmod(F.xxhash64("a"), F.col("n")).alias("batch"), F.lit(1).cast("long").alias("kind"), "a", F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("cost"))
    few = arcs.groupBy(F.col("building_id").cast("long").alias("building_id"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).agg(F.min("cost").cast("long").alias("cost"))
    copies = settle(few).join(n, "building_id").select("building_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("batch"), F.lit(0).cast("long").alias("kind"), "a", "b", "cost")
    rows = copies.unionByName(batch).repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "building_id", "batch").sortWithinPartitions("building_id", "batch", "kind", "a", "b")
    return rows.mapInArrow(_searches(paths), "building_id long, source long, id long, cost long" + (", path string" if paths else ""))


def predecessors(best: DataFrame, arcs: DataFrame, keys: tuple[str, ...] = ("building_id",)) -> DataFrame:
    """(keys, source, id, before): the node before each one on a cheapest way; of several the smallest. best: costs as cheapest gives them, over the same arcs of costs above 0."""
    k = list(keys)
    arcs = arcs.groupBy(*k, "a", "b").agg(F.min("cost").alias("step"))
    start = best.select(*k, "source", F.col("id").alias("a"), F.col("cost").alias("from_cost"))
    way = best.join(arcs.withColumnRenamed("b", "id"), [*k, "id"]).join(start, [*k, "source", "a"])
    return way.where((F.col("from_cost") < F.col("cost")) & (F.round(F.col("from_cost") + F.col("step"), 9) == F.col("cost"))).groupBy(*k, "source", "id").agg(F.min("a").alias("before"))


def ways(before: DataFrame, goals: DataFrame, keys: tuple[str, ...] = ("building_id",)) -> DataFrame:
    """(keys, source, goal, back, id): the nodes of the way to each goal (keys, source, id), counted from the goal back.

    Predecessors are followed by doubling: each round knows the nodes up to 2^n steps back and jumps 2^n further, so
    the rounds grow with the logarithm of the longest way.
    """
    k = list(keys)
    have = settle(goals.select(*k, "source", F.col("id").alias("goal"), F.lit(0).alias("back"), "id").distinct())
    jump, span = settle(before.join(goals.select(*k, "source").distinct(), [*k, "source"], "left_semi").select(*k, "source", "id", "before")), 1
    spent = (have, jump)
    further = lambda one: one.join(one.select(*k, "source", F.col("id").alias("before"), F.col("before").alias("further")), [*k, "source", "before"]).select(*k, "source", "id", F.col("further").alias("before"))
    while True:
        for _ in range(2):  # two jumps a round
            have = have.unionByName(have.join(jump, [*k, "source", "id"]).select(*k, "source", "goal", (F.col("back") + span).alias("back"), F.col("before").alias("id")))
            jump, span = further(jump), 2 * span
        have, jump = settle(have, spent[0]), settle(jump, spent[1])
        spent = (have, jump)
        if jump.isEmpty():  # no node lies as far back as the next jump
            discard(jump)
            return have


def vertical_components(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("stair", "ramp", "elevator", "escalator")) -> DataFrame:
    """(building_id, component, kind, n) of the parts of the graph whose nodes (building_id, id, kind) are all vertical; kind is `vertical` where kinds mix."""
    tall = nodes.where(F.col("kind").isin(*kinds))
    a, b = tall.select("building_id", F.col("id").alias("a")), tall.select("building_id", F.col("id").alias("b"))
    inner = edges.join(a, ["building_id", "a"], "left_semi").join(b, ["building_id", "b"], "left_semi")
    named = components(tall, inner).join(tall, ["building_id", "id"])
    return named.groupBy("building_id", "component").agg(F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("vertical").alias("kind"), F.count("*").alias("n"))


def undirected(edges: DataFrame, cost: str | None = None) -> DataFrame:
    c = [F.col(cost).alias("cost")] if cost else []
    return edges.select("building_id", "a", "b", *c).unionByName(edges.select("building_id", F.col("b").alias("a"), F.col("a").alias("b"), *c))


def space_arcs(transitions: DataFrame) -> DataFrame:
    """Directed arcs (building_id, a, b) of transitions, both ways where they are bidirectional."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    ways = F.when(F.col("bidirectional"), F.array(way("from_id", "to_id"), way("to_id", "from_id"))).otherwise(F.array(way("from_id", "to_id")))
    return transitions.select("building_id", F.explode(ways).alias("w")).select("building_id", "w.a", "w.b").distinct()


def under_scenario(arcs: DataFrame, blocked: DataFrame, multiplier: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Arcs (building_id, a, b, cost) without entry to blocked ids (building_id, id), costs times the larger multiplier (building_id, id, multiplier) of both ends, at least 1.

    A blocked place is no entry and no trap: arcs that leave it stay.
    """
    open_ = arcs.join(blocked.select("building_id", F.col("id").alias("b")), ["building_id", "b"], "left_anti")
    m = lambda end: multiplier.select("building_id", F.col("id").alias(end), F.col("multiplier").alias(f"m_{end}"))
    both = open_.join(m("a"), ["building_id", "a"], "left").join(m("b"), ["building_id", "b"], "left")
    return both.select("building_id", "a", "b", (F.col("cost") * F.greatest(F.lit(1.0), F.coalesce("m_a", F.lit(1.0)), F.coalesce("m_b", F.lit(1.0)))).alias("cost"))
