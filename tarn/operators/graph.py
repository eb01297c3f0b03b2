"""Graph operators over edge tables (src, dst, ...). Steps are equality joins; depths are bounded by parameters, loops cut their lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import Stages, durable, parts_for, release


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours (src, dst), without loops."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbours(edges: DataFrame, node: Column, direction: str = "both") -> DataFrame:
    """(neighbour, way) of one node: out, in or both."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("neighbour"), F.lit("out").alias("way"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("neighbour"), F.lit("in").alias("way"))
    parts = {"out": out, "in": into, "both": out.unionByName(into)}
    return parts[direction].distinct()


#: A frontier of so many nodes goes to all tasks; a larger one meets the edges by a shuffle.
SMALL_FRONTIER = 100_000


def expand(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """(node, depth) of all nodes within `hops` of the seeds (node), by breadth-first frontiers.

    The edges are stored once and never shuffled while frontiers are small; undirected steps look at both ends of the same rows.
    """
    e = durable(edges.select("src", "dst").where("src <> dst"))
    frontier = durable(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, n = frontier, frontier.count()
    for k in range(1, hops + 1):
        here = F.broadcast(frontier) if n <= SMALL_FRONTIER else frontier
        step = e.join(here, F.col("node") == F.col("src")).select(F.col("dst").alias("next"))
        if not directed:
            step = step.unionByName(e.join(here, F.col("node") == F.col("dst")).select(F.col("src").alias("next")))
        step = step.select(F.col("next").alias("node")).distinct()
        frontier = durable(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)))
        n = frontier.count()
        if not n:
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, starts: DataFrame, depth: int, extend: Callable[[DataFrame], Column] | None = None, closing: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Simple paths (start, node, path array, hops, and <c>_path arrays of the carried edge columns) of 1 to `depth` edges.

    extend filters steps (columns of the path and of the edge, e_dst and e_<c>). closing: keep only paths that end on their start.
    """
    e = edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"), *[F.col(c).alias(f"e_{c}") for c in carry])
    empty = {c: F.array().cast(f"array<{dict(edges.dtypes)[c]}>") for c in carry}
    now = starts.select(F.col("node").alias("start"), F.col("node"), F.array("node").alias("path"), *[empty[c].alias(f"{c}_path") for c in carry])
    out = None
    for k in range(1, depth + 1):
        step = now.join(e, F.col("node") == F.col("e_src"))
        if extend is not None:
            step = step.where(extend(step))
        again = F.array_contains("path", F.col("e_dst"))
        closes = F.col("e_dst") == F.col("start")
        grown = step.select("start", F.col("e_dst").alias("node"), F.concat("path", F.array("e_dst")).alias("path"), *[F.concat(f"{c}_path", F.array(f"e_{c}")).alias(f"{c}_path") for c in carry], again.alias("again"), closes.alias("closes"))
        grown = durable(grown.where(~F.col("again") | F.col("closes")))
        found = (grown.where("closes") if closing else grown.where("NOT again")).drop("again", "closes").withColumn("hops", F.lit(k))
        out = found if out is None else out.unionByName(found)
        now = grown.where("NOT again").drop("again", "closes")
    return out


def cycles(edges: DataFrame, longest: int, carry: tuple[str, ...] = (), extend=None) -> DataFrame:
    """Directed cycles of 2 to `longest` edges, each once: from its smallest node."""
    starts = edges.select(F.col("src").alias("node")).distinct()
    ahead = lambda step: (F.col("e_dst") >= F.col("start")) & (extend(step) if extend else F.lit(True))
    return paths(edges, starts, longest, ahead, closing=True, carry=carry).where("hops >= 2")


def shortest_paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(start, node, path, hops): for each reached node the path of fewest hops; of several the smallest array."""
    p = paths(edges, start, depth)
    return p.groupBy("start", "node").agg(F.min(F.struct("hops", "path")).alias("x")).select("start", "node", "x.path", "x.hops")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each reaches, for all nodes with a neighbour.

    Edges are kept as (higher, lower). A large star ties a node's higher neighbours to its lowest one, a small star its lower ones; both
    only move minima, so rounds grow with the logarithm of the longest path and a hub is never gathered. Settled once count and checksum stand still.
    """
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    stages = Stages(edges.sparkSession, "components")
    now, seen = stages.put(now, "edges"), None
    for _ in range(rounds):
        ends = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ends.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stages.put(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return named.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, degree) counting parallel edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count("*").alias("degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank), iterated until the ranks change by less than `tolerance` a node in sum, `iterations` times at most; dangling mass is dealt evenly, parallel edges add weight.

    Each node's share of its edges is worked out once; the change is looked at where the lineage is cut anyway.
    """
    e = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    total = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = durable(e.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w")))
    nodes = e.select("src").distinct().withColumn("loose", F.lit(False)).unionByName(e.select(F.col("dst").alias("src")).distinct().join(e.select("src").distinct(), "src", "left_anti").withColumn("loose", F.lit(True)))
    nodes = durable(nodes.withColumnRenamed("src", "node"))
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(iterations):
        into = e.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
        loose = rank.where("loose").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("mass"))
        new = rank.withColumnRenamed("rank", "was").join(into, F.col("node") == F.col("dst"), "left").join(F.broadcast(loose))  # one row
        new = new.select("node", "loose", "was", ((1 - damping) / n + damping * (F.coalesce("s", F.lit(0.0)) + F.col("mass") / n)).alias("rank"))
        if k % 4 == 3 or k == iterations - 1:
            new = durable(new)
            if new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < n * tolerance:
                return new.select("node", "rank")
        rank = new.drop("was")
    return rank.select("node", "rank")


def propagate(edges: DataFrame, own: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, risk): (1 - d) own + d mean of the neighbours, a neighbour without a score counting 0; isolated nodes keep their own."""
    e = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = durable(e)
    degree = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    # written, as every iteration needs it
    state = durable(own.select("node", F.col("risk").alias("own")).join(degree, "node", "left").withColumn("risk", F.col("own")))
    for k in range(iterations):
        sums = e.join(state.select(F.col("node").alias("dst"), "risk"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("risk").alias("sum"))
        mean = F.coalesce("sum", F.lit(0.0)) / F.col("degree")
        state = state.join(sums, "node", "left").select("node", "own", "degree", F.when(F.col("degree").isNull(), F.col("own")).otherwise((1 - damping) * F.col("own") + damping * mean).alias("risk"))
        if k % 3 == 2 or k == iterations - 1:
            state = durable(state)
    return state.select("node", "risk")


def clustering(edges: DataFrame) -> DataFrame:
    """(node, coefficient) of the simple undirected graph. Edges point from the lower degree, so each triangle is found once.

    A node's later neighbours, no more than the square root of twice the edges, are one row. To each of them go those after it, where they meet its own.
    """
    e = durable(both_ways(edges))
    n = parts_for(e.sparkSession, e.count())
    d = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    half = e.join(d.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    half = half.where(F.struct("ds", "src") < F.struct("dd", "dst"))
    later = durable(half.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dd", "dst")))["dst"].alias("near")))
    tails = later.where("size(near) > 1").select("src", "near", F.posexplode("near").alias("at", "p")).where("at < size(near) - 1")
    tails = tails.select("src", "p", F.slice("near", F.col("at") + 2, F.size("near")).alias("tail"))
    there = later.select(F.col("src").alias("p"), F.col("near").alias("own")).repartition(n, "p").hint("shuffle_hash")
    closed = tails.repartition(n, "p").join(there, "p").select("src", "p", F.array_intersect("tail", "own").alias("q"))
    corner = lambda node, t: F.struct(node.alias("node"), t.cast("long").alias("t"))
    corners = F.concat(F.array(*[corner(F.col(k), F.size("q")) for k in ("src", "p")]), F.transform("q", lambda x: corner(x, F.lit(1))))
    counts = closed.where("size(q) > 0").select(F.explode(corners).alias("x")).groupBy("x.node").agg(F.sum("x.t").alias("t"))
    return d.join(counts, "node", "left").select("node", F.coalesce(F.try_divide(2 * F.coalesce("t", F.lit(0)), F.col("d") * (F.col("d") - 1)), F.lit(0.0)).alias("coefficient"))


def priority_view(edges: DataFrame, scores: DataFrame, cap: int = 500, mode: str = "connected") -> DataFrame:
    """(node, degree, score, priority): the `cap` nodes of highest priority out of scores (node, score), of equals the smallest.

    connected: 10 degree + 5 score, and nodes without edges only once 80 % of the cap is filled; high_risk: 100 score + degree. Parallel edges count each.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    n = scores.join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("score", F.lit(0.0)).alias("score"))
    n = n.withColumn("priority", 10 * F.col("degree") + 5 * F.col("score") if mode == "connected" else 100 * F.col("score") + F.col("degree"))
    order = [F.desc("priority"), F.asc("node")]
    if mode != "connected":
        return n.orderBy(*order).limit(cap)
    first = -(-cap * 4 // 5)
    head = n.where("degree > 0").orderBy(*order).limit(first)
    edge = head.agg(F.count("*").alias("n"), F.min(F.struct("priority", (-F.col("node")).alias("m"))).alias("last")).first()
    if edge["n"] < first:
        return head
    priority, node = edge["last"]["priority"], -edge["last"]["m"]
    later = (F.col("priority") < priority) | ((F.col("priority") == priority) & (F.col("node") > node))
    return head.unionByName(n.where(later).orderBy(*order).limit(cap - first))


def ranked_clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, size, mean_score, max_score, rank) of the components of more than one node that edges make among nodes (node, score); the highest score first, then the largest."""
    inside = edges.select("src", "dst").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").where("src <> dst")
    members = components(inside).join(nodes, "node")
    c = members.groupBy("component").agg(F.count("*").alias("size"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("max_score"), F.desc("size"), "component")))  # no more rows than the view has nodes


def triangles(pairs: DataFrame) -> DataFrame:
    """(x, y, z), x < y < z, mutually linked in undirected pairs (a < b)."""
    p = pairs.select("a", "b").distinct()
    first = p.select(F.col("a").alias("x"), F.col("b").alias("y"))
    second = p.select(F.col("a").alias("y"), F.col("b").alias("z"))
    return first.join(second, "y").join(p.select(F.col("a").alias("x"), F.col("b").alias("z")), ["x", "z"]).select("x", "y", "z")


#: A graph of so many edges (16 bytes each) goes to all tasks that search it; a larger one meets the searches by shuffles.
SEARCHED_EDGES = 4_000_000
#: Places (searches times nodes and edges) that a task holds at a time.
SEARCH_PLACES = 4_000_000
#: Rows (sources times nodes) that joined searches may reach before they write their sums.
JOINED_ROWS = 2_000_000_000


def _searched(graph, places: int):
    """(node, part) of the sources (source) of a task: the searches of a portion of them advance together, a level at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, start, end = graph.value
        n, total = len(names), np.zeros(len(names))
        each = max(1, places // (n + len(end)))
        for pdf in batches:
            for at in range(0, len(pdf), each):
                source = np.searchsorted(names, pdf["source"].to_numpy()[at : at + each])
                first = np.arange(len(source)) * n + source
                level, ways, load, mark = np.full(len(source) * n, -1, np.int32), np.zeros(len(source) * n), np.zeros(len(source) * n), np.empty(len(source) * n, np.int64)
                level[first], ways[first] = 0, 1.0
                here, steps = first, []
                while len(here):
                    node = here % n
                    degree = start[node + 1] - start[node]
                    tail = np.repeat(here, degree)
                    place = np.arange(len(tail)) - np.repeat(np.cumsum(degree) - degree, degree)
                    head = tail - np.repeat(node, degree) + end[np.repeat(start[node], degree) + place]
                    new = level[head] < 0
                    tail, head = tail[new], head[new]
                    np.add.at(ways, head, ways[tail])
                    level[head] = len(steps) + 1
                    mark[head] = np.arange(len(head))
                    here = head[mark[head] == np.arange(len(head))]
                    steps.append((tail, head))
                for tail, head in reversed(steps):
                    np.add.at(load, tail, ways[tail] / ways[head] * (1 + load[head]))
                load[first] = 0.0
                total += load.reshape(len(source), n).sum(axis=0)
        kept = np.flatnonzero(total)
        yield pd.DataFrame({"node": names[kept], "part": total[kept]})

    return run


def _small_searches(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, part): sources are dealt over tasks, each of which has the edges as arrays; the portions' sums meet by node."""
    spark = e.sparkSession
    table = e.select(F.col("src").cast("long"), F.col("dst").cast("long")).toArrow()
    src, dst = (table.column(k).to_numpy() for k in (0, 1))
    names = np.unique(np.concatenate([src, dst]))
    src, dst = np.searchsorted(names, src), np.searchsorted(names, dst)
    graph = spark.sparkContext.broadcast((names, np.searchsorted(np.sort(src), np.arange(len(names) + 1)), dst[np.argsort(src, kind="stable")]))
    dealt = sources.select(F.col("node").cast("long").alias("source")).repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.mapInPandas(_searched(graph, SEARCH_PLACES), "node long, part double")


def _joined_searches(e: DataFrame, sources: DataFrame, stages: Stages, depth: int) -> DataFrame:
    """(node, part): rows (source, node, ways) meet the edges level by level, and on the way back each level hands its dependencies to the one before."""
    levels = [stages.put(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("ways")), "level 0")]
    seen = levels[0].select("source", "node")
    while True:
        step = levels[-1].join(e, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
        level = stages.put(step.join(seen, ["source", "node"], "left_anti"), f"level {len(levels)}")
        if level.isEmpty():
            break
        if len(levels) > depth:
            raise RuntimeError(f"paths of more than {depth} edges")
        levels.append(level)
        seen = seen.unionByName(level.select("source", "node"))
    load, total = None, None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("load", F.lit(0.0)) if load is None else levels[k].join(load, ["source", "node"], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
        here = stages.put(here, f"load {k}")
        part = here.groupBy("node").agg(F.sum("load").alias("part"))
        total = part if total is None else total.unionByName(part)
        back = here.select("source", F.col("node").alias("dst"), ((1 + F.col("load")) / F.col("ways")).alias("each")).join(e, "dst")
        load = levels[k - 1].select("source", F.col("node").alias("src"), "ways").join(back, ["source", "src"]).groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("ways") * F.col("each")).alias("load"))
    return levels[0].select("node", F.lit(0.0).alias("part")) if total is None else total


def betweenness(edges: DataFrame, undirected_nodes: int, pivots: int | None = None, depth: int = 200) -> DataFrame:
    """(node, score), normalised, of a directed graph: the share of shortest paths between others that pass a node.

    Exact from all nodes as sources; with `pivots` from so many, those of smallest hash, and scaled up to all. Up to SEARCHED_EDGES edges and with numbers for nodes,
    the sources are dealt over tasks that have the edges. Else all searches of a share of the sources advance together by joins, so that no more than about JOINED_ROWS rows
    are held at once; there, a search that goes on beyond `depth` levels is an error. Time grows with sources times reached edges in both, so a large graph needs pivots.
    """
    stages = Stages(edges.sparkSession, "betweenness")
    e = stages.put(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    nodes = stages.put(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    sources, n = nodes, nodes.count()
    if pivots is not None and n > pivots:
        sources = stages.put(nodes.orderBy(F.xxhash64("node"), "node").limit(pivots), "sources")
    searches = min(n, pivots or n)
    every = sources.select("node", F.lit(0.0).alias("part"))
    if dict(e.dtypes)["src"] in ("int", "bigint") and e.count() <= SEARCHED_EDGES:
        every = every.unionByName(stages.put(_small_searches(e, sources), "parts")) if n else every
    else:
        shares = -(-searches * n // JOINED_ROWS)
        for k in range(shares):
            some = sources.where(F.pmod(F.xxhash64("node"), F.lit(shares)) == k)
            every = stages.put(every.unionByName(_joined_searches(e, some, stages, depth)).groupBy("node").agg(F.sum("part").alias("part")), "parts")
    scale = n / max(1, searches) / max(1, (undirected_nodes - 1) * (undirected_nodes - 2))
    out = stages.put(every.groupBy("node").agg((F.sum("part") * scale).alias("score")), "out")
    stages.close("out")
    return out


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) by label propagation: each round a node takes its neighbours' most frequent label, the smallest of several.

    A round's shuffle files, each as large as the edges, go once its labels are written, so that the disk holds no more of them as rounds go on.
    """
    e = durable(both_ways(edges))
    n = parts_for(e.sparkSession, e.count())
    label = durable(e.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    for _ in range(rounds):
        release(e.sparkSession)
        there = label.withColumnRenamed("node", "dst").repartition(n, "dst").hint("shuffle_hash")
        # dealt by node alone, so that the count of votes and the choice need no further shuffle
        votes = e.repartition(n, "dst").join(there, "dst").repartition(n, "src").groupBy("src", "community").agg(F.count("*").alias("votes"))
        label = durable(votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(-F.col("votes"), "community")).alias("x")).select("node", F.col("x.community").alias("community")))
    return label
