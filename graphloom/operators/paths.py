"""Reachability, shortest paths, topological order and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.model import GraphError, PropertyGraph, union
from graphloom.operators.common import algo_edges, dense_index, need_node
from graphloom.operators.components import strong_components
from graphloom.plans.match import guarded
from graphloom.storage import drop_written, materialize, materialize_counted


def bfs(graph: PropertyGraph, start: int, *types: str, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """node, depth: least number of hops; the start is at 0. A level is one job: the edges are only
    joined with the nodes of the last level, and what was seen is not read again but by the anti join."""
    need_node(graph, start)
    edges = algo_edges(graph, *types).select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = materialize({"out": edges, "in": back, "both": edges.unionByName(back)}[direction].distinct())
    level = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"))
    seen, depth, n, held = level, 0, 1, []
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        reached = edges.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        level, n = materialize_counted(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if n:
            held.append(level)
            seen = seen.unionByName(level)
        if len(held) == 16:  # one table for the levels so far, so that no plan grows with the depth
            seen = materialize(seen)
            drop_written(*held)
            held = []
            level = seen.filter(F.col("depth") == depth)
    return seen


def shortest_path(graph: PropertyGraph, start: int, goal: int, *types: str, weight: str | None = None, within: float | None = None) -> DataFrame:
    """path (nodes, edges), cost; no row if the goal is out of reach. Of equal paths the one of least ids.
    within: a question of its own, for the paths that leave no node at that cost or more."""
    need_node(graph, start)
    need_node(graph, goal)
    edges = materialize(algo_edges(graph, *types, weight=weight) if weight else algo_edges(graph, *types).withColumn("w", F.lit(1.0)))
    if weight and not edges.filter("w < 0").isEmpty():
        raise GraphError("VALIDATION", "negative weight")
    best = edges.sparkSession.createDataFrame([(start, 0.0, [start], [])], "node long, cost double, nodes array<long>, edges array<long>")
    frontier = best
    while True:
        if within is not None:
            frontier = frontier.filter(F.col("cost") < within)
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edges", F.col("id")).alias("edges"))
        # No path beyond the goal's cost so far can be part of the shortest one.
        bound = best.filter(F.col("node") == goal).agg(F.min("cost")).first()[0]
        if bound is not None:
            step = step.filter(F.col("cost") < bound)
        step = step.groupBy("node").agg(F.min(F.struct("cost", "nodes", "edges")).alias("s")).select("node", "s.*")
        old = best.select("node", F.col("cost").alias("old"))
        frontier, n = materialize_counted(step.join(old, "node", "left").filter("old is null or cost < old").drop("old"))
        if not n:
            break
        best = materialize(best.join(frontier.select("node"), "node", "left_anti").unionByName(frontier))
    return best.filter(F.col("node") == goal).select(F.struct("nodes", "edges").alias("path"), "cost")


def all_shortest_paths(graph: PropertyGraph, start: int, goal: int, *types: str, most: int | None = None, max_hops: int | None = None) -> DataFrame:
    """path, cost of every path of least hops, parallel edges apart, in the order of ids. More than `most`
    paths are an error; they are counted, level by level, before any is made. max_hops: a question of its
    own, for the paths of at most so many hops; a goal farther away has none."""
    depths = bfs(graph, start, *types, max_depth=max_hops)
    need_node(graph, goal)
    end = depths.filter(F.col("node") == goal).first()
    spark = depths.sparkSession
    edges = algo_edges(graph, *types)
    hops = end["depth"] if end else 0
    # The edges between levels, from the goal back: only those on a shortest path, with the number of paths that go on.
    after = spark.createDataFrame([(goal, 1)] if end else [], "node long, ways long")
    steps = []
    for d in range(hops - 1, -1, -1):
        before = depths.filter(F.col("depth") == d).select(F.col("node").alias("src"))
        step = materialize(edges.join(before, "src").join(after, F.col("dst") == F.col("node")).select("id", "src", "dst", "ways"))
        steps.append(step)
        after = step.groupBy(F.col("src").alias("node")).agg(F.sum("ways").alias("ways"))
    n = after.agg(F.coalesce(F.sum("ways"), F.lit(0))).first()[0]
    if most is not None and n > most:
        raise GraphError("ROW_LIMIT", f"{n} paths, more than {most}")
    paths = spark.createDataFrame([(start, [start], [])] if end else [], "node long, nodes array<long>, edges array<long>")
    for step in reversed(steps):
        paths = paths.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edges", F.col("id")).alias("edges"))
    return paths.orderBy("nodes", "edges").select(F.struct("nodes", "edges").alias("path"), F.size("edges").cast("double").alias("cost"))


def topo_sort(graph: PropertyGraph, *types: str, labels: tuple[str, ...] = ()) -> DataFrame:
    """node, order: by level, then id. A level's nodes have all edges in from earlier levels, so the order is a
    valid one, though not the one that takes the least ready node at each step: that goes node by node."""
    nodes = graph.scan(*labels).select(F.col("id").alias("node"))
    edges = materialize(algo_edges(graph, *types).select("src", "dst").distinct())
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    # A round is one job: it writes the nodes that are left, with the edges still open into them.
    now = nodes.join(into, "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open"))
    levels: list[DataFrame] = []
    while True:
        seen = Observation()
        now = materialize(now.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("open") == 0).alias("ready")))
        if not seen.get["n"]:
            break
        if not seen.get["ready"]:
            raise GraphError("VALIDATION", "the graph has a cycle")
        ready = now.filter("open = 0").select("node")
        levels.append(ready.withColumn("level", F.lit(len(levels))))
        closed = edges.join(ready.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("closed"))
        now = now.filter("open > 0").join(closed, "node", "left").select("node", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open"))
    if not levels:
        return nodes.select("node", F.lit(0).cast("long").alias("order"))
    ranked = union(levels).withColumn("key", F.struct("level", "node"))
    return dense_index(ranked, "key", "order").select("key.node", "order")


def cycles(graph: PropertyGraph, *types: str, limit: int | None = None) -> DataFrame:
    """cycle: every self-loop, and of each strong component of several nodes a shortest cycle through its
    least node, in the order of ids; none if and only if the graph has none. More than `limit` are an error."""
    edges = materialize(algo_edges(graph, *types).select("src", "dst").distinct())
    loops = edges.filter("src = dst").select(F.array("src").alias("cycle"))
    part = materialize(strong_components(graph, *types))
    big = part.groupBy("component").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    inside = part.join(big, "component").select("node", "component", "root")
    ends = [inside.select(F.col("node").alias(e), F.col("component").alias(f"c_{e}")) for e in ("src", "dst")]
    edges = materialize(edges.filter("src <> dst").join(ends[0], "src").join(ends[1], "dst").filter("c_src = c_dst").select("src", "dst"))
    walk = materialize(big.select("root", F.col("root").alias("node"), F.array("root").alias("path")))
    seen, found = walk.select("root", "node"), [loops]
    n = 1
    while n:
        step = materialize(walk.join(edges, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.min("path").alias("path")))
        closed = step.filter("root = node").select("root", F.col("path").alias("cycle"))
        found.append(closed.select("cycle"))
        going = step.join(seen, ["root", "node"], "left_anti").join(closed, "root", "left_anti")
        walk, n = materialize_counted(going.select("root", "node", F.array_append("path", F.col("node")).alias("path")))
        seen = seen.unionByName(walk.select("root", "node"))
    found = union(found)
    return (guarded(found, limit) if limit is not None else found).orderBy("cycle")
