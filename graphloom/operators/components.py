"""Weak and strong components, and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.model import GraphError, PropertyGraph
from graphloom.operators.common import algo_edges, dense_index
from graphloom.operators.connected import connected_components
from graphloom.storage import drop_written, materialize, materialize_counted


def _numbered(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """node, component: roots numbered from 0 in the order of their ids; nodes that were not found are their own."""
    roots = materialize(nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    return roots.join(dense_index(roots, "root", "component"), "root").select("node", "component")


def weak_components(graph: PropertyGraph, *types: str, labels: tuple[str, ...] = ()) -> DataFrame:
    nodes = graph.scan(*labels).select(F.col("id").alias("node"))
    found = connected_components(algo_edges(graph, *types).select("src", "dst"))
    return _numbered(nodes, found.withColumnRenamed("component", "root"))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each node along the edges. labels: node, c. Only labels that changed are sent on."""
    front = labels
    while True:
        sent = edges.join(front.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("got"))
        seen = Observation()
        nxt = labels.join(sent, "node", "left").select("node", F.least("c", F.coalesce("got", "c")).alias("c"), F.coalesce(F.col("got") < F.col("c"), F.lit(False)).alias("moved"))
        nxt = materialize(nxt.observe(seen, F.count_if("moved").alias("n")))
        if not seen.get["n"]:
            return nxt.drop("moved")
        labels, front = nxt.drop("moved"), nxt.filter("moved").drop("moved")


def strong_components(graph: PropertyGraph, *types: str, labels: tuple[str, ...] = ()) -> DataFrame:
    """Trimming and forward-backward colouring (Orzan 2004): a colour spreads forward from the least
    node that reaches a place; what reaches its root backward inside the colour is a component."""
    nodes = graph.scan(*labels).select(F.col("id").alias("node"))
    edges, n = materialize_counted(algo_edges(graph, *types).filter("src <> dst").select("src", "dst").distinct())
    done = None
    while n:
        # Nodes without an edge in or out are alone; edges at them go.
        while True:
            both = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            ends = [both.withColumnRenamed("node", e) for e in ("src", "dst")]
            edges, kept = materialize_counted(edges.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst"))
            if kept == n:
                break
            n = kept
        if not n:
            break
        live = edges.select(F.col("src").alias("node")).distinct()
        colour = _spread(edges, materialize(live.withColumn("c", F.col("node"))))
        ends = [colour.select(F.col("node").alias(e), F.col("c").alias(f"c_{e}")) for e in ("src", "dst")]
        coloured = materialize(edges.join(ends[0], "src").join(ends[1], "dst").filter("c_src = c_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = _spread(coloured, materialize(colour.select("node", F.when(F.col("node") == F.col("c"), F.col("c")).otherwise(F.lit(2**63 - 1)).alias("c"))))
        found = materialize(back.filter(F.col("c") < 2**63 - 1).select("node", F.col("c").alias("root")))
        done = found if done is None else done.unionByName(found)
        gone = [found.select(F.col("node").alias(e)) for e in ("src", "dst")]
        edges, n = materialize_counted(edges.join(gone[0], "src", "left_anti").join(gone[1], "dst", "left_anti").select("src", "dst"))
    if done is None:
        done = nodes.select("node", F.col("node").alias("root")).limit(0)
    return _numbered(nodes, done)


def louvain(graph: PropertyGraph, max_levels: int = 10, *types: str, labels: tuple[str, ...] = (), max_rounds: int = 500, gain: float = 1e-3) -> DataFrame:
    """node, community: Blondel et al. (2008), undirected, weight 1 an edge. Nodes move in parallel, in
    turns by a coin of node and round so that neighbours do not swap. A level ends when nobody wants to move in
    two turns running, or once two turns, in which every node had its own, raise modularity by less than
    `gain`, and gives its best partition; so it has at most 2 / gain + 4 rounds on any graph, and a partition that
    got worse by moves at one time is not kept. gain=0 goes on as long as it grows (more than max_rounds are an
    error). Levels end when modularity does not grow by `gain` either. The partition is as valid as that of moves one by one, but need not be the same."""
    nodes = graph.scan(*labels).select(F.col("id").alias("node"))
    raw = algo_edges(graph, *types).select("src", "dst")
    now = materialize(raw.unionByName(raw.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    two_m = now.agg(F.sum("w")).first()[0]
    member = materialize(nodes.select("node", F.col("node").alias("c")))
    if two_m:
        last = -1.0
        for _ in range(max_levels):
            part = _move(now, two_m, max_rounds, gain)
            ends = [part.select(F.col("node").alias(e), F.col("c").alias(f"c_{e}")) for e in ("src", "dst")]
            merged = materialize(now.join(ends[0], "src").join(ends[1], "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w")))
            total = merged.groupBy("src").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("own"))
            quality = total.agg(F.sum(F.col("own") / two_m - (F.col("k") / two_m) ** 2)).first()[0]
            if quality <= last + 1e-12:
                break
            small, last = quality < last + gain, quality
            member = materialize(member.join(part.select(F.col("node").alias("c"), F.col("c").alias("to")), "c", "left").select("node", F.coalesce("to", "c").alias("c")))
            if small:
                break
            now = merged
    least = member.groupBy("c").agg(F.min("node").alias("root"))
    return _numbered(nodes, member.join(least, "c").select("node", "root")).withColumnRenamed("component", "community")


def _move(edges: DataFrame, two_m: float, max_rounds: int, gain: float) -> DataFrame:
    """node, c after rounds of local moves: of the partitions seen, the one of most modularity."""
    strength = materialize(edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    part = best_part = materialize(strength.select("node", "k", F.col("node").alias("c")))
    near = materialize(edges.filter("src <> dst").select(F.col("src").alias("node"), "dst", "w"))
    quiet, known = 0, []
    for i in range(max_rounds):
        total = part.groupBy("c").agg(F.sum("k").alias("total"))
        links = near.join(part.select(F.col("node").alias("dst"), F.col("c").alias("to")), "dst").select("node", "to", "w")
        own = part.select("node", F.col("c").alias("to"), F.lit(0.0).alias("w"))
        options = links.unionByName(own).groupBy("node", "to").agg(F.sum("w").alias("w")).join(total.withColumnRenamed("c", "to"), "to").join(part, "node")
        here = F.col("to") == F.col("c")
        rest = F.col("total") - F.when(here, F.col("k")).otherwise(0.0)
        worth = F.round(F.col("w") - F.col("k") * rest / two_m, 12)
        # A node's share in the modularity before the round, but for self-loops, which stay as they are.
        share = F.max(F.when(here, F.col("w") / two_m - F.col("k") * F.col("total") / two_m**2))
        best = options.groupBy("node").agg(F.max(F.struct(worth.alias("g"), (-F.col("to")).alias("to"))).alias("best"), F.max(F.when(here, worth)).alias("stay"), share.alias("share"))
        turn = F.pmod(F.xxhash64("node", F.lit(i // 2)), F.lit(2)) == i % 2
        moves = (F.col("best.g") > F.col("stay") + 1e-12) & turn
        nxt = part.join(best, "node", "left").select("node", "k", F.when(moves, -F.col("best.to")).otherwise(F.col("c")).alias("c"), F.coalesce(moves, F.lit(False)).alias("moved"), "share")
        seen = Observation()
        nxt = materialize(nxt.observe(seen, F.count_if("moved").alias("n"), F.sum("share").alias("q")).drop("share")).drop("moved")
        known.append(seen.get["q"])
        # What is neither the best one so far nor the last one is read no more.
        old = part
        if known[-1] == max(known):
            old, best_part = best_part, part
        if old is not best_part:
            drop_written(old)
        quiet = 0 if seen.get["n"] else quiet + 1
        if quiet == 2 or i >= 2 and i % 2 == 0 and known[-1] - known[-3] < gain:
            return best_part.select("node", "c")
        part = nxt
    raise GraphError("RUNTIME_ERROR", f"nodes still move after {max_rounds} rounds")
