"""Degree, PageRank and betweenness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.model import GraphError, PropertyGraph, union
from graphloom.operators.common import algo_edges, dense_index
from graphloom.storage import drop_written, materialize, materialize_counted


def degree(graph: PropertyGraph, direction: str = "both", *types: str) -> DataFrame:
    """node, score; a self-loop counts twice in both directions, and nodes without edges are in."""
    edges = algo_edges(graph, *types)
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    counts = union([edges.select(F.col(e).alias("node")) for e in ends]).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    nodes = graph.scan().select(F.col("id").alias("node"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("score"))


def pagerank(graph: PropertyGraph, damping: float = 0.85, iterations: int = 20, *types: str, labels: tuple[str, ...] = (), keep_every: int = 10) -> DataFrame:
    """node, score after a fixed number of rounds; parallel edges weigh by their number, and what
    reaches nodes without an edge out goes to all nodes alike.

    A round shuffles one row for each node that is linked to, combined before: links and nodes are shuffled
    once for the rounds of a job, as Spark reuses their exchanges. Without dangling nodes keep_every rounds
    are one job; with them each round is one, which also sums up what they lose."""
    if not 0 < damping < 1 or iterations < 1:
        raise GraphError("VALIDATION", "damping has to be between 0 and 1, iterations at least 1")
    nodes = graph.scan(*labels).select(F.col("id").alias("node"))
    links = algo_edges(graph, *types).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    out = links.groupBy("src").agg(F.sum("m").alias("out"))
    links = materialize(links.join(out, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("share")))
    nodes = materialize(nodes.join(out.select(F.col("src").alias("node"), F.lit(True).alias("linked")), "node", "left").select("node", F.col("linked").isNull().alias("dangling")))
    n, dangling = nodes.agg(F.count(F.lit(1)), F.count_if("dangling")).first()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    ranks, lost = nodes.withColumn("score", F.lit(1.0 / n)), dangling / n
    for i in range(1, iterations + 1):
        given = links.join(ranks.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)
        ranks = nodes.join(given, "node", "left").select("node", "dangling", score.alias("score"))
        if dangling and i < iterations:
            seen = Observation()
            ranks = materialize(ranks.observe(seen, F.sum(F.when(F.col("dangling"), F.col("score"))).alias("lost")))
            lost = seen.get["lost"]
        elif i % keep_every == 0 and i < iterations:
            ranks = materialize(ranks)
    ranks = materialize(ranks.select("node", "score"))
    drop_written(links, nodes)
    return ranks


def betweenness(graph: PropertyGraph, sample: int | None = None, *types: str, guard: int = 2000) -> DataFrame:
    """node, score: Brandes' algorithm, directed and unweighted, for all sources at once, level by
    level. With `sample`, k sources spread over the ids stand for all. The work has a row for each source and
    node that it reaches, so over `guard` nodes an exact run is an error: ask for a sample, or raise the guard."""
    ids = graph.scan().select(F.col("id").alias("node"))
    edges = materialize(algo_edges(graph, *types).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")))
    n = ids.count()
    sources, scale = ids.select(F.col("node").alias("s")), 1.0
    if sample is not None and 0 < sample < n:
        wanted = sorted({i * n // sample for i in range(sample)})  # `sample` numbers
        sources = dense_index(ids, "node", "at").filter(F.col("at").isin(wanted)).select(F.col("node").alias("s"))
        scale = n / sample
    elif sample is not None and sample < 1:
        raise GraphError("VALIDATION", "a sample has at least one source")
    elif n > guard and sample is None:
        raise GraphError("ROW_LIMIT", f"{n} nodes, more than {guard}")
    levels = [materialize(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")))]
    seen = levels[0].select("s", "v")
    while True:
        reached = levels[-1].join(edges, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum(F.col("paths") * F.col("m")).alias("paths"))
        level, n_level = materialize_counted(reached.join(seen, ["s", "v"], "left_anti"))
        if not n_level:
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "v"))
    parts = []
    below = None
    for level in reversed(levels):
        if below is None:
            below = level.withColumn("delta", F.lit(0.0))
        else:
            nxt = below.select("s", F.col("v").alias("dst"), F.col("paths").alias("p2"), F.col("delta").alias("d2"))
            share = level.join(edges, F.col("v") == F.col("src")).join(nxt, ["s", "dst"]).groupBy("s", "v").agg(F.sum(F.col("m") * F.col("paths") / F.col("p2") * (1 + F.col("d2"))).alias("delta"))
            below = materialize(level.join(share, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        parts.append(below.filter("s <> v").select("v", "delta"))
    sums = union(parts).groupBy(F.col("v").alias("node")).agg((F.sum("delta") * scale).alias("score"))
    return ids.join(sums, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))
