"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.storage import drop_written, materialize, materialize_counted


#: Edges of at most so many rows (2 MB) are one partition: there a step needs no shuffle.
FEW = 100_000


def _star(edges: DataFrame, n: int, large: bool) -> tuple[DataFrame, list[DataFrame], tuple]:
    """One step, what it wrote besides, and a digest of its edges. edges: n pairs v, w with v != w.

    A centre's minimum comes to all of its edges. Minima are written before they are joined: both sides
    then come from plain shuffles, so Spark can split the edges of a hot centre. FEW edges, as counted, go
    through one task without any shuffle."""
    few = n <= FEW
    both = edges.unionByName(edges.select(F.col("w").alias("v"), F.col("v").alias("w"))) if large else edges.select(F.greatest("v", "w").alias("v"), F.least("v", "w").alias("w"))
    both = both.coalesce(1) if few else both
    low = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
    low = low if few else materialize(low)
    near = both.join(F.broadcast(low) if few else low, "v")
    if large:
        out = near.filter(F.col("w") > F.col("v")).select(F.col("w").alias("v"), F.col("m").alias("w"))
    else:
        out = near.select(F.col("w").alias("v"), F.col("m").alias("w")).unionByName(low.select("v", F.col("m").alias("w")))
    out = out.coalesce(1) if few else out
    seen = Observation()
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)")).alias("h")]
    step = materialize(out.filter("v <> w").distinct().observe(seen, *mark), release=not few)
    return step, ([] if few else [low]), (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node that is reachable) of every node with an edge to another one.

    edges: two long columns. Self-loops are ignored."""
    v, w = edges.columns
    now, n = materialize_counted(edges.select(F.col(v).alias("v"), F.col(w).alias("w")).filter("v <> w").distinct())
    mark = None
    for _ in range(max_rounds if n else 0):
        half, low, (n, _) = _star(now, n, large=True)
        nxt, low2, seen = _star(half, n, large=False)
        drop_written(now, half, *low, *low2)
        now, n = nxt, seen[0]
        if seen == mark or not n:
            break
        mark = seen
    else:
        if n:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("w").alias("component")).unionByName(now.select(F.col("w").alias("node"), F.col("w").alias("component")).distinct())
