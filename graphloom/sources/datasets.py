"""Synthetic graphs for measurements."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.model import EdgeTable, NodeTable, PropertyGraph


def synthetic(spark: SparkSession, nodes: int, edges: int, seed: int = 42, label: str = "Entity", kind: str = "LINKS") -> PropertyGraph:
    """Entities with a name and a weight. Sources are skewed towards small ids (the square of a uniform number), so
    there are hubs; targets are uniform; repeated edges and self-loops occur. Rows are made where they are used."""
    coin = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    n = spark.range(nodes).select("id", F.array(F.lit(label)).alias("labels"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), coin(1).alias("weight"))
    e = spark.range(edges).select("id", F.floor(coin(2) * coin(2) * nodes).alias("src"), F.floor(coin(3) * nodes).alias("dst"), coin(4).alias("weight"))
    return PropertyGraph({label: NodeTable(n, (label,))}, {kind: EdgeTable(e, kind, label, label)})
