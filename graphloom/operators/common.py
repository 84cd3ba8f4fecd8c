"""Numbering and loops shared by the graph algorithms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import GraphError, PropertyGraph
from graphloom.storage import materialize


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys numbered from 0 in their order: a range sort, and offsets by partition; no single task sees all rows."""
    rows = df.select(key).distinct()
    rows = materialize(rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offset, before = F.lit(0).cast("long"), 0
    for p, n in sizes:
        offset, before = F.when(part == p, F.lit(before)).otherwise(offset), before + n
    return rows.select(key, (F.col("_at").bitwiseAND((1 << 33) - 1) + offset).alias(name))


def algo_edges(graph: PropertyGraph, *types: str, weight: str | None = None) -> DataFrame:
    """id, src, dst and, if asked for, w: a missing weight, or one that is no number, counts 1."""
    df = graph.edge_frame(*types, props=weight is not None)
    if weight is None:
        return df.select("id", "src", "dst")
    w: Column = F.lit(1.0)
    if weight in df.columns and df.schema[weight].dataType.typeName() in ("integer", "long", "double", "float", "short", "byte"):
        w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    return df.select("id", "src", "dst", w.alias("w"))


def need_node(graph: PropertyGraph, node_id: int) -> None:
    if graph.scan().filter(F.col("id") == node_id).isEmpty():
        raise GraphError("NOT_FOUND", f"no node {node_id}")
