"""Whole-graph shapes: visibility, merging, display labels, caps."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import EdgeTable, NodeTable, PropertyGraph, union

#: A node is shown by the first of these properties that it has.
DISPLAY = ("name", "title", "label", "username", "id")


def _inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def visible(graph: PropertyGraph, hidden_labels: tuple[str, ...] = (), hidden_types: tuple[str, ...] = ()) -> PropertyGraph:
    """Without nodes of hidden labels, edges of hidden types and edges that would dangle."""
    hidden = F.array(*map(F.lit, hidden_labels)).cast("array<string>")
    nodes = {k: replace(t, source=t.df.filter(~F.arrays_overlap("labels", hidden)) if set(hidden_labels) & {*t.labels, *t.optional} else t.df) for k, t in graph.nodes.items()}
    shown = PropertyGraph(nodes, graph.edges, graph.indexes)
    ids = shown.scan().select("id")
    edges = {k: replace(t, source=_inside(t.df, ids).select(*t.df.columns)) for k, t in graph.edges.items() if k not in hidden_types}
    return replace(shown, edges=edges)


def merged(first: PropertyGraph, second: PropertyGraph) -> PropertyGraph:
    """Both graphs by id: of a node or edge that both have, the second's record counts; dangling edges go."""

    def both(a, b):
        if a is None or b is None:
            return a or b
        kept = a.df.join(b.df.select("id"), "id", "left_anti")
        return replace(a, source=b.df.unionByName(kept, allowMissingColumns=True))

    nodes: dict[str, NodeTable] = {k: both(first.nodes.get(k), second.nodes.get(k)) for k in {**first.nodes, **second.nodes}}
    edges: dict[str, EdgeTable] = {k: both(first.edges.get(k), second.edges.get(k)) for k in {**first.edges, **second.edges}}
    out = PropertyGraph(nodes, edges, first.indexes | second.indexes)
    ids = out.scan().select("id")
    return replace(out, edges={k: replace(t, source=_inside(t.df, ids).select(*t.df.columns)) for k, t in edges.items()})


def records(df: DataFrame, *variables: str) -> DataFrame:
    """The distinct nodes or edges that columns v__id, v__labels, v__prop of a match hold."""
    parts = []
    for v in variables:
        own = [c for c in df.columns if c.startswith(f"{v}__")]
        parts.append(df.select(*(F.col(c).alias(c.partition("__")[2]) for c in own)))
    return union(parts).filter("id is not null").dropDuplicates(["id"])


def display_label(df: DataFrame) -> Column:
    """The first display property of a node, else #id."""
    own = [F.col(c).cast("string") for c in DISPLAY if c in df.columns and c != "id"]
    return F.coalesce(*own, F.concat(F.lit("#"), F.col("id").cast("string")))


def capped(df: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The first n nodes by id, and how many there are."""
    return df.orderBy("id").limit(n), df.count()
