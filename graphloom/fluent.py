"""Lazy traversals: every step is a new wrapper over a DataFrame of records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import Value, column, value
from graphloom.model import GraphError, PropertyGraph, union
from graphloom.operators.fulltext import search as fulltext_search


class Record:
    """r.name is property `name` of a record, with its type; null if no record has it."""

    def __init__(self, df: DataFrame):
        self._types = {f.name: f.dataType for f in df.schema}

    def __getattr__(self, prop: str) -> Value:
        if prop.startswith("_"):
            raise AttributeError(prop)
        return column(F.col(prop), self._types[prop]) if prop in self._types else value(None)


@dataclass(frozen=True)
class Traversal:
    """graph().nodes("Person").out("WROTE").where(...).dedup(). Records are columns: id, labels or type, and
    properties. Hops do not drop repeats; with route=True each record carries the way it came."""

    graph: PropertyGraph
    df: DataFrame
    edges: bool = False  # are the records edges
    types: tuple[str, ...] = ()  # of the edges; all without any

    def _with(self, df: DataFrame, edges: bool | None = None) -> Traversal:
        return Traversal(self.graph, df, self.edges if edges is None else edges, self.types)

    # Sources
    @staticmethod
    def nodes(graph: PropertyGraph, *labels: str, route: bool = False) -> Traversal:
        return Traversal(graph, _routed(graph.scan(*labels), route))

    @staticmethod
    def node(graph: PropertyGraph, node_id: int, route: bool = False) -> Traversal:
        return Traversal(graph, _routed(graph.scan().filter(F.col("id") == node_id), route))

    @staticmethod
    def nodes_where(graph: PropertyGraph, label: str, prop: str, exact: object = None, route: bool = False, **bounds) -> Traversal:
        """By an index: an exact value, or gt, gte, lt, lte, which give records ordered by value and id. A value of another
        type than the property's equals none and is neither more nor less."""
        graph.require_index(("property", "unique"), label, prop)
        df = graph.scan(label)
        mine = column(F.col(prop), df.schema[prop].dataType) if prop in df.columns else value(None)
        if exact is not None:
            return Traversal(graph, _routed(df.filter((mine == exact).filter()), route))
        tests = {"gt": lambda x: mine > x, "gte": lambda x: mine >= x, "lt": lambda x: mine < x, "lte": lambda x: mine <= x}
        for k, x in bounds.items():
            df = df.filter(tests[k](x).filter())
        return Traversal(graph, _routed(df.filter(F.col(prop).isNotNull()).orderBy(prop, "id"), route))

    @staticmethod
    def search(graph: PropertyGraph, label: str, prop: str, query: str, prefix: bool = False) -> Traversal:
        graph.require_index(("fulltext",), label, prop)
        return Traversal(graph, fulltext_search(graph.scan(label), prop, query, prefix))

    # Steps
    def where(self, condition: Column | Callable[[Record], Value]) -> Traversal:
        """A function of the record compares as match() does, strict in type: where(lambda r: r.born > 1800).
        A Column is Spark's, with its casts."""
        return self._with(self.df.filter(condition(Record(self.df)).filter() if callable(condition) and not isinstance(condition, Column) else condition))

    def _labels(self, *types: str, ends: tuple[str, ...]) -> tuple[str, ...] | None:
        """The labels that nodes at these ends of the edges have, as far as the types say: only their tables are read."""
        tables = self.graph.edge_tables(*types)
        found = {t.src_label if e == "src" else t.dst_label for t in tables for e in ends}
        return None if None in found or not found else tuple(sorted(found))

    def _far_nodes(self, *types: str, ends: tuple[str, ...]) -> DataFrame:
        labels = self._labels(*types, ends=ends)
        if labels is None:
            return self.graph.scan()
        # A table counts once, if any of the labels may be in it.
        tables = [t.df for t in self.graph.nodes.values() if any(x in t.labels or x in t.optional for x in labels)]
        return union(tables) if tables else self.graph.scan()

    def _ends(self, *types: str, direction: str) -> DataFrame:
        e = self.graph.edge_frame(*types, props=False)
        out = e.select(F.col("src").alias("_near"), F.col("dst").alias("_far"), F.col("id").alias("_edge"))
        back = e.select(F.col("dst").alias("_near"), F.col("src").alias("_far"), F.col("id").alias("_edge"))
        return {"out": out, "in": back, "both": out.unionByName(back)}[direction]

    def _hop(self, *types: str, direction: str) -> Traversal:
        if self.edges:
            raise GraphError("SEMANTIC_ERROR", "a hop starts from nodes")
        keep = [c for c in self.df.columns if c.startswith("_r")]
        here = self.df.select(F.col("id").alias("_here"), *keep)
        step = here.join(self._ends(*types, direction=direction), F.col("_here") == F.col("_near")).drop("_here", "_near")
        if keep:
            step = step.withColumns({"_r_nodes": F.array_append("_r_nodes", F.col("_far")), "_r_edges": F.array_append("_r_edges", F.col("_edge"))})
        ends = {"out": ("dst",), "in": ("src",), "both": ("src", "dst")}[direction]
        nodes = self._far_nodes(*types, ends=ends)
        return self._with(step.join(nodes, F.col("_far") == nodes["id"]).drop("_far", "_edge"))

    def out(self, *types: str) -> Traversal:
        return self._hop(*types, direction="out")

    def in_(self, *types: str) -> Traversal:
        return self._hop(*types, direction="in")

    def both(self, *types: str) -> Traversal:
        """A self-loop counts from either end."""
        return self._hop(*types, direction="both")

    def _to_edges(self, *types: str, end: str) -> Traversal:
        e = self.graph.edge_frame(*types)
        found = e.join(self.df.select(F.col("id").alias("_here")), F.col(end) == F.col("_here")).drop("_here")
        return Traversal(self.graph, found, True, types)

    def out_edges(self, *types: str) -> Traversal:
        return self._to_edges(*types, end="src")

    def in_edges(self, *types: str) -> Traversal:
        return self._to_edges(*types, end="dst")

    def _to_nodes(self, end: str) -> Traversal:
        if not self.edges:
            raise GraphError("SEMANTIC_ERROR", "only edges have ends")
        nodes = self._far_nodes(*self.types, ends=(end,))
        return self._with(self.df.select(F.col(end).alias("_far")).join(nodes, F.col("_far") == nodes["id"]).drop("_far"), False)

    def from_node(self) -> Traversal:
        return self._to_nodes("src")

    def to_node(self) -> Traversal:
        return self._to_nodes("dst")

    def dedup(self) -> Traversal:
        return self._with(self.df.dropDuplicates(["id"]))

    def order(self, *keys: Column | str) -> Traversal:
        return self._with(self.df.orderBy(*keys))

    def limit(self, n: int) -> Traversal:
        return self._with(self.df.limit(n))

    def skip(self, n: int) -> Traversal:
        return self._with(self.df.offset(n))

    # Ends
    def paths(self) -> DataFrame:
        """nodes, edges: the ids along the way. The source has to be routed."""
        return self.df.select(F.col("_r_nodes").alias("nodes"), F.col("_r_edges").alias("edges"))

    def first(self):
        return self.df.first()

    def stream(self):
        """Rows one by one, a partition at a time at the driver."""
        return self.df.toLocalIterator()

    def agg(self, **aggregates: Column) -> DataFrame:
        return self.df.agg(*(c.alias(k) for k, c in aggregates.items()))

    def count(self) -> int:
        return self.df.count()


def _routed(df: DataFrame, route: bool) -> DataFrame:
    return df.withColumns({"_r_nodes": F.array("id"), "_r_edges": F.array().cast("array<long>")}) if route else df
