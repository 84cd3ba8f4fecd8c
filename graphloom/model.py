"""Property graphs as typed DataFrames.

A graph is a set of node tables and edge tables. A node table holds the nodes of one label set: `id`, `labels`
and typed properties. An edge table holds one edge type: `id`, `src`, `dst` and typed properties, with the labels
of its endpoints. An absent property is null. Graphs are immutable: writes give new ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class GraphError(Exception):
    """code: VALIDATION, NOT_FOUND, CONSTRAINT_VIOLATION, DETACH_REQUIRED, ROW_LIMIT, RUNTIME_ERROR or SEMANTIC_ERROR."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class NodeTable:
    source: DataFrame | Callable[[], DataFrame]  # a function is called when the table is first used
    labels: tuple[str, ...]  # that every row has
    optional: tuple[str, ...] = ()  # that some rows have, as their `labels` say

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) else self.source

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "labels")]


@dataclass(frozen=True)
class EdgeTable:
    source: DataFrame | Callable[[], DataFrame]
    type: str
    src_label: str | None = None
    dst_label: str | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) else self.source

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "src", "dst")]


@dataclass(frozen=True)
class Index:
    kind: str  # property, fulltext or unique
    label: str
    property: str


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass(frozen=True)
class PropertyGraph:
    nodes: dict[str, NodeTable]
    edges: dict[str, EdgeTable]
    indexes: frozenset[Index] = field(default_factory=frozenset)

    def scan(self, *labels: str) -> DataFrame:
        """Nodes that have all labels; every node without any."""
        frames = []
        for t in self.nodes.values():
            if all(x in t.labels or x in t.optional for x in labels):
                df = t.df
                for x in labels:
                    if x not in t.labels:
                        df = df.filter(F.array_contains("labels", x))
                frames.append(df)
        return union(frames) if frames else self._no_nodes()

    def _no_nodes(self) -> DataFrame:
        return union([t.df for t in self.nodes.values()]).filter(F.lit(False))

    def edge_tables(self, *types: str) -> list[EdgeTable]:
        """In the order given; a type given twice counts twice. All without any."""
        return [self.edges[t] for t in types if t in self.edges] if types else list(self.edges.values())

    def edge_frame(self, *types: str, props: bool = True) -> DataFrame:
        """id, type, src, dst and, if asked for, properties."""
        frames = [t.df.select("id", F.lit(t.type).alias("type"), "src", "dst", *(t.props if props else ())) for t in self.edge_tables(*types)]
        if not frames:
            some = next(iter(self.edges.values())).df
            return some.select("id", F.lit("").alias("type"), "src", "dst").filter(F.lit(False))
        return union(frames)

    def node(self, node_id: int) -> Row | None:
        return self.scan().filter(F.col("id") == node_id).first()

    def edge(self, kind: str, edge_id: int) -> Row | None:
        return self.edges[kind].df.filter(F.col("id") == edge_id).first() if kind in self.edges else None

    def stats(self) -> DataFrame:
        """kind (node or edge), name of the table, n."""
        parts = [(k, n, t.df) for k, tables in (("node", self.nodes), ("edge", self.edges)) for n, t in tables.items()]
        return union([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), F.lit(n).alias("name"), "n") for k, n, df in parts])

    def with_index(self, kind: str, label: str, prop: str) -> PropertyGraph:
        new = Index(kind, label, prop)
        if new in self.indexes:
            raise GraphError("VALIDATION", f"{kind} index on :{label}({prop}) exists")
        if kind == "unique" and (bad := self.violations(new).head()):
            raise GraphError("CONSTRAINT_VIOLATION", f":{label}({prop}) repeats {bad['value']!r}")
        return replace(self, indexes=self.indexes | {new})

    def without_index(self, kind: str, label: str, prop: str) -> PropertyGraph:
        old = Index(kind, label, prop)
        if old not in self.indexes:
            raise GraphError("NOT_FOUND", f"no {kind} index on :{label}({prop})")
        return replace(self, indexes=self.indexes - {old})

    def require_index(self, kinds: tuple[str, ...], label: str, prop: str) -> None:
        if not any(Index(k, label, prop) in self.indexes for k in kinds):
            raise GraphError("NOT_FOUND", f"no index on :{label}({prop})")

    def show_indexes(self, spark) -> DataFrame:
        rows = sorted((i.kind, i.label, i.property) for i in self.indexes if i.kind != "unique")
        return spark.createDataFrame(rows, "kind string, label string, property string")

    def show_constraints(self, spark) -> DataFrame:
        rows = sorted((i.kind, i.label, i.property) for i in self.indexes if i.kind == "unique")
        return spark.createDataFrame(rows, "kind string, label string, property string")

    def violations(self, unique: Index) -> DataFrame:
        """value, n of property values that a unique constraint forbids; nulls and arrays are exempt."""
        df = self.scan(unique.label)
        if unique.property not in df.columns or df.schema[unique.property].dataType.typeName() == "array":
            return df.select(F.lit("").alias("value"), F.lit(0).cast("long").alias("n")).filter(F.lit(False))
        return df.filter(F.col(unique.property).isNotNull()).groupBy(F.col(unique.property).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    def check(self) -> DataFrame:
        """problem, n: ids that repeat and edges without an endpoint."""
        ids, edges = self.scan().select("id"), self.edge_frame(props=False)
        repeated = ids.groupBy("id").count().filter("count > 1").select(F.lit("repeated node id").alias("problem"))
        lost = [edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select(F.lit(f"edge without {end}").alias("problem")) for end in ("src", "dst")]
        return union([repeated, *lost]).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
