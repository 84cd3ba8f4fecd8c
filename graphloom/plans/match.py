"""Pattern matching as joins.

A path alternates node() and hop(). A fixed hop is an equi-join with an edge table and, unless the
target node is not fetched, with its node table; paths may reuse edges. A variable hop is unrolled
into joins that carry the edges used so far, one row for each path that repeats no edge. Variables
bind flat columns `v__id`, `v__labels`, `v__prop`, so Catalyst prunes what is not used and pushes
filters into the scans.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import Aggregate, Value, column, value
from graphloom.model import GraphError, PropertyGraph, union
from graphloom.storage import materialize

MAX_HOPS = 15


@dataclass(frozen=True)
class NodePattern:
    var: str
    labels: tuple[str, ...]
    props: dict
    fetch: bool


@dataclass(frozen=True)
class HopPattern:
    types: tuple[str, ...]
    direction: str
    var: str | None
    least: int | None
    most: int | None


def node(var: str, *labels: str, fetch: bool = True, **props) -> NodePattern:
    """A node of all labels whose properties have these values. fetch=False binds its id only, and
    its labels are then taken from the edge type, which saves a join, also at the start of a path."""
    return NodePattern(var, labels, props, fetch)


def hop(*types: str, direction: str = "out", var: str | None = None, least: int | None = None, most: int | None = None) -> HopPattern:
    """An edge of any of the types; or, with least or most, a chain of edges."""
    if least is not None or most is not None:
        least, most = 1 if least is None else least, 8 if most is None and least is None else most
        most = least if most is None else most
        if not 1 <= least <= most <= MAX_HOPS:
            raise GraphError("SEMANTIC_ERROR", f"hops have to be in 1..{MAX_HOPS}")
        if var:
            raise GraphError("SEMANTIC_ERROR", "a chain of edges has no variable")
    if direction not in ("out", "in", "both"):
        raise GraphError("SEMANTIC_ERROR", f"no direction: {direction}")
    return HopPattern(types, direction, var, least, most)


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges with `near` and `far` ends. Undirected: each once from either end, a self-loop once."""
    out = edges.withColumns({"near": F.col("src"), "far": F.col("dst")})
    back = edges.withColumns({"near": F.col("dst"), "far": F.col("src")})
    if direction == "out":
        return out
    return back if direction == "in" else out.unionByName(back.filter("src <> dst"))


class Bound:
    """The variables of a match: v.c.name is property `name` of variable c; also id, labels, type."""

    def __init__(self, df: DataFrame):
        self._types = {f.name: f.dataType for f in df.schema}

    def __getattr__(self, var: str) -> _Variable:
        if var.startswith("_"):
            raise AttributeError(var)
        if f"{var}__id" not in self._types:
            raise GraphError("SEMANTIC_ERROR", f"unknown variable {var}")
        return _Variable(var, self._types)


class _Variable:
    def __init__(self, var: str, types: dict):
        self._var, self._types = var, types

    def __getattr__(self, prop: str) -> Value:
        name = f"{self._var}__{prop}"
        if name not in self._types:
            return value(None)
        return column(F.col(name), self._types[name])

    def record(self) -> Value:
        """All that is bound, as a struct."""
        return Value(F.struct(*(F.col(c).alias(c.partition("__")[2]) for c in self._types if c.startswith(f"{self._var}__"))), "record")


Expr = Callable[[Bound], Value]


@dataclass(frozen=True)
class Match:
    """Rows of bindings. Lazy: every step is a DataFrame."""

    graph: PropertyGraph
    df: DataFrame
    bound: frozenset[str] = field(default_factory=frozenset)

    def where(self, condition: Expr) -> Match:
        test = condition(Bound(self.df))
        if isinstance(test, Aggregate):
            raise GraphError("SEMANTIC_ERROR", "an aggregate stands in returns() only")
        return Match(self.graph, self.df.filter(value(test).filter()), self.bound)

    def path(self, *parts: NodePattern | HopPattern) -> Match:
        """One more path: it continues from its first bound node, or else is a product with it."""
        nodes, hops = list(parts[::2]), list(parts[1::2])
        at = next((i for i, n in enumerate(nodes) if n.var in self.bound), None)
        m, done = self, 0
        if at is None:
            at = 0
            if not self.bound and hops and self._bare(nodes[0], hops[0]):
                m, done = m._start(nodes[0], hops[0], nodes[1]), 1
            else:
                m = m._product(nodes[0])
        for i in range(at + done, len(hops)):
            m = m._expand(nodes[i], hops[i], nodes[i + 1])
        flip = {"out": "in", "in": "out", "both": "both"}
        for i in range(at - 1, -1, -1):
            h = hops[i]
            m = m._expand(nodes[i + 1], HopPattern(h.types, flip[h.direction], h.var, h.least, h.most), nodes[i])
        return m

    def join_path(self, other: Match, on: Callable[[Bound], Value]) -> Match:
        """A disjoint match under a condition: a hash join if it is an equality."""
        both = {f.name: f.dataType for f in [*self.df.schema, *other.df.schema]}
        names = Bound(self.df)
        names._types = both
        return Match(self.graph, self.df.join(other.df, on(names).filter()), self.bound | other.bound)

    def join_equal(self, other: Match, left: Callable[[Bound], list[Value]], right: Callable[[Bound], list[Value]], pairs: int = 4_000_000) -> Match:
        """A disjoint match where the values are equal, pair by pair, however many rows share them. The pairs of each
        key are counted, and a key of more than `pairs` is cut into blocks of this side's rows, each of which meets all of the
        other's: the number of tasks grows with the pairs, and a task has a bounded share of them."""
        sides = []
        for m, keys in ((self, left(Bound(self.df))), (other, right(Bound(other.df)))):
            sides.append(m.df.withColumns({f"_k{i}": k.col for i, k in enumerate(keys)}).dropna(subset=[f"_k{i}" for i in range(len(keys))]))
        a, b = sides
        names = [c for c in a.columns if c.startswith("_k")]
        n, k = (x.groupBy(*names).agg(F.count(F.lit(1)).alias(as_)) for x, as_ in ((a, "_n"), (b, "_m")))
        # A row a key that both sides have, numbered and written: the join goes by numbers alone.
        met = F.col("_n").cast("double") * F.col("_m")
        sizes = materialize(n.join(k, names).select(*names, F.least("_n", F.ceil(met / pairs)).alias("_cut"), met.alias("_met"), F.monotonically_increasing_id().alias("_key")))
        parts = max(1, math.ceil((sizes.agg(F.sum("_met")).first()[0] or 0) / pairs))
        sizes = sizes.drop("_met")
        block = F.pmod(F.xxhash64(*(c for c in self.df.columns if c.endswith("__id"))), F.col("_cut"))
        a = a.join(sizes, names).withColumn("_block", block).drop("_cut", *names)
        b = b.join(sizes, names).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cut") - 1))).drop("_cut", *names)
        # Dealt out by number: by their bytes, which do not tell of their pairs, Spark would put many together.
        a, b = (x.repartition(parts, "_key", "_block") for x in (a, b))
        return Match(self.graph, a.join(b.hint("shuffle_hash"), ["_key", "_block"]).drop("_key", "_block"), self.bound | other.bound)

    def _nodes(self, n: NodePattern) -> DataFrame:
        df = self.graph.scan(*n.labels)
        df = df.select(*(F.col(c).alias(f"{n.var}__{c}") for c in df.columns))
        for p, x in n.props.items():
            df = df.filter((getattr(getattr(Bound(df), n.var), p) == x).filter())
        return df

    def _product(self, n: NodePattern) -> Match:
        df = self._nodes(n)
        return Match(self.graph, self.df.crossJoin(df) if self.bound else df, self.bound | {n.var})

    def _expand(self, a: NodePattern, h: HopPattern, b: NodePattern) -> Match:
        if h.least is not None:
            return self._chain(a, h, b)
        edges = self._ends(h)
        on = F.col(f"{a.var}__id") == F.col("_near")
        if b.var in self.bound:
            on = on & (F.col(f"{b.var}__id") == F.col("_far"))
        df = self.df.join(edges, on).drop("_near")
        m = Match(self.graph, df, self.bound | ({h.var} if h.var else set()))
        return m._arrive(b, self._implied(h, b))

    def _ends(self, h: HopPattern) -> DataFrame:
        edges = oriented(self.graph.edge_frame(*h.types, props=bool(h.var)), h.direction)
        keep = [F.col(c).alias(f"{h.var}__{c}") for c in edges.columns if c not in ("near", "far")] if h.var else []
        return edges.select(F.col("near").alias("_near"), F.col("far").alias("_far"), *keep)

    def _bare(self, a: NodePattern, h: HopPattern) -> bool:
        """Is a path's first node but the near end of its edges?"""
        flip = {"out": "in", "in": "out", "both": "both"}
        return h.least is None and not a.fetch and not a.props and self._implied(replace(h, direction=flip[h.direction]), a)

    def _start(self, a: NodePattern, h: HopPattern, b: NodePattern) -> Match:
        """The first hop of a first path from a node that is not fetched: its edges, no join."""
        df = self._ends(h).withColumnRenamed("_near", f"{a.var}__id")
        if b.var == a.var:
            df = df.filter(F.col("_far") == F.col(f"{a.var}__id"))
        m = Match(self.graph, df, frozenset({a.var} | ({h.var} if h.var else set())))
        return m._arrive(b, self._implied(h, b))

    def _implied(self, h: HopPattern, b: NodePattern) -> bool:
        """Does the edge type alone say that the far node has the labels?"""
        for t in self.graph.edge_tables(*h.types):
            ends = {"out": [t.dst_label], "in": [t.src_label], "both": [t.src_label, t.dst_label]}[h.direction]
            if any(x not in ends or set(ends) != {x} for x in b.labels):
                return False
        return True

    def _arrive(self, b: NodePattern, implied: bool) -> Match:
        if b.var in self.bound:
            return Match(self.graph, self.df.drop("_far"), self.bound)
        if not b.fetch and not b.props and implied:
            return Match(self.graph, self.df.withColumnRenamed("_far", f"{b.var}__id"), self.bound | {b.var})
        df = self.df.join(self._nodes(b), F.col("_far") == F.col(f"{b.var}__id")).drop("_far")
        return Match(self.graph, df, self.bound | {b.var})

    def _chain(self, a: NodePattern, h: HopPattern, b: NodePattern) -> Match:
        edges = oriented(self.graph.edge_frame(*h.types, props=False), h.direction).select(F.col("id").alias("_e"), F.col("type").alias("_t"), F.col("near").alias("_near"), F.col("far").alias("_next"))
        now = self.df.withColumns({"_far": F.col(f"{a.var}__id"), "_used": F.array().cast("array<string>")})
        depths = []
        for depth in range(1, h.most + 1):
            name = F.concat_ws(":", "_t", "_e")
            now = now.join(edges, (F.col("_far") == F.col("_near")) & ~F.array_contains("_used", name))
            now = now.withColumns({"_used": F.array_append("_used", name), "_far": F.col("_next")}).drop("_e", "_t", "_near", "_next")
            if depth >= h.least:
                depths.append(now)
        df = union(depths).drop("_used")
        if b.var in self.bound:
            df = df.filter(F.col("_far") == F.col(f"{b.var}__id"))
        return Match(self.graph, df, self.bound)._arrive(b, self._implied(h, b))

    def returns(self, items: Callable[[Bound], dict], distinct: bool = False, order: list | None = None, skip: int = 0, limit: int | None = None, hidden: Callable[[Bound], dict] | None = None) -> DataFrame:
        """Columns by name. Aggregates group by the other items. order: names, or (name, "desc");
        hidden: more sort keys, which are dropped again. Nulls sort last."""
        cols = items(Bound(self.df))
        extra = hidden(Bound(self.df)) if hidden else {}
        plain = {k: value(v) for k, v in cols.items() if not isinstance(v, Aggregate)}
        aggs = {k: v for k, v in cols.items() if isinstance(v, Aggregate)}
        out = {k: (v.true() if v.kind == "boolean" and v.literal is None else v.col).alias(k) for k, v in plain.items()}
        if aggs:
            if extra:
                raise GraphError("SEMANTIC_ERROR", "aggregated results are ordered by their columns")
            made = [v.col.alias(k) for k, v in aggs.items()]
            df = self.df.groupBy(*out.values()).agg(*made) if out else self.df.agg(*made)
            df = df.select(*cols)
        else:
            df = self.df.select(*out.values(), *(v.col.alias(k) for k, v in extra.items()))
        if distinct:
            df = df.groupBy(*cols).agg(*(F.min(k).alias(k) for k in extra)) if extra else df.distinct()
        if order:
            df = df.orderBy(*(_key(o) for o in order))
        if skip:
            df = df.offset(skip)
        if limit is not None:
            df = df.limit(limit)
        return df.select(*cols)


def _key(o) -> Column:
    name, way = o if isinstance(o, tuple) else (o, "asc")
    return F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_last()


def match(graph: PropertyGraph, *parts: NodePattern | HopPattern) -> Match:
    return Match(graph, None).path(*parts)  # type: ignore[arg-type]


def guarded(df: DataFrame, max_rows: int) -> DataFrame:
    """The rows, if they are not more than max_rows; an error, never a part of them."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise GraphError("ROW_LIMIT", f"more than {max_rows} rows")
    return df


def neighbours(graph: PropertyGraph, node_id: int, skip: int = 0, limit: int | None = None, *types: str) -> DataFrame:
    """One page of a node's neighbourhood, by neighbour id: the start is filtered before the join."""
    m = match(graph, node("n"), hop(*types, direction="both", var="r"), node("m")).where(lambda v: v.n.id == node_id)
    return m.returns(lambda v: {"edge": v.r.id, "type": v.r.type, "neighbour": v.m.id}, order=["neighbour", "type", "edge"], skip=skip, limit=limit)
