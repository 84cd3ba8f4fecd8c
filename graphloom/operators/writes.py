"""Writes: operations on an immutable graph give a new one.

A transaction collects operations, each a DataFrame made from matches of the committed graph. commit()
checks the end state (unique constraints) before the new graph is handed out, so a failed transaction
changes nothing. Its log has every operation with its values: replay() of the log on the old graph
gives the new one.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.values import BOOLEAN, DATE, LIST, NUMBER, STRING, column, kind_of
from graphloom.model import EdgeTable, GraphError, NodeTable, PropertyGraph, union
from graphloom.operators.common import dense_index
from graphloom.plans.match import HopPattern, Match, NodePattern, match
from graphloom.storage import materialize

#: seq: number of the statement in its transaction; props: JSON, in which a null removes; types: their schema.
OPS = "seq int, op string, kind string, name string, id long, src long, dst long, props string, types string"


def validate_props(df: DataFrame, props: list[str]) -> None:
    """Names are not empty, values are strings, finite numbers, booleans, dates, or lists of these."""
    bad = F.lit(False)
    for p in props:
        t = df.schema[p].dataType
        kind, inner = kind_of(t), kind_of(t.elementType) if kind_of(t) == LIST else None
        if not p.strip() or kind not in (STRING, NUMBER, BOOLEAN, DATE, LIST, "null") or inner not in (None, STRING, NUMBER, BOOLEAN, DATE, "null"):
            raise GraphError("VALIDATION", f"no property: {p!r} of {t.simpleString()}")
        infinite = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
        if t.typeName() in ("double", "float"):
            bad = bad | F.coalesce(infinite(F.col(f"`{p}`")), F.lit(False))
        elif kind == LIST and t.elementType.typeName() in ("double", "float"):
            bad = bad | F.coalesce(F.exists(F.col(f"`{p}`"), lambda x: F.coalesce(infinite(x), F.lit(False))), F.lit(False))
    if not df.filter(bad).isEmpty():
        raise GraphError("VALIDATION", "a number is not finite")


@dataclass
class Transaction:
    graph: PropertyGraph
    log: list[DataFrame] = field(default_factory=list)  # OPS
    stats: dict = field(default_factory=lambda: {"created": 0, "deleted": 0, "props_set": 0})

    def _next_id(self, frame: DataFrame) -> int:
        return (frame.agg(F.max("id")).first()[0] or 0) + 1

    def _log(self, op: str, kind: str, name: str, rows: DataFrame, props: list[str] = ()) -> None:  # type: ignore[assignment]
        none = F.lit(None)
        packed = F.to_json(F.struct(*(F.col(f"`{p}`") for p in props)), {"ignoreNullFields": "false"}) if props else none.cast("string")
        types = F.lit(rows.select(*(F.col(f"`{p}`") for p in props)).schema.simpleString() if props else None).cast("string")
        ends = [F.col(e) if op == "createEdge" else none.cast("long").alias(e) for e in ("src", "dst")]
        self.log.append(rows.select(F.lit(len(self.log)).alias("seq"), F.lit(op).alias("op"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), "id", *ends, packed.alias("props"), types.alias("types")))

    def _count(self, rows: DataFrame, stat: str) -> int:
        n = rows.count()
        self.stats[stat] += n
        return n

    def create_nodes(self, label: str, rows: DataFrame, key: str, keep_key: bool = True) -> DataFrame:
        """One node of a label for each row; key orders the new ids and is a property too, unless the label's
        nodes have none of that name. Returns the nodes with the key."""
        if not label:
            raise GraphError("VALIDATION", "a node has at least one label")
        validate_props(rows, [c for c in rows.columns if c != key or keep_key])
        start = self._next_id(self.graph.scan().select("id"))
        numbered = rows.join(dense_index(rows, key, "_n"), key).withColumn("id", F.col("_n") + start).drop("_n")
        new = materialize(numbered.withColumn("labels", F.array(F.lit(label))))
        if new.count() != new.select("id").distinct().count():
            raise GraphError("VALIDATION", f"{key} repeats")
        old = self.graph.nodes.get(label)
        props = new if keep_key and (old is None or key in old.df.columns) else new.drop(key)
        table = NodeTable(old.df.unionByName(props, allowMissingColumns=True) if old else props, (label,))
        self.graph = replace(self.graph, nodes=self.graph.nodes | {label: table})
        self._count(new, "created")
        self._log("createNode", "node", label, props, [c for c in props.columns if c not in ("id", "labels")])
        return new

    def create_edges(self, kind: str, rows: DataFrame, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
        """rows: src, dst and properties; one edge each, ids in their order. Both ends have to exist."""
        if not kind:
            raise GraphError("VALIDATION", "an edge has a type")
        props = [c for c in rows.columns if c not in ("src", "dst")]
        validate_props(rows, props)
        ids = self.graph.scan().select("id")
        for end in ("src", "dst"):
            if not rows.join(ids.withColumnRenamed("id", end), end, "left_anti").isEmpty():
                raise GraphError("NOT_FOUND", f"an edge's {end} is no node")
        start = max((self._next_id(t.df.select("id")) for t in self.graph.edges.values()), default=1)
        # Equal rows are counted and numbered, so that no source's edges have to be sorted in one task.
        copies = rows.groupBy(F.struct("src", "dst", *props).alias("_row")).agg(F.count(F.lit(1)).alias("m")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
        copies = copies.select(F.struct("_row", "i").alias("_k"))
        new = materialize(dense_index(copies, "_k", "_n").select((F.col("_n") + start).alias("id"), "_k._row.*"))
        old = self.graph.edges.get(kind)
        table = EdgeTable(old.df.unionByName(new, allowMissingColumns=True) if old else new, kind, src_label, dst_label)
        self.graph = replace(self.graph, edges=self.graph.edges | {kind: table})
        self._count(new, "created")
        self._log("createEdge", "edge", kind, new, props)
        return new

    def set_props(self, label: str, changes: DataFrame, *, edge: bool = False) -> None:
        """changes: id and properties; a null removes. The last of repeated ids is not defined, so they are an error."""
        table = (self.graph.edges if edge else self.graph.nodes)[label]
        props = [c for c in changes.columns if c != "id"]
        validate_props(changes, props)
        if not changes.groupBy("id").count().filter("count > 1").isEmpty():
            raise GraphError("VALIDATION", "an id is set twice in one statement")
        self._replace(label, materialize(_with_props(table.df, changes)), edge)
        self.stats["props_set"] += changes.count() * len(props)
        self._log("setEdgeProps" if edge else "setNodeProps", "edge" if edge else "node", label, changes, props)

    def remove_props(self, label: str, ids: DataFrame, *props: str, edge: bool = False) -> None:
        tables = self.graph.edges if edge else self.graph.nodes
        types = {f.name: f.dataType for f in tables[label].df.schema}
        self.set_props(label, ids.select("id", *(F.lit(None).cast(types.get(p, "string")).alias(p) for p in props)), edge=edge)

    def _replace(self, name: str, df: DataFrame, edge: bool) -> None:
        if edge:
            self.graph = replace(self.graph, edges=self.graph.edges | {name: replace(self.graph.edges[name], source=df)})
        else:
            self.graph = replace(self.graph, nodes=self.graph.nodes | {name: replace(self.graph.nodes[name], source=df)})

    def delete_edges(self, kind: str, ids: DataFrame) -> None:
        df = self.graph.edges[kind].df
        self._once(ids, df)
        self._replace(kind, df.join(ids.select("id"), "id", "left_anti"), True)
        self._count(ids, "deleted")
        self._log("deleteEdge", "edge", kind, ids)

    def delete_nodes(self, label: str, ids: DataFrame, detach: bool = False) -> None:
        """A node with edges needs detach, which deletes them too."""
        df = self.graph.nodes[label].df
        self._once(ids, df)
        for kind, t in list(self.graph.edges.items()):
            ends = [ids.select(F.col("id").alias(e)) for e in ("src", "dst")]
            kept = t.df.join(ends[0], "src", "left_anti").join(ends[1], "dst", "left_anti")
            lost = t.df.count() - kept.count()
            if lost and not detach:
                raise GraphError("DETACH_REQUIRED", f"nodes have {kind} edges")
            if lost:
                gone = t.df.join(kept.select("id"), "id", "left_anti").select("id")
                self._replace(kind, kept.select(*t.df.columns), True)
                self.stats["deleted"] += lost
                self._log("deleteEdge", "edge", kind, gone)
        self._replace(label, df.join(ids.select("id"), "id", "left_anti"), False)
        self._count(ids, "deleted")
        self._log("deleteNode", "node", label, ids)

    def _once(self, ids: DataFrame, df: DataFrame) -> None:
        if not ids.groupBy("id").count().filter("count > 1").isEmpty() or not ids.join(df.select("id"), "id", "left_anti").isEmpty():
            raise GraphError("NOT_FOUND", "an id is deleted twice or does not exist")

    def merge_nodes(self, label: str, rows: DataFrame, key: str, on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> DataFrame:
        """Match the committed nodes of a label by a property, or create what is missing, once for each row as
        matches see committed state only. Returns key and id."""
        nodes = self.graph.nodes[label].df.filter(F.col(key).isNotNull())
        first = nodes.groupBy(key).agg(F.min("id").alias("id"))
        found = materialize(rows.join(first, key, "left"))
        matched, missing = found.filter("id is not null"), found.filter("id is null").drop("id")
        if on_match and not matched.isEmpty():
            self.set_props(label, matched.select("id", *(c.alias(p) for p, c in on_match.items())).distinct())
        out = matched.select(key, "id")
        if not missing.isEmpty():
            order = Window.partitionBy(key).orderBy(*missing.columns)
            made = missing.withColumns({"_key": F.struct(key, F.row_number().over(order).alias("r")), **(on_create or {})})
            new = self.create_nodes(label, materialize(made), "_key", keep_key=False)
            out = out.unionByName(new.select(key, "id"))
        return out

    def merge_path(self, rows: DataFrame, *parts: NodePattern | HopPattern, on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> DataFrame:
        """For each row: the least match of the whole path in the committed graph, or all of it created.

        A node whose variable is a column of rows is bound to the id there; properties of the others are
        values or Columns over rows. on_create, on_match: {"variable.property": Column}. Matches see the
        committed state only, so equal rows create a path each. Returns rows with the ids of the path's
        variables and created."""
        nodes, hops = list(parts[::2]), list(parts[1::2])
        if any(h.least is not None or len(h.types) != 1 for h in hops) or any(len(n.labels) != 1 for n in nodes if n.var not in rows.columns):
            raise GraphError("SEMANTIC_ERROR", "a path that can be created has one label a node and one type a hop")
        names = rows.columns
        free = list(dict.fromkeys(n.var for n in nodes if n.var not in names))
        by = {n.var: n for n in reversed(nodes)}
        wanted = {f"{v}__{p}": x if isinstance(x, Column) else F.lit(x) for v in free for p, x in by[v].props.items()}
        rows = materialize(rows.withColumns({f"_{k}": c for k, c in wanted.items()} | {"_row": F.monotonically_increasing_id()}))

        found = None
        if all(h.types[0] in self.graph.edges for h in hops):
            path = [replace(x, props={}) if isinstance(x, NodePattern) else x for x in parts]
            df = match(self.graph, *path).df
            types = {f.name: f.dataType for f in df.schema}
            if all(k in types for k in wanted):
                mine = {f.name: f.dataType for f in rows.schema}
                on = [F.col(v) == F.col(f"{v}__id") for v in by if v not in free]
                on += [(column(F.col(f"_{k}"), mine[f"_{k}"]) == column(F.col(k), types[k])).filter() for k in wanted]
                ids = df.select(*dict.fromkeys([*(f"{v}__id" for v in by), *wanted]))
                pairs = rows.join(ids, [*on]) if on else rows.crossJoin(F.broadcast(ids.orderBy(*ids.columns).limit(1)))  # one row
                least = pairs.groupBy("_row").agg(F.min(F.struct(*(F.col(f"{v}__id").alias(v) for v in by))).alias("_m"))
                found = materialize(rows.join(least, "_row").select("_row", *names, *(F.col(f"_m.{v}").alias(v) for v in free)))
        missing = materialize(rows.join(found.select("_row"), "_row", "left_anti") if found is not None else rows)
        if not missing.isEmpty():
            for v in free:
                props = {k.partition("__")[2]: F.col(f"_{k}") for k in wanted if k.startswith(f"{v}__")}
                new = self.create_nodes(by[v].labels[0], materialize(missing.select("_row", *(c.alias(p) for p, c in props.items()))), "_row", keep_key=False)
                missing = missing.join(new.select("_row", F.col("id").alias(v)), "_row")
            missing = materialize(missing.select("_row", *names, *free))
            for a, h, b in zip(nodes, hops, nodes[1:]):
                src, dst = (b, a) if h.direction == "in" else (a, b)
                label = lambda n: n.labels[0] if n.labels else None
                self.create_edges(h.types[0], missing.select(F.col(src.var).alias("src"), F.col(dst.var).alias("dst")), label(src), label(dst))
        for some, changes in ((found, on_match), (missing, on_create)):
            for v in dict.fromkeys(k.partition(".")[0] for k in changes or {}):
                if some is not None and not some.isEmpty():
                    new = {k.partition(".")[2]: c for k, c in changes.items() if k.partition(".")[0] == v}
                    self.set_props(by[v].labels[0], materialize(some.select(F.col(v).alias("id"), *(c.alias(p) for p, c in new.items())).dropDuplicates(["id"])))
        made = missing.select(*names, *free, F.lit(True).alias("created")) if not missing.isEmpty() else None
        kept = found.select(*names, *free, F.lit(False).alias("created")) if found is not None else None
        return union([x for x in (kept, made) if x is not None])

    def bound(self, rows: DataFrame, **labels: str) -> Match:
        """A match whose variables are columns of node ids, with their values after the writes so far: what a
        statement returns at its end. labels: a label for each variable."""
        df = rows.select(*(F.col(v).alias(f"_{v}") for v in labels))
        for v, label in labels.items():
            nodes = self.graph.scan(label)
            nodes = nodes.select(*(F.col(c).alias(f"{v}__{c}") for c in nodes.columns))
            df = df.join(nodes, F.col(f"_{v}") == F.col(f"{v}__id")).drop(f"_{v}")
        return Match(self.graph, df, frozenset(labels))

    def commit(self) -> PropertyGraph:
        """The new graph, if its unique constraints hold."""
        for i in self.graph.indexes:
            if i.kind == "unique" and (bad := self.graph.violations(i).head()):
                raise GraphError("CONSTRAINT_VIOLATION", f":{i.label}({i.property}) repeats {bad['value']!r}")
        return self.graph


def _with_props(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows with the properties that changes have for their ids."""
    props = [c for c in changes.columns if c != "id"]
    marked = changes.select("id", *(F.col(p).alias(f"_{p}") for p in props), F.lit(True).alias("_set"))
    old = lambda p: F.col(p) if p in df.columns else F.lit(None)
    return df.join(marked, "id", "left").withColumns({p: F.when(F.col("_set"), F.col(f"_{p}")).otherwise(old(p)) for p in props}).drop("_set", *(f"_{p}" for p in props))


def replay(graph: PropertyGraph, ops: DataFrame) -> PropertyGraph:
    """The graph after the operations of transactions: OPS, and tx_id if there are several."""
    order = ["tx_id", "seq"] if "tx_id" in ops.columns else ["seq"]
    # One row a statement.
    for s in ops.select(*order, "op", "kind", "name", "types").distinct().orderBy(*order).collect():
        here = ops.filter(" and ".join(f"{k} = {s[k]}" for k in order))
        values = here.select("id", "src", "dst", *([F.from_json("props", s["types"]).alias("p")] if s["types"] else []))
        props = ["p.*"] if s["types"] else []
        tables = graph.nodes if s["kind"] == "node" else graph.edges
        old = tables.get(s["name"])
        if s["op"] == "createNode":
            new = values.select("id", F.array(F.lit(s["name"])).alias("labels"), *props)
            table = NodeTable(old.df.unionByName(new, allowMissingColumns=True) if old else new, (s["name"],))
        elif s["op"] == "createEdge":
            new = values.select("id", "src", "dst", *props)
            table = EdgeTable(old.df.unionByName(new, allowMissingColumns=True) if old else new, s["name"], *((old.src_label, old.dst_label) if old else ()))
        elif s["op"].startswith("set"):
            table = replace(old, source=_with_props(old.df, values.select("id", *props)))
        else:
            table = replace(old, source=old.df.join(values.select("id"), "id", "left_anti"))
        if s["kind"] == "node":
            graph = replace(graph, nodes=graph.nodes | {s["name"]: table})
        else:
            graph = replace(graph, edges=graph.edges | {s["name"]: table})
    return graph
