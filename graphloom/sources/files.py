"""Import and export: typed CSV, JSON, and written graph versions."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import EdgeTable, GraphError, Index, NodeTable, PropertyGraph, union
from graphloom.operators.common import dense_index
from graphloom.operators.writes import validate_props
from graphloom.storage import materialize

TYPES = {"string": "string", "number": "double", "boolean": "boolean"}


def _typed(raw: DataFrame, fixed: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Columns `name:type` cast; a cell that does not parse is an error, a blank one is absent."""
    missing = [c for c in fixed if c not in raw.columns]
    if missing:
        raise GraphError("VALIDATION", f"missing columns: {missing}")
    props: dict[str, Column] = {}
    bad = F.lit(False)
    for c in raw.columns:
        if c in fixed:
            continue
        name, _, kind = c.partition(":")
        kind = kind or "string"
        if kind not in TYPES or not name:
            raise GraphError("VALIDATION", f"unknown type in header {c!r}")
        cell = F.when(F.col(f"`{c}`") == "", F.lit(None)).otherwise(F.col(f"`{c}`"))
        if kind == "boolean":
            parsed = F.when(cell.isin("true", "false"), cell == "true")
        else:
            parsed = F.expr(f"try_cast(`{c}` as {TYPES[kind]})") if kind == "number" else cell
        props[name] = parsed
        bad = bad | (cell.isNotNull() & parsed.isNull())
    for c in fixed:
        bad = bad | F.col(f"`{c}`").isNull() | (F.col(f"`{c}`") == "")
    if not raw.filter(bad).isEmpty():
        raise GraphError("VALIDATION", f"a row does not fit its header: {raw.filter(bad).first()}")
    return raw.select(*(F.col(f"`{c}`").alias(c.strip(":")) for c in fixed), *(v.alias(k) for k, v in props.items())), list(props)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def nodes_from_csv(raw: DataFrame) -> DataFrame:
    """tempId, labels and typed properties from tempId, :label, name:type columns."""
    df, props = _typed(raw, ("tempId", ":label"))
    return df.select("tempId", F.split("label", r"\|").alias("labels"), *props)


def edges_from_csv(raw: DataFrame) -> DataFrame:
    """from, to, type and typed properties from :from, :to, :type, name:type columns."""
    df, props = _typed(raw, (":from", ":to", ":type"))
    return df.select("from", "to", "type", *props)


def read_json(spark: SparkSession, path: str, node_props: str, edge_props: str) -> tuple[DataFrame, DataFrame]:
    """One object, so one task reads it. Nodes and edges of {nodes: [{tempId, labels, properties}], edges: [{from, to, type, properties}]}, under schemas of the properties."""
    schema = f"nodes array<struct<tempId:string,labels:array<string>,properties:struct<{node_props}>>>, edges array<struct<`from`:string,`to`:string,type:string,properties:struct<{edge_props}>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    nodes = raw.select(F.explode("nodes").alias("x")).select("x.tempId", "x.labels", "x.properties.*")
    return nodes, raw.select(F.explode("edges").alias("x")).select("x.from", "x.to", "x.type", "x.properties.*")


def read_json_lines(spark: SparkSession, path: str, node_props: str, edge_props: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of folders `nodes` and `edges` with one JSON object a line, which Spark splits: the form for large graphs."""
    nodes = spark.read.schema(f"tempId string, labels array<string>, properties struct<{node_props}>").json(f"{path}/nodes")
    edges = spark.read.schema(f"`from` string, `to` string, type string, properties struct<{edge_props}>").json(f"{path}/edges")
    return nodes.select("tempId", "labels", "properties.*"), edges.select("from", "to", "type", "properties.*")


def import_graph(nodes: DataFrame, edges: DataFrame, known_labels: list[str], known_types: list[str]) -> PropertyGraph:
    """A graph of all rows, or an error and none. Ids follow the order of tempIds; an endpoint that no tempId has, a label
    or type that is not known, or a property that is none, is an error."""
    if not nodes.groupBy("tempId").count().filter("count > 1").isEmpty():
        raise GraphError("VALIDATION", "a tempId repeats")
    if not nodes.filter(~F.arrays_overlap("labels", F.array(*map(F.lit, known_labels)))).isEmpty() or not edges.filter(~F.col("type").isin(known_types)).isEmpty():
        raise GraphError("VALIDATION", "a label or type is not known")
    validate_props(nodes, [c for c in nodes.columns if c not in ("tempId", "labels")])
    validate_props(edges, [c for c in edges.columns if c not in ("from", "to", "type")])
    ids = dense_index(nodes, "tempId", "_n").select("tempId", (F.col("_n") + 1).alias("id"))
    table = nodes.join(ids, "tempId").drop("tempId")
    for end in ("from", "to"):
        if not edges.join(ids.withColumnRenamed("tempId", end), end, "left_anti").isEmpty():
            raise GraphError("NOT_FOUND", f"an edge's {end} is no tempId")
    src, dst = (ids.select(F.col("tempId").alias(e), F.col("id").alias(k)) for e, k in (("from", "src"), ("to", "dst")))
    rows = edges.join(src, "from").join(dst, "to").drop("from", "to")
    return PropertyGraph(
        {"imported": NodeTable(table.select("id", "labels", *(c for c in table.columns if c not in ("id", "labels"))), (), tuple(known_labels))},
        _edge_tables(rows, known_types, 1),
    )


def _edge_tables(rows: DataFrame, known_types: list[str], start: int) -> dict[str, EdgeTable]:
    """rows: src, dst, type and properties. Equal rows are counted and numbered; ids follow their order."""
    key = F.struct("src", "dst", "type", *(c for c in rows.columns if c not in ("src", "dst", "type")))
    keyed = rows.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("m")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).select(F.struct("_k", "i").alias("k"))
    keyed = dense_index(keyed, "k", "_n").select((F.col("_n") + start).alias("id"), "k._k.*")
    return {t: EdgeTable(keyed.filter(F.col("type") == t).drop("type"), t) for t in known_types}


@dataclass
class ImportReport:
    """What an import in batches committed, and why and in which batch it stopped."""

    nodes: int = 0
    edges: int = 0
    error: str | None = None
    at: tuple[str, int] | None = None  # nodes or edges, number of the batch


def import_batches(graph: PropertyGraph, nodes: DataFrame, edges: DataFrame, known_labels: list[str], known_types: list[str], batch: int = 10_000) -> tuple[PropertyGraph, ImportReport]:
    """Add rows to a graph in batches: nodes by tempId, then edges by their rows. The first batch with a bad row ends the
    import; the batches before it stay. An endpoint is a tempId, or else the id of a node of the graph.

    All batches are judged in one pass, so the number of jobs does not depend on that of batches."""
    report = ImportReport()
    props = [c for c in nodes.columns if c not in ("tempId", "labels")]
    repeated = nodes.groupBy("tempId").agg((F.count(F.lit(1)) > 1).alias("_repeats"))
    numbered = nodes.join(dense_index(nodes, "tempId", "_n"), "tempId").join(repeated, "tempId").withColumn("_batch", F.floor(F.col("_n") / batch))
    why = _first_reason(("a tempId repeats", F.col("_repeats")), ("a label is not known", ~F.arrays_overlap("labels", F.array(*map(F.lit, known_labels)))), *_bad_numbers(nodes, props))
    numbered, report.at, report.error = _up_to_error(materialize(numbered.withColumn("_why", why)), "nodes")
    report.nodes = numbered.count()
    start = (graph.scan().agg(F.max("id")).first()[0] or 0) + 1 if graph.nodes else 1
    ids = materialize(numbered.select("tempId", (F.col("_n") + start).alias("id")))
    table = numbered.join(ids, "tempId").select("id", "labels", *props)
    old = graph.nodes.get("imported")
    table = NodeTable(old.df.unionByName(table, allowMissingColumns=True) if old else table, (), tuple(dict.fromkeys([*(old.optional if old else ()), *known_labels])))
    grown = replace(graph, nodes=graph.nodes | {"imported": table})
    if report.error:
        return grown, report

    props = [c for c in edges.columns if c not in ("from", "to", "type")]
    rows = edges
    for end, k in (("from", "src"), ("to", "dst")):
        rows = rows.join(ids.select(F.col("tempId").alias(end), F.col("id").alias(f"_{k}")), end, "left")
        if graph.nodes:
            real = graph.scan().select(F.col("id").cast("string").alias(end), F.col("id").alias(f"_r{k}"))
            rows = rows.join(real, end, "left").withColumn(f"_{k}", F.coalesce(f"_{k}", f"_r{k}")).drop(f"_r{k}")
        rows = rows.withColumnRenamed(f"_{k}", k)
    rows = materialize(rows)
    order = F.struct("from", "to", "type", *props)
    keyed = rows.withColumn("_k", order)
    keyed = keyed.join(dense_index(keyed, "_k", "_n"), "_k").withColumn("_batch", F.floor(F.col("_n") / batch)).drop("_k")
    why = _first_reason(("an endpoint is no node", F.col("src").isNull() | F.col("dst").isNull()), ("a type is not known", ~F.coalesce(F.col("type").isin(known_types), F.lit(False))), *_bad_numbers(edges, props))
    keyed, report.at, report.error = _up_to_error(materialize(keyed.withColumn("_why", why)), "edges")
    report.edges = keyed.count()
    last = max((t.df.agg(F.max("id")).first()[0] or 0 for t in graph.edges.values()), default=0)
    new = _edge_tables(keyed.select("src", "dst", "type", *props), known_types, last + 1)
    both = {t: replace(graph.edges[t], source=graph.edges[t].df.unionByName(e.df, allowMissingColumns=True)) if t in graph.edges else e for t, e in new.items()}
    return replace(grown, edges=graph.edges | both), report


def _bad_numbers(df: DataFrame, props: list[str]) -> list[tuple[str, Column]]:
    numbers = [p for p in props if df.schema[p].dataType.typeName() in ("double", "float")]
    return [("a number is not finite", F.coalesce(F.isnan(p) | (F.abs(p) == float("inf")), F.lit(False))) for p in numbers]


def _first_reason(*tests: tuple[str, Column]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for text, bad in tests))


def _up_to_error(rows: DataFrame, kind: str) -> tuple[DataFrame, tuple[str, int] | None, str | None]:
    """The rows of the batches before the first one with a bad row."""
    first = rows.filter("_why is not null").agg(F.min(F.struct("_batch", "_n", "_why")).alias("x")).first()["x"]
    if first is None:
        return rows, None, None
    return rows.filter(F.col("_batch") < first["_batch"]), (kind, first["_batch"]), first["_why"]


def export_nodes(graph: PropertyGraph) -> DataFrame:
    """tempId, labels, properties (JSON without absent ones): the import format with real ids."""
    parts = [t.df.select(F.col("id").cast("string").alias("tempId"), "labels", F.to_json(F.struct(*t.props)).alias("properties") if t.props else F.lit("{}").alias("properties")) for t in graph.nodes.values()]
    return union(parts)


def export_edges(graph: PropertyGraph) -> DataFrame:
    parts = [t.df.select(F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to"), F.lit(t.type).alias("type"), F.to_json(F.struct(*t.props)).alias("properties") if t.props else F.lit("{}").alias("properties")) for t in graph.edges.values()]
    return union(parts)


def export_json(graph: PropertyGraph, path: str) -> None:
    """Nodes and edges in the import format, one JSON object a line, in folders `nodes` and `edges`."""
    for kind, df in (("nodes", export_nodes(graph)), ("edges", export_edges(graph))):
        keys = [c for c in df.columns if c != "properties"]
        # properties is JSON already, so the line is put together around it.
        line = F.concat(F.expr("substring(x, 1, length(x) - 1)"), F.lit(',"properties":'), F.col("properties"), F.lit("}"))
        df.select(F.to_json(F.struct(*keys)).alias("x"), "properties").select(line.alias("value")).write.text(f"{path}/{kind}")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit_name(version: int) -> str:
    return f"{version:012d}.json"


def save(graph: PropertyGraph, path: str, version: int, ops: list[DataFrame] = ()) -> None:  # type: ignore[assignment]
    """Write a version: a folder of tables and of the transaction's operations. Nothing in it counts until
    its manifest stands in `commits`, which takes one rename; what a crash leaves before that is
    overwritten by the next attempt. A version that is committed cannot be written again."""
    spark = next(iter(graph.nodes.values())).df.sparkSession
    base, name = f"{path}/v={version}", _commit_name(version)
    done, fs = _hadoop(spark, f"{path}/commits/{name}")
    if fs.exists(done):
        raise GraphError("VALIDATION", f"version {version} is committed already")
    for kind, tables in (("nodes", graph.nodes), ("edges", graph.edges)):
        for t_name, t in tables.items():
            t.df.write.mode("overwrite").parquet(f"{base}/{kind}/{t_name}")
    if ops:
        union(list(ops)).withColumn("tx_id", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{base}/ops")
    before = [v for v in versions(spark, path) if v < version]
    manifest = {
        "version": version,
        "after": before[-1] if before else None,
        "nodes": {n: [t.labels, t.optional] for n, t in graph.nodes.items()},
        "edges": {n: [t.src_label, t.dst_label] for n, t in graph.edges.items()},
        "indexes": sorted([i.kind, i.label, i.property] for i in graph.indexes),
        "ops": bool(ops),
    }
    new, _ = _hadoop(spark, f"{path}/commits/.{name}")  # hidden from readers
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(new, done):
        raise GraphError("RUNTIME_ERROR", f"version {version} was not committed")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions that are kept, in order."""
    folder, fs = _hadoop(spark, f"{path}/commits")
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if not n.startswith((".", "_")))


def load(spark: SparkSession, path: str, version: int | None = None) -> PropertyGraph:
    """A committed version, the last one by default."""
    kept = versions(spark, path)
    if not kept or version is not None and version not in kept:
        raise GraphError("NOT_FOUND", f"no version {version if version is not None else ''} in {path}")
    version = kept[-1] if version is None else version
    m = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/commits/{_commit_name(version)}").collect()))
    base = f"{path}/v={version}"
    nodes = {n: NodeTable(spark.read.parquet(f"{base}/nodes/{n}"), tuple(a), tuple(b)) for n, (a, b) in m["nodes"].items()}
    edges = {n: EdgeTable(spark.read.parquet(f"{base}/edges/{n}"), n, a, b) for n, (a, b) in m["edges"].items()}
    return PropertyGraph(nodes, edges, frozenset(Index(*i) for i in m["indexes"]))


def retain(spark: SparkSession, path: str, keep: int) -> None:
    """Keep the last `keep` versions and their operations. Who reads the feed from an older one has to load
    the graph anew."""
    for version in versions(spark, path)[: -max(1, keep)]:
        for old in (f"{path}/commits/{_commit_name(version)}", f"{path}/v={version}"):
            p, fs = _hadoop(spark, old)
            fs.delete(p, True)
