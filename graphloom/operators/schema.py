"""What a graph's labels, properties and edge types are, as observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import kind_of
from graphloom.model import PropertyGraph, union


def _type_name(field) -> str:
    kind = kind_of(field.dataType)
    return f"{kind_of(field.dataType.elementType)}[]" if kind == "list" else kind


def label_stats(graph: PropertyGraph) -> DataFrame:
    """label, n: a node counts under each of its labels."""
    return graph.scan().select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def property_types(graph: PropertyGraph) -> DataFrame:
    """label (of nodes) or type (of edges), property, type, n of values that are there. One scan a table:
    a row becomes the list of properties that it has, and these are counted."""
    parts = []
    for name, t in [*((None, t) for t in graph.nodes.values()), *((t.type, t) for t in graph.edges.values())]:
        if t.props:
            have = [F.when(F.col(p).isNotNull(), F.struct(F.lit(p).alias("property"), F.lit(_type_name(t.df.schema[p])).alias("type"))) for p in t.props]
            label = F.explode("labels") if name is None else F.lit(name)
            counts = t.df.select(label.alias("label"), F.array_compact(F.array(*have)).alias("p")).select("label", F.explode("p").alias("p")).groupBy("label", "p").agg(F.count(F.lit(1)).alias("n"))
            parts.append(counts.select("label", "p.property", "p.type", "n"))
    if not parts:
        return graph.scan().select(*(F.lit("").alias(c) for c in ("label", "property", "type")), F.lit(0).cast("long").alias("n")).filter(F.lit(False))
    return union(parts).groupBy("label", "property", "type").agg(F.sum("n").alias("n"))


def summary(graph: PropertyGraph) -> DataFrame:
    """kind (label, property or edge), name, detail, n: the whole schema in one sorted table."""
    labels = label_stats(graph).select(F.lit("label").alias("kind"), F.col("label").alias("name"), F.lit("").alias("detail"), "n")
    props = property_types(graph).select(F.lit("property").alias("kind"), F.concat_ws(".", "label", "property").alias("name"), F.col("type").alias("detail"), "n")
    edges = edge_types(graph).select(F.lit("edge").alias("kind"), F.col("type").alias("name"), F.concat_ws(" -> ", "from_label", "to_label").alias("detail"), "n")
    return union([labels, props, edges]).orderBy("kind", "name", "detail")


def edge_types(graph: PropertyGraph) -> DataFrame:
    """type, from_label, to_label, n: every label of an endpoint counts."""
    ends = graph.scan().select("id", "labels")
    edges = graph.edge_frame(props=False)
    src = ends.select(F.col("id").alias("src"), F.explode("labels").alias("from_label"))
    dst = ends.select(F.col("id").alias("dst"), F.explode("labels").alias("to_label"))
    return edges.join(src, "src").join(dst, "dst").groupBy("type", "from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))


def dominant_endpoints(graph: PropertyGraph) -> DataFrame:
    """type, from_label, to_label: the most frequent endpoints of each type; of equals the first by name."""
    e = edge_types(graph)

    def top(end: str) -> DataFrame:
        counts = e.groupBy("type", end).agg(F.sum("n").alias("n"))
        return counts.groupBy("type").agg(F.min(F.struct((-F.col("n")).alias("n"), end)).alias("t")).select("type", f"t.{end}")

    return top("from_label").join(top("to_label"), "type")
