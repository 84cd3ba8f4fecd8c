"""The property-graph view of the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.model import EdgeTable, NodeTable, PropertyGraph

#: A node's id is its label's number times 2^40, plus its key.
LABELS = ("Region", "Nation", "Customer", "Supplier", "Part", "Purchase", "User", "Event", "Document")
SHIFT = 1 << 40


def node_id(label: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.lit((LABELS.index(label) + 1) * SHIFT) + key.cast("long")


Frame = Callable[[], DataFrame]


def _nodes(frame: Frame, label: str, key: str, **props: str) -> NodeTable:
    return NodeTable(lambda: frame().select(node_id(label, key).alias("id"), F.array(F.lit(label)).alias("labels"), *(F.col(c).alias(p) for p, c in props.items())), (label,))


def _edges(frame: Frame, kind: str, key: Column, src: tuple[str, str], dst: tuple[str, str], **props: str) -> EdgeTable:
    return EdgeTable(lambda: frame().select(key.cast("long").alias("id"), node_id(*src).alias("src"), node_id(*dst).alias("dst"), *(F.col(c).alias(p) for p, c in props.items())), kind, src[0], dst[0])


def table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Node and edge tables over the parquet tables. Edge ids come from natural keys without a sort:
    a line item's is a digest of its key columns. A file is opened when a query first uses it."""
    read = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    t = lambda name: lambda: read(name)
    orders, lines, customer, supplier, events = t("orders"), t("lineitem"), t("customer"), t("supplier"), t("events")

    def documents() -> DataFrame:
        labelled = F.when(F.col("quality").isNotNull(), F.array(F.lit("Document"), F.lit("Labelled"))).otherwise(F.array(F.lit("Document")))
        rows = read("documents").join(read("labels"), "doc_id", "left")
        return rows.select(node_id("Document", "doc_id").alias("id"), labelled.alias("labels"), "text", "lang", "source", "n_chars", "quality", "toxic")

    def nexts() -> DataFrame:
        after = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return orders().select("o_orderkey", F.lead("o_orderkey").over(after).alias("next")).filter("next is not null")

    def refers() -> DataFrame:
        most = customer().agg(F.max("c_custkey").alias("m"))
        rows = customer().crossJoin(F.broadcast(most))  # one row
        rows = rows.select("c_custkey", "m", F.posexplode(F.array((31 * F.col("c_custkey") + 7) % (F.col("m") + 1), (17 * F.col("c_custkey") + 3) % (F.col("m") + 1))).alias("k", "to"))
        return rows.select("c_custkey", "to", (2 * F.col("c_custkey") + F.col("k")).alias("e"), (1 + F.col("c_custkey") % 5).alias("w"))

    def trades() -> DataFrame:
        sold = lines().select("l_orderkey", "l_suppkey").distinct().join(orders(), F.col("l_orderkey") == F.col("o_orderkey"))
        return sold.join(customer(), F.col("o_custkey") == F.col("c_custkey")).join(supplier(), F.col("l_suppkey") == F.col("s_suppkey")).select("c_nationkey", "s_nationkey").distinct()

    line_id = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    line = {"quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "shipdate": "l_shipdate"}
    nodes = {
        "Region": _nodes(t("region"), "Region", "r_regionkey", name="r_name"),
        "Nation": _nodes(t("nation"), "Nation", "n_nationkey", name="n_name"),
        "Customer": _nodes(customer, "Customer", "c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment"),
        "Supplier": _nodes(supplier, "Supplier", "s_suppkey", name="s_name", acctbal="s_acctbal"),
        "Part": _nodes(t("part"), "Part", "p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", retailprice="p_retailprice"),
        "Purchase": _nodes(orders, "Purchase", "o_orderkey", status="o_orderstatus", totalprice="o_totalprice", orderdate="o_orderdate", priority="o_orderpriority"),
        "User": _nodes(lambda: events().select("user_id").distinct(), "User", "user_id"),
        "Event": _nodes(events, "Event", "event_id", ts="ts", event_type="event_type", value="value"),
        "Document": NodeTable(documents, ("Document",), ("Labelled",)),
    }
    edges = [
        _edges(t("nation"), "IN_REGION", F.col("n_nationkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
        _edges(customer, "LIVES_IN", F.col("c_custkey"), ("Customer", "c_custkey"), ("Nation", "c_nationkey")),
        _edges(supplier, "BASED_IN", F.col("s_suppkey"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")),
        _edges(orders, "PLACED", F.col("o_orderkey"), ("Customer", "o_custkey"), ("Purchase", "o_orderkey")),
        _edges(lines, "HAS_PART", line_id, ("Purchase", "l_orderkey"), ("Part", "l_partkey"), **line),
        _edges(lines, "FULFILLED_BY", line_id, ("Purchase", "l_orderkey"), ("Supplier", "l_suppkey"), quantity="l_quantity"),
        _edges(lambda: lines().select("l_suppkey", "l_partkey").distinct(), "SUPPLIES", F.col("l_suppkey") * SHIFT + F.col("l_partkey"), ("Supplier", "l_suppkey"), ("Part", "l_partkey")),
        _edges(events, "DID", F.col("event_id"), ("User", "user_id"), ("Event", "event_id")),
        _edges(nexts, "NEXT_PURCHASE", F.col("o_orderkey"), ("Purchase", "o_orderkey"), ("Purchase", "next")),
        _edges(refers, "REFERS", F.col("e"), ("Customer", "c_custkey"), ("Customer", "to"), w="w"),
        _edges(trades, "TRADES", F.col("c_nationkey") * 1000 + F.col("s_nationkey"), ("Nation", "c_nationkey"), ("Nation", "s_nationkey")),
    ]
    return PropertyGraph(nodes, {e.type: e for e in edges})
