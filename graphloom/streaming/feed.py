"""The change feed on Structured Streaming: a stream over the commits of written versions.

A commit is one small file, so a transaction is seen as soon as it counts, and whole: a micro-batch has
the operations (writes.OPS and tx_id) of one or more transactions, read from their versions. A filter
forwards all of a transaction if it creates a node of a wanted label or an edge of a wanted type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.model import GraphError
from graphloom.operators.writes import OPS
from graphloom.sources.files import versions

SCHEMA = f"{OPS}, tx_id long"


def subscribe(spark: SparkSession, path: str, from_tx: int = 0, per_trigger: int | None = None) -> DataFrame:
    """A stream of commits (tx_id, ops, after: the commit before) from a transaction on, at most per_trigger
    a micro-batch. A cursor older than what is kept is an error."""
    kept = versions(spark, path)
    if kept and 0 < from_tx < kept[0]:
        raise GraphError("NOT_FOUND", f"resync required: kept from {kept[0]}, asked for {from_tx}")
    reader = spark.readStream.schema("version long, ops boolean, after long")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    commits = reader.json(f"{path}/commits").select(F.col("version").alias("tx_id"), "ops", "after")
    return commits.filter(F.col("tx_id") >= from_tx)


def operations(spark: SparkSession, path: str, tx_ids: list[int]) -> DataFrame:
    """The operations of transactions. One that is kept no more is an error: its reader has to resync."""
    gone = sorted(set(tx_ids) - set(versions(spark, path)))
    if gone:
        raise GraphError("NOT_FOUND", f"resync required: {gone[0]} is kept no more")
    return spark.read.schema(SCHEMA).parquet(*(f"{path}/v={t}/ops" for t in tx_ids))


def wanted(batch: DataFrame, labels: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> DataFrame:
    """The transactions of a batch that create a wanted label or type, whole; all without a filter."""
    if not labels and not types:
        return batch
    hit = ((F.col("op") == "createNode") & F.col("name").isin(list(labels))) | ((F.col("op") == "createEdge") & F.col("name").isin(list(types)))
    return batch.join(batch.filter(hit).select("tx_id").distinct(), "tx_id", "left_semi")


def deliver(
    stream: DataFrame, path: str, handler: Callable[[DataFrame], None], checkpoint: str, labels: tuple[str, ...] = (), types: tuple[str, ...] = (), available_now: bool = True
) -> StreamingQuery:
    """Hand the operations of each micro-batch of subscribe() to a handler; by default up to what is there now.

    A handler that fails ends its own subscription, not others. Its batch does not count as delivered:
    the same checkpoint starts with it again. A subscription that falls behind what is kept ends with an error,
    as the commits in between are lost to it."""
    last: list[int] = []

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        commits = sorted(map(tuple, batch.select("tx_id", "ops", "after").collect()))  # one row a transaction
        for tx_id, _, after in commits:
            if last and after is not None and after > last[-1]:
                raise GraphError("NOT_FOUND", f"resync required: {after} is kept no more")
            last.append(tx_id)
        del last[:-1]
        tx_ids = [tx_id for tx_id, ops, _ in commits if ops]
        if tx_ids:
            found = wanted(operations(spark, path, tx_ids), labels, types)
            if not found.isEmpty():
                handler(found)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
