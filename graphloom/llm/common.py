"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import drop_path, drop_written, materialize, shared_dir

__all__ = ["BATCH_BYTES", "drop_path", "drop_written", "keyed", "materialize", "rejoin", "shared_dir", "small_batches", "table"]

#: Bytes of an Arrow batch. One row may be longer: texts are never cut.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that whole long texts fit in a worker's memory. All operators
    want the same bound, and one that is tighter already stays."""
    if int(str(spark.conf.get(_BYTES)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row (all columns of docs as one struct, so that no name of an operator's own can clash), doc_id, id and
    h (the row's identity: doc_id, or -2^63 without one, and a 64-bit digest of the text) and text."""
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(columns, F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("id"), F.xxhash64(F.col(text).isNull(), text).alias("h"), F.col(text).alias("text"))


def rejoin(rows: DataFrame, names: list[str], new_text: Column | None = None, text: str = "text") -> DataFrame:
    """The columns of docs back from keyed() rows, with another text if one is given."""
    return rows.select(*(new_text.alias(c) if new_text is not None and c == text else F.col("row").getField(c).alias(c) for c in names))
