"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import re
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, a temporary folder serves
    if driver and executors are one process, as in tests; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graphloom-{os.urandom(8).hex()}"


def materialize(df: DataFrame, release: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here and a lost executor loses
    nothing. release: also let Spark remove the shuffle files that only the lineage needed, which it does
    when the frames are collected as garbage; worth it where much was shuffled."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    if release:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """materialize(), and the number of rows, counted while they are written: one job and not two."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def drop_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(*frames: DataFrame) -> None:
    """Remove what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        for folder in {os.path.dirname(x) for x in df.inputFiles()}:
            drop_path(df.sparkSession, folder)
