"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own is made under a local master; on a
    cluster a machine's own folder would split the data, so that is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='paperlode-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again; cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with place, their number (from 0) in the given order, written to the shared folder.

    order must tell any two rows apart, so range partitions are even. A row's number is what the
    partitions before its own hold and its place inside; only the partitions' counts meet in one task."""
    held = written(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    counts = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    held = held.withColumn("part", part).join(F.broadcast(before), "part")
    return held.withColumn("place", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "before")
