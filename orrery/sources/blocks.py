"""Blocked storage of long series and tensors: Parquet, one folder a block, so a reader opens only the blocks it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blocks(df: DataFrame, path: str, length: int, index: str = "idx", mode: str = "errorifexists") -> None:
    """Rows go to block `index div length`; a block's rows are written by one task in order of the index."""
    blocked = df.withColumn("block", F.floor(F.col(index) / length).cast("long"))
    blocked.repartition("block").sortWithinPartitions("block", index).write.mode(mode).partitionBy("block").parquet(path)


def read_blocks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Blocks first … last; the others are pruned by folder."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("block") >= first)
    return df if last is None else df.where(F.col("block") <= last)


def plan_digest(plan: dict) -> str:
    """A content id of a plan's options."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(plan, sort_keys=True).encode()).hexdigest()
