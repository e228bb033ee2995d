"""Rendezvous (highest random weight) sharding of stable keys over weighted shards, by built-in functions only.

A row's score on a shard is weight / -ln(u), u from a hash of (key, shard); the largest score wins, ties to the smaller shard. A shard
added takes rows only into itself; one removed gives up only its own. A null key hashes as the text 'null'. Repeated rows go to the
same shard and get slots of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import RangeBuckets, partitions, staged, text_of


def unit(key: Column, shard: int) -> Column:
    """Uniform in (0, 1): 52 bits of md5('key:shard'), which other engines can compute too."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard)))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    scores = [F.struct((F.lit(float(w)) / -F.log(unit(key, i))).alias("score"), F.lit(-i).alias("minus")) for i, w in enumerate(weights)]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["minus"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (one more shard of mean weight). Slots follow the key's order, nulls last.

    Slots come from counts per (shard, range of keys), at most shards x ranges rows, and a row number within each such cell, so no
    shard's rows meet in one task; rows without a key, or of one that fills a range, are spread by their text.
    """
    weights = list(weights)
    grown = [*weights, sum(weights) / len(weights)]
    key, text = F.col(key_col), text_of(text_col)
    buckets = RangeBuckets(docs.select(F.col(key_col).cast("long").alias("key")), "key", 4 * partitions(docs.sparkSession))
    light = staged(
        docs.select(
            key.cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
            shard_of(key, weights).alias("shard"), shard_of(key, grown).alias("grown_shard"), buckets.cells(key.cast("long"), F.shiftright(F.crc32(text).cast("long"), 26)).alias("bucket"),
        ), "shards",
    )
    cells = light.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.asc_nulls_last("doc_id"), "text_crc32", "size")
    return (
        light.withColumn("at", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "bucket"])  # at most shards x ranges rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")
    )
