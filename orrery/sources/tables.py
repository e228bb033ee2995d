"""Reading the driver's tables and ordered series from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.sources.scratch import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without a zone are read as times of the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by its keys over all cores, several tasks a core: for rows that are few bytes and much work, as a file of some MB is one
    task otherwise. The number is given, so that adaptive execution doesn't join the small parts again."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def series(df: DataFrame, keys: list[str], order: list[str], value: str | Column, name: str = "x") -> DataFrame:
    """keys, idx (0-based place in `order` within the keys), value: the one form of ordered series used here. A series must be bounded
    per key; the window deals series by their keys."""
    col = F.col(value) if isinstance(value, str) else value
    return df.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).alias("idx"), col.alias(name))


def indexed(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """`df` with its 0-based place in `order` over all rows, for which no task needs all: rows are dealt by ranges and sorted, and each
    range adds how many rows come before it (a number a range). Ties are in any order; the places stay as they are once given."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = staged(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "indexed")
    part = F.shiftright("_id", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect()  # a row a partition
    first, total = [], 0
    for r in sizes:
        first.append((r["part"], total))
        total += r["rows"]
    starts = df.sparkSession.createDataFrame(first, "_part long, _first long")
    placed = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_first", "_id")


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.value per user in order of (ts, event_id): user_id, idx, x."""
    return series(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


#: The same for SQL.
USER_SERIES_SQL = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS x FROM events"
