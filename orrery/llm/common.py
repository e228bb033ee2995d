"""Helpers shared by the training-data operators: staging, ordered buckets, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups with at least this share of all rows are joined by broadcast: there are at most 1000 of them.
HOT_SHARE = 1 / 1000
#: What the text contracts call white space (and the complement is a word).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local session names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, evaluates `df` once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


class RangeBuckets:
    """Buckets of neighbouring long keys, about equally full, found from quantiles of the keys alone.

    At most `MOST` of them, as the bounds are literals of the plan. Null keys fall into the last bucket. `cells` splits the rows of a
    null key, or of a key that fills a bucket by itself, further.
    """

    MOST = 20_000

    def __init__(self, df: DataFrame, key: str, count: int):
        count = max(1, min(count, self.MOST))
        found = df.approxQuantile(key, [i / count for i in range(count)], 1 / (4 * count)) if count > 1 else []
        # approxQuantile works on doubles; whatever rounding does to a bound, comparing with `>=` keeps buckets ordered
        at = [int(x) for x in found]
        #: Keys that fill a bucket or more: each has a bucket of its own.
        self.hot = sorted({x for x, y in zip(at, at[1:], strict=False) if x == y and -(2**53) < x < 2**53})
        self.bounds = sorted({*at, *self.hot, *(x + 1 for x in self.hot)} - {min(at, default=0)} | {x for x in self.hot if x > min(at)})

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    def of(self, key: Column) -> Column:
        """Number of bounds <= key, by two short scans: over the heads of runs of bounds, then within a run."""
        if not self.bounds:
            return F.lit(0)
        step = max(1, int(len(self.bounds) ** 0.5))
        runs = [self.bounds[i : i + step] for i in range(0, len(self.bounds), step)]
        array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        run = F.size(F.filter(array([r[0] for r in runs]), lambda x: x <= key))
        inside = F.size(F.filter(F.element_at(F.array(*map(array, runs)), F.greatest(run, F.lit(1))), lambda x: x <= key))
        return F.when(key.isNull(), F.lit(len(self.bounds))).otherwise(F.when(run == 0, 0).otherwise((run - 1) * step + inside))

    def cells(self, key: Column, tie: Column) -> Column:
        """Buckets in the order of (key, tie), nulls last: rows of one bucket, 64 for a null or hot key. `tie` is from 0 to 63, rising
        with what breaks ties; null keys come after all others of the last bucket."""
        alone = key.isin(self.hot) if self.hot else F.lit(False)
        return self.of(key).cast("long") * 129 + F.when(key.isNull(), tie + 65).when(alone, tie).otherwise(0)


def skew_safe_left_join(rows: DataFrame, groups: DataFrame, key: str, size: str, salt: tuple[str, ...] | None = None) -> DataFrame:
    """`rows` left join `groups` on `key`, one group row a key, where single keys may hold any share of the rows.

    `groups` must be staged (it is read three times). Keys whose `size` is at least `HOT_SHARE` of the total, hence at most
    1 / HOT_SHARE of them, are joined by broadcast; the rows they match get a hash of the columns `salt` (default: all of `rows`) in place
    of the key in the one shuffle join that serves all others, so they spread, and alike if a task runs again. Null keys match nothing.
    """
    salt = salt or tuple(rows.columns)
    payload = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) >= max(2, total * HOT_SHARE)).select(F.col(key).alias("_hot_key"), F.struct(*payload).alias("_hot"))
    cold = groups.where(F.col(size) < max(2, total * HOT_SHARE)).select(F.col(key).alias("_cold_key"), F.struct(*payload).alias("_cold"))
    spread = F.when(F.col("_hot").isNull(), F.xxhash64(F.col(key))).otherwise(F.xxhash64(*salt))
    joined = (
        rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_spread", spread)
        .withColumn("_match", F.when(F.col("_hot").isNull(), F.col(key)))
        .join(cold.withColumn("_cold_spread", F.xxhash64("_cold_key")), (F.col("_spread") == F.col("_cold_spread")) & (F.col("_match") == F.col("_cold_key")), "left")
    )
    return joined.select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in payload])
