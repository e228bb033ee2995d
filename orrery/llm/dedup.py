"""Exact deduplication against a persistent digest index.

The index is a bucketed table sorted by digest. A batch is first reduced to one row per digest (partial aggregation, so a group of
copies of any size is small before the shuffle), then anti-joined by sort-merge with the index, and what is new is appended.

Defined results: null text equals the empty text; a digest that the index already holds drops all its new rows; of equal new texts
the row with the largest doc_id stays (null ids only if the group has no other); rows equal in id and text are one document: all are
marked alike by `mark`, and `keep` returns one of them. An empty batch appends nothing. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import fresh_path, partitions, skew_safe_left_join, staged, text_of

INDEX_SCHEMA = "digest string, keep_id long, group_size long, batch string"


class DigestIndex:
    """A bucketed table at `path`; opened again by path in a later session, with the bucket count stored beside it.

    A batch's rows are appended under its name, and count only once that name is in the list of published batches (one row, one file,
    written last): a batch that fails halfway is never seen, and is written anew under another name. The catalog's table is named after
    the path, so opening again makes no other.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or fresh_path(spark, "digest-index")).rstrip("/")
        try:
            stored = spark.read.parquet(f"{self.path}/_form").first()["buckets"]
        except AnalysisException:  # nothing there yet
            stored = buckets or partitions(spark)
            spark.createDataFrame([(stored,)], "buckets int").coalesce(1).write.parquet(f"{self.path}/_form")
        if buckets not in (None, stored):
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets, self.table = stored, f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        spark.catalog.refreshTable(self.table)

    def read(self) -> DataFrame:
        """The rows of published batches."""
        try:
            batches = self.spark.read.schema("batch string").parquet(f"{self.path}/_batches")
        except AnalysisException:
            return self.spark.table(self.table).where("false")
        return self.spark.table(self.table).join(F.broadcast(batches), "batch", "left_semi").select("digest", "keep_id", "group_size", "batch")  # a row a batch

    def append(self, entries: DataFrame, batch: str) -> None:
        """One task, hence one file, a bucket: bucketing and this repartition hash alike."""
        (
            entries.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.table)
        )
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/_batches")
        self.spark.catalog.refreshTable(self.table)

    def forget(self) -> None:
        """Drop the catalog's table; the files stay, to be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def remove(self) -> None:
        """Drop the catalog's table and the files."""
        self.forget()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def grouped(docs: DataFrame) -> DataFrame:
    """A staged row per digest of `docs(doc_id, digest)`: keep_id, group_size."""
    # staged, as the planner would else push an anti-join below the aggregation and shuffle every row of a group of copies
    return staged(docs.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")


def add_batch(groups: DataFrame, index: DigestIndex) -> str:
    """Append what is new in `groups` to the index; the batch's name."""
    batch = uuid.uuid4().hex
    index.append(groups.join(index.read().select("digest").hint("merge"), "digest", "left_anti"), batch)
    return batch


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return staged(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_of(text_col), 256).alias("digest")), "dedup-digests")


def mark(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    With several `batches` the documents come one range of ids after another, the largest ids first and those without id last, so each
    batch is deduplicated against what the earlier ones have left in the index. Without an index one is made for the run and removed.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    light = digests(docs, id_col, text_col)
    cuts = sorted({int(x) for x in light.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)}, reverse=True) if batches > 1 else []
    below = [F.lit(True), *(F.coalesce(F.col("doc_id") < c, F.lit(True)) for c in cuts)]
    groups, names = [], []
    for i, low in enumerate(below):
        part = light.where(low if i + 1 == len(below) else low & ~below[i + 1])
        groups.append(grouped(part))
        names.append(add_batch(groups[-1], index))
    sizes = reduce(DataFrame.unionByName, groups).groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    known = index.read().select("digest", "keep_id", "batch", F.col("group_size").alias("_earlier"))
    new = F.col("batch").isin(names)
    found = sizes.join(known.hint("merge"), "digest").select("digest", "keep_id", F.when(new, F.col("group_size")).otherwise(F.col("_earlier")).alias("group_size"), F.col("group_size").alias("_rows"), new.alias("_new"))
    found = staged(found, "dedup-found")
    if own:
        index.remove()
    joined = skew_safe_left_join(light, found, "digest", "_rows")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256"))


def keep(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    light = digests(docs, id_col, text_col)
    batch = add_batch(grouped(light), index)
    winners = staged(index.read().where(F.col("batch") == batch).select(F.col("keep_id").alias("_id"), F.col("digest").alias("_digest")), "dedup-winners")
    if own:
        index.remove()
    here = docs.withColumn("_row_digest", F.sha2(text_of(text_col), 256))
    kept = here.join(winners, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_row_digest") == F.col("_digest")), "left_semi")
    rows = light.join(winners, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    if rows.count() > winners.count():  # rows that repeat: texts go through one more shuffle
        kept = kept.dropDuplicates([id_col, "_row_digest"])
    return kept.drop("_row_digest")
