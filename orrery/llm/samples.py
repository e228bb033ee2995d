"""Bounded samples of labelled texts for models that one task fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS, SAMPLE_BYTES = 1500, 1 << 24


def label_of(labels: DataFrame, label: str, held_out: Column, agreed: Column) -> DataFrame:
    """One row an id: _id, _y (boolean). `agreed` joins labels that disagree; ids without label and held-out ids fall out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    return known.groupBy(F.col("doc_id").alias("_id")).agg((agreed > 0).alias("_y"))


def bounded(docs: DataFrame, known: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame | None, float]:
    """Labelled texts (text, _y, _order) of the ids of `known(_id, _y)`, and the share of true labels among those ids.

    At most `per_class` texts of each label and `sample_bytes` bytes of each (one text at least), whole texts, in order of a hash of the
    id and then of the text, whatever number of rows an id has; equal texts of an id count once. None without labels of both kinds.
    What reaches the driver are at most `per_class` sizes a label.
    """
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    share = counts.get(True, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return None, share
    order = F.shiftrightunsigned(F.xxhash64(F.lit(4), "_id"), 11) / F.lit(float(2**53))
    rate = F.when(F.col("_y"), 4.0 * per_class / counts[True]).otherwise(4.0 * per_class / counts[False])
    near = known.withColumn("_order", order).where(F.col("_order") < rate)  # about four times as many as wanted: labels without text fall out
    some = [near.where(F.col("_y") == y).orderBy("_order", "_id").limit(4 * per_class) for y in (True, False)]
    found = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), F.col("doc_id") == F.col("_id"))
    sized = found.select("_y", "_order", F.xxhash64("text").alias("_hash"), F.octet_length("text").alias("_n"))
    wanted = []
    for y in (True, False):  # equal rows may take several of the places; they are one text
        taken = {(r["_order"], r["_hash"]): r["_n"] for r in sized.where(F.col("_y") == y).orderBy("_order", "_hash").limit(per_class).collect()}
        total = 0
        for place, (key, n) in enumerate(taken.items()):
            total += n
            if total > sample_bytes and place:
                break
            wanted.append(key)
    if not wanted:
        return None, share
    keys = docs.sparkSession.createDataFrame(wanted, "_order double, _hash long")
    texts = found.withColumn("_hash", F.xxhash64("text")).join(F.broadcast(keys), ["_order", "_hash"], "left_semi")
    return texts.groupBy("_y", "_order", "_hash").agg(F.min("text").alias("text")).select("text", "_y", "_order"), share
