"""Canonical exact document fingerprints, by built-in functions only.

Texts are brought to Unicode form NFKC, case-folded, white space runs become one space, ends are trimmed; two chained xxhash64 values
(128 bits) make the digest. Rows with equal digests are compared byte by byte: a digest whose canonical texts aren't all equal is
told apart by adding the SHA-256 of the canonical text. Null text is empty.

Unicode form and case folding are those of the ICU classes that ship with Spark, called by the SQL function `reflect`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import RangeBuckets, partitions, skew_safe_left_join, staged, text_of


def _nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(_nfkc(folded), r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", " "))


def digest(canonical_text: Column) -> Column:
    part = lambda *cols: F.lpad(F.lower(F.hex(F.xxhash64(*cols))), 16, "0")
    return F.concat(part(canonical_text), part(F.lit("second half"), canonical_text))


def mixed_digests(rows: DataFrame, digest_col: str, canonical_col: str) -> DataFrame:
    """Digests that stand for more than one canonical text (128 bits: practically none).

    Texts of a digest are compared byte by byte as a set, before and after the shuffle, so each distinct text is sent once a task and a
    group of copies of any size stays one text.
    """
    groups = rows.groupBy(digest_col).agg(F.size(F.collect_set(canonical_col)).alias("kinds"))
    return groups.where("kinds > 1").select(F.col(digest_col).alias("_mixed"))


def exact_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with columns fingerprint and group_size (rows of equal canonical text); columns of these names are replaced."""
    rows = docs.drop("fingerprint", "group_size").withColumn("_canonical", canonical(text_of(text_col))).withColumn("_digest", digest(F.col("_canonical")))
    mixed = mixed_digests(rows, "_digest", "_canonical")
    told = F.when(F.col("_mixed").isNull(), F.col("_digest")).otherwise(F.concat_ws("-", "_digest", F.sha2("_canonical", 256)))
    marked = rows.join(mixed, F.col("_digest") == F.col("_mixed"), "left").withColumn("fingerprint", told).drop("_canonical", "_digest", "_mixed")
    sizes = staged(marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size")), "fingerprint-groups")
    return skew_safe_left_join(marked, sizes, "fingerprint", "group_size")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by ascending doc_id (ties by text, nulls last), after the last the first.

    Rows go once to ranges of neighbouring ids; the rows that begin a range are also sent to the range before it, so no range needs
    another and each is a bounded window.
    """
    key = F.col("doc_id")
    ranges = RangeBuckets(docs.select("doc_id"), "doc_id", 4 * partitions(docs.sparkSession))
    bucket = ranges.of(key)
    begins = [(r["bucket"], r["least"]) for r in docs.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.min("doc_id").alias("least")).orderBy("bucket").collect()]
    previous = dict(zip([b for b, _ in begins], [None, *(b for b, _ in begins)], strict=False))  # the range before, of those with rows
    last, least = begins[-1][0] if begins else 0, min((x for _, x in begins if x is not None), default=None)
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("wraps"), F.lit(False).alias("guest"))
    firsts = F.array(*[F.lit(x).cast("long") for b, x in begins if x is not None and previous[b] is not None]).cast("array<long>")
    before = F.array(*[F.lit(previous.get(b)).cast("int") for b in range(ranges.count)])
    earlier = F.struct(F.element_at(before, bucket + 1).alias("bucket"), F.lit(0).alias("wraps"), F.lit(True).alias("guest"))
    around = F.struct(F.lit(last).alias("bucket"), F.lit(1).alias("wraps"), F.lit(True).alias("guest"))
    first = key.isNull() if least is None else key == F.lit(least)
    none = F.array().cast("array<struct<bucket:int,wraps:int,guest:boolean>>")
    places = F.concat(F.array(own), F.when(F.array_contains(firsts, key), F.array(earlier)).otherwise(none), F.when(first, F.array(around)).otherwise(none))
    dealt = docs.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.*")
    order = Window.partitionBy("bucket").orderBy("wraps", F.asc_nulls_last("doc_id"), "text", "guest")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where(~F.col("guest")).drop("bucket", "wraps", "guest")


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by the first as many of the next text."""
    n, half = F.length(text), F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))
