"""Mixing sources to target weights, by built-in functions only.

Each source's words, documents in order of doc_id, are packed into blocks of `BLOCK` words, fewer in sources that would have under
`FEWEST` blocks. A source's target in blocks is its number of slots; how many of them each output shard gets is a multinomial draw
(counts drawn freely, shard by shard, would miss the targets by their square roots, which sources must come near). The table of these
counts is the plan of the mix: a source's slots are numbered shard after shard, and all that is taken, `take`'s sums included, is read
from it. The k-th slot of a source takes the block at place k mod blocks of a pseudorandom
permutation of its block indices, another one for each pass k div blocks (swap-or-not rounds, which permute any number of indices);
slots and blocks are joined by (source, index). Targets end at `MAX_PASSES` times a source's size, and so do its slots.

Defined results: null text has no words; a null source is a source of its own, ordered last; documents without words are taken 0
times; an empty table gives an empty mix; repeated rows are documents of their own in `take`, and in `mix_documents` rows equal in id,
source and text each give the copies of the first of them; extra columns pass through. The sources are a small table: their targets
are found by windows over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import WORD, RangeBuckets, partitions, staged, text_of

BLOCK, FEWEST, SHARD_SLOTS, CELL, CHUNK, MAX_PASSES, SWAPS, WEIGHTS = 64, 256, 4096, 1024, 1 << 14, 3, 24, (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_key(col: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col)), F.lit(""))


def block_length(source_size: Column) -> Column:
    """Words of a source's blocks: BLOCK, but short enough for FEWEST blocks."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(source_size / FEWEST))).cast("long")


def targets(light: DataFrame, weights=WEIGHTS, cap: int = MAX_PASSES) -> DataFrame:
    """A row per source: skey, source, source_size, target. Weights repeat in order of code points, null last; targets share the sum of
    sizes, none above `cap` times its source's size (the excess goes to the others by weight)."""
    sources = light.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    ratio = F.lit(float(cap)) * F.col("source_size") / F.col("weight")
    order = Window.orderBy("ratio", "skey")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (total - F.coalesce(F.sum(F.lit(float(cap)) * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = staged(weighted.withColumn("ratio", ratio).withColumn("level", level).withColumn("total", total), "mix-sources")
    # the first source, by rising cap per weight, that stays below its cap sets the level of all that do
    found = levels.where("ratio >= level").orderBy("ratio", "skey").select("level").first()
    water = float(found[0]) if found else 0.0
    return levels.select("skey", "source", "source_size", "total", F.least(F.lit(float(cap)) * F.col("source_size"), F.lit(water) * F.col("weight")).alias("target"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, source, skey, size, text_hash, start, length: where the document's words begin in its source's row of words, and the
    length of the source's blocks.

    Sums per (source, range of ids) and a running sum within each such cell: no source's documents meet in one task.
    """
    buckets = RangeBuckets(docs.select("doc_id"), "doc_id", 4 * partitions(docs.sparkSession))
    light = staged(
        docs.select("doc_id", "source", source_key().alias("skey"), word_count(text_of()).alias("size"), F.xxhash64(text_of()).alias("text_hash"), buckets.cells(F.col("doc_id"), F.shiftright(F.xxhash64(text_of()), 58) + 32).alias("bucket")),
        "mix-light",
    )
    cells = light.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col("skey").alias("_skey"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("cell_start"), block_length(F.sum("words").over(Window.partitionBy("skey"))).alias("length"))
    inside = Window.partitionBy("skey", "bucket").orderBy(F.asc_nulls_last("doc_id"), "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    at = light.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = at.join(starts, (F.col("skey") == F.col("_skey")) & (F.col("bucket") == F.col("_bucket")))
    return staged(joined.select("doc_id", "source", "skey", "size", "text_hash", (F.col("cell_start") + F.col("_before")).alias("start"), "length"), "mix-placed")


def permuted(index: Column, size: Column, *keys) -> Column:
    """The place of `index` in a pseudorandom permutation of 0 to size - 1, one for each value of `keys`.

    Swap-or-not: a round pairs x with (shift - x) mod size and swaps the pair or not by a hash of its larger member, so each is a
    permutation of any number of indices.
    """

    def swap(x: Column, turn: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("shift"), turn, *keys), size) - x, size)
        return F.when(F.xxhash64(F.lit("swap"), turn, F.greatest(x, other), *keys) < 0, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in range(SWAPS)]), index, swap)


def shard_counts(sources: DataFrame, seed: int = 17) -> DataFrame:
    """The mix's plan: skey, blocks, shard, n, first. n is how many slots of the shard the source has, drawn: each of the source's slots
    (its target in blocks) falls into a shard by an independent uniform, so a source's counts are multinomial; the shard's slots are
    the source's from `first` on."""
    own = sources.withColumn("blocks", F.ceil(F.col("source_size") / block_length(F.col("source_size"))).cast("long"))
    own = own.where("blocks > 0").withColumn("slots", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), MAX_PASSES * F.col("blocks")))
    wanted = own.agg(F.sum("slots")).first()[0] or 0
    # in two steps, so that no row becomes a long array, and over as many tasks as a shuffle has
    chunks = own.where("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))))
    chunks = chunks.repartition(partitions(sources.sparkSession), "skey", "chunk")
    draws = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1)))
    shard = F.pmod(F.xxhash64(F.lit(seed), "skey", "k"), F.lit(max(1, -(-wanted // SHARD_SLOTS))))
    counts = draws.groupBy("skey", "blocks", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts.withColumn("cell", F.floor(F.col("shard") / CELL).cast("long")), "mix-counts")
    # where a shard's slots begin: sums before its cell of shards, then before it within the cell
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("skey", "cell").agg(F.sum("n").alias("_n"))
    starts = cells.select(F.col("skey").alias("_skey"), F.col("cell").alias("_cell"), F.coalesce(F.sum("_n").over(before("skey").orderBy("cell")), F.lit(0)).alias("_start"))
    inside = counts.withColumn("_inside", F.coalesce(F.sum("n").over(before("skey", "cell").orderBy("shard")), F.lit(0)))
    joined = inside.join(starts, (F.col("skey") == F.col("_skey")) & (F.col("cell") == F.col("_cell")))
    return joined.select("skey", "blocks", "shard", "n", (F.col("_start") + F.col("_inside")).alias("first"))


def slots(sources: DataFrame, seed: int = 17) -> DataFrame:
    """A row per slot of the mix: shard, skey, pass, block (index in its source)."""
    counts = shard_counts(sources, seed).repartition(partitions(sources.sparkSession), "skey", "shard")
    each = counts.withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    placed = each.withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("int"))
    return placed.select("shard", "skey", "pass", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("skey"), F.col("pass")).alias("block"))


def pieces(rows: DataFrame) -> DataFrame:
    """skey, block, length, start (the document's key within its source), words: a row per document and block that it shares."""
    ends, block = F.col("start") + F.col("size"), F.col("length")
    spread = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((ends - 1) / block).cast("long"))))
    words = F.least(ends, (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    return spread.select("skey", "block", "length", "start", "doc_id", "text_hash", words.alias("words"))


def taken_blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed documents, sources, and pieces with `times`, how often the mix takes their block."""
    rows = placed(docs)
    sources = staged(targets(rows), "mix-targets")
    # the planner takes what is exploded from the few sources for small: never broadcast the slots
    times = slots(sources).groupBy("skey", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
    return rows, sources, pieces(rows).join(times, ["skey", "block"], "left").fillna(0, ["times"])


def take(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row per document."""
    rows, sources, used = taken_blocks(docs)
    taken = used.groupBy("skey", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    each = rows.where("size > 0").join(taken, ["skey", "start"], "left").select(*rows.columns, F.coalesce("taken", F.lit(0)).alias("taken"))
    # one row a source: a hot source's rows stay where they are if the sources are broadcast, and the planner measures them for that
    return each.unionByName(none).join(sources.select("skey", "source_size", "target"), "skey").select("doc_id", "size", "source_size", "target", "taken")


def blocks(docs: DataFrame) -> DataFrame:
    """The mix itself: shard, skey, pass, block and the documents' pieces in it (doc_id, first word, words), joined by index."""
    rows = placed(docs)
    own = pieces(rows)
    return own.join(slots(staged(targets(rows), "mix-targets")).hint("merge"), ["skey", "block"]).select("shard", "skey", "pass", "block", "doc_id", "start", "words")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass a copy of each document, of all its words or of those in the blocks that the pass takes
    (white space between them then becomes one space). The columns of `docs`, n_chars brought up to date."""
    rows, _, used = taken_blocks(docs)
    gathered = used.groupBy("skey", "start", "length", "doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("block", "times"))).alias("used"))
    first = gathered.groupBy("skey", "doc_id", "text_hash").agg(F.min(F.struct("start", "length", "used")).alias("own"))
    keyed = docs.withColumn("_skey", source_key()).withColumn("_hash", F.xxhash64(text_of())).withColumn("_id", F.col("doc_id"))
    right = first.select(F.col("skey").alias("_r_skey"), F.col("doc_id").alias("_r_id"), F.col("text_hash").alias("_r_hash"), (F.col("own.start") % F.col("own.length")).alias("_lead"), F.col("own.length").alias("_length"), F.col("own.used.times").alias("_times"))
    joined = keyed.join(right, F.col("_id").eqNullSafe(F.col("_r_id")) & (F.col("_hash") == F.col("_r_hash")) & (F.col("_skey") == F.col("_r_skey")))
    copies = joined.where(F.array_max("_times") > 0).withColumn("_pass", F.explode(F.sequence(F.lit(1), F.array_max("_times").cast("int"))))
    words = F.filter(F.regexp_extract_all("text", F.lit(WORD), 0), lambda w, i: F.element_at(F.col("_times"), (F.floor((i + F.col("_lead")) / F.col("_length")) + 1).cast("int")) >= F.col("_pass"))
    whole = F.array_min("_times") >= F.col("_pass")
    cut = copies.withColumn("_whole", whole).withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(F.array_join(words, " ")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_whole"), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*docs.columns)
