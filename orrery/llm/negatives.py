"""Hard negatives: rows of another label that score nearly as high with an anchor as its nearest rows of the same label.

Vectors become integers, floor(scale * x). A score is the integer inner product of two rows. All vectors are turned by an orthogonal
matrix, the principal axes of the second moments of all rows, so that leading components hold most of a product. Rows are dealt by
number into blocks of about `ROWS` rows, anchors into slabs of about `ANCHORS`; each block meets each slab in one group, in which
partial products over the first components are accumulated `STEPS` components and `TILE` anchors at a time. What is left of a product is at most the
product of the norms of what is left of both rows (Cauchy and Schwarz), plus a slack for rounding. A pair whose upper bound stays
under the bound that enough others reach for certain is discarded; when few pairs are left, they are verified by integer products.
A group gives its best rows for each anchor; their merge is exact, as a group's bests include all of the whole table's that it holds.

Work is anchors times rows, a stated query set against all rows in blocks; memory is that of a block and a slab. The moments are sums
of d x d numbers, whatever the number of rows, and only tune the bounds: results don't depend on them.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; shorter vectors count as ended
by zeros (an empty one is all zeros); a null id comes last among ties and is never an anchor; rows are told apart by their place in
the table, so repeated rows each count, and a copy of an anchor is one of its other rows; an anchor without positives, and a positive
without negatives, have no rows; an empty table gives an empty result; extra columns are ignored. Components whose integer is over
2 ** 52, or products that could pass 2 ** 62, raise.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import partitions, staged

ROWS, LEAST_ROWS, ANCHORS, TILE, STEPS, VERIFY = 16_384, 1024, 1024, 64, 16, 1 << 15
#: Pairs are verified one by one once no more than this share of them is left.
FEW = 1 / 64


def participants(rows: DataFrame, label: Column, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = 256) -> DataFrame:
    """row (number), vec_id, label, vector (integers) of the rows that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    return kept.where("label IS NOT NULL").withColumn("row", F.monotonically_increasing_id())


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists as rows of int64, ended by zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def axes(rows: DataFrame, width: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of all rows' second moments, the widest first."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("vector"), width).astype(float)
            total += x.T @ x
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total.ravel()[cell], pa.float64())], ["cell", "value"])

    total = np.zeros(width * width)
    for r in rows.select("vector").mapInArrow(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r["cell"]] = r["value"]  # width x width numbers
    total = total.reshape(width, width)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


class Block:
    """Rows as integers and turned, with the norms of what is left of them from each component on."""

    def __init__(self, table: pa.Table, turn: np.ndarray):
        self.whole = matrix(table.column("vector"), len(turn))
        self.turned = self.whole.astype(float) @ turn
        self.left = np.sqrt(np.concatenate([np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(self.whole), 1))], axis=1))
        self.row, self.label = table.column("row").to_numpy(), table.column("label").to_numpy()

    def part(self, at: slice) -> Block:
        out = copy(self)
        out.whole, out.turned, out.left, out.row, out.label = self.whole[at], self.turned[at], self.left[at], self.row[at], self.label[at]
        return out


class Products:
    """Bounds of the products of some anchors with a block of rows, tightened by each `advance`."""

    def __init__(self, a: Block, b: Block):
        self.a, self.b, self.at = a, b, 0
        self.part = np.zeros((len(a.whole), len(b.whole)))
        # turning, multiplying and summing in doubles loses at most some tens of units in the last place of the norms' product a component
        self.slack = 64 * a.whole.shape[1] * np.finfo(float).eps

    def advance(self) -> bool:
        """Adds the next components; False when there are none."""
        if self.at >= self.a.whole.shape[1]:
            return False
        some = slice(self.at, self.at + STEPS)
        self.part += self.a.turned[:, some] @ self.b.turned[:, some].T
        self.at = min(some.stop, self.a.whole.shape[1])
        return True

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        left = np.outer(self.a.left[:, self.at], self.b.left[:, self.at]) + self.slack * np.outer(self.a.left[:, 0], self.b.left[:, 0]) + 1e-9
        return self.part - left, self.part + left

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Integer products of the pairs (i, j)."""
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), VERIFY):
            out[k : k + VERIFY] = np.einsum("ij,ij->i", self.a.whole[i[k : k + VERIFY]], self.b.whole[j[k : k + VERIFY]])
        return out


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest value; minus infinity where it has fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def survivors(products: Products, allowed: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among the `most` highest of an anchor's allowed rows with a score within one of its windows (lowest, highest)."""
    alive = allowed
    while products.advance():
        low, high = products.bounds()
        left = np.zeros_like(alive)
        for least, greatest in windows:
            inside = alive & (low >= least[:, None]) & (high <= greatest[:, None])
            enough = np.maximum(kth_largest(np.where(inside, low, -np.inf), most), least)
            left |= alive & (high >= enough[:, None]) & (low <= greatest[:, None])
        alive = left
        if alive.sum() <= alive.size * FEW:
            break
    return np.nonzero(alive)


def first_of(keys: list[np.ndarray], group: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` rows of each group in the order of `keys`."""
    order = np.lexsort([*reversed(keys), group])
    sorted_group = group[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < most]


def ids_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and whether they are missing (they come last)."""
    column = table.column("vec_id").combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def searched(rows: DataFrame, anchors: DataFrame, turn: np.ndarray, found: Callable, columns: list[str]) -> DataFrame:
    """`found(products, block, some anchors)` over all rows and all anchors. Blocks are dealt by row number, so no value makes one large."""
    spark, sizes = rows.sparkSession, (rows.count(), anchors.count())
    blocks = max(1, -(-sizes[0] // ROWS), min(partitions(spark), sizes[0] // LEAST_ROWS))
    slabs = max(1, -(-sizes[1] // ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int")).withColumn("slab", every(slabs))
    right = anchors.withColumn("slab", F.pmod("row", F.lit(slabs)).cast("int")).withColumn("block", every(blocks))

    def group(block: pa.Table, slab: pa.Table) -> pa.Table:
        out = [pa.table({c: pa.array([], pa.int64()) for c in columns})]
        if block.num_rows and slab.num_rows:
            of_rows, of_anchors = Block(block, turn), Block(slab, turn)
            for at in range(0, slab.num_rows, TILE):
                some = of_anchors.part(slice(at, at + TILE))
                out += found(Products(some, of_rows), block, slab.slice(at, TILE))
        return pa.concat_tables(out)

    return left.groupBy("block", "slab").cogroup(right.groupBy("block", "slab")).applyInArrow(group, ", ".join(f"{c} long" for c in columns))


def positives(rows: DataFrame, anchors: DataFrame, turn: np.ndarray, most: int) -> DataFrame:
    """row, vec_id, label, vector of each anchor with its first `most` other rows of its label: array near(place, id, score)."""

    def found(products: Products, block: pa.Table, some: pa.Table) -> list[pa.Table]:
        a, b = products.a, products.b
        allowed = (a.label[:, None] == b.label[None]) & (a.row[:, None] != b.row[None])
        i, j = survivors(products, allowed, [(np.full(len(a.row), -np.inf), np.full(len(a.row), np.inf))], most)
        score = products.exact(i, j)
        ids, missing = ids_of(block)
        top = first_of([-score, missing[j], ids[j]], i, most)
        i, j, score = i[top], j[top], score[top]
        return [pa.table({"row": a.row[i], "near_row": b.row[j], "id": pa.array(ids[j], pa.int64(), mask=missing[j]), "score": score})]

    parts = searched(rows, anchors, turn, found, ["row", "near_row", "id", "score"])
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "near_row")
    best = parts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    near = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near"))  # at most `most` of an anchor
    return anchors.join(near, "row")


def negatives(rows: DataFrame, anchors: DataFrame, turn: np.ndarray, most: int, least_percent: int) -> DataFrame:
    """For anchors with `near`: each positive's first `most` rows of other labels that score from `least_percent` of its score up to it."""

    def found(products: Products, block: pa.Table, some: pa.Table) -> list[pa.Table]:
        a, b = products.a, products.b
        near = some.column("near").combine_chunks()
        owner = np.repeat(np.arange(some.num_rows), near.value_lengths().to_numpy())
        place, positive = (near.flatten().field(n).to_numpy().astype(np.int64) for n in ("place", "score"))
        greatest = np.full((some.num_rows, int(place.max())), -(2**62))  # no positive there: nothing lies within
        greatest[owner, place - 1] = positive
        least = np.where(greatest >= 0, -(-least_percent * np.maximum(greatest, 0) // 100), 2**62)  # below zero nothing lies within
        i, j = survivors(products, a.label[:, None] != b.label[None], [(x.astype(float), y.astype(float)) for x, y in zip(least.T, greatest.T, strict=True)], most)
        score = products.exact(i, j)
        ids, missing = ids_of(block)
        out = []
        for k in range(greatest.shape[1]):
            at = np.flatnonzero((score >= least[i, k]) & (score <= greatest[i, k]))
            at = at[first_of([-score[at], missing[j[at]], ids[j[at]]], i[at], most)]
            out.append(pa.table({"row": a.row[i[at]], "place": np.full(len(at), k + 1, np.int64), "near_row": b.row[j[at]], "id": pa.array(ids[j[at]], pa.int64(), mask=missing[j[at]]), "score": score[at]}))
        return out

    parts = searched(rows, anchors, turn, found, ["row", "place", "near_row", "id", "score"])
    order = Window.partitionBy("row", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "near_row")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor: Column, label: Column, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = 256, positives_of: int = 5, negatives_of: int = 5, least_percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `is_anchor` and `label` are over the columns of `rows`
    (`is_anchor` over vec_id, label and vector as they take part)."""
    spark = rows.sparkSession
    part = staged(participants(rows, label, vector_col, id_col, scale), "vectors")
    size = part.agg(F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    width, largest = size["width"] or 0, size["most"] or 0
    if largest > 2**52 or largest**2 * width > 2**62:
        raise ValueError(f"integers of {largest} in vectors of {width} pass what a 64-bit product holds")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not width:  # no rows, or none but empty vectors: pad these to one zero
        width = 1
    turn = axes(part, width)
    anchors = staged(positives(part, part.where(is_anchor), turn, positives_of), "anchors")
    found = negatives(part, anchors, turn, negatives_of, least_percent)
    near = anchors.select("row", F.col("vec_id").alias("anchor_id"), F.explode("near").alias("near")).select("row", "anchor_id", F.col("near.place").cast("long").alias("place"), F.col("near.id").alias("positive_id"), F.col("near.score").alias("positive_score"))
    joined = found.join(near, ["row", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return joined.to(spark.createDataFrame([], out).schema)
