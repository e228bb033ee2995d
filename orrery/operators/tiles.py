"""Dense matrices larger than a task: products of square tiles, and elimination with partial pivoting over column panels.

A tile is a row (bi, bj, rows, columns, data), a panel (bj, columns, data) holds `width` whole columns; data are doubles in row order.
A product joins tiles by the inner index, multiplies pairs and adds up those of one place, each task its own first. Elimination goes panel by panel: one task
factors a panel (the largest entry left in each column is its pivot), its multipliers and row order go to each of the panels after it,
which are brought up to date in parallel; then unknowns come back panel by panel. A task holds a panel and the one that it is
eliminated with, so n x width doubles must fit twice; every step is written to the shared folder.

Cells that are missing are zero; repeated cells of a place are added; a singular matrix raises; an empty one gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.tensor import gram
from orrery.sources.scratch import staged
from orrery.sources.tables import indexed, table

TILE, WIDTH = 512, 128
#: Tiles of a product that a task adds up before it passes them on.
HELD = 64
_TILE = "bi long, bj long, rows int, columns int, data array<double>"
_PANEL = "bj long, columns int, data array<double>"
_FACTOR = "lead long, columns int, data array<double>, turned array<long>, swaps long, least double"


def _lists(*arrays: np.ndarray) -> pa.Array:
    return pa.array([np.asarray(a, float).ravel() for a in arrays], pa.list_(pa.float64()))


def _dense(row: dict, rows: int) -> np.ndarray:
    return np.array(row["data"]).reshape(rows, row["columns"])


def tiled(cells: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of a cell table (i, j, v)."""
    dealt = cells.select(F.floor(F.col("i") / size).cast("long").alias("bi"), F.floor(F.col("j") / size).cast("long").alias("bj"), (F.col("i") % size).cast("long").alias("i"), (F.col("j") % size).cast("long").alias("j"), F.col("v").cast("double").alias("v"))

    def one(group: pa.Table) -> pa.Table:
        at = {c: group.column(c).to_numpy() for c in ("i", "j", "v")}
        out = np.zeros((size, size))
        np.add.at(out, (at["i"], at["j"]), at["v"])
        return pa.table({"bi": group.column("bi").slice(0, 1), "bj": group.column("bj").slice(0, 1), "rows": pa.array([size], pa.int32()), "columns": pa.array([size], pa.int32()), "data": _lists(out)})

    return dealt.groupBy("bi", "bj").applyInArrow(one, _TILE)


def cells_of(tiles: DataFrame) -> DataFrame:
    """(i, j, v) of all cells of the tiles that there are, zeros included."""
    each = tiles.select("bi", "bj", "rows", "columns", F.posexplode("data").alias("at", "v"))
    return each.select((F.col("bi") * F.col("rows") + F.floor(F.col("at") / F.col("columns"))).alias("i"), (F.col("bj") * F.col("columns") + F.col("at") % F.col("columns")).alias("j"), "v")


def transposed(tiles: DataFrame) -> DataFrame:
    def turned(batches):
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"bi": [r["bj"] for r in rows], "bj": [r["bi"] for r in rows], "rows": pa.array([r["columns"] for r in rows], pa.int32()), "columns": pa.array([r["rows"] for r in rows], pa.int32()), "data": _lists(*(_dense(r, r["rows"]).T for r in rows))})

    return tiles.mapInArrow(turned, _TILE)


def multiplied(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tiles of the product of two tiled matrices of one tile size."""
    left = a.select("bi", F.col("bj").alias("inner"), "rows", F.col("columns").alias("mid"), F.col("data").alias("left"))
    right = b.select(F.col("bi").alias("inner"), "bj", "columns", F.col("data").alias("right"))

    def products(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}

        def ready() -> pa.RecordBatch:
            at = list(sums)
            out = {"bi": [i for i, _ in at], "bj": [j for _, j in at], "rows": pa.array([m.shape[0] for m in sums.values()], pa.int32()), "columns": pa.array([m.shape[1] for m in sums.values()], pa.int32()), "data": _lists(*sums.values())}
            sums.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            shapes, left, right = batch.select(["bi", "bj", "rows", "columns", "mid"]).to_pylist(), batch.column("left"), batch.column("right")
            for k, r in enumerate(shapes):
                made = left[k].values.to_numpy().reshape(r["rows"], r["mid"]) @ right[k].values.to_numpy().reshape(r["mid"], r["columns"])
                place = (r["bi"], r["bj"])
                sums[place] = sums[place] + made if place in sums else made
                if len(sums) >= HELD:
                    yield ready()
        if sums:
            yield ready()

    def added(group: pa.Table) -> pa.Table:
        total = sum(x.values.to_numpy() for x in group.column("data"))
        return group.slice(0, 1).drop_columns("data").append_column("data", _lists(total))

    return left.join(right, "inner").select("bi", "bj", "rows", "columns", "mid", "left", "right").mapInArrow(products, _TILE).groupBy("bi", "bj").applyInArrow(added, _TILE)


def row_products(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, s): the inner products of the rows of two matrices in tiles of one size."""
    pairs = a.select("bi", "bj", "rows", "columns", F.col("data").alias("left")).join(b.select("bi", "bj", F.col("data").alias("right")), ["bi", "bj"])

    def summed(batches):
        for batch in batches:
            shapes, left, right = batch.select(["bi", "rows", "columns"]).to_pylist(), batch.column("left"), batch.column("right")
            for k, r in enumerate(shapes):
                both = left[k].values.to_numpy() * right[k].values.to_numpy()
                yield pa.RecordBatch.from_pydict({"i": r["bi"] * r["rows"] + np.arange(r["rows"]), "s": both.reshape(r["rows"], r["columns"]).sum(1)})

    return pairs.mapInArrow(summed, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))


def panels(cells: DataFrame, n: int, width: int, first: int = 0) -> DataFrame:
    """Column panels of an n-row cell table, numbered from `first`."""
    dealt = cells.select((F.floor(F.col("j") / width) + first).cast("long").alias("bj"), F.col("i").cast("long").alias("i"), (F.col("j") % width).cast("long").alias("j"), F.col("v").cast("double").alias("v"))

    def one(group: pa.Table) -> pa.Table:
        at = {c: group.column(c).to_numpy() for c in ("i", "j", "v")}
        out = np.zeros((n, int(at["j"].max()) + 1))
        np.add.at(out, (at["i"], at["j"]), at["v"])
        return pa.table({"bj": group.column("bj").slice(0, 1), "columns": pa.array([out.shape[1]], pa.int32()), "data": _lists(out)})

    return dealt.groupBy("bj").applyInArrow(one, _PANEL)


def _factored(n: int, top: int) -> Callable[[pa.Table], pa.Table]:
    """Factors the panel that begins with column `top`."""

    def factored(group: pa.Table) -> pa.Table:
        row = group.to_pylist()[0]
        m, order, swaps, least = _dense(row, n), np.arange(n), 0, np.inf
        for c in range(m.shape[1]):
            at = top + c
            pivot = at + int(np.abs(m[at:, c]).argmax())
            if m[pivot, c] == 0:
                raise ArithmeticError("a singular matrix")
            if pivot != at:
                m[[at, pivot]], order[[at, pivot]], swaps = m[[pivot, at]], order[[pivot, at]], swaps + 1
            least = min(least, abs(m[at, c]))
            m[at + 1 :, c] /= m[at, c]
            m[at + 1 :, c + 1 :] -= np.outer(m[at + 1 :, c], m[at, c + 1 :])
        return pa.table({"lead": [row["bj"]], "columns": pa.array([m.shape[1]], pa.int32()), "data": _lists(m), "turned": pa.array([order], pa.list_(pa.int64())), "swaps": [swaps], "least": [float(least)]})

    return factored


def _updated(n: int, top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A later panel in the factor's row order, its rows of the factor's columns solved, those below them reduced."""

    def updated(panel: pa.Table, factor: pa.Table) -> pa.Table:
        row, lead = panel.to_pylist()[0], factor.to_pylist()[0]
        low = _dense(lead, n)
        m, end = _dense(row, n)[np.array(lead["turned"])], top + low.shape[1]
        for at in range(top, end):
            m[at + 1 : end] -= np.outer(low[at + 1 : end, at - top], m[at])
        m[end:] -= low[end:] @ m[top:end]
        return pa.table({"bj": panel.column("bj"), "columns": panel.column("columns"), "data": _lists(m)})

    return updated


def _back(n: int, top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The unknowns of a factor's columns, taken out of the right-hand side's rows above."""

    def back(group: pa.Table, factor: pa.Table) -> pa.Table:
        row, upper = group.to_pylist()[0], _dense(factor.to_pylist()[0], n)
        y, x = np.array(row["data"]), np.zeros(upper.shape[1])
        for c in range(len(x) - 1, -1, -1):
            x[c] = y[top + c] / upper[top + c, c]
            y[: top + c] -= upper[: top + c, c] * x[c]
        return pa.table({"bj": group.column("bj"), "columns": group.column("columns"), "data": _lists(y), "x": _lists(np.concatenate([x, row["x"]]))})

    return back


def eliminate(matrix: DataFrame, right: DataFrame, n: int, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Solves A x = b for cells `matrix(i, j, v)` (n x n) and `right(i, v)`: (i, x), and a row (swaps, least_pivot, residual)."""
    count = -(-n // width)
    now = staged(panels(matrix, n, width).unionByName(panels(right.select("i", F.lit(0).alias("j"), "v"), n, width, count)), "panels")
    factors = []
    for k in range(count):
        factors.append(staged(now.where(F.col("bj") == k).groupBy("bj").applyInArrow(_factored(n, k * width), _FACTOR), "panel-factor"))
        sent = factors[k].withColumn("bj", F.explode(F.sequence(F.lit(k + 1).cast("long"), F.lit(count).cast("long"))))
        later = now.where(F.col("bj") > k)
        now = staged(later.groupBy("bj").cogroup(sent.groupBy("bj")).applyInArrow(_updated(n, k * width), _PANEL), "panels")
    side = now.withColumn("x", F.array().cast("array<double>"))  # the right-hand side alone is left
    for k in reversed(range(count)):
        factor = factors[k].withColumn("bj", F.lit(count).cast("long"))
        side = staged(side.groupBy("bj").cogroup(factor.groupBy("bj")).applyInArrow(_back(n, k * width), _PANEL + ", x array<double>"), "panel-side")
    found = staged(side.select(F.posexplode("x").alias("i", "x")).select(F.col("i").cast("long").alias("i"), "x"), "panel-unknowns")
    product = matrix.join(found.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("ax"))
    known = right.groupBy("i").agg(F.sum("v").alias("b"))
    residual = product.join(known, "i", "full").agg(F.max(F.abs(F.coalesce("ax", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("residual"))
    parts = reduce(DataFrame.unionByName, [f.select("swaps", "least") for f in factors])
    return found, parts.agg(F.sum("swaps").alias("swaps"), F.min("least").alias("least_pivot")).crossJoin(residual)  # a row each


# ---- queries


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").alias("v"))


def q_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inner products of the embeddings, X X', in tiles of 128; per vector the sum of their squares, and its product with itself. The
    squares in row i of X X' add up to row i of X (X'X) times row i of X, which takes no table of all pairs."""
    vectors = indexed(_rows(spark, sf_dir), ["vec_id"], "i")
    tiles = staged(tiled(vectors.select("i", F.posexplode("v").alias("j", "v")), 128), "tiles")
    inner = staged(multiplied(transposed(tiles), tiles), "tiles")
    each = row_products(multiplied(tiles, inner), tiles).withColumnRenamed("s", "squares").join(row_products(tiles, tiles).withColumnRenamed("s", "own"), "i")
    return each.join(vectors.select("i", "vec_id"), "i").select("vec_id", F.round("squares", 6).alias("squares"), F.round("own", 6).alias("own"))


PRODUCTS_SQL = """
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::double AS v FROM embeddings),
g AS (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS g FROM x a JOIN x b USING (vec_id) GROUP BY ALL),
o AS (SELECT vec_id, sum(v * v) AS own FROM x GROUP BY vec_id)
SELECT vec_id, round(sum(a.v * b.v * g), 6) AS squares, round(any_value(own), 6) AS own FROM x a JOIN x b USING (vec_id) JOIN g ON g.i = a.k AND g.j = b.k JOIN o USING (vec_id) GROUP BY vec_id
"""


def _normal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """X'X w = X'1 for the embeddings, its rows in another order, so that pivots have to be looked for."""
    rows = _rows(spark, sf_dir)
    turn = lambda c: ((c * 7 + 3) % 64).cast("long")
    matrix = staged(gram(rows, "v", 64).select(turn(F.col("i")).alias("i"), F.col("j").cast("long").alias("j"), "v"), "normal")
    right = rows.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("double")).alias("v"))
    return matrix, staged(right.select(turn(F.col("i")).alias("i"), "v"), "normal-right")


def q_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights whose products with all embeddings come nearest to 1, by elimination in panels of 12 columns."""
    found, report = eliminate(*_normal(spark, sf_dir), 64, 12)
    said = report.select((F.col("residual") < 1e-9).alias("exact"), (F.col("swaps") > 0).alias("swapped"))
    return found.crossJoin(F.broadcast(said)).select("i", F.round("x", 6).alias("x"), "exact", "swapped")


SOLVE_SQL = """
WITH RECURSIVE x AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::double AS v FROM embeddings),
g AS (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (vec_id) GROUP BY ALL UNION ALL SELECT k, 64, sum(v) FROM x GROUP BY k),
r AS (SELECT i, list(v ORDER BY j) AS r FROM g GROUP BY i),
e AS (SELECT 0 AS k, list(r ORDER BY i) AS m FROM r
 UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN r ELSE list_transform(r, lambda v, j: v - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) FROM e WHERE k < 64)
SELECT i, round(m[i + 1][65] / m[i + 1][i + 1], 6) AS x, true AS exact, true AS swapped FROM e, (SELECT unnest(range(64)) AS i) WHERE k = 64
"""

QUERIES = {"tensor_tile_products": (q_products, PRODUCTS_SQL), "tensor_tile_solve": (q_solve, SOLVE_SQL)}
