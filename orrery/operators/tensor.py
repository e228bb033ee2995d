"""Tensor operations over tables: cell tables (one row a cell) for what doesn't fit in a row, arrays otherwise."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import scalar as S
from orrery.sources.tables import spread, table


def matmul_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, v) x (k, j, v) -> (i, j, v): join on k, partial sums before the shuffle on (i, j). Skewed k are split by adaptive execution."""
    return a.select("i", "k", F.col("v").alias("va")).join(b.select("k", "j", F.col("v").alias("vb")), "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def gram(df: DataFrame, value: str, width: int) -> DataFrame:
    """(i, j, v) of X'X over all rows of an array column: each task sums its own width x width matrix, so the shuffle doesn't grow with rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.array(batch[value].tolist(), float).reshape(-1, width)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    return df.select(value).mapInPandas(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose_cells(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def bareiss(m: list[list]) -> Fraction:
    """Fraction-free determinant, exact on integers and fractions; the first nonzero pivot is taken."""
    m, n, sign, last = [[Fraction(x) for x in row] for row in m], len(m), 1, Fraction(1)
    for k in range(n - 1):
        pivot = next((r for r in range(k, n) if m[r][k]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            m[k], m[pivot], sign = m[pivot], m[k], -sign
        for i in range(k + 1, n):
            for j in range(k + 1, n):
                m[i][j] = (m[i][j] * m[k][k] - m[i][k] * m[k][j]) / last
        last = m[k][k]
    return sign * m[-1][-1] if n else Fraction(1)


def determinants(df: DataFrame, key: str, data: str, n: int) -> DataFrame:
    """key, determinant of an n x n array column, exact, as text 'p' or 'p/q'."""
    kind = df.schema[key].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "determinant": [str(bareiss(np.reshape(list(x), (n, n)).tolist())) for x in batch[data]]})

    return df.select(key, data).mapInPandas(of, f"{key} {kind}, determinant string")


def solve(df: DataFrame, key: str, matrix: str, right: str, n: int) -> DataFrame:
    """key, x, residual (largest absolute) of n x n systems in a row, scaled partial pivoting."""
    kind = df.schema[key].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = np.array([np.reshape(list(x), (n, n)) for x in batch[matrix]], float), np.array(batch[right].tolist(), float)
            scale = np.abs(a).max(2, keepdims=True)
            x = np.linalg.solve(a / scale, (b / scale[:, :, 0])[:, :, None])[:, :, 0]
            yield pd.DataFrame({key: batch[key], "x": x.tolist(), "residual": np.abs((a @ x[:, :, None])[:, :, 0] - b).max(1)})

    return df.select(key, matrix, right).mapInPandas(of, f"{key} {kind}, x array<double>, residual double")


def half_precision(data: np.ndarray, brain: bool = False) -> np.ndarray:
    """Values rounded to 16 bits: IEEE half, or the upper half of a 32-bit float rounded to even."""
    if not brain:
        with np.errstate(over="ignore"):
            return data.astype(np.float16).astype(np.float32)
    bits = data.astype(np.float32).view(np.uint32)
    rounded = (bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)
    return rounded.view(np.float32)


# ---- queries on embeddings


def _v(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, n).cast("array<double>").alias("v"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _cells(df: DataFrame, t: F.Column, name: str = "v") -> DataFrame:
    return df.select("vec_id", t.alias("t")).select("vec_id", F.posexplode("t.data").alias("pos", name))


def _elementwise(df: DataFrame) -> DataFrame:
    t = A.vec(F.col("v"))
    out = A.each(t, lambda x: F.round(F.sqrt(F.abs(x)) + F.exp(x) + F.sin(x) * F.cos(x) - x * x / 2, 6))
    return _cells(df, out)


def q_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elementwise(_v(spark, sf_dir))


def q_elementwise_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elementwise(_whole(spark, sf_dir))


def q_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 2 x 3 matrix plus a row of 3, times a column of 2."""
    t = A.mat(F.col("v"), 2, 3)
    row, column = A.vec(F.array(*map(F.lit, (1.0, 2.0, 3.0)))), A.mat(F.array(F.lit(10.0), F.lit(-1.0)), 2, 1)
    out = A.broadcasted(A.broadcasted(t, row, lambda x, y: x + y), column, lambda x, y: F.round(x * y, 6))
    return _cells(_v(spark, sf_dir), out)


def _reductions(df: DataFrame) -> DataFrame:
    t = A.vec(F.col("v"))
    return df.select("vec_id", *(F.round(c, 6).alias(n) for n, c in (("total", A.total(t)), ("least", A.least(t)), ("most", A.most(t)), ("norm", A.norm(t)), ("dot", A.dot(t, A.each(t, lambda x: x + 1))))))


def q_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reductions(_v(spark, sf_dir))


def q_reductions_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reductions(_whole(spark, sf_dir))


def q_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinants, inverse, trace, cross product, transpose and product of small matrices cut from each vector."""
    shift = A.mat(F.array(*map(F.lit, (3.0, 0.0, 0.0, 3.0))), 2, 2)
    t = _v(spark, sf_dir, 9).select("vec_id", "v", A.mat(F.slice("v", 1, 4), 2, 2).alias("m2"), A.mat(F.col("v"), 3, 3).alias("m3"))
    t = t.select(
        "vec_id", "m2", "m3", A.inverse(A.broadcasted(F.col("m2"), shift, lambda x, y: x + y), 2).alias("inv"), A.cross(A.vec(F.slice("v", 1, 3)), A.vec(F.slice("v", 4, 3))).alias("c"),
        A.matmul(F.col("m3"), A.transpose(F.col("m3"))).alias("p"),
    )
    cell = lambda name, *at: A.index(F.col(name), *at)
    named = {"det2": A.det(F.col("m2"), 2), "det3": A.det(F.col("m3"), 3), "inv00": cell("inv", 0, 0), "inv01": cell("inv", 0, 1), "trace": A.trace(F.col("m3")), "cross0": cell("c", 0), "cross2": cell("c", 2), "product01": cell("p", 0, 1), "product22": cell("p", 2, 2)}
    return t.select("vec_id", *(F.round(x, 6).alias(n) for n, x in named.items()))


def q_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of a 2 x 3 matrix reshaped to a column, cast half to even after scaling."""
    cut = A.reshape(A.block(A.mat(F.col("v"), 2, 3), [0, 1], [2, 2]), 4, 1)
    return _cells(_v(spark, sf_dir), A.to_integers(A.each(cut, lambda x: F.round(x * 2, 0) / 2)))


def q_matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _v(spark, sf_dir).select(F.col("vec_id").alias("i"), F.posexplode("v").alias("k", "v"))
    b = spark.range(6).select(F.col("id").cast("int").alias("k"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j")).withColumn("v", (F.col("k") - 2 * F.col("j")).cast("double"))
    return matmul_cells(a, b).withColumn("v", F.round("v", 6))


def q_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram(_v(spark, sf_dir), "v", 6).withColumn("v", F.round("v", 6))


def q_gram_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _whole(spark, sf_dir)
    width = df.agg(F.max(F.size("v"))).first()[0] or 0
    return gram(df, "v", width).withColumn("v", F.round("v", 6))


def _transposed(df: DataFrame) -> DataFrame:
    cells = df.select(F.col("vec_id").alias("i"), F.posexplode("v").alias("j", "v"))
    return transpose_cells(cells).withColumn("v", F.round("v", 6))


def q_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transposed(_v(spark, sf_dir, 3))


def q_transpose_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transposed(_whole(spark, sf_dir))


def q_determinant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact determinants of 3 x 3 integer matrices: each vector's cells in thousandths."""
    return determinants(_v(spark, sf_dir, 9).select("vec_id", F.transform("v", lambda x: F.rint(x * 1000).cast("bigint")).alias("m")), "vec_id", "m", 3)


def q_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.broadcasted(A.mat(F.slice("v", 1, 4), 2, 2), A.mat(F.array(*map(F.lit, (3.0, 0.0, 0.0, 3.0))), 2, 2), lambda x, y: x + y)
    t = solve(_v(spark, sf_dir).select("vec_id", m["data"].alias("m"), F.slice("v", 5, 2).alias("b")), "vec_id", "m", "b", 2)
    return t.select("vec_id", F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[1], 6).alias("x1"), (F.col("residual") < 1e-9).alias("solved"))


def q_exact_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.lit(2**62)
    t = table(spark, sf_dir, "part").select("p_partkey", A.add_exact(F.array(F.col("p_partkey") + big, F.col("p_size").cast("bigint")), big * 1).alias("d"))
    return t.select("p_partkey", F.col("d")[0].cast("string").alias("first"), F.col("d")[1].cast("string").alias("second"))


def q_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed boolean tensors: or, xor, and of sign bits as words."""
    word = F.aggregate(F.transform("v", lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("bigint")).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    mask = F.lit(0b101101).cast("bigint")
    return _v(spark, sf_dir).select("vec_id", word.bitwiseOR(mask).alias("either"), word.bitwiseXOR(mask).alias("differ"), word.bitwiseAND(mask).alias("both"))


def q_bits_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed boolean tensors over whole vectors: the sign bits against every third place."""
    df = _whole(spark, sf_dir)
    shape = F.array(F.size("v"))
    t = df.select("vec_id", A.bits(shape, F.transform("v", lambda x: x > 0)).alias("a"), A.bits(shape, F.transform("v", lambda x, i: i % 3 == 0)).alias("b"))
    said = lambda x: F.array_join(F.transform(A.flags_of(x), lambda f: F.when(f, "1").otherwise("0")), "")
    a, b = F.col("a"), F.col("b")
    return t.select("vec_id", said(A.bits_or(a, b)).alias("either"), said(A.bits_xor(a, b)).alias("differ"), said(A.bits_and(a, b)).alias("both"))


def _ratio(num: F.Column, den: F.Column) -> F.Column:
    return S.rational(num, den)


def q_rational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 matrices of exact rationals: m + 1/3 in each cell, then the trace of m m."""
    k, n = F.col("p_partkey"), F.col("p_size")
    cells = F.array(_ratio(k % 97, n), _ratio(n, F.lit(6)), _ratio(-k % 89, F.lit(4)), _ratio(F.lit(1), n))
    t = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", A.tensor_of(F.array(F.lit(2), F.lit(2)), cells).alias("m"))
    third = A.tensor_of(F.array(F.lit(1)), F.array(_ratio(F.lit(1), F.lit(3))))
    moved = t.select("p_partkey", A.broadcasted(F.col("m"), third, S.rational_add).alias("s"), A.matmul_of(F.col("m"), F.col("m"), _ratio(F.lit(0), F.lit(1)), S.rational_add, S.rational_mul).alias("p"))
    said = {"s00": F.col("s.data")[0], "s01": F.col("s.data")[1], "s10": F.col("s.data")[2], "s11": F.col("s.data")[3]}
    return moved.select("p_partkey", *(S.rational_text(c).alias(n) for n, c in said.items()), S.rational_text(S.rational_add(F.col("p.data")[0], F.col("p.data")[3])).alias("trace"))


def _said_sql(num: str, den: str, name: str) -> str:
    return f"CASE WHEN {den} = gcd({num}, {den}) THEN (({num}) // {den})::varchar ELSE (({num}) // gcd({num}, {den}))::varchar || '/' || (({den}) // gcd({num}, {den}))::varchar END AS {name}"


RATIONAL_SQL = f"""WITH p AS (SELECT p_partkey, (p_partkey % 97)::bigint AS k, (-p_partkey % 89)::bigint AS j, p_size::bigint AS n FROM part)
SELECT p_partkey, {_said_sql("(3 * k + n)", "(3 * n)", "s00")}, {_said_sql("(n + 2)", "6", "s01")}, {_said_sql("(3 * j + 4)", "12", "s10")}, {_said_sql("(3 + n)", "(3 * n)", "s11")},
 {_said_sql("(12 * k * k + n * n * n * j + 12)", "(12 * n * n)", "trace")} FROM p"""


def q_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole vectors as complex tensors (neighbouring components are a cell's parts): their squares, cell by cell, and the sum of these."""
    df = _whole(spark, sf_dir)
    half = F.floor(F.size("v") / 2).cast("int")
    cells = F.transform(F.sequence(F.lit(0), half - 1), lambda i: S.complex_of(F.get("v", 2 * i), F.get("v", 2 * i + 1)))
    t = df.select("vec_id", A.tensor_of(F.array(half), cells).alias("z")).select("vec_id", A.broadcasted(F.col("z"), F.col("z"), S.complex_mul).alias("z"))
    summed = t.select("vec_id", A.total_of(F.col("z"), S.complex_of(F.lit(0.0), F.lit(0.0)), S.complex_add).alias("s"))
    return summed.select("vec_id", *(F.round(F.col("s")[f], 6).alias(f) for f in ("re", "im")))


_D = "(embedding[{}]::double)"
_d = [_D.format(i + 1) for i in range(9)]
_gram = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum({_d[i]} * {_d[j]}), 6) AS v FROM embeddings" for i in range(6) for j in range(6))
_det3 = f"{_d[0]} * ({_d[4]} * {_d[8]} - {_d[5]} * {_d[7]}) - {_d[1]} * ({_d[3]} * {_d[8]} - {_d[5]} * {_d[6]}) + {_d[2]} * ({_d[3]} * {_d[7]} - {_d[4]} * {_d[6]})"
_q = [f"round_even({x} * 1000, 0)::bigint" for x in _d]
_det3i = f"{_q[0]} * ({_q[4]} * {_q[8]} - {_q[5]} * {_q[7]}) - {_q[1]} * ({_q[3]} * {_q[8]} - {_q[5]} * {_q[6]}) + {_q[2]} * ({_q[3]} * {_q[7]} - {_q[4]} * {_q[6]})"
_CELLS = "(SELECT vec_id, unnest(range({n})) AS pos, unnest(embedding[1:{n}])::double AS x FROM embeddings)"
_WHOLE = "(SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::double AS x FROM embeddings)"
_safe = f"(({_d[0]} + 3) * ({_d[3]} + 3) - {_d[1]} * {_d[2]})"
_bits = "(" + " + ".join(f"CASE WHEN {_d[i]} > 0 THEN {1 << i} ELSE 0 END" for i in range(6)) + ")::bigint"

QUERIES = {
    "tensor_elementwise": (q_elementwise, f"SELECT vec_id, pos, round(sqrt(abs(x)) + exp(x) + sin(x) * cos(x) - x * x / 2, 6) AS v FROM {_CELLS.format(n=6)}"),
    "tensor_broadcast": (q_broadcast, f"SELECT vec_id, pos, round((x + pos % 3 + 1) * CASE WHEN pos < 3 THEN 10 ELSE -1 END, 6) AS v FROM {_CELLS.format(n=6)}"),
    "tensor_reductions": (q_reductions, f"SELECT vec_id, round(sum(x), 6) AS total, round(min(x), 6) AS least, round(max(x), 6) AS most, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x * (x + 1)), 6) AS dot FROM {_CELLS.format(n=6)} GROUP BY vec_id"),
    "tensor_small_matrices": (q_matrix, f"SELECT vec_id, round({_d[0]} * {_d[3]} - {_d[1]} * {_d[2]}, 6) AS det2, round({_det3}, 6) AS det3, round(({_d[3]} + 3) / {_safe}, 6) AS inv00, round(-{_d[1]} / {_safe}, 6) AS inv01, round({_d[0]} + {_d[4]} + {_d[8]}, 6) AS trace, round({_d[1]} * {_d[5]} - {_d[2]} * {_d[4]}, 6) AS cross0, round({_d[0]} * {_d[4]} - {_d[1]} * {_d[3]}, 6) AS cross2, round({_d[0]} * {_d[3]} + {_d[1]} * {_d[4]} + {_d[2]} * {_d[5]}, 6) AS product01, round({_d[6]} ^ 2 + {_d[7]} ^ 2 + {_d[8]} ^ 2, 6) AS product22 FROM embeddings"),
    "tensor_slice_reshape_cast": (q_shapes, f"SELECT vec_id, CASE pos WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS pos, round_even(round(x * 2, 0) / 2, 0)::bigint AS v FROM {_CELLS.format(n=6)} WHERE pos % 3 > 0"),
    "tensor_matmul": (q_matmul, f"SELECT vec_id AS i, j, round(sum(x * (pos - 2 * j)), 6) AS v FROM {_CELLS.format(n=6)}, (SELECT unnest([0, 1, 2]) AS j) GROUP BY ALL"),
    "tensor_gram": (q_gram, _gram),
    "tensor_transpose": (q_transpose, f"SELECT pos AS i, vec_id AS j, round(x, 6) AS v FROM {_CELLS.format(n=3)}"),
    "tensor_elementwise_wide": (q_elementwise_wide, f"SELECT vec_id, pos, round(sqrt(abs(x)) + exp(x) + sin(x) * cos(x) - x * x / 2, 6) AS v FROM {_WHOLE}"),
    "tensor_reductions_wide": (q_reductions_wide, f"SELECT vec_id, round(sum(x), 6) AS total, round(min(x), 6) AS least, round(max(x), 6) AS most, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x * (x + 1)), 6) AS dot FROM {_WHOLE} GROUP BY vec_id"),
    "tensor_gram_wide": (q_gram_wide, f"SELECT a.pos AS i, b.pos AS j, round(sum(a.x * b.x), 6) AS v FROM {_WHOLE} a JOIN {_WHOLE} b USING (vec_id) GROUP BY ALL"),
    "tensor_transpose_wide": (q_transpose_wide, f"SELECT pos AS i, vec_id AS j, round(x, 6) AS v FROM {_WHOLE}"),
    "tensor_determinant": (q_determinant, f"SELECT vec_id, ({_det3i})::varchar AS determinant FROM embeddings"),
    "tensor_solve": (q_solve, f"SELECT vec_id, round(({_d[4]} * ({_d[3]} + 3) - {_d[1]} * {_d[5]}) / {_safe}, 6) AS x0, round((({_d[0]} + 3) * {_d[5]} - {_d[2]} * {_d[4]}) / {_safe}, 6) AS x1, true AS solved FROM embeddings"),
    "tensor_exact_add": (q_exact_add, "SELECT p_partkey, (p_partkey::hugeint + 9223372036854775808::hugeint)::varchar AS \"first\", (p_size::hugeint + 4611686018427387904::hugeint)::varchar AS \"second\" FROM part"),
    "tensor_bits": (q_bits, f"SELECT vec_id, {_bits} | 45 AS either, xor({_bits}, 45) AS differ, {_bits} & 45 AS both FROM embeddings"),
    "tensor_bits_packed": (q_bits_packed, "SELECT vec_id, string_agg(CASE WHEN x > 0 OR pos % 3 = 0 THEN '1' ELSE '0' END, '' ORDER BY pos) AS either, string_agg(CASE WHEN (x > 0) <> (pos % 3 = 0) THEN '1' ELSE '0' END, '' ORDER BY pos) AS differ, "
        f"string_agg(CASE WHEN x > 0 AND pos % 3 = 0 THEN '1' ELSE '0' END, '' ORDER BY pos) AS both FROM {_WHOLE} GROUP BY vec_id"),
    "tensor_rational": (q_rational, RATIONAL_SQL),
    "tensor_complex": (q_complex, f"SELECT vec_id, round(sum(CASE WHEN pos % 2 = 0 THEN x * x ELSE -x * x END), 6) AS re, round(sum(2 * x * y) FILTER (pos % 2 = 0), 6) AS im FROM (SELECT *, lead(x) OVER (PARTITION BY vec_id ORDER BY pos) AS y FROM {_WHOLE}) GROUP BY vec_id"),
}
