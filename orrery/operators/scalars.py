"""Queries of the scalar functions over table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import big as B
from orrery.functions import scalar as S
from orrery.sources.tables import spread, table

BIG = 9_007_199_254_740_993  # 2^53 + 1


def integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, differences and products past 64 bits; remainder, power, comparison, negation."""
    a, b, k = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", S.add(a, b, k).cast("string").alias("added"), S.sub(a, b, k).cast("string").alias("taken"), S.mul(a, b, F.lit(BIG)).cast("string").alias("times"),
        S.rem(b - a, k + 1).cast("string").alias("rest"), S.power(k, k).cast("string").alias("raised"), S.compare(a, b).alias("compared"), S.neg(a).cast("string").alias("negated"),
    )


INTEGERS_SQL = f"""
SELECT l_orderkey, l_linenumber, (l_orderkey::hugeint + l_partkey + l_linenumber)::varchar AS added, (l_orderkey::hugeint - l_partkey - l_linenumber)::varchar AS taken,
 (l_orderkey::hugeint * l_partkey * {BIG}::hugeint)::varchar AS times, ((l_partkey - l_orderkey) % (l_linenumber + 1))::varchar AS rest,
 list_reduce(list_transform(range(l_linenumber), lambda i: l_linenumber::hugeint), lambda x, y: x * y)::varchar AS raised,
 CASE WHEN l_orderkey < l_partkey THEN -1 WHEN l_orderkey = l_partkey THEN 0 ELSE 1 END AS compared, (-l_orderkey)::varchar AS negated
FROM lineitem
"""


def rationals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotients of integers in lowest terms, their sums, differences, products, quotients and powers."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    base = orders.select("o_orderkey", S.rational(F.col("o_custkey"), F.col("o_orderkey") + 1).alias("r"), S.rational(F.lit(-5), F.length("o_orderpriority")).alias("q"))
    text = lambda c, name: S.rational_text(c).alias(name)
    r, q = F.col("r"), F.col("q")
    return base.select(
        "o_orderkey", text(r, "ratio"), text(S.rational_add(r, q), "added"), text(S.rational_sub(r, q), "taken"), text(S.rational_mul(r, q), "times"), text(S.rational_div(r, q), "over"),
        text(S.rational_power(q, -2), "raised"), text(S.rational_neg(r), "negated"), F.round(S.rational_value(r), 9).alias("value"),
    )


def _frac(n: str, d: str) -> str:
    g = f"(gcd({n}, {d}) * sign({d}))::hugeint"
    return f"CASE WHEN ({d}) // {g} = 1 THEN (({n}) // {g})::varchar ELSE (({n}) // {g})::varchar || '/' || (({d}) // {g})::varchar END"


RATIONALS_SQL = f"""
WITH t AS (SELECT o_orderkey, o_custkey::hugeint AS a, o_orderkey::hugeint + 1 AS b, -5::hugeint AS c, length(o_orderpriority)::hugeint AS d FROM orders)
SELECT o_orderkey, {_frac("a", "b")} AS ratio, {_frac("a * d + c * b", "b * d")} AS added, {_frac("a * d - c * b", "b * d")} AS taken, {_frac("a * c", "b * d")} AS times,
 {_frac("a * d", "b * c")} AS over, {_frac("d * d", "c * c")} AS raised, {_frac("-a", "b")} AS negated, round(a::double / b, 9) AS value FROM t
"""


def rational_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("/", F.col("p_size").cast("string"), (F.length("p_name") * 2).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("given"), S.rational_text(S.rational_of(text)).alias("reduced"))


RATIONAL_PARSE_SQL = f"""
WITH t AS (SELECT p_partkey, p_size::hugeint AS a, length(p_name)::hugeint * 2 AS b FROM part)
SELECT p_partkey, a::varchar || '/' || b::varchar AS given, {_frac("a", "b")} AS reduced FROM t
"""


def floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float arithmetic in 64 and 32 bits, division by zero by the IEEE rules."""
    a, b = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(a + b, 6).alias("added"), F.round(a * b, 6).alias("times"), F.round(F.when(b != 0, S.divide(a, b)), 4).alias("over"),
        (S.divide(a, b) == float("inf")).alias("infinite"), F.isnan(S.divide(F.lit(0.0), b)).alias("undefined"), F.round((a.cast("float") * F.lit(2).cast("float")).cast("double"), 2).alias("single"),
    )


FLOATS_SQL = """
SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_discount, 6) AS added, round(l_extendedprice * l_discount, 6) AS times, round(l_extendedprice / nullif(l_discount, 0), 4) AS over,
 l_discount = 0 AS infinite, l_discount = 0 AS undefined, round((l_extendedprice::float * 2::float)::double, 2) AS single FROM lineitem
"""


def complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = S.complex_of(F.col("l_quantity"), F.col("l_discount")), S.complex_of(F.col("l_tax"), F.col("l_linenumber"))
    out = []
    for name, c in (("added", S.complex_add(a, b)), ("taken", S.complex_sub(a, b)), ("times", S.complex_mul(a, b)), ("over", S.complex_div(a, b)), ("negated", S.complex_neg(a))):
        out += [F.round(c["re"], 6).alias(f"{name}_re"), F.round(c["im"], 6).alias(f"{name}_im")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *out, F.round(S.complex_abs(a), 6).alias("modulus"))


COMPLEXES_SQL = """
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS c, l_linenumber::double AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a + c, 6) AS added_re, round(b + d, 6) AS added_im, round(a - c, 6) AS taken_re, round(b - d, 6) AS taken_im, round(a * c - b * d, 6) AS times_re,
 round(a * d + b * c, 6) AS times_im, round((a * c + b * d) / (c * c + d * d), 6) AS over_re, round((b * c - a * d) / (c * c + d * d), 6) AS over_im, round(-a, 6) AS negated_re, round(-b, 6) AS negated_im,
 round(sqrt(a * a + b * b), 6) AS modulus FROM t
"""


def booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.groupBy(S.bool_add(a, b).alias("added"), S.bool_mul(a, b).alias("times"), S.bool_sub(a, b).alias("taken"), (~a).alias("negated")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("b").alias("summed"), F.bool_and("b").alias("multiplied")
    )


BOOLEANS_SQL = """
WITH t AS (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels)
SELECT a OR b AS added, a AND b AS times, a <> b AS taken, NOT a AS negated, count(*) AS n, bool_or(b) AS summed, bool_and(b) AS multiplied FROM t GROUP BY ALL
"""


def reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums and products: a sum of widened keys, the product of an order's quantities."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(S.wide(F.col("l_partkey"))).alias("s"), F.collect_list(F.col("l_quantity").cast("int")).alias("q"))
    return lines.select("l_orderkey", F.col("s").cast("string").alias("summed"), S.product(F.col("q")).cast("string").alias("multiplied"))


REDUCTIONS_SQL = """
SELECT l_orderkey, sum(l_partkey::hugeint)::varchar AS summed, list_reduce(list(l_quantity::int::hugeint), lambda x, y: x * y)::varchar AS multiplied FROM lineitem GROUP BY l_orderkey
"""


def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continued fractions of ratios: coefficients, value, and the exact convergent, which gives the ratio back."""
    t = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").withColumn("cf", S.fraction_coefficients(F.col("o_orderkey"), F.col("o_custkey") + 1))
    return t.select("o_orderkey", F.array_join(F.transform("cf", lambda x: x.cast("string")), ",").alias("coefficients"), F.round(S.fraction_value(F.col("cf")), 9).alias("value"), S.rational_text(S.fraction_convergent(F.col("cf"))).alias("ratio"))


FRACTIONS_SQL = f"""
WITH RECURSIVE e(o_orderkey, a, b, out, step) AS (
 SELECT o_orderkey, o_orderkey::hugeint, (o_custkey + 1)::hugeint, '', 0 FROM orders
 UNION ALL SELECT o_orderkey, b, a % b, CASE WHEN step = 0 THEN (a // b)::varchar ELSE out || ',' || (a // b)::varchar END, step + 1 FROM e WHERE b <> 0)
SELECT e.o_orderkey, e.out AS coefficients, round(o.o_orderkey::double / (o.o_custkey + 1), 9) AS value, {_frac("o.o_orderkey::hugeint", "(o.o_custkey + 1)::hugeint")} AS ratio
FROM e JOIN orders o USING (o_orderkey) WHERE e.b = 0
"""

def rational_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal texts as exact rationals, and a quotient of two."""
    text = F.col("l_discount").cast("string")
    both = F.concat_ws("/", text, F.col("l_quantity").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_discount", "l_quantity").distinct()
    return rows.select("l_discount", "l_quantity", S.rational_text(S.rational_of(text)).alias("exact"), S.rational_text(S.rational_of(both)).alias("quotient"))


RATIONAL_DECIMALS_SQL = """WITH d AS (SELECT DISTINCT l_discount, l_quantity, round(l_discount * 100)::bigint AS n, round(l_quantity)::bigint * 100 AS q FROM lineitem)
SELECT l_discount, l_quantity, CASE WHEN n % 100 = 0 THEN (n // 100)::varchar ELSE (n // gcd(n, 100))::varchar || '/' || (100 // gcd(n, 100))::varchar END AS exact,
 CASE WHEN n % q = 0 THEN (n // q)::varchar ELSE (n // gcd(n, q))::varchar || '/' || (q // gcd(n, q))::varchar END AS quotient FROM d"""

#: The number kinds, the Spark type of each, and whether its results are exact.
DOMAINS = [
    ("bool", "BOOLEAN", True), ("i8", "TINYINT", True), ("i16", "SMALLINT", True), ("i32", "INT", True), ("i64", "BIGINT", True), ("bigint", "DECIMAL(38,0)", True),
    ("rational", "STRUCT<num DECIMAL(38,0), den DECIMAL(38,0)>", True), ("f32", "FLOAT", False), ("f64", "DOUBLE", False), ("complex", "STRUCT<re DOUBLE, im DOUBLE>", False), ("cf", "ARRAY<DECIMAL(38,0)>", True),
]


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "name string, spark_type string, exact boolean")


DOMAINS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}', {str(e).lower()})" for n, t, e in DOMAINS) + ") AS t(name, spark_type, exact)"


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed integers and what they promote to, as casts of one column."""
    c = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", c.cast("tinyint").cast("int").alias("i8"), c.cast("smallint").cast("int").alias("i16"), c.cast("bigint").alias("i64"), c.cast("decimal(38,0)").cast("string").alias("bigint"), c.cast("float").cast("double").alias("f32"), c.cast("double").alias("f64")
    )


PROMOTIONS_SQL = "SELECT p_partkey, p_size::tinyint::int AS i8, p_size::smallint::int AS i16, p_size::bigint AS i64, p_size::varchar AS \"bigint\", p_size::float::double AS f32, p_size::double AS f64 FROM part"

def fraction_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convergents of the built-in continued fractions after as many terms as the part's size."""
    p = table(spark, sf_dir, "part").select("p_size").distinct()
    named = F.array(*[F.struct(F.lit(n).alias("name"), S.fraction_constant(n, F.col("p_size")).alias("terms")) for n in S.FRACTION_STARTS])
    each = p.select(F.col("p_size").alias("terms"), F.explode(named).alias("c")).withColumn("r", S.fraction_convergent(F.col("c.terms")))
    return each.select("terms", "c.name", F.col("r.num").cast("string").alias("num"), F.col("r.den").cast("string").alias("den"))


FRACTION_CONSTANTS_SQL = """
WITH RECURSIVE n AS (SELECT unnest(['sqrt2', 'phi', 'e', 'pi']) AS name),
 t AS (SELECT name, i, CASE name WHEN 'sqrt2' THEN CASE WHEN i = 0 THEN 1 ELSE 2 END WHEN 'phi' THEN 1
   WHEN 'e' THEN CASE WHEN i = 0 THEN 2 WHEN i % 3 = 2 THEN 2 * ((i + 1) // 3) ELSE 1 END
   ELSE CASE i WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 15 WHEN 4 THEN 292 ELSE 1 END END::hugeint AS a FROM n, (SELECT unnest(range(60)) AS i)),
 c AS (SELECT name, 0::bigint AS i, a AS h, 1::hugeint AS h0, 1::hugeint AS k, 0::hugeint AS k0 FROM t WHERE i = 0
  UNION ALL SELECT c.name, t.i, t.a * c.h + c.h0, c.h, t.a * c.k + c.k0, c.k FROM c JOIN t ON t.name = c.name AND t.i = c.i + 1)
SELECT p_size AS terms, name, h::varchar AS num, k::varchar AS den FROM c JOIN (SELECT DISTINCT p_size FROM part) p ON c.i = p.p_size - 1
"""


def complex_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex numbers written as text, read and squared."""
    text = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("+"), (F.col("p_partkey") % 100).cast("string"), F.lit(".5i"))
    p = table(spark, sf_dir, "part").select("p_partkey", S.complex_parse(text).alias("z"))
    return p.select("p_partkey", S.complex_text(F.col("z")).alias("said"), *(S.complex_mul(F.col("z"), F.col("z"))[f].alias(f) for f in ("re", "im")))


COMPLEX_TEXTS_SQL = """
WITH z AS (SELECT p_partkey, p_size::double AS x, (CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END) * (p_partkey % 100 + 0.5::double) AS y FROM part)
SELECT p_partkey, x::varchar || CASE WHEN y < 0 THEN '' ELSE '+' END || y::varchar || 'i' AS said, x * x - y * y AS re, 2 * x * y AS im FROM z
"""


def fraction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continued fractions of ratios that lie a ten-millionth or less from an integer."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.explode(F.array(*[(F.col("p_size").cast("bigint") * den + off).alias("x") for den in (10**7, 10**12) for off in (-1, 1)])).alias("num"))
    cut = p.withColumn("den", F.when(F.col("num") < 10**10, 10**7).otherwise(10**12))
    return cut.select("p_partkey", "num", F.array_join(S.fraction_coefficients(F.col("num"), F.col("den")).cast("array<string>"), ",").alias("coefficients"))


FRACTION_EDGES_SQL = """
WITH RECURSIVE p AS (SELECT p_partkey, p_size * den + off AS num, CASE WHEN p_size * den + off < 10000000000 THEN 10000000 ELSE 1000000000000 END AS den
  FROM part, (SELECT unnest([10000000, 1000000000000]) AS den), (SELECT unnest([-1, 1]) AS off)),
e(p_partkey, num, a, b, out, step) AS (
 SELECT p_partkey, num, num::hugeint, den::hugeint, '', 0 FROM p
 UNION ALL SELECT p_partkey, num, b, a % b, CASE WHEN step = 0 THEN (a // b)::varchar ELSE out || ',' || (a // b)::varchar END, step + 1 FROM e WHERE b <> 0)
SELECT p_partkey, num, out AS coefficients FROM e WHERE b = 0
"""


def big_operands(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Integers of 200 and 120 digits a part, some negative; `more` columns of the part beside them."""
    long = lambda c, times, digits: F.substring(F.repeat(c.cast("string"), times), 1, digits)
    key, size = F.col("p_partkey") * 7919 + 13, F.col("p_size") * 104_729 + F.col("p_partkey")
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", *more), "p_partkey")
    p = part.select("p_partkey", *more, F.concat(F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(""), long(key, 100, 200)).alias("x"), F.concat(F.when(F.col("p_size") % 2 == 0, "-").otherwise(""), long(size, 60, 120)).alias("y"))
    return p.select("p_partkey", *more, B.parse(F.col("x")).alias("a"), B.parse(F.col("y")).alias("b"))


_BIG_OPERANDS_SQL = """p AS (
 SELECT p_partkey, p_partkey % 3 = 0 AS an, p_size % 2 = 0 AS bn, left(repeat((p_partkey * 7919 + 13)::varchar, 100), 200) AS x, left(repeat((p_size * 104729 + p_partkey)::varchar, 60), 120) AS y FROM part),
signed AS (SELECT p_partkey, CASE WHEN an THEN '-' ELSE '' END || x AS xs, CASE WHEN bn THEN '-' ELSE '' END || y AS ys FROM p)"""


def big_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, differences, products, quotients and powers past 38 digits."""
    a, b, k = F.col("a"), F.col("b"), F.col("p_partkey")
    short = B.parse(F.concat((k % 90_000 + 10_001).cast("string"), F.lit("00000000007")))
    first = big_operands(spark, sf_dir).select("p_partkey", "a", "b", B.add(a, b).alias("added"), B.subtract(a, b).alias("taken"), B.multiply(a, b).alias("times"), B.divide(a, b).alias("d"), B.divide(a, short).alias("s"), B.compare(a, b).alias("compared"))
    second = first.select("*", B.multiply(F.col("d.quotient"), b).alias("part"), B.power(B.add(B.parse(F.lit("1" + "0" * 50)), B.of(k)), 4).alias("raised"))
    third = second.select("*", B.add(F.col("part"), F.col("d.rest")).alias("back"), F.col("s.quotient").alias("over"), F.col("s.rest").alias("rest"), (B.compare(B.magnitude(F.col("d.rest")), B.magnitude(b)) < 0).alias("below"))
    return third.select("p_partkey", "compared", "below", *[B.text(F.col(c)).alias(c) for c in ("added", "taken", "times", "back", "over", "rest", "raised")])


BIG_INTEGERS_SQL = f"""
WITH RECURSIVE {_BIG_OPERANDS_SQL},
xs AS (SELECT p_partkey, an <> bn AS n, i, substring('0000000' || x, i * 9 + 1, 9)::hugeint AS v FROM p, (SELECT unnest(range(23)) AS i)),
ys AS (SELECT p_partkey, i, substring('000000' || y, i * 9 + 1, 9)::hugeint AS v FROM p, (SELECT unnest(range(14)) AS i)),
times AS (SELECT p_partkey, CASE WHEN n THEN '-' ELSE '' END || sum((v || repeat('0', 9 * k))::bignum)::varchar AS t
 FROM (SELECT xs.p_partkey, n, 35 - xs.i - ys.i AS k, sum(xs.v * ys.v)::varchar AS v FROM xs JOIN ys USING (p_partkey) GROUP BY ALL) GROUP BY p_partkey, n),
long(p_partkey, i, r, q) AS (
 SELECT p_partkey, 0, 0::hugeint, '' FROM p
 UNION ALL SELECT l.p_partkey, i + 1, (r * 10 + substring(x, i + 1, 1)::hugeint) % c, q || ((r * 10 + substring(x, i + 1, 1)::hugeint) // c)::varchar
 FROM long l JOIN p USING (p_partkey), (SELECT p_partkey AS key, ((p_partkey % 90000 + 10001)::varchar || '00000000007')::hugeint AS c FROM part) d WHERE d.key = l.p_partkey AND i < 200)
SELECT p_partkey, CASE WHEN xs::bignum < ys::bignum THEN -1 WHEN xs::bignum > ys::bignum THEN 1 ELSE 0 END AS compared, true AS below,
 (xs::bignum + ys::bignum)::varchar AS added, (xs::bignum - ys::bignum)::varchar AS taken, t AS times, xs AS back,
 CASE WHEN an THEN '-' ELSE '' END || ltrim(q, '0') AS over, CASE WHEN an AND r > 0 THEN '-' ELSE '' END || r::varchar AS rest,
 '1' || lpad((4 * p_partkey)::varchar, 50, '0') || lpad((6 * p_partkey::hugeint * p_partkey)::varchar, 50, '0') || lpad((4 * p_partkey::hugeint * p_partkey * p_partkey)::varchar, 50, '0')
  || lpad((p_partkey::hugeint * p_partkey * p_partkey * p_partkey)::varchar, 50, '0') AS raised
FROM p JOIN signed USING (p_partkey) JOIN times USING (p_partkey) JOIN long USING (p_partkey) WHERE i = 200
"""


def big_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of integers of 200 digits a brand."""
    return B.total(big_operands(spark, sf_dir, "p_brand").select("p_brand", "a"), ["p_brand"], F.col("a")).select("p_brand", B.text(F.col("total")).alias("total"))


BIG_TOTALS_SQL = f"""
WITH {_BIG_OPERANDS_SQL} SELECT p_brand, sum(xs::bignum)::varchar AS total FROM signed JOIN part USING (p_partkey) GROUP BY p_brand
"""


def big_rationals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and products of ratios of neighbours of 10^30 + key, in lowest terms."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = [B.add(B.parse(F.lit("1" + "0" * 30)), B.of(F.col("s_suppkey") + i)).alias(f"n{i}") for i in range(3)]
    whole = s.select("s_suppkey", *n)
    one = B.of(F.lit(1))
    pair = lambda a, b: F.struct(a.alias("num"), b.alias("den"))
    r = whole.select("s_suppkey", pair(one, F.col("n0")).alias("a"), pair(one, F.col("n1")).alias("b"), pair(F.col("n0"), F.col("n1")).alias("x"), pair(F.col("n1"), F.col("n2")).alias("y"))
    made = r.select("s_suppkey", B.rational_add(F.col("a"), F.col("b")).alias("added"), B.rational_sub(F.col("a"), F.col("b")).alias("taken"), B.rational_mul(F.col("x"), F.col("y")).alias("times"), B.rational_compare(F.col("x"), F.col("y")).alias("compared"))
    return B.reduced(made, "added", "taken", "times").select("s_suppkey", "compared", *[B.rational_text(F.col(c)).alias(c) for c in ("added", "taken", "times")])


BIG_RATIONALS_SQL = """
WITH t AS (SELECT s_suppkey, s_suppkey::hugeint AS k, '1' || lpad((2 * s_suppkey + 1)::varchar, 30, '0') || lpad((s_suppkey::hugeint * (s_suppkey + 1))::varchar, 30, '0') AS den FROM supplier)
SELECT s_suppkey, -1 AS compared, '2' || lpad((2 * k + 1)::varchar, 30, '0') || '/' || den AS added, '1/' || den AS taken,
 CASE WHEN k % 2 = 0 THEN '5' || lpad((k // 2)::varchar, 29, '0') || '/5' || lpad((k // 2 + 1)::varchar, 29, '0')
 ELSE '1' || lpad(k::varchar, 30, '0') || '/1' || lpad((k + 2)::varchar, 30, '0') END AS times FROM t
"""


QUERIES = {
    "scalar_big": (big_integers, BIG_INTEGERS_SQL), "scalar_big_totals": (big_totals, BIG_TOTALS_SQL), "scalar_big_rationals": (big_rationals, BIG_RATIONALS_SQL), "scalar_fraction_edges": (fraction_edges, FRACTION_EDGES_SQL),
    "scalar_fraction_constants": (fraction_constants, FRACTION_CONSTANTS_SQL), "scalar_complex_text": (complex_texts, COMPLEX_TEXTS_SQL),
    "scalar_integers": (integers, INTEGERS_SQL), "scalar_rationals": (rationals, RATIONALS_SQL), "scalar_rational_parse": (rational_parse, RATIONAL_PARSE_SQL), "scalar_rational_decimals": (rational_decimals, RATIONAL_DECIMALS_SQL), "scalar_floats": (floats, FLOATS_SQL),
    "scalar_complex": (complexes, COMPLEXES_SQL), "scalar_booleans": (booleans, BOOLEANS_SQL), "scalar_reductions": (reductions, REDUCTIONS_SQL), "scalar_continued_fractions": (fractions, FRACTIONS_SQL),
    "scalar_domains": (domains, DOMAINS_SQL), "scalar_promotions": (promotions, PROMOTIONS_SQL),
}
