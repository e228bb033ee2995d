"""Markov chains and hidden Markov models over sequences of rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.stats import GOLDEN, splitmix
from orrery.sources.scratch import shared_path
from orrery.sources.tables import series, table


# ---- Markov chains


def transitions(df: DataFrame, seq: str, order: list[str], state: str) -> DataFrame:
    """(from_state, to_state) pairs of neighbouring rows of each sequence; a sequence must be bounded."""
    after = F.lead(state).over(Window.partitionBy(seq).orderBy(*order))
    return df.select(seq, F.col(state).alias("from_state"), after.alias("to_state")).where("to_state IS NOT NULL")


def transition_matrix(pairs: DataFrame, smoothing: float = 1.0, states: DataFrame | None = None) -> DataFrame:
    """from_state, to_state, n, p = (n + a) / (row + a S) for all pairs of the vocabulary, unseen ones included.

    The vocabulary is `states(s)`, or what the pairs hold; the dense matrix has S x S rows, so S is meant to be small and is checked.
    """
    counts = pairs.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    if states is None:
        states = counts.select(F.explode(F.array("from_state", "to_state")).alias("s")).distinct()
    size = states.count()
    if size > 5000:
        raise ValueError(f"{size} states: the dense matrix would have {size * size} rows")
    vocabulary = states.agg(F.sort_array(F.collect_list("s")).alias("v"))  # one row
    dense = vocabulary.select(F.explode("v").alias("from_state"), "v").select("from_state", F.explode("v").alias("to_state"))
    row = Window.partitionBy("from_state")
    n = F.coalesce("n", F.lit(0))
    return dense.join(counts, ["from_state", "to_state"], "left").select("from_state", "to_state", n.alias("n"), ((n + F.lit(smoothing)) / (F.sum(n).over(row) + F.lit(smoothing * size))).alias("p"))


def markov_score(pairs: DataFrame, matrix: DataFrame, seq: str) -> DataFrame:
    """Per sequence: transitions, log-likelihood, mean negative log-likelihood, perplexity. A pair outside the vocabulary raises."""
    known = pairs.join(matrix.select("from_state", "to_state", "p"), ["from_state", "to_state"], "left")
    p = F.coalesce("p", F.raise_error(F.lit("state outside the vocabulary")).cast("double"))
    scored = known.groupBy(seq).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log(p)).alias("log_likelihood"))
    return scored.withColumn("mean_nll", -F.col("log_likelihood") / F.col("n")).withColumn("perplexity", F.exp("mean_nll"))


def held_out_rows(df: DataFrame, seq: str, held_out: int) -> DataFrame:
    """`df` with held_out: whether a row's sequence is among the last `held_out` in order of its key. Raises unless some are left to
    learn from. The cut is one key, found by sorting the keys alone; it reaches the executors as a literal."""
    if held_out < 0:
        raise ValueError("a negative number of sequences")
    if not held_out:
        return df.withColumn("held_out", F.lit(False))
    cut = df.select(seq).where(F.col(seq).isNotNull()).distinct().orderBy(F.col(seq).desc()).offset(held_out - 1).limit(2).collect()
    if len(cut) < 2:
        raise ValueError(f"{held_out} held-out sequences leave none to learn from")
    return df.withColumn("held_out", F.col(seq) >= F.lit(cut[0][0]))


def fit_markov(df: DataFrame, seq: str, order: list[str], state: str, held_out: int = 0, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The transition matrix of all but the last `held_out` sequences, and per sequence its score with held_out.

    The vocabulary is that of the training sequences, those of a single row included; a held-out state outside it raises when the scores
    are read, and so does a smoothing below 0. A part without any pair has no scores.
    """
    if not smoothing >= 0:
        raise ValueError("smoothing below 0")
    rows = held_out_rows(df, seq, held_out)
    after = F.lead(state).over(Window.partitionBy(seq).orderBy(*order))
    pairs = rows.select(seq, "held_out", F.col(state).alias("from_state"), after.alias("to_state")).where("to_state IS NOT NULL")
    vocabulary = rows.where("NOT held_out").select(F.col(state).alias("s")).distinct()
    matrix = transition_matrix(pairs.where("NOT held_out"), smoothing, vocabulary)
    scores = markov_score(pairs.select(F.struct(seq, "held_out").alias("who"), "from_state", "to_state"), matrix, "who")
    return matrix, scores.select(f"who.{seq}", "who.held_out", "n", "log_likelihood", "mean_nll", "perplexity")


def stable_text(matrix: DataFrame, header: str, smoothing: float, held_out: int, corpus: dict[str, str]) -> str:
    """The model as text that is equal for equal models: header, policy, states in order, counts of the pairs seen. Texts are hexadecimal
    UTF-8, smoothing the bits of its double. `corpus` has id, source, license and hash. The matrix is bounded (see transition_matrix)."""
    rows = matrix.select(F.col("from_state").cast("string"), F.col("to_state").cast("string"), "n").orderBy("from_state", "to_state").collect()
    states = sorted({r["from_state"] for r in rows})
    place = {x: i for i, x in enumerate(states)}
    lines = [header, f"additive-smoothing-bits={struct.unpack('>Q', struct.pack('>d', smoothing))[0]:016x}", f"held-out-sequences={held_out}"]
    lines += [f"corpus-{k}={corpus[k].encode().hex()}" for k in ("id", "source", "license", "hash")]
    lines += [f"states={len(states)}", *(f"state={i}:{x.encode().hex()}" for x, i in place.items())]
    counted = sorted((place[r["from_state"]], place[r["to_state"]], r["n"]) for r in rows if r["n"])
    return "\n".join([*lines, *(f"transition={a}:{b}:{n}" for a, b, n in counted)]) + "\n"


def row_stochastic(matrix: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Rows of the matrix that don't sum to 1 or have a probability outside [0, 1]; none for a valid matrix."""
    return matrix.groupBy("from_state").agg(F.sum("p").alias("total"), F.min("p").alias("least")).where((F.abs(F.col("total") - 1) > tolerance) | (F.col("least") < 0))


def fnv1a64(data: bytes) -> int:
    """The 64-bit FNV-1a hash (fixed constants of the published function)."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
    return h


# ---- hidden Markov models


@dataclass
class Hmm:
    """Start, transition and emission probabilities; emissions are discrete (states x symbols) or Gaussian (means, variances)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray | None = None
    mean: np.ndarray | None = None
    variance: np.ndarray | None = None

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            if self.emit is not None:
                return np.log(self.emit[:, x.astype(int)]).T
            return -0.5 * (np.log(2 * np.pi * self.variance) + (x[:, None] - self.mean) ** 2 / self.variance)

    def forward_backward(self, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, state marginals per place, expected transitions; scaled per step."""
        e = self.log_emissions(x)
        top = e.max(1, keepdims=True)
        e = np.exp(e - top)
        n, k = e.shape
        a, b, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
        for t in range(n):
            a[t] = (self.start if t == 0 else a[t - 1] @ self.move) * e[t]
            scale[t] = a[t].sum()
            a[t] /= scale[t]
        for t in range(n - 2, -1, -1):
            b[t] = self.move @ (e[t + 1] * b[t + 1]) / scale[t + 1]
        moves = np.zeros((k, k))
        for t in range(n - 1):
            moves += a[t][:, None] * self.move * (e[t + 1] * b[t + 1]) / scale[t + 1]
        return float(np.log(scale).sum() + top.sum()), a * b, moves

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """Best path; ties to the lowest state."""
        e = self.log_emissions(x)
        with np.errstate(divide="ignore"):
            move, best = np.log(self.move), np.log(self.start) + e[0]
        back = np.zeros(e.shape, int)
        for t in range(1, len(e)):
            step = best[:, None] + move
            back[t] = step.argmax(0)
            best = step.max(0) + e[t]
        path = [int(best.argmax())]
        for t in range(len(e) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return np.array(path[::-1])


def decode(df: DataFrame, seq: str, model: Hmm) -> DataFrame:
    """`df(seq, t, x)`: per row the Viterbi state, the most probable state and its probability; per sequence in one task."""
    kind = df.schema[seq].dataType.simpleString()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        x = frame["x"].to_numpy()
        log_likelihood, marginal, _ = model.forward_backward(x)
        return pd.DataFrame({seq: frame[seq], "t": frame["t"], "path": model.viterbi(x), "state": marginal.argmax(1), "confidence": marginal.max(1), "log_likelihood": log_likelihood})

    return df.select(seq, "t", "x").groupBy(seq).applyInPandas(one, f"{seq} {kind}, t long, path int, state int, confidence double, log_likelihood double")


class Units:
    """Seeded uniforms in [0, 1): the generator's top 53 bits."""

    def __init__(self, seed: int):
        self.state = seed

    def next(self) -> int:
        self.state = (self.state + GOLDEN) & (2**64 - 1)
        return int(splitmix(np.array([self.state], np.uint64))[0])

    def unit(self) -> float:
        return (self.next() >> 11) / 2**53


def first_model(states: int, symbols: int, seed: int) -> Hmm:
    """Each probability proportional to 0.5 + a uniform; drawn for start, transition rows, emission rows in this order."""
    r = Units(seed)
    row = lambda n: (lambda v: v / v.sum())(np.array([0.5 + r.unit() for _ in range(n)]))
    start = row(states)
    move = np.array([row(states) for _ in range(states)])
    return Hmm(start, move, np.array([row(symbols) for _ in range(states)]))


def fit(df: DataFrame, seq: str, states: int, symbols: int, seed: int = 23, rounds: int = 6, smoothing: float = 1e-6, tolerance: float = 1e-9, start: Hmm | None = None) -> tuple[Hmm, list[float]]:
    """Baum-Welch over `df(seq, t, x)` with symbols 0 … symbols - 1, from `start` or a seeded model.

    E-step: sequences in parallel emit expected counts, added per task before they are summed by Spark; M-step on the summed counts,
    whose number depends on the model alone. The log-likelihoods are those before each round's update and after the last.
    """
    sequences = df.groupBy(seq).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda r: r["x"].cast("int")).alias("xs")).select("xs").cache()
    model, found = start or first_model(states, symbols, seed), []

    def expected(model: Hmm):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols)), 0.0
            for batch in batches:
                for xs in batch["xs"]:
                    x = np.asarray(xs)
                    ll, marginal, moves = model.forward_backward(x)
                    total += ll
                    start += marginal[0]
                    move += moves
                    for s in range(symbols):
                        emit[:, s] += marginal[x == s].sum(0)
            values = np.concatenate([[total], start, move.ravel(), emit.ravel()])
            yield pd.DataFrame({"i": np.arange(len(values)), "v": values})

        rows = sequences.mapInPandas(count, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        return np.array([r["v"] for r in rows])

    for number in range(rounds + 1):
        v = expected(model)
        if found and v[0] < found[-1] - 1e-9 * abs(found[-1]) - 1e-9:
            raise ArithmeticError("the likelihood fell")
        found.append(float(v[0]))
        if number == rounds or (len(found) > 1 and found[-1] - found[-2] <= tolerance):
            break
        start, move, emit = v[1 : 1 + states], v[1 + states : 1 + states + states**2].reshape(states, states), v[1 + states + states**2 :].reshape(states, symbols)
        norm = lambda m: (m + smoothing) / (m + smoothing).sum(-1, keepdims=True)
        model = Hmm(norm(start), norm(move), norm(emit))
    sequences.unpersist()
    return model, found


def values_at(df: DataFrame, order: list[str], value: str, places: list[int]) -> list[float]:
    """The values at the given places of `df` sorted by `order`: rows are numbered by their sorted partition and their place in it, so
    only a count a partition reaches the driver."""
    spark, at = df.sparkSession, shared_path(df.sparkSession, "sorted")
    df.orderBy(*order).select(F.monotonically_increasing_id().alias("m"), F.col(value).cast("double").alias("v")).write.parquet(at)
    numbered = spark.read.parquet(at)
    counts = numbered.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    found = {}
    for wanted in sorted(set(places)):
        before = 0
        for r in counts:
            if wanted < before + r["n"]:
                found[wanted] = (r["p"] << 33) + wanted - before
                break
            before += r["n"]
    got = {r["m"]: r["v"] for r in numbered.where(F.col("m").isin(list(found.values()))).collect()}
    return [got[found[w]] for w in places]


def first_gaussian_model(df: DataFrame, seq: str, states: int, seed: int, variance_floor: float) -> Hmm:
    """Start and transition rows as `first_model` draws them; means are values drawn from all rows in order of (seq, t), variances that of
    all values."""
    r = Units(seed)
    row = lambda n: (lambda v: v / v.sum())(np.array([0.5 + r.unit() for _ in range(n)]))
    start, move = row(states), np.array([row(states) for _ in range(states)])
    known = df.agg(F.count("x").alias("n"), F.var_pop("x").alias("variance")).first()
    means = values_at(df, [seq, "t"], "x", [r.next() % known["n"] for _ in range(states)])
    return Hmm(start, move, mean=np.array(means), variance=np.full(states, max(known["variance"], variance_floor)))


def fit_gaussian(df: DataFrame, seq: str, states: int, seed: int = 23, rounds: int = 6, smoothing: float = 1e-6, tolerance: float = 1e-9, variance_floor: float = 1e-6, floor: float = 1e-12) -> tuple[Hmm, list[float]]:
    """Baum-Welch over `df(seq, t, x)` with a Gaussian a state: as `fit`, with sums of weights, values and squares in place of symbol
    counts. A state of no weight keeps its mean and variance. Values are taken from their mean, so that squares keep their digits."""
    if df.where("x IS NULL OR isnan(x)").limit(1).count():
        raise ValueError("missing values")
    centre = df.agg(F.avg("x")).first()[0]
    if centre is None:
        raise ValueError("no sequences")
    sequences = df.groupBy(seq).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda r: r["x"].cast("double")).alias("xs")).select("xs").cache()
    model, found = first_gaussian_model(df, seq, states, seed, variance_floor), []

    def expected(model: Hmm) -> np.ndarray:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start, move, sums, total = np.zeros(states), np.zeros((states, states)), np.zeros((3, states)), 0.0
            for batch in batches:
                for xs in batch["xs"]:
                    x = np.asarray(xs, float)
                    ll, marginal, moves = model.forward_backward(x)
                    near = x - centre
                    total += ll
                    start += marginal[0]
                    move += moves
                    sums += np.array([marginal.sum(0), near @ marginal, near**2 @ marginal])
            values = np.concatenate([[total], start, move.ravel(), sums.ravel()])
            yield pd.DataFrame({"i": np.arange(len(values)), "v": values})

        rows = sequences.mapInPandas(count, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        return np.array([r["v"] for r in rows])

    for number in range(rounds + 1):
        v = expected(model)
        found.append(float(v[0]))
        if number == rounds or (len(found) > 1 and abs(found[-1] - found[-2]) <= tolerance):
            break
        start, move, (weight, first, second) = v[1 : 1 + states], v[1 + states : 1 + states + states**2].reshape(states, states), v[1 + states + states**2 :].reshape(3, states)
        norm = lambda m: np.maximum(m + smoothing, floor) / np.maximum(m + smoothing, floor).sum(-1, keepdims=True)
        some = weight > floor
        safe = np.where(some, weight, 1.0)
        mean = np.where(some, centre + first / safe, model.mean)
        variance = np.where(some, np.maximum(second / safe - (first / safe) ** 2, variance_floor), model.variance)
        model = Hmm(norm(start), norm(move), mean=mean, variance=variance)
    sequences.unpersist()
    return model, found


# ---- queries


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def q_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transition_matrix(user_events(spark, sf_dir)).withColumn("p", F.round("p", 6))


def q_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on users below 90 of each hundred, scored on the others (a held-out set, part of the operator)."""
    pairs = user_events(spark, sf_dir)
    matrix = transition_matrix(pairs.where("user_id % 100 < 90"))
    t = markov_score(pairs.where("user_id % 100 >= 90"), matrix, "user_id")
    return t.select("user_id", "n", *(F.round(c, 6).alias(c) for c in ("log_likelihood", "mean_nll", "perplexity")))


def q_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's score under the chain of all users but the last ten."""
    _, scores = fit_markov(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", 10)
    return scores.select("user_id", "held_out", "n", *(F.round(c, 6).alias(c) for c in ("log_likelihood", "mean_nll", "perplexity")))


HOLDOUT_SQL = """WITH h AS (SELECT *, user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id DESC LIMIT 10) AS held_out FROM events),
 p AS (SELECT user_id, held_out, event_type AS f, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM h), v AS (SELECT count(DISTINCT event_type) AS s FROM h WHERE NOT held_out),
 c AS (SELECT f, t, count(*) AS n FROM p WHERE t IS NOT NULL AND NOT held_out GROUP BY ALL), r AS (SELECT f, sum(n) AS n FROM c GROUP BY f),
 s AS (SELECT user_id, held_out, count(*) AS n, sum(ln((coalesce(c.n, 0) + 1.0) / (coalesce(r.n, 0) + v.s))) AS l FROM p CROSS JOIN v LEFT JOIN c USING (f, t) LEFT JOIN r USING (f) WHERE p.t IS NOT NULL GROUP BY ALL)
SELECT user_id, held_out, n, round(l, 6) AS log_likelihood, round(-l / n, 6) AS mean_nll, round(exp(-l / n), 6) AS perplexity FROM s"""


def q_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    model, found = fit_gaussian(series(events, ["user_id"], ["ts", "event_id"], "value").withColumnRenamed("idx", "t"), "user_id", 2)
    rows = [(i, float(model.mean[i]), float(model.variance[i]), float(model.start[i])) for i in range(2)]
    return spark.createDataFrame(rows, "state int, mean double, variance double, start double").withColumn("log_likelihood", F.lit(found[-1]))


def q_stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_stochastic(transition_matrix(user_events(spark, sf_dir))).agg(F.count(F.lit(1)).alias("bad_rows"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as symbols: whether the text is longer than 200 characters."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("t"), F.when(F.length("text") > 200, 1).otherwise(0).alias("x"))


EXAMPLE = Hmm(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[0.9, 0.1], [0.2, 0.8]]))


def q_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(roles(spark, sf_dir), "conv_id", EXAMPLE).select("conv_id", "t", "path", "state", F.round("confidence", 6).alias("confidence"), F.round("log_likelihood", 6).alias("log_likelihood"))


def q_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, found = fit(roles(spark, sf_dir), "conv_id", 2, 2)
    rows = [(i, j, round(float(model.move[i, j]), 6), round(float(model.emit[i, j]), 6)) for i in range(2) for j in range(2)]
    return spark.createDataFrame(rows, "state int, other int, move double, emit double").withColumn("log_likelihood", F.lit(round(found[-1], 4)))


_PAIRS = "p AS (SELECT user_id, event_type AS from_state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_state FROM events)"


def _matrix_sql(where: str) -> str:
    return f"""c AS (SELECT from_state, to_state, count(*) AS n FROM p WHERE to_state IS NOT NULL AND {where} GROUP BY ALL),
 v AS (SELECT from_state AS s FROM c UNION SELECT to_state FROM c),
 m AS (SELECT a.s AS from_state, b.s AS to_state, coalesce(c.n, 0) AS n, (coalesce(c.n, 0) + 1.0) / (sum(coalesce(c.n, 0)) OVER (PARTITION BY a.s) + (SELECT count(*) FROM v)) AS p
 FROM v a CROSS JOIN v b LEFT JOIN c ON c.from_state = a.s AND c.to_state = b.s)"""


QUERIES = {
    "markov_matrix": (q_matrix, f"WITH {_PAIRS}, {_matrix_sql('true')} SELECT from_state, to_state, n, round(p, 6) AS p FROM m"),
    "markov_score": (q_score, f"WITH {_PAIRS}, {_matrix_sql('user_id % 100 < 90')}, s AS (SELECT user_id, count(*) AS n, sum(ln(m.p)) AS l FROM p JOIN m USING (from_state, to_state) WHERE user_id % 100 >= 90 GROUP BY user_id) SELECT user_id, n, round(l, 6) AS log_likelihood, round(-l / n, 6) AS mean_nll, round(exp(-l / n), 6) AS perplexity FROM s"),
    "markov_row_stochastic": (q_stochastic, "SELECT 0 AS bad_rows"),
    "markov_holdout": (q_holdout, HOLDOUT_SQL),
    "hmm_fit_gaussian": (q_gaussian, None),
    "hmm_fit": (q_fit, None),
}
