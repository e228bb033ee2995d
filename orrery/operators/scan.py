"""Hidden Markov models over one sequence of any length, by scans over blocks.

What a block of observations does to the state before it is a k x k matrix: sums of path probabilities for forward and backward
messages, maxima for the best path. Such matrices multiply associatively, so each block's is made by itself (one task a block), their
products before and after each block come from a scan, and each block is then resolved inside from the messages that reach it. The best
path needs one more scan, of maps: a block tells for each state at its end at which state before it the best path comes in.

A scan goes up a tree: groups of `FAN` neighbours are combined until one group is left, and down again, so no task holds more than
`FAN` items or one block. Every level is written to the shared folder, which cuts lineage and survives lost executors.

Results are those of `sequence.decode` on the same sequence up to rounding, as products of matrices round differently; ties of the best
path go to the lowest state. An empty table gives an empty table; null observations raise; places must be unique.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.sequence import EXAMPLE, Hmm, fit, q_decode, roles
from orrery.sources.scratch import staged
from orrery.sources.tables import indexed, table

BLOCK, FAN = 1 << 15, 256
_ITEMS = "at long, item array<double>"


def _items(at: list, items: list[np.ndarray]) -> pa.Table:
    return pa.table({"at": pa.array(at, pa.int64()), "item": pa.array([np.asarray(x, float) for x in items], pa.list_(pa.float64()))})


def _read(group: pa.Table, name: str = "item") -> list[np.ndarray]:
    return [np.array(x) for x in group.column(name).to_pylist()]


def scanned(parts: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], backward: bool = False, fan: int = FAN) -> DataFrame:
    """at, item, before: what combines of all earlier items (later ones, if `backward`), null for the first. `parts(at, item)` is staged,
    `at` runs from 0; `combine(a, b)` takes the items in the order of the scan."""
    schema = _ITEMS + ", before array<double>"

    def swept(group: pa.Table, first: np.ndarray | None) -> pa.Table:
        order = np.argsort(group.column("at").to_numpy())
        at, items, out, state = group.column("at").to_numpy(), _read(group), [], first
        for i in order[::-1] if backward else order:
            out.append((int(at[i]), items[i], state))
            state = items[i] if state is None else combine(state, items[i])
        before = pa.array([b for *_, b in out], pa.list_(pa.float64()))
        return _items([a for a, *_ in out], [x for _, x, _ in out]).append_column("before", before)

    if parts.count() <= fan:
        return parts.groupBy(F.lit(0).alias("all")).applyInArrow(lambda group: swept(group, None), schema)

    def total(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("at").to_numpy())
        items = _read(group)
        state = None
        for i in order[::-1] if backward else order:
            state = items[i] if state is None else combine(state, items[i])
        return _items([int(group.column("at")[0].as_py()) // fan], [state])

    grouped = parts.withColumn("up", F.floor(F.col("at") / fan))
    tops = staged(grouped.groupBy("up").applyInArrow(total, _ITEMS), "scan-up")
    above = staged(scanned(tops, combine, backward, fan), "scan-down").withColumnRenamed("at", "up")

    def down(group: pa.Table, top: pa.Table) -> pa.Table:
        first = top.column("before")[0].as_py()
        return swept(group, None if first is None else np.array(first))

    return grouped.groupBy("up").cogroup(above.groupBy("up")).applyInArrow(down, schema)


# ---- items: a matrix scaled to a largest entry of 1 and the log of the scale; a matrix of logs; a map of states


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = int(np.sqrt(len(a) - 1))
    m = a[:-1].reshape(k, k) @ b[:-1].reshape(k, k)
    top = m.max()
    return np.append(m / top if top > 0 else m, a[-1] + b[-1] + (np.log(top) if top > 0 else -np.inf))


def _best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = int(np.sqrt(len(a)))
    return (a.reshape(k, k)[:, :, None] + b.reshape(k, k)[None]).max(1).ravel()


def _through(later: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Maps from the end of all to before a block: `later` leads to the block's end, `own` on from there."""
    return own[later.astype(int)]


def _sorted(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = group.column("t").to_numpy()
    order = np.argsort(t)
    x = group.column("x").to_numpy(zero_copy_only=False).astype(float)[order]
    if np.isnan(x).any():
        raise ValueError("a sequence with missing observations")
    return t[order], x


def _logs(model: Hmm, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Moves into a block's first place (from nowhere, if it is the sequence's), and all later moves, in logs."""
    with np.errstate(divide="ignore"):
        move, start = np.log(model.move), np.log(model.start)
    return (np.broadcast_to(start, move.shape) if first else move), move


def decode_long(df: DataFrame, model: Hmm, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """`df(t, x)`, t from 0 without gaps: t, path (the best path's state), state (the likeliest one), confidence, log_likelihood."""
    k = len(model.start)
    rows = staged(df.select(F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"), F.floor(F.col("t") / block).cast("long").alias("at")), "scan-rows")

    def matrices(group: pa.Table) -> pa.Table:
        t, x = _sorted(group)
        e = model.log_emissions(x)
        lead, move = _logs(model, t[0] == 0)
        top = e.max(1)
        weights, into, plain = np.exp(e - top[:, None]), np.exp(lead), np.exp(move)
        total, best, scale = into * weights[0], lead + e[0], top[0]
        for i in range(1, len(x)):
            total = total @ plain * weights[i]
            most = total.max()
            total, scale = total / most, scale + top[i] + np.log(most)
            best = (best[:, :, None] + move[None]).max(1) + e[i]
        return pa.table({"at": pa.array([int(t[0]) // block], pa.int64()), "total": pa.array([np.append(total.ravel(), scale)], pa.list_(pa.float64())), "best": pa.array([best.ravel()], pa.list_(pa.float64()))})

    made = staged(rows.groupBy("at").applyInArrow(matrices, "at long, total array<double>, best array<double>"), "scan-blocks")
    totals, bests = made.select("at", F.col("total").alias("item")), made.select("at", F.col("best").alias("item"))
    swap = lambda later, own: _product(own, later)
    before, after = scanned(totals, _product, fan=fan), scanned(totals, swap, backward=True, fan=fan)
    ahead = staged(scanned(bests, _best, fan=fan), "scan-best")
    reach = before.select("at", F.col("before").alias("left")).join(after.select("at", F.col("before").alias("right")), "at").join(ahead.select("at", F.col("before").alias("best")), "at")
    reach = staged(reach, "scan-reach")

    def likelihood(item: list[float], left: list[float] | None) -> float:
        whole = np.array(item) if left is None else _product(np.array(left), np.array(item))
        return float(np.log(whole[:-1].reshape(k, k)[0].sum()) + whole[-1])  # all rows are alike: the first block has them all come from nowhere

    last = made.join(reach, "at").orderBy(F.desc("at")).select("total", "left").first()  # k x k numbers
    found = likelihood(last["total"], last["left"]) if last else 0.0

    def steps(t: np.ndarray, x: np.ndarray, best: list[float] | None) -> tuple[np.ndarray, np.ndarray]:
        """Best scores at the block's end and back pointers at each of its places (at the first: to the states before the block)."""
        e = model.log_emissions(x)
        lead, move = _logs(model, t[0] == 0)
        score = np.array(best).reshape(k, k).max(0) if best is not None else np.zeros(k)
        back = np.zeros((len(x), k), int)
        for i in range(len(x)):
            step = score[:, None] + (lead if i == 0 else move)
            back[i] = step.argmax(0)
            score = step.max(0) + e[i]
        return score, back

    def posteriors(t: np.ndarray, x: np.ndarray, left: list[float] | None, right: list[float] | None) -> np.ndarray:
        e = model.log_emissions(x)
        e = np.exp(e - e.max(1, keepdims=True))
        a, b = np.zeros(e.shape), np.ones(e.shape)
        lead = model.start if t[0] == 0 else np.array(left[:-1]).reshape(k, k)[0] @ model.move
        for i in range(len(x)):
            a[i] = (lead if i == 0 else a[i - 1] @ model.move) * e[i]
            a[i] /= a[i].sum()
        if right is not None:
            b[-1] = np.array(right[:-1]).reshape(k, k).sum(1)
        for i in range(len(x) - 2, -1, -1):
            b[i] = model.move @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        p = a * b
        return p / p.sum(1, keepdims=True)

    def inward(group: pa.Table, reached: pa.Table) -> pa.Table:
        t, x = _sorted(group)
        score, back = steps(t, x, reached.column("best")[0].as_py())
        enter = np.arange(k)
        for i in range(len(x) - 1, -1, -1):
            enter = back[i][enter]
        return pa.table({"at": pa.array([int(t[0]) // block], pa.int64()), "item": pa.array([enter.astype(float)], pa.list_(pa.float64())), "end": pa.array([int(score.argmax())], pa.int64())})

    maps = staged(rows.groupBy("at").cogroup(reach.groupBy("at")).applyInArrow(inward, _ITEMS + ", end long"), "scan-maps")
    final = maps.orderBy(F.desc("at")).select("end").first()
    ends = staged(scanned(maps.select("at", "item"), _through, backward=True, fan=fan).select("at", F.col("before").alias("ends")).join(reach, "at"), "scan-ends")

    def resolved(group: pa.Table, reached: pa.Table) -> pa.Table:
        t, x = _sorted(group)
        r = {c: reached.column(c)[0].as_py() for c in ("ends", "left", "right", "best")}
        _, back = steps(t, x, r["best"])
        path = np.empty(len(x), int)
        path[-1] = final["end"] if r["ends"] is None else int(r["ends"][final["end"]])
        for i in range(len(x) - 1, 0, -1):
            path[i - 1] = back[i][path[i]]
        p = posteriors(t, x, r["left"], r["right"])
        return pa.table({"t": t, "path": path.astype(np.int32), "state": p.argmax(1).astype(np.int32), "confidence": p.max(1)})

    out = rows.groupBy("at").cogroup(ends.groupBy("at")).applyInArrow(resolved, "t long, path int, state int, confidence double")
    return out.withColumn("log_likelihood", F.lit(found))


# ---- queries


def q_decode_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in order of time as one sequence of errors and other events, in blocks of 600 (16 of them on the small tables)."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("x"))
    found = decode_long(indexed(events, ["ts", "event_id"], "t"), EXAMPLE, block=600, fan=4)
    return found.select("t", "path", "state", F.round("confidence", 6).alias("confidence"), F.round("log_likelihood", 3).alias("log_likelihood"))


def messages_sql(rows: str) -> str:
    """CTEs of Viterbi and forward-backward of the two-state example, place by place, for sequences `rows` (seq, t from 0, x): f has the
    forward probability a of state 0 and the log-likelihood l so far, b the backward share b of state 0, the best path and l of all."""
    (s0, s1), ((m00, m01), (m10, m11)), ((e00, e01), (e10, e11)) = EXAMPLE.start, EXAMPLE.move, EXAMPLE.emit
    return f"""
WITH RECURSIVE r AS ({rows}), o AS (SELECT seq, t, x, CASE x WHEN 0 THEN {e00}::double ELSE {e01} END AS e0, CASE x WHEN 0 THEN {e10}::double ELSE {e11} END AS e1, max(t) OVER (PARTITION BY seq) AS n FROM r),
f AS (
 SELECT seq, t, {s0}::double * e0 / ({s0} * e0 + {s1} * e1) AS a, ln({s0}::double * e0 + {s1} * e1) AS l, ln({s0}::double) + ln(e0) AS d0, ln({s1}::double) + ln(e1) AS d1, 0 AS p0, 0 AS p1 FROM o WHERE t = 0
 UNION ALL SELECT seq, t, u0 / (u0 + u1), l + ln(u0 + u1), greatest(d0 + ln({m00}::double), d1 + ln({m10}::double)) + ln(e0), greatest(d0 + ln({m01}::double), d1 + ln({m11}::double)) + ln(e1),
  CASE WHEN d0 + ln({m00}::double) >= d1 + ln({m10}::double) THEN 0 ELSE 1 END, CASE WHEN d0 + ln({m01}::double) >= d1 + ln({m11}::double) THEN 0 ELSE 1 END
 FROM (SELECT o.seq, o.t, (f.a * {m00} + (1 - f.a) * {m10}) * o.e0 AS u0, (f.a * {m01} + (1 - f.a) * {m11}) * o.e1 AS u1, f.l, f.d0, f.d1, o.e0, o.e1 FROM f JOIN o ON o.seq = f.seq AND o.t = f.t + 1)),
b AS (
 SELECT seq, t, 0.5::double AS b, CASE WHEN d0 >= d1 THEN 0 ELSE 1 END AS path, CASE WHEN d0 >= d1 THEN p0 ELSE p1 END AS back, l FROM f JOIN o USING (seq, t) WHERE t = n
 UNION ALL SELECT seq, t, v0 / (v0 + v1), path, back, l
 FROM (SELECT f.seq, f.t, {m00} * o.e0 * b.b + {m01} * o.e1 * (1 - b.b) AS v0, {m10} * o.e0 * b.b + {m11} * o.e1 * (1 - b.b) AS v1, b.back AS path, CASE b.back WHEN 0 THEN f.p0 ELSE f.p1 END AS back, b.l
  FROM b JOIN f ON f.seq = b.seq AND f.t = b.t - 1 JOIN o ON o.seq = b.seq AND o.t = b.t)),
p AS (SELECT seq, t, path, a * b / (a * b + (1 - a) * (1 - b)) AS p, b.l FROM b JOIN f USING (seq, t))"""


def decode_sql(rows: str) -> str:
    return messages_sql(rows) + """
SELECT seq, t, path, CASE WHEN p >= 0.5 THEN 0 ELSE 1 END AS state, round(greatest(p, 1 - p), 6) AS confidence, l FROM p"""


_ROLES = "SELECT conv_id AS seq, turn AS t, CASE WHEN length(text) > 200 THEN 1 ELSE 0 END AS x FROM conversations"
DECODE_SQL = f"SELECT seq AS conv_id, t, path, state, confidence, round(l, 6) AS log_likelihood FROM ({decode_sql(_ROLES)})"


def q_fit_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of Baum-Welch from the example model: the model it gives, and the likelihoods before and after."""
    model, found = fit(roles(spark, sf_dir), "conv_id", 2, 2, rounds=1, start=EXAMPLE)
    rows = [(i, j, float(model.start[i]), float(model.move[i, j]), float(model.emit[i, j])) for i in range(2) for j in range(2)]
    out = spark.createDataFrame(rows, "state int, other int, start double, move double, emit double")
    return out.select("state", "other", *(F.round(c, 6).alias(c) for c in ("start", "move", "emit")), F.lit(round(found[0], 4)).alias("before"), F.lit(found[1] > found[0]).alias("better"))


_MOVE, _EMIT = EXAMPLE.move, EXAMPLE.emit
FIT_ROUND_SQL = messages_sql(_ROLES) + f""",
g AS (SELECT p.*, o.x FROM p JOIN o USING (seq, t)),
w AS (SELECT i, j, (CASE i WHEN 0 THEN f.a ELSE 1 - f.a END) * (CASE WHEN i = 0 AND j = 0 THEN {_MOVE[0, 0]}::double WHEN i = 0 THEN {_MOVE[0, 1]} WHEN j = 0 THEN {_MOVE[1, 0]} ELSE {_MOVE[1, 1]} END)
  * (CASE j WHEN 0 THEN o.e0 * b.b ELSE o.e1 * (1 - b.b) END) AS w, f.seq, f.t
 FROM f JOIN o ON o.seq = f.seq AND o.t = f.t + 1 JOIN b ON b.seq = o.seq AND b.t = o.t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
moves AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w / sum(w) OVER (PARTITION BY seq, t) AS w FROM w) GROUP BY i, j),
emits AS (SELECT i, j, sum(CASE WHEN x = j THEN CASE i WHEN 0 THEN p ELSE 1 - p END ELSE 0 END) AS w FROM g, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) GROUP BY i, j),
starts AS (SELECT i, sum(CASE i WHEN 0 THEN p ELSE 1 - p END) AS w FROM g, (SELECT unnest([0, 1]) AS i) WHERE t = 0 GROUP BY i)
SELECT moves.i AS state, moves.j AS other, round((starts.w + 1e-6) / (SELECT sum(w + 1e-6) FROM starts), 6) AS start, round((moves.w + 1e-6) / sum(moves.w + 1e-6) OVER (PARTITION BY moves.i), 6) AS move,
 round((emits.w + 1e-6) / sum(emits.w + 1e-6) OVER (PARTITION BY moves.i), 6) AS emit, (SELECT round(sum(l), 4) FROM b WHERE t = 0) AS before, true AS better
FROM moves JOIN emits ON emits.i = moves.i AND emits.j = moves.j JOIN starts ON starts.i = moves.i
"""

DECODE_LONG_SQL = f"""
SELECT t, path, state, confidence, round(l, 3) AS log_likelihood FROM (
{decode_sql("SELECT 0 AS seq, row_number() OVER (ORDER BY ts, event_id) - 1 AS t, CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS x FROM events")})
"""

QUERIES = {"hmm_decode": (q_decode, DECODE_SQL), "hmm_decode_long": (q_decode_long, DECODE_LONG_SQL), "hmm_fit_round": (q_fit_round, FIT_ROUND_SQL)}
