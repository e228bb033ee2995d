"""Quality of documents by a byte-level convolutional network in numpy.

Bytes are embedded; filters of `WIDTH` bytes slide over every position of the whole document; each filter is rectified and max-pooled
over chunks of two halves of `HALF` bytes, which overlap by one half, so that every byte lies in a chunk (in two, but for the ends).
The mean over a document's chunks says in what part of them a filter found its pattern; a hidden layer turns these means into one
probability. As a position adds up what its bytes give each filter, embedding and filters are one table a place of the filter when
texts are scored. Memory is bounded by `SLAB` bytes of text at a time, also within one document.

Training reads a bounded sample (`samples.bounded`: at most `PER_CLASS` whole documents of each label and `SAMPLE_BYTES` bytes of each),
learns in one task by back-propagation with Adam, both labels weighing the same, and brings the probability back to the share of
good documents among all labelled ones.

Defined results: null and empty texts have no chunks and score by the network's value for none; without labels of both kinds every
score is the share of good labels (0 without labels); a document whose labels disagree counts as poor; repeated rows are scored each;
an empty table gives an empty result; extra columns pass through (one named _quality is replaced).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import samples

WIDTH, HALF, FILTERS, EMBEDDING, HIDDEN, SLAB, THRESHOLD = 7, 32, 32, 10, 16, 1 << 17, 0.7
PER_CLASS, SAMPLE_BYTES, EPOCHS, DOCUMENTS_A_STEP, RATE, DECAY = 600, 1 << 20, 14, 32, 0.004, 1e-3


class Network:
    """`bytes`: embedding a byte; `filters`: width x embedding x filters, with `bias`; `inner` and `outer`: the two dense layers."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bytes = rng.normal(0, 0.3, (256, EMBEDDING))
        kinds = [range(65, 91), range(97, 123), range(48, 58), (9, 10, 13, 32), [b for b in range(33, 127) if not chr(b).isalnum()], range(128, 256)]
        for k, members in enumerate(kinds):  # where learning starts: capitals, small letters, digits, white space, marks, other bytes
            self.bytes[list(members), k] += 1
        self.bytes[0] = 0  # what stands behind the end
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * EMBEDDING), (WIDTH, EMBEDDING, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.inner = rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS + 1, HIDDEN))
        self.outer = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN + 1)
        self.shift, self.prior = 0.0, None

    def parts(self) -> list[np.ndarray]:
        return [self.bytes, self.filters, self.bias, self.inner, self.outer]

    def tables(self) -> np.ndarray:
        """What a byte at each place of the window gives each filter."""
        return np.einsum("be,wef->wbf", self.bytes, self.filters).astype(np.float32)

    def dense(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(means @ self.inner[:-1] + self.inner[-1])
        return hidden, hidden @ self.outer[:-1] + self.outer[-1]

    def probability(self, means: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(means), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.dense(means)[1] + self.shift, -50, 50)))


def rectified(x: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filters at every position of a text's bytes `x` but the last WIDTH - 1 (which a caller adds as look-ahead)."""
    n = len(x) - WIDTH + 1
    out = np.take(tables[0], x[:n], axis=0)
    for w in range(1, WIDTH):
        out += np.take(tables[w], x[w : w + n], axis=0)
    out += bias.astype(np.float32)
    return np.maximum(out, 0, out=out)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another, each followed by zeros up to a whole number of halves; halves of each; positions that hold no byte."""
    sizes = np.array([len(t) for t in texts], np.int64)
    halves = -(-sizes // HALF)
    ends = np.cumsum(halves) * HALF
    x = np.zeros(int(ends[-1] if len(ends) else 0) + WIDTH - 1, np.uint8)
    beyond = [np.zeros(0, np.int64)]
    for text, size, count, end in zip(texts, sizes, halves, ends, strict=True):
        begin = int(end - count * HALF)
        x[begin : begin + size] = np.frombuffer(text, np.uint8)
        beyond.append(np.arange(begin + size, end))
    return x, halves, np.concatenate(beyond)


def chunk_means(pooled: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Mean over each document's chunks of the larger of two neighbouring halves (of the one half, if there is no other)."""
    out = np.zeros((len(halves), pooled.shape[1]))
    first = np.cumsum(halves) - halves
    ones = np.flatnonzero(halves == 1)
    out[ones] = pooled[first[ones]]
    many = np.flatnonzero(halves > 1)
    if len(many):
        pairs = np.maximum(pooled[:-1], pooled[1:])
        inside = np.ones(len(pairs), bool)
        inside[(first + halves - 1)[(halves > 0) & (first + halves - 1 < len(pairs))]] = False
        kept = pairs[inside].astype(np.float64)
        counts = halves[many] - 1
        out[many] = np.add.reduceat(kept, np.cumsum(counts) - counts, axis=0) / counts[:, None]
    return out


def means_of(texts: list[bytes], tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Each text's means, SLAB bytes at a time; a window sees no byte of another text."""
    out = np.zeros((len(texts), len(bias)))
    held: list[int] = []

    def flush() -> None:
        if held:
            x, halves, beyond = laid_out([texts[i] + bytes(WIDTH) for i in held])  # the zeros keep windows within their text
            found = rectified(x, tables, bias)
            sizes = np.array([len(texts[i]) for i in held])
            ends = np.cumsum(halves) * HALF
            for end, count, size in zip(ends, halves, sizes, strict=True):
                found[int(end - count * HALF + size) : int(end)] = 0
            pooled = found.reshape(-1, HALF, len(bias)).max(1)
            used = -(-sizes // HALF)
            keep = np.concatenate([np.arange(u) + (e // HALF - c) for u, e, c in zip(used, ends, halves, strict=True)])
            out[held] = chunk_means(pooled[keep], used)
            held.clear()

    filled = 0
    for i, text in enumerate(texts):
        if len(text) > SLAB:
            out[i] = long_means(text, tables, bias)
        elif text:
            if filled + len(text) > SLAB:
                flush()
                filled = 0
            held.append(i)
            filled += len(text) + 2 * HALF
    flush()
    return out


def long_means(text: bytes, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The means of one text of more than SLAB bytes."""
    total, count, before = np.zeros(len(bias)), 0, None
    for begin in range(0, len(text), SLAB):
        piece = text[begin : begin + SLAB + WIDTH - 1]
        own = min(SLAB, len(text) - begin)
        rows = -(-own // HALF) * HALF
        x = np.zeros(rows + WIDTH - 1, np.uint8)
        x[: len(piece)] = np.frombuffer(piece, np.uint8)
        found = rectified(x, tables, bias)
        found[own:] = 0
        pooled = found.reshape(-1, HALF, len(bias)).max(1)
        if before is not None:
            pooled = np.concatenate([before[None], pooled])
        pairs = np.maximum(pooled[:-1], pooled[1:])
        total += pairs.sum(0, dtype=np.float64)
        count += len(pairs)
        before = pooled[-1]
    return total / count


def gradients(net: Network, texts: list[bytes], good: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted loss of texts (none empty), and its slopes in the order of `parts`."""
    x, halves, beyond = laid_out([t + bytes(WIDTH) for t in texts])
    tables = net.tables()
    found = rectified(x, tables, net.bias)
    found[beyond] = 0
    cells = found.reshape(-1, HALF, FILTERS)
    at = cells.argmax(1)
    pooled = np.take_along_axis(cells, at[:, None], 1)[:, 0]
    at += (np.arange(len(at)) * HALF)[:, None]
    means = chunk_means(pooled, halves)
    hidden, logit = net.dense(means)
    p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    loss = -(weight * np.where(good == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum()
    d_logit = weight * (p - good)
    d_outer = np.append(hidden.T @ d_logit, d_logit.sum())
    d_hidden = d_logit[:, None] * net.outer[:-1] * (1 - hidden**2)
    d_inner = np.concatenate([means.T @ d_hidden, d_hidden.sum(0)[None]])
    d_means = d_hidden @ net.inner[:-1].T
    # each chunk sends its slope to the half that won; a document of one half to that one
    share = d_means / np.maximum(1, halves - 1)[:, None]
    owner = np.repeat(np.arange(len(halves)), halves)
    d_pooled = np.zeros(pooled.shape)
    joined = np.flatnonzero(owner[1:] == owner[:-1])
    first_wins = pooled[joined] >= pooled[joined + 1]
    slope = share[owner[joined]]
    d_pooled[joined] += slope * first_wins
    d_pooled[joined + 1] += slope * ~first_wins
    alone = np.flatnonzero(halves[owner] == 1)
    d_pooled[alone] += share[owner[alone]]
    d_pooled *= pooled > 0
    spot, what = np.nonzero(d_pooled)
    flow, place = d_pooled[spot, what], at[spot, what]
    d_tables = np.stack([np.bincount(x[place + w].astype(np.int64) * FILTERS + what, flow, 256 * FILTERS).reshape(256, FILTERS) for w in range(WIDTH)])
    d_bytes = np.einsum("wbf,wef->be", d_tables, net.filters)
    d_bytes[0] = 0
    d_filters = np.einsum("be,wbf->wef", net.bytes, d_tables)
    return loss, [d_bytes, d_filters, np.bincount(what, flow, FILTERS), d_inner, d_outer]


def fit(texts: list[bytes], good: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """`share`: of good documents among all labelled ones."""
    net = Network(seed)
    some = [i for i, t in enumerate(texts) if t]
    if not some or good[some].min() == good[some].max():
        net.prior = share
        return net
    rng = np.random.default_rng(seed)
    rate_of = good[some].mean()
    fast, slow, step = [np.zeros_like(x) for x in net.parts()], [np.zeros_like(x) for x in net.parts()], 0
    batches = -(-len(some) // DOCUMENTS_A_STEP)
    for epoch in range(epochs):
        for group in np.array_split(rng.permutation(some), batches):
            y = good[group].astype(float)
            weight = np.where(y == 1, 0.5 / rate_of, 0.5 / (1 - rate_of)) / len(group)
            _, slopes = gradients(net, [texts[i] for i in group], y, weight)
            step += 1
            rate = RATE * (1 - (epoch / epochs) ** 2)
            for part, slope, f, s in zip(net.parts(), slopes, fast, slow, strict=True):
                slope = slope + DECAY * part / len(some) * batches
                f += 0.1 * (slope - f)
                s += 0.01 * (slope**2 - s)
                part -= rate * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    net.shift = float(np.log(share / (1 - share)))
    return net


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """`docs(doc_id, text)`, `labels(doc_id, quality)`; rows that are held out aren't read."""
    known = samples.label_of(labels, "quality", held_out(F.col("doc_id")), F.min("quality"))
    texts, share = samples.bounded(docs, known, per_class, sample_bytes)
    if texts is None:
        return fit([], np.zeros(0), share)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("_order", "text", "_y")), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t.encode("utf-8", "replace") for _, t, _ in rows], np.array([y for *_, y in rows], int), share))])], ["model"])

    # one task for the bounded sample; the driver gets the network alone
    return pickle.loads(texts.repartition(1).mapInArrow(fitted, "model binary").first()["model"])


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """`docs` with double column _quality, the probability of a good document."""
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables()))  # a network of fixed size

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        model, tables = shared.value
        raw = text.cast(pa.binary()) if not pa.types.is_large_string(text.type) else text.cast(pa.large_binary())
        return pa.array(model.probability(means_of([t or b"" for t in raw.to_pylist()], tables, model.bias)), pa.float64())

    return docs.withColumn("_quality", scored(text_col))
