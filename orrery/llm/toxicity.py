"""Toxic spans by a linear-chain conditional random field.

Labels exist for documents; token labels are drawn from them on the training sample: a word (or a word's first `PREFIX` letters) that
occurs in several toxic documents and hardly in others marks its tokens toxic there. A two-state chain over each whole document, with
features word, prefixes, suffix and the words on both sides, is fitted by gradient ascent on the exact conditional likelihood.
Forward-backward marginals give each token's probability; messages are passed in rows of `RUN` tokens and from row to row, so many
documents go through numpy together and the marginals are those of the whole chain. A document's score is a logistic function of the
maximum of its marginals and of the sum of their fourth powers (in which the many doubtful tokens of a long text hardly add up), fitted
on the same sample and brought back to the share of toxic documents among all labelled ones.

Training reads a bounded sample (`samples.bounded`): whole documents by hash of doc_id and text, at most `PER_CLASS` of each label and
`SAMPLE_BYTES` of text of each (one at least), however many rows an id has; one task fits them. Every text is scored whole.

Defined results: null and empty texts have no tokens and score as such; without labels of both kinds every score is the share of
toxic labels (0 without labels); a document whose labels disagree counts as toxic; repeated rows are scored each; an empty table gives
an empty result; extra columns pass through (one named _toxicity is replaced).
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import samples
from orrery.llm.samples import PER_CLASS, SAMPLE_BYTES

RUN, DIMS, CACHE, THRESHOLD, STEPS, POWER = 64, 1 << 18, 400_000, 0.7, 25, 4
PREFIX, PREFIXES = 5, (4, 5)
BATCH = 1 << 17
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_TOKEN = re.compile(r"\S+")


def tokens(text: str) -> list[str]:
    return text.lower().split()


def bare(token: str) -> str:
    return token.strip(_EDGES)


def features(word: str) -> list[int]:
    """Hashed features of a bare word: itself, its first letters, its last three."""
    named = [f"w{word}", *(f"p{word[:n]}" for n in PREFIXES if len(word) >= n), f"s{word[-3:]}"]
    return [zlib.crc32(x.encode("utf-8", "replace")) % DIMS for x in named]


def side_features(word: str) -> list[int]:
    """Hashed features that a bare word gives the token after it and the token before it."""
    return [zlib.crc32(f"{side}{word}".encode("utf-8", "replace")) % DIMS for side in "lr"]


class Chain:
    """Two states, clean and toxic. `weights`: of features, for toxic; `moves`: scores of clean-clean, clean-toxic, toxic-clean, toxic-toxic."""

    def __init__(self):
        self.weights, self.bias, self.moves, self.start = np.zeros(DIMS), -4.0, np.zeros((2, 2)), 0.0
        self.document, self.prior = np.zeros(3), 0.0

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, pairs: bool = False, first: np.ndarray | None = None, last: np.ndarray | None = None):
        """P(toxic) per token for runs in rows of `scores` (padded to one width); with `pairs` also the expected moves within rows and the
        log normaliser. `first`: messages to the rows' first tokens from what precedes them, `last`: to their last tokens from what follows."""
        n, width = scores.shape
        move = np.exp(self.moves)
        up = np.exp(np.clip(scores, -30, 30))
        f = np.empty((width, 2, n))
        b = np.ones((width, 2, n)) if last is None else np.broadcast_to(last, (width, 2, n)).copy()
        a0, a1 = (np.ones(n), np.exp(self.start) * up[:, 0]) if first is None else (first[0], first[1] * up[:, 0])
        log_z = np.zeros(n)
        for t in range(width):
            if t:
                n0, n1 = a0 * move[0, 0] + a1 * move[1, 0], (a0 * move[0, 1] + a1 * move[1, 1]) * up[:, t]
                on = t < lengths
                a0, a1 = np.where(on, n0, a0), np.where(on, n1, a1)
            z = a0 + a1
            log_z += np.log(z)
            a0, a1 = a0 / z, a1 / z
            f[t, 0], f[t, 1] = a0, a1
        for t in range(width - 2, -1, -1):
            c0, c1 = b[t + 1, 0], b[t + 1, 1] * up[:, t + 1]
            n0, n1 = move[0, 0] * c0 + move[0, 1] * c1, move[1, 0] * c0 + move[1, 1] * c1
            z = n0 + n1
            on = t + 1 < lengths
            b[t, 0], b[t, 1] = np.where(on, n0 / z, b[t, 0]), np.where(on, n1 / z, b[t, 1])
        p = f[:, 1] * b[:, 1] / (f[:, 0] * b[:, 0] + f[:, 1] * b[:, 1])
        if not pairs:
            return p.T
        expected = np.zeros((2, 2))
        for t in range(width - 1):
            cell = np.stack([f[t, i] * move[i, j] * b[t + 1, j] * (up[:, t + 1] if j else 1.0) for i in (0, 1) for j in (0, 1)])
            expected += (cell / cell.sum(0) * (t + 1 < lengths)).sum(1).reshape(2, 2)
        return p.T, expected, log_z

    def messages(self, scores: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Messages to each row's first token and to its last, from the other rows of its document; documents have `rows` rows each."""
        n, width = scores.shape
        move, up = np.exp(self.moves), np.exp(np.clip(scores, -30, 30))
        through = np.zeros((2, 2, n))  # from the state of a row's first token to that of its last, all scores within
        through[0, 0], through[1, 1] = 1, up[:, 0]
        for t in range(1, width):
            on = t < lengths
            if not on.any():
                break
            to0, to1 = through[:, 0] * move[0, 0] + through[:, 1] * move[1, 0], (through[:, 0] * move[0, 1] + through[:, 1] * move[1, 1]) * up[:, t]
            z = (to0 + to1).sum(0)
            through[:, 0], through[:, 1] = np.where(on, to0 / z, through[:, 0]), np.where(on, to1 / z, through[:, 1])
        first, last = np.empty((2, n)), np.ones((2, n))
        first[0], first[1] = 1, np.exp(self.start)
        begin = np.concatenate([[0], np.cumsum(rows)[:-1]])
        for k in range(1, int(rows.max(initial=0))):
            at = begin[rows > k] + k
            a = np.einsum("in,ijn->jn", first[:, at - 1], through[:, :, at - 1])
            a = move.T @ a
            first[:, at] = a / a.sum(0)
            at = begin[rows > k] + rows[rows > k] - k
            b = move @ np.einsum("ijn,jn->in", through[:, :, at], last[:, at])
            last[:, at - 1] = b / b.sum(0)
        return first, last

    def whole(self, scores: np.ndarray, sizes: np.ndarray, pairs: bool = False):
        """P(toxic) of each token of documents that lie one after another, each a chain of `sizes` tokens; with `pairs` also the expected
        moves."""
        grid, lengths, place = runs(scores, sizes)
        if not len(grid):
            return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
        rows = -(-sizes // RUN)
        first, last = self.messages(grid, lengths, rows[rows > 0])
        if not pairs:
            return self.marginals(grid, lengths, first=first, last=last).ravel()[place]
        p, expected, _ = self.marginals(grid, lengths, True, first, last)
        begins = np.zeros(len(grid), bool)
        begins[np.concatenate([[0], np.cumsum(rows[rows > 0])[:-1]])] = True
        at = np.flatnonzero(~begins)  # rows that go on from the one before: a row's last marginal and messages give the move between
        if len(at):
            before = p[at - 1, lengths[at - 1] - 1]
            front = np.stack([1 - before, before]) / last[:, at - 1]
            own = np.stack([1 - p[at, 0], p[at, 0]]) / first[:, at]
            cell = front[:, None] * np.exp(self.moves)[:, :, None] * own[None]
            expected = expected + (cell / cell.sum((0, 1))).sum(2)
        return p.ravel()[place], expected

    def document_score(self, strong: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = self.document[0] + self.document[1] * np.log(strong + 1e-3) + self.document[2] * most
        return 1 / (1 + np.exp(-np.clip(z, -50, 50))) if self.document.any() else np.full(len(strong), self.prior)


def runs(scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' token scores, one after another, cut into rows of RUN; row lengths and each token's place in the rows."""
    rows = -(-sizes // RUN)
    first_row = np.concatenate([[0], np.cumsum(rows)[:-1]])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(scores)) - np.repeat(first, sizes) + np.repeat(first_row, sizes) * RUN
    grid = np.zeros(int(rows.sum()) * RUN)
    grid[place] = scores
    lengths = np.bincount(place // RUN, minlength=int(rows.sum()))
    return grid.reshape(-1, RUN), lengths, place


def seed_words(texts: list[set[str]], toxic: np.ndarray) -> tuple[set[str], set[str]]:
    """Words and prefixes that mark tokens toxic: in at least 4 toxic documents and 1 % of them, and at least 20 times as often there as
    elsewhere."""
    out = []
    for kind in (lambda w: w, lambda w: w[:PREFIX] if len(w) > PREFIX else ""):
        inside, outside = Counter(), Counter()
        for words, y in zip(texts, toxic, strict=True):
            (inside if y else outside).update({kind(w) for w in words} - {""})
        a, b = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
        out.append({w for w, c in inside.items() if c >= max(4, 0.01 * a) and (c / a) >= 20 * (outside[w] + 0.25) / b})
    return out[0], out[1]


def one_of_copies(ids: list[np.ndarray]) -> list[int]:
    """Places of documents to learn words from: one of those that share their least word-pair hash, as near copies nearly always do. A
    copied document's words would else look like marks of its label."""
    seen: dict[int, int] = {}
    for i, x in enumerate(ids):
        pairs = x[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (x[1:].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        seen.setdefault(int((pairs * np.uint64(0x94D049BB133111EB)).min()) if len(pairs) else -1 - i, i)
    return sorted(seen.values())


def fit(texts: list[str], toxic: np.ndarray, share: float, steps: int = STEPS, rate: float = 0.3) -> Chain:
    """`share`: of toxic documents among all labelled ones."""
    chain = Chain()
    chain.prior = share
    if not len(texts) or toxic.min() == toxic.max():
        return chain
    order: dict[str, int] = {}
    ids = [np.array([order.setdefault(bare(t), len(order)) for t in tokens(x)], np.int64) for x in texts]
    words = list(order)
    some = one_of_copies(ids)
    plain, starts = seed_words([{words[i] for i in set(ids[k].tolist())} for k in some], toxic[some])
    marked = np.array([w in plain or (len(w) > PREFIX and w[:PREFIX] in starts) for w in words], bool)
    rows = [features(w) for w in words]
    width = max(map(len, rows))
    table = np.array([r + [DIMS] * (width - len(r)) for r in rows])  # DIMS: no feature
    sides = np.array([side_features(w) for w in words])
    sizes = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    label = (marked[flat] & (np.repeat(toxic, sizes) == 1)).astype(float)
    used = np.repeat(np.arange(len(sizes)), sizes)
    joined = np.flatnonzero(used[1:] == used[:-1])  # tokens whose next one is of the same document
    begins = (np.cumsum(sizes) - sizes)[sizes > 0]
    seen = np.array([[((label[joined] == i) & (label[joined + 1] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    speed, speed_bias, speed_moves, speed_start = np.full(DIMS + 1, 1e-8), 1e-8, np.full((2, 2), 1e-8), 1e-8
    weights = np.zeros(DIMS + 1)

    def scores() -> np.ndarray:
        out = (weights[table].sum(1) + chain.bias)[flat]
        out[joined + 1] += weights[sides[:, 0]][flat[joined]]
        out[joined] += weights[sides[:, 1]][flat[joined + 1]]
        return out

    for _ in range(steps):
        p, expected = chain.whole(scores(), sizes, pairs=True)
        wrong = label - p
        by_word = np.bincount(flat, wrong, len(words))
        slope = np.bincount(table.ravel(), np.repeat(by_word, width), DIMS + 1) - 0.05 * weights
        slope += np.bincount(sides[:, 0], np.bincount(flat[joined], wrong[joined + 1], len(words)), DIMS + 1)
        slope += np.bincount(sides[:, 1], np.bincount(flat[joined + 1], wrong[joined], len(words)), DIMS + 1)
        slope[DIMS] = 0
        speed += slope**2
        weights += rate * slope / np.sqrt(speed)
        speed_bias += wrong.sum() ** 2
        chain.bias += rate * wrong.sum() / np.sqrt(speed_bias)
        step = seen - expected - 0.05 * chain.moves
        speed_moves += step**2
        chain.moves += 0.1 * rate * step / np.sqrt(speed_moves)
        step = wrong[begins].sum() - 0.05 * chain.start
        speed_start += step**2
        chain.start += 0.1 * rate * step / np.sqrt(speed_start)
    chain.weights = weights[:DIMS]
    p = chain.whole(scores(), sizes)
    most = np.zeros(len(sizes))
    np.maximum.at(most, used, p)
    x = np.stack([np.ones(len(sizes)), np.log(np.bincount(used, p**POWER, len(sizes)) + 1e-3), most])
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    w = np.zeros(3)
    for _ in range(50):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        slope = x @ (weight * (toxic - q)) - 0.1 * w
        w = w + np.linalg.solve((x * (weight * q * (1 - q))) @ x.T + 0.1 * np.eye(3), slope)
    chain.document = w
    return chain


class TokenScores(dict):
    """Token to number; `of` holds by number its own score and what it adds to the token after it and to the one before."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain, self.of, self.chars = chain, np.zeros((1 << 14, 3)), 0

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        if n >= len(self.of):
            self.of = np.concatenate([self.of, np.zeros_like(self.of)])
        word = bare(token)
        self.of[n, 0] = self.chain.weights[features(word)].sum() + self.chain.bias
        self.of[n, 1:] = self.chain.weights[side_features(word)]
        self.chars += len(token)
        return n

    def room(self) -> None:
        """Forget all when there is much."""
        if len(self) >= CACHE or self.chars > 1 << 25:
            self.clear()
            self.chars = 0


def score_texts(texts: list[str | None], chain: Chain, cache: TokenScores) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Score of each text, and its toxic spans (code points, end exclusive): tokens with a marginal of a half or more."""
    strong, most, spans = np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts]
    held: list[tuple[int, int]] = []
    numbers: list[np.ndarray] = []
    filled = 0

    def flush() -> None:
        nonlocal filled
        if not held:
            return
        sizes = np.array([n for _, n in held])
        owner = np.repeat(np.array([i for i, _ in held]), sizes)
        each = cache.of[np.concatenate(numbers)]
        same = np.flatnonzero(owner[1:] == owner[:-1])
        scores = each[:, 0].copy()
        scores[same + 1] += each[same, 1]
        scores[same] += each[same + 1, 2]
        p = chain.whole(scores, sizes)
        np.add.at(strong, owner, p**POWER)
        np.maximum.at(most, owner, p)
        first = dict(zip([i for i, _ in held], np.concatenate([[0], np.cumsum(sizes)[:-1]]), strict=True))
        hits = np.flatnonzero(p >= 0.5)
        for i in np.unique(owner[hits]):
            own = {int(h - first[i]) for h in hits[owner[hits] == i]}
            spans[i] = [m.span() for k, m in enumerate(_TOKEN.finditer(texts[i])) if k in own]
        held.clear()
        numbers.clear()
        filled = 0

    for i, text in enumerate(texts):
        words = tokens(text) if text else []
        if words:
            if not held:
                cache.room()
            held.append((i, len(words)))
            numbers.append(np.fromiter(map(cache.__getitem__, words), np.int64, len(words)))
            filled += len(words)
            if filled >= BATCH:
                flush()
    flush()
    return chain.document_score(strong, most), spans


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """`docs(doc_id, text)`, `labels(doc_id, toxic)`; rows that are held out aren't read."""
    known = samples.label_of(labels, "toxic", held_out(F.col("doc_id")), F.max("toxic"))
    texts, share = samples.bounded(docs, known, per_class, sample_bytes)
    if texts is None:
        return fit([], np.zeros(0, int), share)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(o, t, int(y)) for batch in batches for o, t, y in zip(*(batch.column(c).to_pylist() for c in ("_order", "text", "_y")), strict=True)]
        rows.sort()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for _, t, _ in rows], np.array([y for *_, y in rows], int), share))])], ["model"])

    # one task for the bounded sample; the driver gets the weights alone
    return pickle.loads(texts.repartition(1).mapInArrow(fitted, "model binary").first()["model"])


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """`docs` with struct column _toxicity(score, spans(start, end))."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # DIMS weights

    @F.arrow_udf("score double, spans array<struct<start: int, end: int>>")
    def scored(text: pa.Array) -> pa.Array:
        cache = TokenScores(shared.value) if not hasattr(shared.value, "cache") else shared.value.cache
        shared.value.cache = cache
        scores, spans = score_texts(text.to_pylist(), shared.value, cache)
        offsets = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), offsets], ["score", "spans"])

    return docs.withColumn("_toxicity", scored.asNondeterministic()(text_col))
