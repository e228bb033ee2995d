"""A hashed maximum-entropy language model.

P(word | history) = P(class | history) x P(slot | class, history) x P(word | cell), a cell being a slot of a class. The `HEAD` most
frequent words (the end among them) have cells of their own; any other word's class is a hash of its last two bytes and its slot one
of the two before, so that words unseen in training have a cell too. Both softmaxes have hashed features of the history: the word
before, the two before together, and the one before last alone (a skip), in the slot's softmax each together with the class. Words that
aren't among the `FEATURE_WORDS` most frequent count as their cell there. Within a cell the maximum-entropy solution of unigram features
is closed: (c + 0.5) / (N_cell + 0.5 (V_cell + 1)).

Texts are split once: `tokenized` stages blocks of about `BLOCK` tokens, a row a block, with the words as numbers in the block's own
vocabulary of 64-bit keys. Counting, training and scoring read only these. Word counts are a Spark aggregation. Every training document
is learned from once, in one of `ROUNDS` rounds of distributed gradient updates: a partition takes Adagrad steps (a rate a row) from the
shared weights and returns its change of each row it touched, and the rows' means, weighted by touches, are the next shared weights; so
the model depends on how the rows are partitioned, as the outcome of any such training does.

Scoring runs in numpy batches. Counts of the `HOT_WORDS` most frequent words (bounded) are broadcast; all others are joined by key.
Words are known by 56 bits of their xxhash64 and their cell. Holding two words for one needs a collision of these bits.

Defined results: null text is empty and scores its end alone; an empty training set leaves uniform classes and c = N = V = 0; repeated
rows are scored each and count each; a text without spaces is one word; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import staged

CLASSES, SLOTS, HEAD = 16, 16, 64
CELLS, TAIL = CLASSES * SLOTS, CLASSES - HEAD // SLOTS
FEATURE_WORDS, HOT_WORDS, DIMS, ROUNDS = 16_384, 200_000, 1 << 15, 2
STEP, RATE, BLOCK, CACHE, CACHE_BYTES, PART = 8192, 0.15, 100_000, 400_000, 1 << 26, 1 << 22
END = 0
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """A text's words, lower-cased in A-Z, in lists from parts cut at white space."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + PART) if at + PART < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end].lower().split()
        at = end


def key_of(word: bytes) -> int:
    """56 bits of hash, then the word's cell unless it is a head word; as a signed long."""
    cell = (CLASSES - TAIL + zlib.crc32(word[-2:]) % TAIL) * SLOTS + zlib.crc32(word[-4:-2]) % SLOTS
    key = (xxhash.xxh64_intdigest(word) >> 8 << 8) | cell
    return key - (1 << 64) if key >> 63 else key


class Numbers(dict):
    """Word to number within a task; `keys` by number. None is the end."""

    def __init__(self):
        super().__init__()
        self.keys: list[int] = []
        self.bytes = 0

    def __missing__(self, word: bytes | None) -> int:
        n = self[word] = len(self.keys)
        self.keys.append(END if word is None else key_of(word))
        self.bytes += len(word or b"")
        return n


BLOCKS = "turn int, rids array<long>, doc_ids array<long>, learn array<boolean>, sizes array<int>, words binary, keys binary"


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, turn = Numbers(), 0
    rows: list[tuple] = []
    parts: list[np.ndarray] = []
    filled = 0

    def block() -> pa.RecordBatch:
        nonlocal numbers, filled, turn
        ids = np.concatenate(parts)
        here = np.zeros(len(numbers.keys), bool)
        here[ids] = True
        own = np.flatnonzero(here)
        local = np.zeros(len(here), np.uint32)
        local[own] = np.arange(len(own))
        words = local[ids].astype("<u2" if len(own) <= 1 << 16 else "<u4")
        keys = np.array(numbers.keys, "<i8")[own]
        rids, ids_of, learn, sizes = zip(*rows, strict=True)
        lists = [pa.array([x], pa.list_(t)) for x, t in ((rids, pa.int64()), (ids_of, pa.int64()), (learn, pa.bool_()), (sizes, pa.int32()))]
        out = pa.RecordBatch.from_arrays([pa.array([turn % ROUNDS], pa.int32()), *lists, pa.array([words.tobytes()]), pa.array([keys.tobytes()])], ["turn", "rids", "doc_ids", "learn", "sizes", "words", "keys"])
        rows.clear()
        parts.clear()
        filled, turn = 0, turn + 1
        if len(numbers.keys) > CACHE or numbers.bytes > CACHE_BYTES:
            numbers = Numbers()
        return out

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i, (rid, doc, learn) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("learn").to_pylist(), strict=True)):
            n = 0
            for some in word_lists(texts[i].as_py() or b""):
                parts.append(np.fromiter(map(numbers.__getitem__, some), np.uint32, len(some)))
                n += len(some)
            parts.append(np.array([numbers[None]], np.uint32))
            rows.append((rid, doc, learn, n + 1))
            filled += n + 1
            if filled >= BLOCK:
                yield block()
    if rows:
        yield block()


def tokenized(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """Staged blocks of `docs(doc_id, text)`; `learn` says which rows the model may learn from (default: all)."""
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), learn.alias("learn"), "text")
    return staged(rows.mapInArrow(_tokenize, BLOCKS), "lm-blocks")


class Block:
    """A row of `tokenized`: numbers into its vocabulary and the documents' sizes, of learning rows alone if asked."""

    def __init__(self, row: pa.StructScalar, learning: bool = False):
        self.keys = np.frombuffer(row["keys"].as_py(), "<i8")
        raw = row["words"].as_py()
        self.sizes = row["sizes"].values.to_numpy()
        self.words = np.frombuffer(raw, "<u2" if len(raw) == 2 * int(self.sizes.sum()) else "<u4")
        if learning:
            some = row["learn"].values.to_numpy(zero_copy_only=False)
            if not some.all():
                self.words, self.sizes = self.words[np.repeat(some, self.sizes)], self.sizes[some]


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.StructScalar]:
    for batch in batches:
        yield from batch.to_struct_array()


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(times), len(key)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, times, held = [], [], 0
    for row in block_rows(batches):
        block = Block(row, learning=True)
        n = np.bincount(block.words, minlength=len(block.keys))
        keys.append(block.keys[n > 0])
        times.append(n[n > 0])
        held += len(keys[-1])
        if held > 1_000_000:
            key, n = _summed(keys, times)
            keys, times, held = [key], [n], len(key)
            if held > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                keys, times, held = [], [], 0
    if keys:
        key, n = _summed(keys, times)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


class Shared:
    """What all tasks need: the frequent words' counts, the cells' totals, the weights."""

    def __init__(self, hot_keys: np.ndarray, hot_counts: np.ndarray, total: int, kinds: int, cell_totals: dict[int, tuple[int, int]]):
        self.hot_keys, self.hot_counts, self.total, self.kinds = hot_keys, hot_counts, total, kinds
        head = [END, *[int(k) for k in hot_keys[: HEAD + 1] if k != END]][:HEAD]
        self.head = {k: i for i, k in enumerate(head)}
        mass, size = np.zeros(CELLS), np.zeros(CELLS)
        for c, (n, v) in cell_totals.items():
            mass[c], size[c] = n, v
        mass[:HEAD] = size[:HEAD] = 0  # the end's, whose key names no cell
        for k, n in zip(hot_keys.tolist(), hot_counts.tolist(), strict=True):
            if k in self.head:
                if k != END:
                    mass[k & (CELLS - 1)] -= n
                    size[k & (CELLS - 1)] -= 1
                mass[self.head[k]], size[self.head[k]] = n, 1
        self.spread = np.log10(mass + 0.5 * (size + 1))
        by_class = mass.reshape(CLASSES, SLOTS)
        self.bias = np.log(by_class.sum(1) + 1).astype(np.float32)
        self.inner_bias = np.log(by_class + 1).astype(np.float32)
        self.weights, self.inner = np.zeros((DIMS, CLASSES), np.float32), np.zeros((DIMS, SLOTS), np.float32)

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of a block's words its cell, its number as a feature, and log10(count + 0.5) (nan if it isn't frequent)."""
        if not hasattr(self, "_order"):
            self._order = np.argsort(self.hot_keys)
            self._sorted = self.hot_keys[self._order]
            cell = self.hot_keys & (CELLS - 1)
            cell[[i for i, k in enumerate(self.hot_keys[: HEAD + 1].tolist()) if k in self.head]] = [self.head[k] for k in self.hot_keys[: HEAD + 1].tolist() if k in self.head]
            self._cell, self._log = cell, np.log10(self.hot_counts + 0.5)
        cells, log, rank = keys & (CELLS - 1), np.full(len(keys), np.nan), np.full(len(keys), -1)
        if len(self._sorted):
            at = np.minimum(np.searchsorted(self._sorted, keys), len(self._sorted) - 1)
            hit = np.flatnonzero(self._sorted[at] == keys)
            rank[hit] = own = self._order[at[hit]]
            cells[hit], log[hit] = self._cell[own], self._log[own]
        return cells, np.where((rank >= 0) & (rank < FEATURE_WORDS), CELLS + 1 + rank, 1 + cells).astype(np.uint64), log

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_order", "_sorted", "_cell", "_log")}


def histories(feat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Names of each token's history features, a row a token: one before, two before together, the one before last."""
    before, earlier = np.zeros(len(feat), np.uint64), np.zeros(len(feat), np.uint64)
    before[1:], earlier[2:] = feat[:-1], feat[:-2]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before[starts] = 0
    earlier[starts] = 0
    second = starts[sizes > 1] + 1
    earlier[second] = 0
    return np.stack([3 * before + np.uint64(1), (before << np.uint64(20)) + 3 * earlier + np.uint64(2), 3 * earlier + np.uint64(3)], 1)


def hashed(names: np.ndarray) -> np.ndarray:
    return ((names * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64)


def history(feat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Weight rows of each token's history features."""
    return hashed(histories(feat, sizes))


def within(names: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Weight rows of the history features together with a class."""
    return hashed(names * np.uint64(CLASSES) + kinds.astype(np.uint64)[:, None])


def class_scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log of the odds; `bias` is one row, or one a row of `rows`."""
    scores = np.take(weights, rows[:, 0], axis=0, mode="clip")
    scores += np.take(weights, rows[:, 1], axis=0, mode="clip")
    scores += np.take(weights, rows[:, 2], axis=0, mode="clip")
    scores += bias
    return np.clip(scores, -80, 80, out=scores)


def class_logs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    scores = class_scores(weights, bias, rows)
    return scores - np.log(np.exp(scores).sum(1, keepdims=True))


def picked_logs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Natural logs of the probabilities of `picked`."""
    scores = class_scores(weights, bias, rows)
    own = scores[np.arange(len(picked)), picked]
    return own - np.log(np.einsum("ij->i", np.exp(scores, out=scores)))


class Learner:
    """A partition's Adagrad steps from shared weights of one of the softmaxes."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.width = weights.copy(), weights.shape[1]
        self.speed, self.touched = np.full(DIMS, 0.1 * self.width, np.float32), np.zeros(DIMS, np.int64)

    def learn(self, bias: np.ndarray, rows: np.ndarray, picked: np.ndarray) -> None:
        slope = class_scores(self.weights, bias, rows)
        np.exp(slope, out=slope)
        slope *= (1 / np.einsum("ij->i", slope))[:, None]
        slope[np.arange(len(picked)), picked] -= 1
        flat = rows.ravel().astype(np.uint16)  # rows of 2^15: sorted by radix
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        order //= rows.shape[1]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        own, n = flat[starts].astype(np.int64), np.diff(np.append(starts, len(flat)))
        mean = np.take(slope, order[starts], axis=0, mode="clip")
        many = np.flatnonzero(n > 1)
        if len(many):  # rows that occur once need no sum
            some = n[many]
            sums = np.add.reduceat(np.take(slope, order[np.repeat(n > 1, n)], axis=0, mode="clip"), np.cumsum(some) - some, axis=0)
            mean[many] = sums / np.sqrt(some)[:, None].astype(np.float32)
        speed = self.speed[own] + np.einsum("ij,ij->i", mean, mean)
        self.speed[own] = speed
        mean *= (RATE / np.sqrt(speed / self.width))[:, None]
        self.weights[own] -= mean
        self.touched[own] += n


def hot_count(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach: from how many words have each count up to 100,000 and each power of two above."""
    step = F.when(F.col("n") <= 100_000, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    total, least = 0, 1
    rows = sorted(counts.groupBy(step.alias("at")).count().collect(), reverse=True)
    for i, (at, words) in enumerate(rows):
        total += words
        if total > most:
            return rows[i - 1][0] if i else at + 1
        least = at
    return least


def _updates(batches: Iterator[pa.RecordBatch], shared: Shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    outer, inner = Learner(shared.weights), Learner(shared.inner)
    for row in block_rows(batches):
        block = Block(row, learning=True)
        cell_of, feat_of, _ = shared.words(block.keys)
        cells, features = cell_of[block.words], histories(feat_of[block.words], block.sizes) if len(block.sizes) else None
        for at in range(0, len(cells), STEP):
            kinds, slots = np.divmod(cells[at : at + STEP], SLOTS)
            outer.learn(shared.bias, hashed(features[at : at + STEP]), kinds)
            inner.learn(np.take(shared.inner_bias, kinds, axis=0), within(features[at : at + STEP], kinds), slots)
    for number, (learner, before) in enumerate(((outer, shared.weights), (inner, shared.inner))):
        own = np.flatnonzero(learner.touched)
        if len(own):
            n = learner.touched[own]
            change = (learner.weights[own] - before[own]) * n[:, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(own + number * DIMS), pa.array(n), *(pa.array(change[:, i]) for i in range(change.shape[1]))], ["row", "n", *names])


def train_blocks(blocks: DataFrame) -> tuple[Shared, DataFrame]:
    """The model of the learning rows of `tokenized`, all of them, and the word counts (key, n)."""
    spark = blocks.sparkSession
    counts = staged(blocks.mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")
    by_cell = {int(r["c"]): (int(r["n"]), int(r["v"])) for r in counts.groupBy(F.col("key").bitwiseAND(F.lit(CELLS - 1)).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    hot = counts.where(F.col("n") >= hot_count(counts, HOT_WORDS)).toArrow()  # at most HOT_WORDS rows
    keys, n = hot.column("key").to_numpy(), hot.column("n").to_numpy()
    order = np.lexsort((keys, -n))
    shared = Shared(keys[order], n[order], sum(x for x, _ in by_cell.values()), sum(v for _, v in by_cell.values()), by_cell)
    names = [f"d{i}" for i in range(CLASSES)]
    for number in range(ROUNDS):
        now = spark.sparkContext.broadcast(shared)
        updates = blocks.where(F.col("turn") == number).mapInArrow(lambda batches, now=now: _updates(batches, now.value, names), "row long, n long, " + ", ".join(f"{x} float" for x in names))
        sums = updates.groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names)).toArrow()  # at most 2 x DIMS rows
        row = sums.column("row").to_numpy()
        if len(row):
            change = (np.stack([sums.column(x).to_numpy() for x in names], 1) / sums.column("n").to_numpy()[:, None]).astype(np.float32)
            both = np.concatenate([shared.weights, shared.inner])
            both[row] += change
            shared.weights, shared.inner = both[:DIMS], both[DIMS:]
    return shared, counts


def train(docs: DataFrame) -> tuple[Shared, DataFrame]:
    """The model of `docs(doc_id, text)`, all of them, and the word counts (key, n)."""
    return train_blocks(tokenized(docs))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


SCORED = "rid long, doc_id long, n_tokens long, known long, base double, own double, keys array<long>, times array<long>"


def _scored(batches: Iterator[pa.RecordBatch], model: Shared) -> Iterator[pa.RecordBatch]:
    for row in block_rows(batches):
        block = Block(row)
        sizes, ids = block.sizes, block.words
        cell_of, feat_of, log_of = model.words(block.keys)
        cells, log = cell_of[ids], log_of[ids]
        features, picked = histories(feat_of[ids], sizes), np.empty(len(ids))
        for at in range(0, len(ids), STEP):
            kinds, slots = np.divmod(cells[at : at + STEP], SLOTS)
            some = features[at : at + STEP]
            picked[at : at + STEP] = picked_logs(model.weights, model.bias, hashed(some), kinds) + picked_logs(model.inner, np.take(model.inner_bias, kinds, axis=0), within(some, kinds), slots)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        rare = np.isnan(log)
        log[rare] = 0
        inside = np.where(cells >= HEAD, log - model.spread[cells], 0)
        base, own = np.bincount(owner, log, len(sizes)), np.bincount(owner, picked / np.log(10) + inside, len(sizes))
        known = np.bincount(owner, ~rare, len(sizes)).astype(np.int64)
        # words that aren't frequent: once a document, with how often
        pairs, times = np.unique((owner[rare] << 32) | ids[rare].astype(np.int64), return_counts=True)
        offsets = np.searchsorted(pairs >> 32, np.arange(len(sizes) + 1)).astype(np.int32)
        lists = lambda x, kind, o=offsets: pa.ListArray.from_arrays(pa.array(o), pa.array(x, kind))
        yield pa.RecordBatch.from_arrays(
            [row["rids"].values, row["doc_ids"].values, pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(own), lists(block.keys[pairs & 0xFFFFFFFF], pa.int64()), lists(times, pa.int64())],
            ["rid", "doc_id", "n_tokens", "known", "base", "own", "keys", "times"],
        )


def score_blocks(blocks: DataFrame, shared: Shared, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: a row per document of `tokenized`, learned from or not."""
    now = blocks.sparkSession.sparkContext.broadcast(shared)
    light = staged(blocks.mapInArrow(lambda batches: _scored(batches, now.value), SCORED), "lm-scored")
    rare = light.select("rid", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("rid", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    found = rare.join(counts, "key", "left").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    whole = float(np.log10(shared.total + 0.5 * (shared.kinds + 1)))
    return light.drop("keys", "times").join(found, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + rare_log - F.col("n_tokens") * whole).alias("base_score"), (F.col("own") + rare_log).alias("score"),
    )


def score(docs: DataFrame, shared: Shared, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: a row per row of `docs(doc_id, text)`."""
    return score_blocks(tokenized(docs), shared, counts)
