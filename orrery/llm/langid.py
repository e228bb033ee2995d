"""Language identification by prediction by partial matching.

Per language a tree of byte contexts of orders 0 to `MAX_ORDER` with counts; a byte's probability in the longest context that knows it
is count / (n + d), and leaving a context costs d / (n + d) (d distinct bytes among n: escape method C); below order 0 all 256 bytes
are alike. Statistics are frozen after training, so a text's code length is a sum of table entries and exact for its whole text.

Training reads a bounded sample: whole documents by hash of doc_id until `SAMPLE_BYTES` a language (at least one document), and no
more than `TOTAL_BYTES` over all languages. Counting is a Spark aggregation; the summed counts are the model.

Defined results: null text and text without a letter are `und` with score 0; without any training text all is `und`; ties go to the
smaller language name; repeated rows are answered each, an empty table gives an empty result, and extra columns pass through (those
named _predicted, _lang_pred or _lang_score are replaced). Numerals (a half, circled and Roman ones) aren't letters. Bytes are compared after lower-casing A-Z and the two-byte Latin capitals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_ORDER, SAMPLE_BYTES, TOTAL_BYTES, CHUNK, ROWS = 3, 1_000_000, 32_000_000, 1 << 18, 500
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")  # a letter, or a numeral such as a half
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def folded(raw: np.ndarray) -> np.ndarray:
    out = _LOWER[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    capitals = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
    out[capitals] += 0x20
    return out


def grams(x: np.ndarray, order: int) -> np.ndarray:
    """For each place from MAX_ORDER on, its byte and the `order` bytes before it as one number, tagged with the order."""
    out = np.full(len(x) - MAX_ORDER, order + 1, np.uint64) << np.uint64(56)
    for back in range(order + 1):
        out |= x[MAX_ORDER - back : len(x) - back].astype(np.uint64) << np.uint64(8 * back)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang in set(langs):
            found: dict[int, list[np.ndarray]] = {k: [] for k in range(MAX_ORDER + 1)}
            for i in np.flatnonzero(langs == lang):
                x = folded(np.frombuffer(bytes(MAX_ORDER) + texts[i], np.uint8))
                for k in found:
                    found[k].append(grams(x, k))
            for parts in found.values():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


def sample(rows: DataFrame) -> DataFrame:
    """The bounded training sample of `rows(doc_id, lang, text)`: whole documents of each language in order of a hash of the id."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").withColumn("bytes", F.octet_length("text").cast("long"))
    totals = rows.groupBy("lang").agg(F.sum("bytes").alias("total"), F.count(F.lit(1)).alias("n"))
    share = max(1, min(SAMPLE_BYTES, TOTAL_BYTES // max(1, totals.count())))
    rank = F.shiftrightunsigned(F.xxhash64(F.lit(9), "doc_id"), 11) / F.lit(float(2**53))
    # about four times the share and 64 documents a language pass this filter; only their ids and sizes go through the running sum
    near = rows.select("doc_id", F.col("lang").alias("_lang"), "bytes", rank.alias("rank")).join(F.broadcast(totals.withColumnRenamed("lang", "_lang")), "_lang")
    near = near.where(F.col("rank") < F.lit(4.0 * share) / F.col("total") + F.lit(64.0) / F.col("n")).select("_lang", "doc_id", "rank", "bytes")
    upto = Window.partitionBy("_lang").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = near.withColumn("before", F.coalesce(F.sum("bytes").over(upto), F.lit(0))).where((F.col("before") + F.col("bytes") <= share) | (F.col("before") == 0))
    return rows.join(F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "_lang")), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi").select("lang", "text")


def has_letter(text: str) -> bool:
    first = _LETTER.search(text)
    return first is not None and (first[0].isalpha() or any(map(str.isalpha, text[first.end() :])))


class Model:
    """Frozen statistics: for each n-gram of any language a row of log probabilities and a row of log escapes, by language."""

    def __init__(self, langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.langs, size = langs, len(langs)
        tag, low = code >> np.uint64(56), np.uint64((1 << 56) - 1)
        # contexts get rows as n-grams of one order less, also those (starts of texts) that never end in a coded byte
        contexts = ((tag - np.uint64(1)) << np.uint64(56) | (code & low) >> np.uint64(8))[tag > 1]
        self.codes = np.unique(np.concatenate([code, contexts]))
        count = np.zeros((len(self.codes), size))
        count[np.searchsorted(self.codes, code), lang] = n
        order = (self.codes >> np.uint64(56)).astype(np.int64) - 1
        body = self.codes & low
        self.escape = np.zeros((len(self.codes), size), np.float32)
        log_p = np.zeros((len(self.codes), size))
        with np.errstate(divide="ignore"):
            for k in range(MAX_ORDER + 1):
                at = np.flatnonzero(order == k)
                c = count[at]
                heads, head = np.unique(body[at] >> np.uint64(8), return_inverse=True)
                total, kinds = np.zeros((len(heads), size)), np.zeros((len(heads), size))
                np.add.at(total, head, c)
                np.add.at(kinds, head, c > 0)
                known = total > 0
                leave = np.where(known, np.log(np.where(known, kinds, 1) / np.where(known, total + kinds, 1)), 0.0)
                if k:
                    lower = np.searchsorted(self.codes, (np.uint64(k) << np.uint64(56)) | (body[at] & np.uint64((1 << (8 * k)) - 1)))
                    shorter = log_p[lower]
                    self.escape[np.searchsorted(self.codes, (np.uint64(k) << np.uint64(56)) | heads)] = leave
                else:
                    shorter = np.full((len(at), size), -np.log(256.0))
                    self.root = leave[0].astype(np.float32) if len(heads) else np.zeros(size, np.float32)
                log_p[at] = np.where(c > 0, np.log(np.where(c > 0, c, 1) / np.where(c > 0, total[head] + kinds[head], 1)), leave[head] + shorter)
        self.log_p = log_p.astype(np.float32)
        self._index()

    def _index(self) -> None:
        """Open addressing at a quarter full at most: a lookup is mostly one gather."""
        self.bits = max(10, int(np.ceil(np.log2(4 * max(1, len(self.codes))))))
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(self.codes)), self._slot(self.codes)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.rows[slot[put]] = self.codes[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 if unknown."""
        slot = self._slot(codes)
        key = self.keys[slot]
        out = np.where(key == codes, self.rows[slot], -1)
        left = np.flatnonzero((key != codes) & (key != 0))
        while len(left):
            slot_left = (slot[left] + 1) & ((1 << self.bits) - 1)
            slot[left] = slot_left
            key = self.keys[slot_left]
            hit = key == codes[left]
            out[left[hit]] = self.rows[slot_left[hit]]
            left = left[~hit & (key != 0)]
        return out

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the bytes of `x` from MAX_ORDER on, each given those before it: a row a byte, a column a language."""
        codes = [grams(x, k) for k in range(MAX_ORDER + 1)]
        row = self.find(codes[MAX_ORDER])
        out = self.log_p[row]
        left = np.flatnonzero(row < 0)
        out[left] = 0
        for k in range(MAX_ORDER, -1, -1):
            if not len(left):
                break
            if k < MAX_ORDER:
                row = self.find(codes[k][left])
                hit = row >= 0
                out[left[hit]] += self.log_p[row[hit]]
                left = left[~hit]
            if k:
                # the context: the n-gram of order k - 1 that ends just before
                tag = np.uint64(k) << np.uint64(56)
                context = self.find(tag | ((codes[k][left] >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1)))
                out[left[context >= 0]] += self.escape[context[context >= 0]]
            else:
                out[left] += self.root - np.float32(np.log(256.0))
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Log probability of each whole text by language; long texts in parts, each with the bytes before it as context."""
        out = np.zeros((len(texts), len(self.langs)))
        parts, owners, filled = [], [], 0

        def flush() -> None:
            nonlocal parts, owners, filled
            if parts:
                x = folded(np.frombuffer(b"".join(parts), np.uint8))
                sizes = np.array([len(p) for p in parts])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                each = self.lengths(np.concatenate([np.zeros(MAX_ORDER, np.uint8), x]))
                for s in range(MAX_ORDER):  # the leading context bytes of each part aren't coded
                    each[starts + s] = 0
                np.add.at(out, owners, np.add.reduceat(each, starts, axis=0, dtype=np.float64))
            parts, owners, filled = [], [], 0

        for i, raw in enumerate(texts):
            for at in range(0, len(raw), CHUNK):
                part = (raw[at - MAX_ORDER : at] if at else bytes(MAX_ORDER)) + raw[at : at + CHUNK]
                parts.append(part)
                owners.append(i)
                filled += len(part)
                if filled >= CHUNK:
                    flush()
        flush()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        some = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if self.langs else []
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        if some:
            totals = self.totals([texts[i].encode("utf-8", "replace") for i in some])
            best = totals.argmax(1)
            odds = np.exp(totals - totals.max(1, keepdims=True))
            for i, b, p in zip(some, best, 1 / odds.sum(1), strict=True):
                names[i], scores[i] = self.langs[b], p
        return names, scores


def train(rows: DataFrame) -> Model:
    counts = sample(rows).mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in counts.column("lang").to_pylist()], np.int64)
    return Model(langs, lang, counts.column("code").to_numpy().view(np.uint64), counts.column("n").to_numpy())


def predictor(docs: DataFrame, model: Model):
    """A function from a text column to struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TOTAL_BYTES

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        parts = [shared.value.predict(text[at : at + ROWS].to_pylist()) for at in range(0, len(text), ROWS)]  # few texts at once
        names, scores = [n for part, _ in parts for n in part], [x for _, part in parts for x in part]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict.asNondeterministic()  # so that no plan evaluates it twice


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`docs` with _lang_pred and _lang_score; learns from the rows that aren't held out."""
    model = train(docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("doc_id"), "lang", "text"))
    return docs.withColumn("_predicted", predictor(docs, model)("text")).withColumn("_lang_pred", F.col("_predicted.lang_pred")).withColumn("_lang_score", F.col("_predicted.score")).drop("_predicted")
