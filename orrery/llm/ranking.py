"""Ranked lexical search: each item's best documents by integer impacts of shared terms.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Items are taken in blocks whose terms
are bounded (`BLOCK_BYTES` of text on average, dealt by hash; one item at least): a block's vocabulary, and which items want a term how
often, goes to all tasks. Documents are read once a block into a table of posting lists, whole, never by term: a document's number of
terms, and which wanted terms it holds how often. Document frequencies, the number of documents and of terms are sums over that table.

Scores are accumulated by sorting. Tasks hold ranges of the documents; for a run of them the arrays of (item, document, impact) that
terms match are concatenated, their keys, packed as item * documents + document, sorted by radix (16-bit digits, stable), and impacts of
equal keys summed by `numpy.add.reduceat`. A heap an item selects the best of a task; those of all tasks, at most `most` a task and item,
are dealt by ranges of the item and ranked. No pair of item and document leaves a task unless it is among its bests.

Defined results: null texts have no terms, items and documents alike, and give no rows; rows of items equal in id and text are one item,
other rows with a common id are ranked each; a null document id comes last among ties; repeated documents are ranked each; without
items, documents or common terms the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import staged

BLOCK_BYTES, BATCH_BYTES, MATCHES = 4 << 20, 1 << 22, 1 << 21
#: The rule of scores: saturation by 1000 tf / (1000 tf + 8 m), m = 25 + 75 * length / mean length.
SCALE, SATURATION, PLAIN, BY_LENGTH = 1_000_000_000, 8, 25, 75
#: Bytes of UTF-8 to terms: what separates them to spaces, A-Z to a-z.
TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


class Wanted:
    """Terms of a block of items: `of` to numbers; a number's items and how often each wants it at items[starts[t] : starts[t + 1]]."""

    def __init__(self, texts: list[bytes]):
        self.of: dict[bytes, int] = {}
        rows: list[tuple[int, int, int]] = []
        for item, text in enumerate(texts):
            for term, times in Counter(terms(text)).items():
                rows.append((self.of.setdefault(term, len(self.of)), item, times))
        rows.sort()
        number, self.items, self.times = np.array(rows, np.int64).reshape(-1, 3).T
        self.starts = np.searchsorted(number, np.arange(len(self.of) + 1))
        self.count = len(texts)


def posting_lists(docs: DataFrame, wanted: Wanted) -> DataFrame:
    """doc_id, n (number of terms), terms, times (of wanted terms) of the documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, size = shared.value.of, max(1, len(shared.value.of))

        def made(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            sizes, numbers = np.zeros(len(texts), np.int64), []
            for i, text in enumerate(texts):
                words = terms(text)
                sizes[i] = len(words)
                numbers.append(np.fromiter((of.get(w, -1) for w in words), np.int64, len(words)))
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            key = np.repeat(np.arange(len(texts)), sizes)[flat >= 0] * size + flat[flat >= 0]
            key, times = np.unique(key, return_counts=True)
            kept = np.flatnonzero(sizes)
            offsets = np.append(np.searchsorted(key, kept * size), len(key)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (key % size, times)]
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in kept], pa.int64()), pa.array(sizes[kept]), *lists], ["doc_id", "n", "terms", "times"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            first, room = 0, BATCH_BYTES
            held: list[bytes] = []
            for k in range(batch.num_rows):  # whole texts, as many as fit
                text = texts[k].as_buffer()
                text = b"" if text is None else text.to_pybytes()
                if held and len(text) > room:
                    yield made(ids[first:k], held)
                    first, room, held = k, BATCH_BYTES, []
                held.append(text)
                room -= len(text)
            if held:
                yield made(ids[first:], held)

    binary = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return binary.where("text IS NOT NULL").mapInArrow(listed, "doc_id long, n long, terms array<int>, times array<int>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of non-negative keys, one 16-bit digit after another (numpy sorts those by radix)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high, shift = int(keys.max(initial=0)) >> 16, 16
    while high:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        high, shift = high >> 16, shift + 16
    return order


def accumulated(document: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int, wanted: Wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of all pairs that share a term, in order; one entry of the inputs a document's term."""
    counts = wanted.starts[term + 1] - wanted.starts[term]
    which = np.repeat(np.arange(len(term)), counts)
    at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + wanted.starts[term][which]
    key = wanted.items[at] * documents + document[which]
    order = radix_order(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat((wanted.times[at] * impact[which])[order], first) if len(first) else np.zeros(0, np.int64)
    return key[first] // documents, key[first] % documents, total


class Bests:
    """A heap an item of its `most` best (score, document), the worst on top."""

    def __init__(self, items: int, most: int):
        self.heaps, self.most = [[] for _ in range(items)], most
        self.least, self.last = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).max)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """Keeps what beats the worst kept: a higher score, or the same with a smaller id (missing ids last)."""
        may = np.flatnonzero((score > self.least[item]) | ((score == self.least[item]) & (score > 0) & ~missing & (ids < self.last[item])))
        for k in may[np.lexsort([-score[may], item[may]])]:  # the best first, so that few of an item's others are pushed
            i, heap = item[k], self.heaps[item[k]]
            new = (int(score[k]), not missing[k], -int(ids[k]))
            if len(heap) < self.most:
                heapq.heappush(heap, new)
            elif new > heap[0]:
                heapq.heapreplace(heap, new)
            else:
                continue
            if len(heap) == self.most:
                self.least[i], self.last[i] = heap[0][0], -heap[0][2] if heap[0][1] else np.iinfo(np.int64).max

    def rows(self) -> tuple[list, list, list]:
        kept = [(i, -n if known else None, score) for i, heap in enumerate(self.heaps) for score, known, n in heap]
        return tuple(map(list, zip(*kept, strict=True))) if kept else ([], [], [])


def impacts(term: np.ndarray, times: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What each term adds to a document of n terms, in integers."""
    length = BY_LENGTH * n * documents // total if int(n.max(initial=0)) * BY_LENGTH * documents < 2**63 else np.array([BY_LENGTH * int(x) * documents // total for x in n], np.int64)
    return weight[term] * (SCALE * times // (1000 * times + SATURATION * (PLAIN + length)))


def ranked(lists: DataFrame, wanted: Wanted, most: int) -> DataFrame:
    """item (number in the block), doc_id, score: each task's bests."""
    spark = lists.sparkSession
    whole = lists.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    held = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # at most one row a wanted term
    weight = np.zeros(max(1, len(wanted.of)), np.int64)
    for r in held:
        weight[r["term"]] = math.floor(1000 * math.log((2 * whole["documents"] + 2) / (2 * r["df"] + 1)))
    shared = spark.sparkContext.broadcast((wanted, weight, whole["documents"], whole["terms"] or 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, by_term, documents, total = shared.value
        bests, reach = Bests(want.count, most), np.append(np.diff(want.starts), 0)
        for batch in batches:
            lists = batch.column("terms")
            sizes, term, times = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.int64), batch.column("times").flatten().to_numpy().astype(np.int64)
            n, missing = batch.column("n").to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids, owner = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
            value = impacts(term, times, n[owner], by_term, documents, total)
            useful = value > 0
            owner, term, value = owner[useful], term[useful], value[useful]
            matched = np.cumsum(np.bincount(owner, reach[term], len(sizes)))
            begin = 0
            while begin < len(sizes):  # runs of whole documents with about MATCHES matches
                before = matched[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(matched, before + MATCHES, "right")))
                some = slice(*np.searchsorted(owner, [begin, end]))
                item, document, score = accumulated(owner[some] - begin, term[some], value[some], end - begin, want)
                bests.add(item, score, ids[begin + document], missing[begin + document])
                begin = end
        item, doc, score = bests.rows()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return lists.mapInArrow(scored, "item int, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, most: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, text (of the item), rank, doc_id, score. `items(item_id, text)`, `docs(doc_id, text)`."""
    spark = items.sparkSession
    asked = items.where("text IS NOT NULL").select("item_id", "text").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        # a block of the query set: about block_bytes of text
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        wanted = Wanted([(r["text"]).encode("utf-8", "replace") for r in rows])
        best = ranked(staged(posting_lists(docs, wanted), "postings"), wanted, most)
        names = spark.createDataFrame([(k, r["item_id"], r["text"]) for k, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}, text string")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = best.repartitionByRange("item").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        part = top.join(F.broadcast(names), "item").select("item_id", "text", "rank", "doc_id", "score")  # as many names as items in the block
        found = part if found is None else found.unionByName(part)
    return found
