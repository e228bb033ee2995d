"""SimHash near-duplicates by a byte-position inverted index.

A fingerprint is 8 bytes, so two that differ in at most 3 bits share at least 8 - 3 = 5 bytes at the same positions: the guaranteed
minimum of matches. Posting lists of single positional bytes would be as long as the corpus, so a list here is keyed by 5 positions
and their bytes together (56 choices): pairs whose tally reaches the minimum are those that meet in some list, and no others meet.
So an entry stands for five matches at once, and a pair that meets has the minimum; `linked` tallies its positional matches and verifies
its bits. A list's members differ in 24 bits only. Candidates of lists up to `PAIRWISE` are all their pairs; in longer ones they are the
values that share a neighbour one bit away from one and up to two from the other: all that can pass, with work in proportion to the
list. Both go through `linked`. Lists give spanning links only; components follow from the links by alternating star contractions, each
round a few shuffles of id pairs, its result written to the shared folder.

Equal fingerprints are one node from the start, so groups of copies of any size cost one row.

Defined results: null text has no words and the fingerprint zero, linked like any other; rows without an id carry the component of
the others and count for no minimum; an empty table gives an empty result; repeated rows are returned each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import skew_safe_left_join, staged, text_of

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: A list of up to this many fingerprints is compared pair by pair.
PAIRWISE = 1024
PART = 1 << 22
_CHOICES = list(combinations(range(8), 8 - MAX_BITS))


def shingle_hashes(raw: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles; long texts in parts that overlap by size - 1 words."""
    found, kept, at = False, [], 0
    while at < len(raw) or at == 0:
        end = at + PART
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = kept + raw[at:end].lower().split()
        last = end >= len(raw)
        if len(words) >= size:
            n = len(words) - size + 1
            yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)))), repeat(SEED)), np.uint64, n)
            found = True
        elif last and not found and words:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        kept = words[-(size - 1) :] if size > 1 else []
        at = end
        if last:
            break


def shingle_counts(raw: bytes, size: int = SHINGLE) -> tuple[np.ndarray, int]:
    """How many shingle hashes set each of the 64 bits, and the number of shingles."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(raw, size):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    return counts, total


def simhash(raw: bytes, size: int = SHINGLE) -> int:
    counts, total = shingle_counts(raw, size)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little") if total else 0


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    prints = [simhash(x.as_py() or b"") for x in text.cast(pa.binary())]  # one text at a time
    return pa.array(np.array(prints, np.uint64).view(np.int64))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under each choice of positions: the choice's number and the bytes there make the key."""
    for batch in batches:
        values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for number, positions in enumerate(_CHOICES):
            key = np.full(len(values), number, np.uint64)
            for p in positions:
                key = (key << np.uint64(8)) | ((values >> np.uint64(8 * p)) & np.uint64(255))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("fp")], ["key", "fp"])


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs whose tally of equal positional bytes reaches the minimum and whose differing bits are at most MAX_BITS."""
    differ = a ^ b
    spread = differ | (differ >> np.uint64(4))
    spread |= spread >> np.uint64(2)
    spread |= spread >> np.uint64(1)
    tally = 8 - np.bitwise_count(spread & np.uint64(0x0101010101010101))
    return (tally >= 8 - MAX_BITS) & (np.bitwise_count(differ) <= MAX_BITS)


class Merger:
    """Labels of what is connected so far; `add` returns which of the given links joined different labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        new = self.label[a] != self.label[b]
        a, b = a[new], b[new]
        while len(a):
            x, y = self.label[a], self.label[b]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]
            rest = self.label[a] != self.label[b]
            a, b = a[rest], b[rest]
        return new


def short_list_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of lists of bounded length, which lie one after another, by comparing places d apart for each d."""
    merger, found, at, d = Merger(len(fp)), [], np.arange(len(fp)), 1
    while True:
        at = at[at + d < len(fp)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        close = at[linked(fp[at], fp[at + d])]
        close = close[merger.add(close, close + d)]
        found.append((fp[close], fp[close + d]))
        d += 1
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (fp[:0], fp[:0])


def long_list_links(key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one list without forming its pairs.

    Every value's neighbourhood of at most one flipped bit (of the 24 that may differ) is laid out and sorted; values that share a
    neighbour are at most 2 bits apart. A value whose neighbour at two flips lies in another's neighbourhood is at most 3 apart.
    """
    positions = [p for p in range(8) if p not in _CHOICES[key >> 40]]
    bits = [np.uint64(1) << np.uint64(8 * p + i) for p in positions for i in range(8)]
    n, merger, found = len(fp), Merger(len(fp)), []
    near = np.concatenate([fp, *(fp ^ b for b in bits)])
    owner = np.tile(np.arange(n), 1 + len(bits))
    order = np.argsort(near, kind="stable")
    near, owner = near[order], owner[order]
    same = np.flatnonzero(near[1:] == near[:-1])

    def link(a: np.ndarray, b: np.ndarray) -> None:
        good = linked(fp[a], fp[b])
        a, b = a[good], b[good]
        new = merger.add(a, b)
        found.append((fp[a[new]], fp[b[new]]))

    link(owner[same], owner[same + 1])
    for x, y in combinations(bits, 2):
        moved = fp ^ (x | y)
        at = np.minimum(np.searchsorted(near, moved), len(near) - 1)
        hit = np.flatnonzero(near[at] == moved)
        link(hit, owner[at[hit]])
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key, then fingerprint, in; links (hi, lo) out. Holds one list, of at most 2**24 fingerprints, and one batch."""

    def of(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        size = np.repeat(sizes, sizes)
        some = (size > 1) & (size <= PAIRWISE)
        parts = [short_list_links(key[some], fp[some])] if some.any() else []
        parts += [long_list_links(int(key[s]), fp[s : s + n]) for s, n in zip(starts, sizes, strict=True) if n > PAIRWISE]
        for a, b in parts:
            if len(a):
                a, b = a.view(np.int64), b.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["hi", "lo"])

    kept_key, kept_fp = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column("key").to_numpy().view(np.uint64), batch.column("fp").to_numpy().view(np.uint64)
        if key[0] != key[-1] or (kept_key and kept_key[-1][-1] != key[0]):
            cut = int(np.searchsorted(key, key[-1]))
            done_key, done_fp = np.concatenate([*kept_key, key[:cut]]), np.concatenate([*kept_fp, fp[:cut]])
            kept_key, kept_fp = [key[cut:]], [fp[cut:]]
            if len(done_key):
                yield from of(done_key, done_fp)
        else:
            kept_key.append(key)
            kept_fp.append(fp)
    if kept_key:
        yield from of(np.concatenate(kept_key), np.concatenate(kept_fp))


def components(links: DataFrame) -> DataFrame:
    """(hi, lo): every node of `links(hi, lo)`, hi > lo, but a component's smallest, with that smallest node."""
    edges = staged(links.distinct(), "links")
    state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: a node's larger neighbours go to the smallest of all its neighbours and itself
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
        edges = staged(small.distinct(), "links")
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if after == state:
            break
        state = after
    return edges


def rooted(prints: DataFrame) -> DataFrame:
    """fp, least (doc_id), n (rows), root (the fingerprint that names the component): a staged row per fingerprint of `prints(doc_id, fp)`.
    With a column hash also first: the least (id is missing, doc_id, hash)."""
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("first")] if "hash" in prints.columns else []
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), *first), "simhash-nodes")
    lists = nodes.select("fp").mapInArrow(_postings, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    roots = components(lists.mapInArrow(_links, "hi long, lo long"))
    return staged(nodes.join(roots, F.col("fp") == F.col("hi"), "left").select(*nodes.columns, F.coalesce("lo", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id: a row per row of `docs`."""
    prints = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")), "simhash")
    roots = rooted(prints)
    groups = staged(roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "simhash-groups")
    named = staged(skew_safe_left_join(roots.select("fp", "n", "root"), groups, "root", "nodes").select("fp", "n", "component_id"), "simhash-named")
    joined = skew_safe_left_join(prints, named, "fp", "n")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one document a group: that of the smallest id, nulls last, and then of the smallest hash of its text.
    Rows equal in id and text are one document."""
    text_hash = F.xxhash64(text_of(text_col))
    prints = staged(docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("hash"), fingerprint(F.col(text_col)).alias("fp")), "simhash")
    keep = rooted(prints).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_keep_id"), F.col("first.hash").alias("_keep_hash"))
    here = docs.withColumn("_text_hash", text_hash)
    return here.join(keep, F.col(id_col).eqNullSafe(F.col("_keep_id")) & (F.col("_text_hash") == F.col("_keep_hash")), "left_semi").select(*docs.columns)
