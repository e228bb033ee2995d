"""Near copies: SimHash's links (three-word shingles, at most 3 bits) and texts whose five-word shingle sets have a Jaccard similarity of
0.8 or more.

SimHash at 3 bits finds few edited copies, so here its groups are joined further. Each text has `BANDS` band keys of `ROWS` minima of
hashed shingles; texts that share a key are candidates, which a pair of similarity 0.8 is with a probability of 1 - (1 - 0.8^6)^20 =
0.998. One bit of each minimum makes a sketch of 120 bits: two texts of similarity s agree in (1 + s) / 2 of them on average, and
candidates that agree in fewer than `AGREE` are no pairs (at 0.8 that is four standard deviations off; texts that share just a passage
fail). Pairs of different groups are verified by their whole shingle sets, in rounds: first the members of each list with the one nearest
to the list's majority of bits, the least edited of a group of copies; then, where groups still differ, each group's `CLOSEST` pairs in
each of its lists, `TURNS` times. These rounds join most, so that little is left for the last, which tests every pair of each list: the
members that have a candidate in another group meet with their whole sets, and only links between groups leave the task. So rows grow
with the texts, not with the square of a group's size, and no candidate is left out. A text that shares fewer than 8 in 10 of its
shingles with other groups of the list has no similar text there, which ends most of that work. In the last round a list of more than
`LONG` members (or `WEIGHT` shingles) goes over cells of two blocks each, so that every pair of groups meets in bounded memory; in the
rounds before it is dealt by pairs of band keys. The links join SimHash's groups.

Texts are known by 64 bits of hash, shingles too. A text of fewer than five words is one shingle. Defined results: null text has no words
and, like all such texts, the fingerprint zero; rows without an id count for no minimum; repeated rows are returned each by
`near_copies`, and are one document for `keep`; an empty table gives an empty result; extra columns pass through `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import HOT_SHARE, skew_safe_left_join, staged, text_of
from orrery.llm.simhash import Merger, components, fingerprint, rooted, shingle_hashes

SHINGLE = 5
#: The least similarity, in tenths.
TENTHS = 8
BANDS, ROWS, AGREE, LONG, BLOCK, SPREAD = 20, 6, 95, 1 << 14, 1 << 9, 1 << 11
#: Pairs that a group of texts takes from each list, in each of TURNS turns, before all pairs are tested.
CLOSEST, TURNS = 8, 1
#: Shingles that meet in a task at once, in the test of all pairs.
WEIGHT = 1 << 21
_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64)


def shingle_set(raw: bytes) -> np.ndarray:
    parts = list(shingle_hashes(raw, SHINGLE))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> list[int]:
    """Two longs of bits, one a minimum, and a signed key a band."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = (hashes[at : at + 4096, None] ^ _TERMS) * _FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0))
    raw = least.tobytes()
    bits = np.zeros(128, np.uint8)
    bits[: BANDS * ROWS] = (least >> np.uint64(7)) & np.uint64(1)
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) - 2**63 for i in range(BANDS)]
    return [*np.packbits(bits).view(np.int64).tolist(), *keys]


@F.arrow_udf(T.ArrayType(T.LongType()))
def sketch(text: pa.Array) -> pa.Array:
    """The size of the shingle set, then its signature; of a text without words nothing."""

    def of(raw: bytes) -> list[int]:
        hashes = shingle_set(raw)
        return [len(hashes), *signature(hashes)] if len(hashes) else []

    return pa.array([of(x.as_py() or b"") for x in text.cast(pa.binary())], pa.list_(pa.int64()))


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingles(text: pa.Array) -> pa.Array:
    return pa.array([shingle_set(x.as_py() or b"").view(np.int64) for x in text.cast(pa.binary())], pa.list_(pa.int64()))


def fit(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which of the pairs of (text, root, n, bits, bits) are of different roots, and of sizes and bits that let them be similar enough."""
    sizes = (a[1] != b[1]) & (10 * np.minimum(a[2], b[2]) >= TENTHS * np.maximum(a[2], b[2]))
    differ = np.bitwise_count((a[3] ^ b[3]).view(np.uint64)).astype(np.int16) + np.bitwise_count((a[4] ^ b[4]).view(np.uint64))
    return sizes & (differ <= BANDS * ROWS - AGREE)


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole lists (text, root, n, bits, bits) of batches sorted by key."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not len(columns[0]):
            continue
        if kept is not None:
            columns = [np.concatenate([k, c]) for k, c in zip(kept, columns, strict=True)]
        key = columns[0]
        cuts = [*(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        begin = 0
        for end in cuts[:-1]:
            if end - begin > 1:
                yield [c[begin:end] for c in columns[1:]]
            begin = end
        kept = [c[begin:] for c in columns]
    if kept is not None and len(kept[0]) > 1:
        yield kept[1:]


def bits_of(members: list[np.ndarray]) -> np.ndarray:
    """Each member's bits as 0 and 1."""
    return np.unpackbits(np.stack(members[3:5], 1).view(np.uint8), axis=1)[:, : BANDS * ROWS]


def star(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The member nearest to the list's majority of bits (of equals the first), which is that with the fewest edits, with all others."""
    bits = bits_of(members)
    center = int((bits != (2 * bits.sum(0) > len(bits))).sum(1).argmin())
    first = [c[center : center + 1] for c in members]
    good = fit(first, members)
    return np.full(int(good.sum()), members[0][center]), members[0][good]


def closest(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each root of a list the CLOSEST pairs of one of its members with one of another root, by equal bits."""
    n, best = len(members[0]), []
    for i in range(0, n, BLOCK):
        one = [c[i : i + BLOCK, None] for c in members]
        found = []
        for j in range(0, n, BLOCK):
            other = [c[None, j : j + BLOCK] for c in members]
            x, y = np.nonzero(fit(one, other))
            differ = sum(np.bitwise_count((members[k][i + x] ^ members[k][j + y]).view(np.uint64)).astype(np.int64) for k in (3, 4))
            found.append((members[1][i + x], differ, members[0][i + x], members[0][j + y]))
            if sum(len(f[0]) for f in found) > 1 << 18 or j + BLOCK >= n:
                found = [_first_of_roots([np.concatenate(c) for c in zip(*found, strict=True)])]
        best = [_first_of_roots([np.concatenate(c) for c in zip(*best, *found, strict=True)])]
    _, _, x, y = best[0]
    return x, y


def _first_of_roots(rows: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort([*rows[:0:-1], rows[0]])
    root = rows[0][order]
    starts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])) if len(root) else np.zeros(0, np.int64)
    place = np.arange(len(root)) - np.repeat(starts, np.diff(np.append(starts, len(root))))
    return [c[order][place < CLOSEST] for c in rows]


def _pairs(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of text hashes that may be similar: of each list its star, or, if `whole`, the closest pairs of its roots."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def ready() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in found])) for i in (0, 1)], ["a", "b"])
        found.clear()
        return out

    for members in lists(batches):
        if (members[1] == members[1][0]).all():
            continue
        x, y = closest(members) if whole else star(members)
        if len(x):
            found.append((np.minimum(x, y), np.maximum(x, y)))
        if len(found) >= 256:
            yield ready()
    if found:
        yield ready()


def partners(members: list[np.ndarray]) -> np.ndarray:
    """Which members have a candidate of another root. Of two roots one isn't the list's largest, so its own pairs aren't formed."""
    n, found = len(members[0]), np.zeros(len(members[0]), bool)
    _, root, sizes = np.unique(members[1], return_inverse=True, return_counts=True)
    outside = np.flatnonzero(root != sizes.argmax())
    for i in range(0, len(outside), BLOCK):
        at = outside[i : i + BLOCK]
        one = [c[at, None] for c in members]
        for j in range(0, n, BLOCK):
            good = fit(one, [c[None, j : j + BLOCK] for c in members])
            found[at] |= good.any(1)
            found[j : j + BLOCK] |= good.any(0)
    return found


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, text) of the members that `partners` finds; lists of the same such members are one unit."""
    for members in lists(batches):
        if (members[1] == members[1][0]).all():
            continue
        hashes = members[0][partners(members)]
        if len(hashes):
            unit = xxhash.xxh64_intdigest(np.sort(hashes).tobytes()) - 2**63
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), unit)), pa.array(hashes)], ["unit", "hash"])


def alike(root: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (hi, lo) of the roots that have similar texts, of all pairs of texts with sets of `sizes` that lie one after another
    in `values`."""
    names, place = np.unique(root, return_inverse=True)
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    _, token = np.unique(values, return_inverse=True)
    alive, shared = np.ones(len(sizes), bool), sizes
    for _ in range(4):  # a bound: what a text shares with other roots; each text without a partner lowers that of others
        use = alive[owner]
        least, most = np.full(len(token) + 1, len(names)), np.full(len(token) + 1, -1)
        np.minimum.at(least, token[use], place[owner[use]])
        np.maximum.at(most, token[use], place[owner[use]])
        shared = np.bincount(owner[use & (least[token] != most[token])], minlength=len(sizes))
        fewer = alive & (10 * shared >= TENTHS * sizes)
        if (fewer == alive).all():
            break
        alive = fewer
    merger, hi, lo = Merger(len(names)), [], []
    rest = np.flatnonzero(alive)
    if not len(rest):
        return names[:0], names[:0]
    main = np.bincount(place[rest]).argmax()
    rest = np.concatenate([rest[place[rest] != main], rest[place[rest] == main]])  # each pair of two roots has its first text outside the largest
    marked = np.zeros(len(token) + 1, bool)
    for i, x in enumerate(rest[: int((place[rest] != main).sum())]):
        y = rest[i + 1 :]
        both = sizes[x] + sizes[y]
        y = y[(merger.label[place[x]] != merger.label[place[y]]) & (10 * np.minimum(sizes[x], sizes[y]) >= TENTHS * np.maximum(sizes[x], sizes[y])) & ((10 + TENTHS) * np.minimum(shared[x], shared[y]) >= TENTHS * both)]
        if not len(y):
            continue
        mine = token[starts[x] : starts[x] + sizes[x]]
        marked[mine] = True
        ends = np.cumsum(sizes[y])
        common = np.add.reduceat(marked[token[np.arange(ends[-1]) + np.repeat(starts[y] - (ends - sizes[y]), sizes[y])]], ends - sizes[y], dtype=np.int64)
        marked[mine] = False
        y = y[10 * common >= TENTHS * (sizes[x] + sizes[y] - common)]
        a, b = np.full(len(y), place[x]), place[y]
        new = merger.add(a, b)
        hi.append(np.maximum(names[a[new]], names[b[new]]))
        lo.append(np.minimum(names[a[new]], names[b[new]]))
    return np.concatenate([names[:0], *hi]), np.concatenate([names[:0], *lo])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (hi, lo) of each whole unit of batches (unit, root, set) sorted by unit."""

    def of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, sets = (np.concatenate([p.column(1).to_numpy() for p in parts]), [p.column(2) for p in parts])
        if len(root) > 1 and (root != root[0]).any():
            hi, lo = alike(root, np.concatenate([s.value_lengths().to_numpy() for s in sets]).astype(np.int64), np.concatenate([s.flatten().to_numpy() for s in sets]))
            if len(hi):
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["hi", "lo"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if kept and kept[0].column(0)[0].as_py() != unit[begin]:
                yield from of(kept)
                kept = []
            kept.append(batch.slice(begin, end - begin))
    if kept:
        yield from of(kept)


def celled(rows: DataFrame, key: str, weight: Column, most: int) -> DataFrame:
    """`rows(key, hash, root, ...)` with the lists of more than `most` in all weights dealt over cells of about that much. A list's rows
    outside its largest root are cut into blocks, and so are all its rows; a cell is a block of each, so every pair of roots meets."""
    of_roots = rows.groupBy(key, "root").agg(F.sum(weight).alias("weight"))
    sizes = of_roots.groupBy(key).agg(F.sum("weight").alias("all"), F.max(F.struct("weight", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where((F.col("roots") > 1) & (F.col("all") > most))
    blocks = [F.ceil(2 * x / most).cast("long").alias(n) for x, n in ((F.col("all") - F.col("main.weight"), "ones"), (F.col("all"), "others"))]
    long = staged(sizes.select(key, "all", F.col("main.root").alias("main"), *blocks), "near-long")
    if long.isEmpty():
        return rows
    marked = skew_safe_left_join(rows, long, key, "all")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cell = lambda i, j: F.xxhash64(F.col(key), i, j)
    other = F.transform(upto("ones"), lambda i: cell(i, F.pmod(F.xxhash64("hash"), F.col("others"))))
    one = F.transform(upto("others"), lambda j: cell(F.pmod(F.xxhash64("hash"), F.col("ones")), j))
    cells = F.when(F.col("all").isNull(), F.array(key)).when(F.col("root") == F.col("main"), other).otherwise(F.array_union(one, other))
    return marked.select(F.explode(cells).alias(key), *(c for c in rows.columns if c != key))


def posted(texts: DataFrame, whole: bool) -> DataFrame:
    """Postings (key, text, root, n, bits) of the band keys. In the `whole` round members of long lists are posted by pairs of keys."""
    row = ("hash", "root", F.col("sketch")[0].alias("n"), F.col("sketch")[1].alias("bits0"), F.col("sketch")[2].alias("bits1"))
    each = texts.select(F.posexplode(F.slice("sketch", 4, BANDS)).alias("band", "key"), *row)
    if not whole:
        return each.drop("band")
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("root").alias("roots")).where(F.col("roots") > 1)
    long = staged(sizes.where(F.col("size") > LONG).select("key", "size"), "near-long")
    if long.isEmpty():
        return each.drop("band")
    marked = skew_safe_left_join(each, long, "key", "size")
    others = F.transform(F.filter(F.slice("sketch", 4, BANDS), lambda k: k != F.col("key")), lambda k: F.xxhash64(F.least(k, F.col("key")), F.greatest(k, F.col("key"))))
    again = marked.where("size IS NOT NULL").select("hash", "key").join(texts, "hash").select(F.explode(others).alias("key"), *row).distinct()
    return marked.where("size IS NULL").drop("band", "size").unionByName(again)


def with_sets(pairs: DataFrame, sets: DataFrame, hot: DataFrame, side: str) -> DataFrame:
    """`pairs` with root and set of one side. A set that very many pairs need is sent to several places, the pairs dealt over them; `hot`
    tells how many (id and number alone: at most 1 / HOT_SHARE rows)."""
    other = "b" if side == "a" else "a"
    copies = F.broadcast(hot.select(F.col("hash").alias("_hot"), "places"))
    left = pairs.join(copies, F.col(side) == F.col("_hot"), "left").withColumn("_place", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("places"))).cast("long"))
    right = sets.join(copies, F.col("hash") == F.col("_hot"), "left").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("places") - 1, F.lit(0).cast("long")))))
    named = right.select(F.col("hash").alias("_hash"), "_at", F.col("root").alias(f"root_{side}"), F.col("set").alias(f"set_{side}"))
    joined = left.drop("_hot", "places").join(named.hint("shuffle_hash"), (F.col(side) == F.col("_hash")) & (F.col("_place") == F.col("_at")))
    return joined.drop("_place", "_hash", "_at")


def sets_of(hashes: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(hash, root, set) of the texts with these hashes, staged."""
    known = texts.select("hash", "root").join(hashes, "hash")
    once = docs.select(F.xxhash64("text").alias("_hash"), "text").join(known, F.col("_hash") == F.col("hash"))
    return staged(once.select("hash", "root", shingles(F.col("text")).alias("set")).dropDuplicates(["hash"]), "near-sets")


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(hi, lo): the roots of pairs (a, b) of text hashes that are similar enough. `pairs` and `texts(hash, root)` are staged."""
    ends = staged(pairs.select(F.explode(F.array("a", "b")).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("uses")), "near-ends")
    sets = sets_of(ends.select("hash"), texts, docs)
    total = ends.agg(F.sum("uses")).first()[0] or 0
    hot = ends.where(F.col("uses") >= max(2 * SPREAD, total * HOT_SHARE)).select("hash", F.ceil(F.col("uses") / SPREAD).cast("long").alias("places"))
    both = with_sets(with_sets(pairs, sets, hot, "a"), sets, hot, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    alike = both.where(10 * shared >= TENTHS * (F.size("set_a") + F.size("set_b") - shared))
    return alike.select(F.greatest("root_a", "root_b").alias("hi"), F.least("root_a", "root_b").alias("lo")).where("hi <> lo")


def linked_wholly(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(hi, lo): links of all roots that have a similar pair of texts in some list."""
    postings = celled(posted(texts.where(F.size("sketch") > 0), False), "key", F.lit(1), LONG)
    ordered = postings.select("key", "hash", "root", "n", "bits0", "bits1").repartition("key").sortWithinPartitions("key", "hash")
    units = staged(ordered.mapInArrow(_partners, "unit long, hash long").distinct(), "near-units")
    sets = sets_of(units.select("hash").distinct(), texts, docs)
    rows = celled(units.join(sets.select("hash", "root", F.size("set").alias("n")), "hash"), "unit", F.col("n"), WEIGHT)
    whole = rows.select("unit", "hash").join(sets, "hash").select("unit", "root", "set").repartition("unit").sortWithinPartitions("unit")
    return whole.mapInArrow(_alike, "hi long, lo long")


def renamed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """`rows` with the roots in `joined(hi, lo)` replaced."""
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("uses"))
    moved = staged(sizes.join(joined, F.col("root") == F.col("hi")).select("root", "lo", "uses"), "near-moved")
    return staged(skew_safe_left_join(rows, moved, "root", "uses").withColumn("root", F.coalesce("lo", "root")).select(*rows.columns), "near-rows")


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, hash (of the text), root (of its group): a staged row per row of `docs`."""
    plain = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    prints = staged(plain.select("doc_id", F.xxhash64("text").alias("hash"), fingerprint(F.col("text")).alias("fp"), sketch(F.col("text")).alias("sketch")), "near-prints")
    roots = rooted(prints.select("doc_id", "fp"))
    distinct = prints.groupBy("hash").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    texts = staged(skew_safe_left_join(distinct, roots.select("fp", "n", "root"), "fp", "n").select("hash", "sketch", "copies", "root"), "near-texts")
    for whole in [False] + [True] * TURNS:
        ordered = posted(texts.where(F.size("sketch") > 0), whole).repartition("key").sortWithinPartitions("key", "hash")
        pairs = staged(ordered.mapInArrow(lambda batches, w=whole: _pairs(batches, w), "a long, b long").distinct(), "near-pairs")
        texts = renamed(texts, components(verified(pairs, texts, plain)))
    texts = renamed(texts, components(linked_wholly(texts, plain)))
    return staged(skew_safe_left_join(prints.select("doc_id", "hash"), texts.select("hash", "copies", "root"), "hash", "copies").select("doc_id", "hash", "root"), "near-groups")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: a row per row of `docs`."""
    rows = grouped(docs, id_col, text_col)
    groups = staged(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "near-least")
    return skew_safe_left_join(rows.select("doc_id", "root"), groups, "root", "n").select("doc_id", "component_id")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one document a group: that of the smallest id, nulls last, and then of the smallest hash of its text.
    Rows equal in id and text are one document."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("first")
    kept = grouped(docs, id_col, text_col).groupBy("root").agg(first).select(F.col("first.doc_id").alias("_keep_id"), F.col("first.hash").alias("_keep_hash"))
    here = docs.withColumn("_text_hash", F.xxhash64(text_of(text_col)))
    return here.join(kept, F.col(id_col).eqNullSafe(F.col("_keep_id")) & (F.col("_text_hash") == F.col("_keep_hash")), "left_semi").select(*docs.columns)
