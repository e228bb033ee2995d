import hashlib
import math
import unicodedata
import zlib
from collections import Counter

import pytest
from orrery.llm import dedup, fingerprints, mixing, sharding
from pyspark.sql import functions as F


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def canonical(text):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(t.split())


def test_canonical_form_follows_unicode(spark, odd):
    got = {(r["doc_id"], r["text"]): r["c"] for r in rows_of(odd.select("doc_id", "text", fingerprints.canonical(F.coalesce("text", F.lit(""))).alias("c")))}
    for (_, text), c in got.items():
        assert c == canonical(text or ""), text


def test_fingerprints_group_equal_canonical_texts(odd, none):
    got = rows_of(fingerprints.exact_fingerprints(odd))
    groups = Counter(canonical(r["text"] or "") for r in got)
    by = {}
    for r in got:
        c = canonical(r["text"] or "")
        assert r["group_size"] == groups[c]
        assert by.setdefault(c, r["fingerprint"]) == r["fingerprint"]
    assert len(set(by.values())) == len(by) and len(got) == odd.count()
    assert fingerprints.exact_fingerprints(none).count() == 0


def test_mixed_digests_are_told_apart_by_bytes(spark):
    rows = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "c"), ("d2", "c")], "digest string, canonical string")
    assert [r["_mixed"] for r in fingerprints.mixed_digests(rows, "digest", "canonical").collect()] == ["d1"]


def test_next_and_edited_texts(spark):
    docs = spark.createDataFrame([(i * 3, f"text {i} " + "é𝔘" * (i % 7)) for i in range(200)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.with_next(docs).withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text"))).collect()}
    assert len(got) == 200
    for i in range(200):
        t, n = got[i * 3]["text"], got[(i + 1) % 200 * 3]["text"]
        half = len(t) // 2
        assert got[i * 3]["next_text"] == n and got[i * 3]["edited"] == t[: len(t) - half] + n[:half]


def test_next_text_with_odd_rows(odd, none, spark):
    docs = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = fingerprints.with_next(docs).collect()
    assert len(got) == docs.count()
    order = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"].encode()), r["text"]) for r in docs.collect())
    want = Counter((None if k[0] else k[1], t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in got) == want
    assert fingerprints.with_next(none.select("doc_id", "text")).count() == 0
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert fingerprints.with_next(one).collect()[0]["next_text"] == "ab"


def rendezvous(key, weights):
    best = None
    for i, w in enumerate(weights):
        u = (int(hashlib.md5(f"{'null' if key is None else key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        s = w / -math.log(u)
        if best is None or s > best[0]:
            best = (s, i)
    return best[1]


def test_sharding_matches_brute_force(spark, odd, none):
    for docs in (odd, spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string")):
        got = rows_of(sharding.assign(docs, (1.0, 2.0, 1.0)))
        assert len(got) == docs.count()
        for r in got:
            assert r["shard"] == rendezvous(r["doc_id"], (1, 2, 1))
            assert r["grown_shard"] in (r["shard"], 3) and r["grown_shard"] == rendezvous(r["doc_id"], (1, 2, 1, 4 / 3))
        for shard in {r["shard"] for r in got}:
            slots = [r for r in got if r["shard"] == shard]
            assert sorted(r["slot"] for r in slots) == list(range(len(slots)))
            ids = [r["doc_id"] for r in sorted(slots, key=lambda r: r["slot"])]
            assert ids == sorted(ids, key=lambda x: (x is None, x or 0))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows_of(sharding.assign(odd))) == Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows_of(odd)
    )
    assert sharding.assign(none).count() == 0


def test_dedup_marks_and_keeps(odd, none):
    got = rows_of(dedup.mark(odd))
    texts = Counter(r["text"] or "" for r in rows_of(odd))
    best = {}
    for r in rows_of(odd):
        t = r["text"] or ""
        best[t] = max((x for x in (best.get(t), r["doc_id"]) if x is not None), default=None)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    assert len(got) == odd.count()
    for r in got:
        t = sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best[t], texts[t], r["doc_id"] == best[t])
    kept = rows_of(dedup.keep(odd))
    assert Counter(r["text"] or "" for r in kept) == Counter(dict.fromkeys(texts, 1)) and set(kept[0]) == set(odd.columns)
    assert all(r["doc_id"] == best[r["text"] or ""] for r in kept)
    assert dedup.mark(none).count() == 0 and dedup.keep(none).count() == 0


def test_index_persists_over_batches(spark, odd):
    index = dedup.DigestIndex(spark, buckets=3)
    first = dedup.keep(odd, index)
    n = first.count()
    assert n == index.read().count()
    again = dedup.DigestIndex(spark, index.path, 3)  # opened by path
    assert dedup.keep(odd, again).count() == 0
    more = spark.createDataFrame([(100, "brand new"), (101, "x")], "doc_id long, text string")
    assert [r["doc_id"] for r in dedup.keep(more, again).collect()] == [100]
    assert not any(r["kept"] for r in dedup.mark(more, again).collect())
    assert again.read().count() == n + 1


def water(sizes, weights, cap=3):
    target, free, total = {}, dict(weights), float(sum(sizes.values()))
    while free:
        level = total / sum(free.values())
        full = [s for s in free if free[s] * level > cap * sizes[s] + 1e-9]
        if not full:
            return target | {s: w * level for s, w in free.items()}
        for s in full:
            target[s] = cap * sizes[s]
            total -= target[s]
            del free[s]
    return target


def test_mixing_targets_and_takes(spark, odd, none):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 90)), "big" if i % 3 == 0 else f"s{i % 5}" if i % 31 else None, 0) for i in range(600)]
    rows += [(1000 + i, "tiny words here", "aaa" if i else "zzz", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(7)
    got = rows_of(mixing.take(docs))
    assert len(got) == len(rows)
    sizes = Counter()
    of = {}
    for i, t, s, _ in rows:
        sizes[s] += len(t.split())
        of[i] = s
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: 1 + i % 3 for i, s in enumerate(names)})
    taken = Counter()
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 3 * mixing.BLOCK + 0.02 * want[s], s
    again = {r["doc_id"]: r["taken"] for r in rows_of(mixing.take(docs.repartition(3)))}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    words = Counter()
    for r in rows_of(mixing.mix_documents(docs)):
        words[r["doc_id"]] += len(r["text"].split())
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in again.items() if v}
    assert {r["doc_id"] for r in rows_of(mixing.take(odd))} == {r["doc_id"] for r in rows_of(odd)}
    assert mixing.take(odd).count() == odd.count() and mixing.mix_documents(odd).columns == odd.columns
    assert mixing.take(none).count() == 0 and mixing.mix_documents(none).count() == 0
    blocks = rows_of(mixing.blocks(docs))
    assert sum(b["words"] for b in blocks) == sum(again.values())


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(n)), s) for i, (s, n) in enumerate([("a", 20), ("b", 30), ("b", 1), ("c", 70), ("d", 3), (None, 9), ("e", 400), ("f", 5000), ("g", 1)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, sizes, of = rows_of(mixing.take(docs)), Counter(), {i: s for i, _, s in rows}
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = water(sizes, {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))})
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= 1.5 * max(1, min(64, n // 256)) and math.isclose(next(r["target"] for r in got if of[r["doc_id"]] == s), want[s])


def test_each_pass_is_a_permutation_of_its_own(spark):
    for size in (1, 2, 7, 64, 1000):
        frame = spark.range(size).crossJoin(spark.range(3).withColumnRenamed("id", "pass"))
        rows = frame.select("id", "pass", mixing.permuted(F.col("id"), F.lit(size).cast("long"), F.lit(17), F.lit("s"), F.col("pass")).alias("at")).collect()
        orders = [[r["at"] for r in sorted(rows, key=lambda r: r["id"]) if r["pass"] == p] for p in range(3)]
        assert all(sorted(o) == list(range(size)) for o in orders)
        if size == 1000:
            assert len({tuple(o) for o in orders}) == 3
            steps = Counter((b - a) % size for a, b in zip(orders[0], orders[0][1:]))
            assert max(steps.values()) < 12 and abs(sum(a < b for a, b in zip(orders[0], orders[0][1:])) - 500) < 60


def test_shard_counts_are_multinomial(spark):
    """A source's counts over the shards vary as independent throws do, and add up to its target."""
    sources = spark.createDataFrame([("=a", "a", 64 * 8000, 64 * 16000.0), ("=b", "b", 64 * 9000, 64 * 4000.0)], "skey string, source string, source_size long, target double")
    counts = {(r["skey"], r["shard"]): r["count"] for r in mixing.slots(sources).groupBy("skey", "shard").count().collect()}
    for key, n in (("=a", 16000), ("=b", 4000)):
        own = [c for (k, _), c in counts.items() if k == key]
        assert sum(own) == n and len(own) == 5
        spread = sum((c - n / 5) ** 2 / (n / 5) for c in own)  # chi-square of 4 degrees
        assert 0.05 < spread < 25


def test_hot_and_missing_ids_are_spread(spark):
    from orrery.llm.common import RangeBuckets

    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i} here", "ab"[i % 2]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    buckets = RangeBuckets(docs.select("doc_id"), "doc_id", 16)
    tie = F.shiftright(F.xxhash64("text"), 58) + 32
    cells = docs.select("doc_id", tie.alias("tie"), buckets.cells(F.col("doc_id"), tie).alias("cell")).collect()
    order = sorted(cells, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["tie"]))
    assert [r["cell"] for r in order] == sorted(r["cell"] for r in cells)
    assert max(Counter(r["cell"] for r in cells).values()) < 400 and 7 in buckets.hot
    got = rows_of(mixing.take(docs))
    assert len(got) == 3000 and all(r["taken"] <= 3 * r["size"] for r in got)
    shards = rows_of(sharding.assign(docs))
    for shard in {r["shard"] for r in shards}:
        own = [r for r in shards if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        ids = [r["doc_id"] for r in sorted(own, key=lambda r: r["slot"])]
        assert ids == sorted(ids, key=lambda x: (x is None, x or 0))


def test_index_opened_with_other_settings(spark, odd):
    index = dedup.DigestIndex(spark, buckets=3)
    n = dedup.keep(odd, index).count()
    index.forget()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = dedup.DigestIndex(spark, index.path)  # another session's default count
        assert again.buckets == 3 and again.table == index.table and dedup.keep(odd, again).count() == 0 and again.read().count() == n
        plan = again.read().join(again.read().select(F.col("digest").alias("d")).hint("merge"), F.col("digest") == F.col("d"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "hashpartitioning(digest" not in plan  # both sides are read by bucket
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="3 buckets"):
        dedup.DigestIndex(spark, index.path, 4)


def test_half_a_batch_is_never_seen(spark):
    index = dedup.DigestIndex(spark, buckets=2)
    entries = spark.createDataFrame([("d1", 1, 1)], "digest string, keep_id long, group_size long")
    entries.withColumn("batch", F.lit("failed")).repartition(2, "digest").write.bucketBy(2, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(index.table)
    assert index.read().count() == 0
    index.append(entries, "whole")
    assert [(r["digest"], r["batch"]) for r in index.read().collect()] == [("d1", "whole")]


def test_one_id_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, "b")], "doc_id long, text string")
    assert Counter((r["doc_id"], r["text"]) for r in dedup.keep(docs).collect()) == Counter([(2, "a"), (1, "b")])
    assert Counter((r["doc_id"], r["keep_id"], r["kept"]) for r in dedup.mark(docs).collect()) == Counter([(1, 2, False), (2, 2, True), (1, 1, True), (1, 1, True)])
    mixed = spark.createDataFrame([(1, "a b c", "s", 5), (1, "d e", "s", 3), (1, "a b c", "t", 5)], "doc_id long, text string, source string, n_chars long")
    words = Counter()
    for r in mixing.mix_documents(mixed).collect():
        words[r["source"]] += len(r["text"].split())
    taken = Counter()
    for r in mixing.take(mixed).collect():
        taken[r["source_size"]] += r["taken"]
    assert words["s"] == taken[5] and words["t"] == taken[3]


def test_taken_follows_the_shard_counts(spark, monkeypatch):
    """Brute force of op8's taken: counts per shard are read back, slots numbered shard after shard, blocks looked up by permutation."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mixing, "CELL", 4)
    rows = [(i, " ".join(["w"] * (40 + i % 90)), ["a", "b", None][min(i % 5, 2)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = mixing.placed(docs)
    sources = mixing.staged(mixing.targets(placed), "t")
    counts = mixing.shard_counts(sources).collect()
    assert len({r["shard"] for r in counts}) > 20
    slots = {r["skey"]: min(round(r["target"] * n / r["source_size"]), 3 * n) for r in sources.collect() for n in [-(-r["source_size"] // max(1, min(64, r["source_size"] // 256)))]}
    for skey, n in slots.items():
        own = sorted((r["shard"], r["n"], r["first"]) for r in counts if r["skey"] == skey)
        assert sum(x for _, x, _ in own) == n and [f for *_, f in own] == [sum(x for _, x, _ in own[:i]) for i in range(len(own))]
        mean, shards = n / len({r["shard"] for r in counts}), len({r["shard"] for r in counts})
        spread = sum((x - mean) ** 2 for _, x, _ in own) / shards
        assert 0.3 * mean < spread < 3 * mean  # a multinomial's, not an even deal
    times = {}
    drawn = mixing.slots(sources).collect()
    for r in drawn:
        times[r["skey"], r["block"]] = times.get((r["skey"], r["block"]), 0) + 1
    want = {}
    for r in placed.collect():
        want[r["doc_id"]] = sum(times.get((r["skey"], w // r["length"]), 0) for w in range(r["start"], r["start"] + r["size"]))
    assert {r["doc_id"]: r["taken"] for r in mixing.take(docs).collect()} == want


def test_batches_meet_the_index(spark, odd):
    """Batch by batch the result is that of one batch, and a run's own index leaves nothing behind."""
    tables = {t.name for t in spark.catalog.listTables()}
    extra = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)] + [(None, "text 3"), (None, "alone"), (3, "text 3")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    one = Counter(tuple(r) for r in dedup.mark(docs).collect())
    assert one == Counter(tuple(r) for r in dedup.mark(docs, batches=2).collect()) == Counter(tuple(r) for r in dedup.mark(docs, batches=5).collect())
    assert {t.name for t in spark.catalog.listTables()} == tables
    index = dedup.DigestIndex(spark)
    dedup.mark(docs, index, batches=2)
    per_batch = sorted(r["count"] for r in index.read().groupBy("batch").count().collect())
    assert len(per_batch) == 2 and sum(per_batch) == len({r["text"] or "" for r in docs.collect()})
    index.remove()
