"""Hard negatives, lexical search and quality against brute force, with odd rows."""

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from orrery.llm import negatives, quality, queries, ranking, samples
from pyspark.sql import functions as F
from test_models import invented

# ---- hard negatives


def brute_negatives(rows):
    """From (vec_id, label, vector) in the order of the table."""
    part = []
    for at, (i, label, x) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        part.append((at, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    product = lambda x, y: sum(p * q for p, q in zip(x, y, strict=False))
    first = lambda s: sorted(s, key=lambda t: (-t[0], t[1] is None, t[1] or 0))[:5]
    out = Counter()
    for at, i, label, x in part:
        if i is None or i % 100:
            continue
        near = first([(product(x, y), j) for other, j, same, y in part if same == label and other != at])
        away = [(product(x, y), j) for _, j, same, y in part if same != label]
        for score, j in near:
            for rank, (s, k) in enumerate(first([t for t in away if 80 * score <= 100 * t[0] <= 100 * score]), 1):
                out[i, j, rank, k, score, s] += 1
    return out


def mined(spark, rows, path):
    schema = "vec_id long, embedding array<float>, label int, row long, block int, near string"
    spark.createDataFrame([(i, x, y, 1, 2, "z") for i, y, x in rows], schema).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return Counter(tuple(r) for r in queries.op11_hard_negatives(spark, str(path)).collect())


def test_negatives_match_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "TILE", 1)
    monkeypatch.setattr(negatives, "STEPS", 3)
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 1, (4, 10))
    rows = [(k * 25, int(y), [float(v) for v in centers[y // 3] + rng.normal(0, 0.5, 10)]) for k, y in enumerate(rng.integers(0, 10, 160))]
    rows += [(9000 + k, 3, rows[4][2]) for k in range(40)] + [(9100 + k, 4, rows[4][2]) for k in range(40)]  # a vector many rows have
    rows += [rows[4], rows[4], rows[8]]  # repeated rows, anchors among them
    rows += [(None, 3, rows[4][2]), (None, 5, rows[4][2]), (100_000, None, rows[0][2]), (100_100, 1, None), (100_200, 1, [1.0, None]), (100_300, 1, [float("nan")]), (100_400, 2, [float("inf"), 1.0])]
    rows += [(100_500, 2, []), (100_600, 2, [0.5, -0.25]), (-100, 7, [-0.001] * 10), (100_700, 8, [0.0] * 10)]
    got = mined(spark, rows, tmp_path / "a")
    assert len(got) > 100
    assert got == brute_negatives(rows)


def test_negatives_of_little(spark, tmp_path):
    assert mined(spark, [], tmp_path / "none") == Counter()
    assert mined(spark, [(100, 1, []), (1, 1, []), (2, 2, [])], tmp_path / "empty") == brute_negatives([(100, 1, []), (1, 1, []), (2, 2, [])])
    assert mined(spark, [(100, 1, [1.0])], tmp_path / "one") == Counter()
    with pytest.raises(ValueError, match="64-bit"):
        mined(spark, [(100, 1, [1e30])], tmp_path / "large")


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(0)
    axis = rng.normal(0, 100, (3, 24))
    whole = (rng.normal(0, 1, (400, 3)) @ axis + rng.normal(0, 2, (400, 24))).astype(np.int64)
    turn = np.linalg.eigh(whole.T @ whole / 1.0)[1][:, ::-1]
    block = negatives.Block.__new__(negatives.Block)
    block.whole, block.turned, block.row, block.label = whole, whole @ turn, np.arange(400), np.zeros(400)
    block.left = np.stack([np.sqrt((block.turned[:, k:] ** 2).sum(1)) for k in range(25)], 1)
    products, exact = negatives.Products(block.part(slice(0, 7)), block), whole[:7] @ whole.T
    i, j = negatives.survivors(products, np.ones((7, 400), bool), [(np.full(7, -np.inf), np.full(7, np.inf))], 5)
    assert products.at == 16  # the rest was never multiplied out
    assert len(i) < 0.05 * 7 * 400
    for k in range(7):
        assert set(np.argsort(-exact[k], kind="stable")[:5]) <= set(j[i == k])
    low, high = products.bounds()
    assert (low <= exact).all() and (exact <= high).all()


# ---- lexical search


def brute_search(items, docs, most=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in set(items):
        scores = []
        for i, c in held:
            n, score = sum(c.values()), 0
            m = 100 - 75 + 75 * n * n_docs // total
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((score, i))
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out.update((item, rank, i, s) for rank, (s, i) in enumerate(scores[:most], 1))
    return out


@pytest.mark.parametrize("block_bytes, batch, matches", [(1 << 20, 1 << 20, 1 << 20), (300, 2000, 50)])
def test_search_matches_brute_force(spark, odd, monkeypatch, block_bytes, batch, matches):
    monkeypatch.setattr(ranking, "BATCH_BYTES", batch)
    monkeypatch.setattr(ranking, "MATCHES", matches)
    items = [(i, invented("aa", 12, i) + " Fox FOX É𝔘 long") for i in range(12)] + [(3, None), (4, ""), (None, "the fox"), (5, "dog dog"), (5, "dog dog"), (6, "nowhere-to_be.found"), (7, "x" * 5000 + " fox")]
    extra = [(100 + i, invented("aa", 5 + i % 90, i // 3) + (" fox" if i % 4 else "")) for i in range(300)] + [(1, "fox")] * 30 + [(None, "fox dog")] * 3
    docs = odd.select("doc_id", "text", "score", "size").unionByName(spark.createDataFrame([(i, t, 1.0, 1) for i, t in extra], "doc_id long, text string, score double, size int"))
    got = ranking.search(spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, rank string, n int"), docs, block_bytes=block_bytes)
    want = brute_search([x for x in items if x[1] is not None], [(r[0], r[1]) for r in docs.collect()])
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == want


def test_search_of_nothing(spark, none):
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "fox")], "doc_id long, text string")
    assert ranking.search(items, none).count() == 0
    assert ranking.search(items.where("false"), docs).count() == 0
    assert [tuple(r) for r in ranking.search(items, docs).select("rank", "doc_id").collect()] == [(1, 1)]


def test_radix_order_is_stable():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000) // 1000 * 1000
    assert (ranking.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ranking.radix_order(keys[:0])) == 0


def test_long_documents_keep_integers(monkeypatch):
    n = np.array([7, 2**45])
    got = ranking.impacts(np.array([0, 0]), np.array([3, 3]), n, np.array([500]), 10**6, 10**9)
    want = [500 * (1000000000 * 3 // (3000 + 8 * (25 + 75 * int(x) * 10**6 // 10**9))) for x in n]
    assert got.tolist() == want


# ---- quality


def good(k):
    return invented(["aa", "bb", "cc"][k % 3], 20 + k % 60, k) + "."


def poor(k):
    words = invented(["aa", "bb", "cc"][k % 3], 20 + k % 60, k + 5000).split()
    return [" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w + "###" for w in words)][k % 3]


def naive_means(text, net):
    """Means over chunks straight from the definition."""
    tables, x = net.tables().astype(float), text + bytes(quality.WIDTH)
    at = np.array([np.maximum(0, sum(tables[w][x[t + w]] for w in range(quality.WIDTH)) + net.bias) for t in range(len(text))])
    halves = [at[k : k + quality.HALF].max(0) for k in range(0, len(text), quality.HALF)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:], strict=False)] or halves
    return np.mean(chunks, 0)


def test_means_match_definition(monkeypatch):
    net = quality.Network(2)
    texts = [b"a", b"", b"x" * 31, b"y" * 32, b"z" * 33, ("É| !! " * 40).encode(), bytes(range(1, 256)) * 2]
    got = quality.means_of(texts, net.tables(), net.bias)
    for t, m in zip(texts, got, strict=True):
        np.testing.assert_allclose(m, naive_means(t, net) if t else 0, atol=1e-5)
    monkeypatch.setattr(quality, "SLAB", 64)
    np.testing.assert_allclose(quality.means_of(texts, net.tables(), net.bias), got, atol=1e-5)


def test_slopes_match_differences():
    net, rng = quality.Network(3), np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (5, 40, 200, 33)]
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])
    _, slopes = quality.gradients(net, texts, y, weight)
    for part, slope in zip(net.parts(), slopes, strict=True):
        flat, near = part.reshape(-1), []
        for k in rng.choice(np.flatnonzero(slope.ravel()), 12):
            old, step = flat[k], 1e-3
            flat[k] = old + step
            up = quality.gradients(net, texts, y, weight)[0]
            flat[k] = old - step
            down = quality.gradients(net, texts, y, weight)[0]
            flat[k] = old
            near.append(abs((up - down) / 2 / step - slope.ravel()[k]) < 1e-3)
        assert sum(near) >= 10  # the loss has kinks where another position becomes the largest; a difference across one is no slope


def test_quality_tells_held_out_rows(spark, odd, tmp_path):
    rows = [(k, poor(k) if k % 4 == 0 else good(k)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(600)] + [(None, 1, 0), (700, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op13_quality(spark, str(tmp_path)).collect()
    assert len(got) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean([r["predicted"] == (r["doc_id"] % 4 > 0) for r in held]) > 0.95
    net = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), 50)
    odd_rows = quality.score(odd.withColumn("_quality", F.lit("x")), net)
    assert odd_rows.count() == odd.count() and odd_rows.where("_quality IS NULL OR _quality < 0 OR _quality > 1").count() == 0
    assert odd_rows.where("text IS NULL OR text = ''").select("_quality").distinct().count() == 1


def test_quality_without_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r[0] for r in quality.score(odd, quality.train(odd, labels)).select("_quality").collect()} == {1.0}
    assert {r[0] for r in quality.score(odd, quality.train(odd, labels.where("false"))).select("_quality").collect()} == {0.0}
    assert quality.score(none, quality.train(none, labels)).count() == 0


def test_sample_is_bounded(spark):
    """Many rows of one id, equal and different, take no more places than the bound."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(1, "same")] * 500 + [(2, "other")] + [(k, f"few {k}") for k in range(3, 40)], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2 == 1) for k in range(1, 40)], "_id long, _y boolean")
    texts, share = samples.bounded(docs, known, 30)
    rows = sorted((r["_y"], r["text"]) for r in texts.collect())
    assert share == 20 / 39
    for y, group in groupby(rows, key=lambda r: r[0]):
        held = [t for _, t in group]
        assert 1 <= len(held) <= 30 and len(set(held)) == len(held), y
    small, _ = samples.bounded(docs, known, 30, 1)
    assert Counter(r["_y"] for r in small.collect()) == Counter([True, False])
