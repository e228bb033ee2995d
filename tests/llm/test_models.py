import hashlib
import math
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from orrery.llm import langid, lm, nearcopies, packing, pii, simhash, toxicity
from orrery.llm.queries import tokenizer_path
from pyspark.sql import functions as F

SYLLABLES = {"aa": ["ba", "ko", "ri", "tu"], "bb": ["sch", "enk", "ulf", "ost"], "cc": ["é", "oui", "ça", "lle"]}


def invented(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


# ---- language identification


def ppm(train, text, order=langid.MAX_ORDER):
    """Natural log probability of a text's bytes under escape method C, from dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        x = bytes(order) + t
        for i in range(order, len(x)):
            for k in range(order + 1):
                counts[k][x[i - k : i], x[i]] += 1
    context = [{} for _ in counts]
    for k, c in enumerate(counts):
        for (ctx, _), n in c.items():
            total, kinds = context[k].get(ctx, (0, 0))
            context[k][ctx] = total + n, kinds + 1
    x, out = bytes(order) + text, 0.0
    for i in range(order, len(x)):
        for k in range(order, -1, -1):
            ctx = x[i - k : i]
            if ctx in context[k]:
                total, kinds = context[k][ctx]
                if n := counts[k][ctx, x[i]]:
                    out += math.log(n / (total + kinds))
                    break
                out += math.log(kinds / (total + kinds))
        else:
            out -= math.log(256)
    return out


def fold(t):
    return langid.folded(np.frombuffer(t.encode(), np.uint8)).tobytes()


def test_code_lengths_match_brute_force(spark, monkeypatch):
    rows = [(i, lang, invented(lang, 30, i)) for i, lang in enumerate(["aa", "bb", "cc"] * 5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.langs == ["aa", "bb", "cc"]
    tests = [fold(x) for x in ("bakori ÉÇ enkulf zzz", "oui ÇA lle " * 40, "q", "\x00\x01 ba")]
    monkeypatch.setattr(langid, "CHUNK", 64)  # texts longer than a part give the same lengths
    got = model.totals(tests)
    for j, lang in enumerate(model.langs):
        for i, t in enumerate(tests):
            assert math.isclose(got[i, j], ppm([fold(r[2]) for r in rows if r[1] == lang], t), rel_tol=1e-4)


def test_held_out_accuracy_and_odd_rows(spark, odd, none):
    rows = [(i, (lang := ["aa", "bb", "cc"][i % 3]), invented(lang, 3 + i % 9, 1000 + i)) for i in range(300)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string")).where(langid.held_out(F.col("doc_id"))).collect()
    assert got and np.mean([r["lang"] == r["_lang_pred"] for r in got]) > 0.97 and all(0 <= r["_lang_score"] <= 1 for r in got)
    for r in langid.identify(odd).collect():
        letters = bool(r["text"]) and any(c.isalpha() for c in r["text"])
        assert (r["_lang_pred"] == "und") == (not letters)
    assert langid.identify(none).count() == 0
    assert {r["_lang_pred"] for r in langid.identify(spark.createDataFrame([(1, None, "abc")], "doc_id long, lang string, text string")).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    texts = ["½ ² ① Ⅷ", "12 ٣", "½a", "Ⅷ é", "_ -", "中", "\u0301"]
    rows = [(i, "aa", invented("aa", 30, i)) for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.predict(texts)[0] == ["und", "und", "aa", "aa", "und", "aa", "und"]


# ---- SimHash


def brute_simhash(text, size=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash_in_parts_equals_whole(monkeypatch):
    text = invented("cc", 500, 3) + "\x0b A\x1cB"
    whole = simhash.simhash(text.encode())
    assert whole == brute_simhash(text)
    monkeypatch.setattr(simhash, "PART", 37)
    assert simhash.simhash(text.encode()) == whole
    for t in ("", "one", "One two", "a b c"):
        assert simhash.simhash(t.encode()) == brute_simhash(t)


@pytest.mark.parametrize("n", [60, 700])
def test_both_list_forms_find_the_same_components(n):
    rng = np.random.default_rng(n)
    fixed, low = 0x0102030405000000, rng.choice(1 << 13, n, replace=False).astype(np.uint64)
    # positions 3 to 7 fixed: the last choice of five positions
    fp = np.sort(np.uint64(fixed) | low)
    number = simhash._CHOICES.index((3, 4, 5, 6, 7))
    key = (number << 40) | 5
    want = brute_components(fp.tolist())
    for a, b in (simhash.short_list_links(np.full(n, key), fp), simhash.long_list_links(key, fp)):
        assert simhash.linked(a, b).all() and len(a) < 40 * n
        place = {x: i for i, x in enumerate(fp.tolist())}
        merger = simhash.Merger(n)
        merger.add(np.array([place[x] for x in a.tolist()], int), np.array([place[x] for x in b.tolist()], int))
        assert len(set(zip(want, merger.label.tolist(), strict=True))) == len(set(want)) == len(set(merger.label.tolist()))


def test_near_duplicates_match_brute_force(spark, odd, none):
    base = invented("bb", 120, 1).split()
    rows = []
    for i in range(150):
        words = list(base)
        if i % 3:
            words[(7 * i) % 120] = f"w{i}"
        rows.append((i, " ".join(words) if i % 5 else invented("aa", 40, i)))
    for docs in (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), odd):
        got = simhash.near_duplicates(docs).collect()
        texts = docs.collect()
        prints = [brute_simhash(r["text"]) for r in texts]
        roots = brute_components(prints)
        least = {}
        for r, root in zip(texts, roots, strict=True):
            if r["doc_id"] is not None:
                least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
        want = Counter((r["doc_id"], f"{p:016x}", least.get(root)) for r, p, root in zip(texts, prints, roots, strict=True))
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_representatives_know_documents_by_id_and_text(spark, odd, none):
    a, b = invented("bb", 120, 1), invented("aa", 120, 2)
    near = next(t for k in range(400) if 0 < (brute_simhash(t := " ".join([*a.split()[:119], f"w{k}"])) ^ brute_simhash(a)).bit_count() <= 3)
    rows = [(1, a), (2, b), (2, near), (None, near), (None, near + " "), (3, None)]
    got = Counter((r["doc_id"], r["text"]) for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, a), (2, b), (3, None)])
    alone = spark.createDataFrame([(None, near), (None, a)], "doc_id long, text string")
    assert simhash.representatives(alone).count() == 1
    assert simhash.representatives(none).count() == 0 and simhash.representatives(odd).columns == odd.columns


def brute_copies(texts):
    """The smallest place of each text's group, linked by 3 bits of SimHash or five-word similarity of 0.8."""
    prints, sets, label = [brute_simhash(t) for t in texts], [], list(range(len(texts)))
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    for i, j in combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if label[i] != label[j] and ((prints[i] ^ prints[j]).bit_count() <= 3 or (shared and 10 * shared >= 8 * len(sets[i] | sets[j]))):
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def test_near_copies_match_brute_force(spark, odd, none):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(260):
        words = invented("aa", 100, i % 40 if i < 160 else 7).split()
        for at in rng.integers(0, 100, i % 7):
            words[at] = f"w{i}"
        rows.append((i, " ".join(words)))
    words = invented("bb", 60, 9).split()
    rows += [(1000 + i, " ".join(words[i : i + 40])) for i in range(0, 20, 2)] + [(1100, "four words are here"), (1101, "Four  words are here"), (1102, "four words are there")]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), odd):
        texts = docs.collect()
        label = brute_copies([r["text"] for r in texts])
        least = {}
        for r, root in zip(texts, label, strict=True):
            if r["doc_id"] is not None:
                least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
        got = nearcopies.near_copies(docs).collect()
        assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((r["doc_id"], least.get(root)) for r, root in zip(texts, label, strict=True))
        kept = Counter((r["doc_id"], r["text"]) for r in nearcopies.keep(docs).collect())
        first = {}
        for r, root in zip(texts, label, strict=True):
            hashed = xxhash.xxh64_intdigest((r["text"] or "").encode(), 42)
            mine = (r["doc_id"] is None, r["doc_id"] or 0, hashed - 2**64 if hashed >= 2**63 else hashed)
            first[root] = min(first.get(root, (mine, r)), (mine, r), key=lambda x: x[0])
        assert set(kept) == {(r["doc_id"], r["text"]) for _, r in first.values()}
    assert nearcopies.near_copies(none).count() == 0 and nearcopies.keep(none).count() == 0


def test_long_lists_are_dealt_anew(spark, monkeypatch):
    """Texts that share half of their words fill long lists; the similar ones among them are still found."""
    monkeypatch.setattr(nearcopies, "LONG", 6)
    monkeypatch.setattr(nearcopies, "BLOCK", 5)
    assert nearcopies.CLOSEST >= 8
    passage, rows = invented("aa", 90, 1), []
    for i in range(60):
        own = invented("bb", 60, i // 2).split()
        own[30] = f"w{i}"
        rows.append((i, passage + " " + " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = nearcopies.staged(docs.select(F.xxhash64("text").alias("hash"), F.xxhash64("text").alias("root"), nearcopies.sketch(F.col("text")).alias("sketch")), "texts")
    sizes = [r["count"] for r in texts.select(F.explode(F.slice("sketch", 4, nearcopies.BANDS)).alias("key")).groupBy("key").count().collect()]
    assert max(sizes) > 6
    label = brute_copies([t for _, t in rows])
    assert len(set(label)) == 30
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == {i: min(k for k, x in enumerate(label) if x == root) for i, root in enumerate(label)}


def test_a_similar_text_behind_many_closer_ones_is_found(spark):
    """The one text similar to text 1 is text 2, whose sketch is farther from it than those of more than CLOSEST others in each of their lists."""
    words = [f"b20w{i}" for i in range(200)]
    apart = [*words[:90], *(f"x20w{i}" for i in range(20)), *words[110:]]
    rows = [words, apart, words[:107] + apart[107:], *([*words[:93], *(f"d20w{k}v{i}" for i in range(12)), *words[105:]] for k in range(100))]
    texts = [" ".join(r) for r in rows]
    assert brute_copies(texts) == [0] * len(texts) and set(brute_copies(texts[:2] + texts[3:])) == {0, 1}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in nearcopies.near_copies(docs).collect()} == {0}


def test_all_pairs_of_a_unit_are_tested():
    rng = np.random.default_rng(1)
    for n in (2, 7, 30, 40):
        bases, sets = rng.integers(-(2**62), 2**62, (3, 60)), []
        for _ in range(n):
            at = rng.choice(60, rng.integers(0, 16), False)
            mixed = bases[rng.integers(0, 3)].copy()
            mixed[at] = bases[rng.integers(0, 3)][at] if rng.random() < 0.5 else rng.integers(-(2**62), 2**62, len(at))
            sets.append(np.unique(mixed[: rng.integers(50, 61)]))
        root = rng.integers(0, n // 2 + 1, n) - 3
        similar = [(root[i], root[j]) for i, j in combinations(range(n), 2) if 10 * len(shared := np.intersect1d(sets[i], sets[j])) >= 8 * (len(sets[i]) + len(sets[j]) - len(shared))]
        joined = []
        for links in (similar, list(zip(*nearcopies.alike(root, np.array([len(s) for s in sets]), np.concatenate(sets)), strict=True))):
            label = {r: r for r in root.tolist()}
            for a, b in links:
                label = {r: min(label[a], label[b]) if x in (label[a], label[b]) else x for r, x in label.items()}
            joined.append(label)
        assert joined[0] == joined[1]


def test_cells_let_every_pair_of_roots_meet(spark):
    rows = [(1, i, i // 12) for i in range(30)] + [(2, i, 0) for i in range(30)] + [(3, i, i) for i in range(4)]
    df = spark.createDataFrame(rows, "key long, hash long, root long")
    cells = {}
    for r in nearcopies.celled(df, "key", F.lit(1), 8).collect():
        cells.setdefault(r["key"], []).append((r["hash"], r["root"]))
    assert len(cells[2]) == 30 and len(cells[3]) == 4 and max(len(v) for k, v in cells.items() if k != 2) <= 20
    met = {(a, b) for k, v in cells.items() if k not in (2, 3) for (a, _), (b, _) in combinations(sorted(v), 2)}
    assert met >= {(i, j) for i, j in combinations(range(30), 2) if i // 12 != j // 12}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(100)] + [(501, 500)], "hi long, lo long")
    assert {(r["hi"], r["lo"]) for r in simhash.components(links).collect()} == {(i + 1, 0) for i in range(100)} | {(501, 500)}


# ---- packing


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    window = 256
    got = packing.pack_documents(odd, tokenizer_path(), window, keep_ids=True).collect()
    want = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (2,)) for r in odd.collect())
    windows = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] and r["doc_tokens"]
        windows.setdefault(r["sequence_id"], []).append(r)
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    pieces = Counter()
    for (doc, ids), n in want.items():
        for at in range(0, len(ids), window):
            pieces[doc, at, ids[at : at + window]] += n
    assert pieces == Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in got)
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_ids_are_those_of_the_tokenizer():
    """100,000 random texts of marks, letters that change case, emoji, controls, spaces and special tokens, with the tokenizer as judge."""
    from tokenizers import Tokenizer

    tokenizer, cache, rng = Tokenizer.from_file(tokenizer_path()), packing.word_cache(tokenizer_path()), np.random.default_rng(8)
    odd = list("aZé_.!,;'\"’-<|>&@()0٣½②Ⅷ İıŞßẞΣςσǅﬁＡÅÅ\u0301\u0307\u0327\u0338\u20dd😀👩\u200d\ufe0f\x00\x1c\x1f\x7f\x85\xa0\u2003\u2028\u3000\t\n中あ한अ\u093f¡µªº×") + ["'s", "'ll", "n't", "<|endoftext|>", "<|startoftext|>", "the", "The", "I\u0307", "don't.", "x<|", "|>"]
    plain = list("abcdeXYZéÉ0123.,;:'!? ") + ["word", "Word,", "it's", " "]
    for kind, n in ((odd, 70_000), (plain, 30_000)):
        picks = rng.integers(0, len(kind), (n, 12))
        texts = ["".join(kind[i] for i in row[: 1 + k % 12]) for k, row in enumerate(picks)]
        want = tokenizer.encode_batch(texts, add_special_tokens=False)
        for at in range(0, n, 5000):
            for text, got, ids in zip(texts[at : at + 5000], packing.token_bytes(texts[at : at + 5000], cache), want[at : at + 5000], strict=True):
                assert np.frombuffer(got, "<u4").tolist() == [*ids.ids, 2], ascii(text)


def test_giant_words_do_not_stay_in_the_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHARS", 10_000)
    cache = packing.WordCache(packing.word_cache(tokenizer_path()).tokenizer)
    for i in range(5):
        list(packing.token_bytes([f"small {i} " + f"g{i}" * 5000], cache))
    assert sum(map(len, [*cache.now, *cache.old])) < 30_000


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 400)
    where, offset = packing.best_fit_decreasing(lengths, 64)
    rest, brute = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(c, k) for k, c in enumerate(rest) if c >= lengths[i]]
        least = min(fits)[0] if fits else 64
        assert 64 - offset[i] == least  # the same remaining capacity, whichever of its windows
        k = where[i]
        brute.setdefault(k, 0)
        if k == len(rest):
            rest.append(64)
        rest[k] -= lengths[i]
        brute[k] += lengths[i]
    assert max(brute.values()) <= 64
    assert len(rest) <= 11 / 9 * max(math.ceil(lengths.sum() / 64), (lengths > 32).sum()) + 1


# ---- toxicity


def toxic_rows(n=600):
    rng = np.random.default_rng(5)
    bad, rows = ["zorgh", "blixt", "quarm", "fnordy"], []
    for i in range(n):
        words = invented("aa", 20 + i % 60, i).split()
        y = i % 5 == 0
        for w in rng.choice(bad, 1 + i % 3) if y else []:
            words.insert(int(rng.integers(0, len(words))), w + ("." if i % 2 else ""))
        rows.append((i, " ".join(words), int(y)))
    return rows


def test_toxicity_on_held_out_rows(spark, odd, none):
    rows = toxic_rows()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    y = {r[0]: r[2] for r in rows}
    got = toxicity.score(docs, chain).where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r["_toxicity"]["score"] >= 0.7) == bool(y[r["doc_id"]]) for r in got]) > 0.98
    found = [r["text"][s["start"] : s["end"]].strip(".").lower() for r in got for s in r["_toxicity"]["spans"]]
    assert found and np.mean([w in {"zorgh", "blixt", "quarm", "fnordy"} for w in found]) > 0.95
    assert all(0 <= r["_toxicity"]["score"] < 0.7 for r in toxicity.score(odd, chain).collect())
    assert toxicity.score(odd, chain).count() == odd.count() and toxicity.score(none, chain).count() == 0
    flat = toxicity.train(docs, labels.where("false"))
    assert {r["_toxicity"]["score"] for r in toxicity.score(odd, flat).collect()} == {0.0}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    chain = toxicity.Chain()
    chain.moves, chain.start = rng.normal(size=(2, 2)), 0.3
    scores = rng.normal(size=(3, 6))
    lengths = np.array([6, 1, 4])
    p, moves, log_z = chain.marginals(scores, lengths, pairs=True)
    want_moves = np.zeros((2, 2))
    for r in range(3):
        total, one, pairs = 0.0, np.zeros(6), np.zeros((2, 2))
        for state in range(1 << lengths[r]):
            s = [state >> t & 1 for t in range(lengths[r])]
            w = math.exp(chain.start * s[0] + sum(scores[r, t] * s[t] for t in range(len(s))) + sum(chain.moves[a, b] for a, b in zip(s, s[1:])))
            total += w
            one[: len(s)] += w * np.array(s)
            for a, b in zip(s, s[1:]):
                pairs[a, b] += w
        assert np.allclose(p[r, : lengths[r]], one[: lengths[r]] / total) and math.isclose(log_z[r], math.log(total))
        want_moves += pairs / total
    assert np.allclose(moves, want_moves)


def test_marginals_of_whole_documents(monkeypatch):
    """Messages from row to row give what one row as long as the document gives, moves over the rows' ends included."""
    rng = np.random.default_rng(7)
    chain = toxicity.Chain()
    chain.moves, chain.start = rng.normal(size=(2, 2)) * 2, -0.7
    sizes = np.array([5, 0, 64, 65, 1, 200, 128, 7])
    scores = rng.normal(size=sizes.sum()) * 2
    p, moves = chain.whole(scores, sizes, pairs=True)
    assert np.allclose(p, chain.whole(scores, sizes))
    monkeypatch.setattr(toxicity, "RUN", 256)
    q, want = chain.whole(scores, sizes, pairs=True)
    assert np.allclose(p, q) and np.allclose(moves, want)
    at = 0
    for n in sizes.tolist():
        if n:
            one, _, _ = chain.marginals(scores[None, at : at + n], np.array([n]), pairs=True)
            assert np.allclose(one[0], p[at : at + n])
        at += n


def test_scores_are_those_of_the_chain(spark):
    """Brute force: features of each token by definition, forward-backward in one row, the logistic of maximum and sum of powers."""
    rows = toxic_rows(300)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    texts = [r[1] for r in rows[:40]] + [" ".join(r[1] for r in rows[40:60]), None, "", "zorgh"]
    got, _ = toxicity.score_texts(texts, chain, toxicity.TokenScores(chain))
    for text, s in zip(texts, got, strict=True):
        words = [toxicity.bare(t) for t in (text or "").lower().split()]
        each = [chain.bias + sum(chain.weights[f] for f in toxicity.features(w)) for w in words]
        for k, w in enumerate(words):
            after, before = toxicity.side_features(w)
            if k + 1 < len(words):
                each[k + 1] += chain.weights[after]
            if k:
                each[k - 1] += chain.weights[before]
        p = chain.marginals(np.array([each]), np.array([len(words)]))[0] if words else np.zeros(0)
        want = chain.document_score(np.array([(p**toxicity.POWER).sum()]), np.array([p.max(initial=0)]))[0]
        assert math.isclose(s, want, abs_tol=1e-9)
    assert chain.start != 0


# ---- language model


def test_language_model(spark, odd, none):
    rows = [(i, invented(["aa", "bb", "cc"][i % 3], 40, i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared, counts = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    got = lm.score(docs, shared, counts).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([w.lower() for w in t.split()] + [None])
    n, v = sum(train.values()), len(train)
    text = dict(rows)
    for r in got:
        words = [w.lower() for w in text[r["doc_id"]].split()] + [None]
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(w in train for w in words)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score(odd, shared, counts).count() == odd.count() and lm.score(none, shared, counts).count() == 0
    flat, nothing = lm.train(none)
    assert all(r["n_known"] == 0 for r in lm.score(odd, flat, nothing).collect())


def brute_score(words, shared, train):
    """log10 of a text's probability, token by token, by the definition: class, slot of the class, word of the cell."""
    count = lambda w: train.get(w, 0)
    cells, kinds = Counter(), Counter()
    key = lambda w: lm.END if w is None else lm.key_of(w.encode())
    cell = lambda w: shared.head.get(key(w), key(w) & (lm.CELLS - 1))
    for w, n in train.items():
        cells[cell(w)] += n
        kinds[cell(w)] += 1
    place = {k: i for i, k in enumerate(shared.hot_keys.tolist()) if i < lm.FEATURE_WORDS}
    feature = lambda w: lm.CELLS + 1 + place[key(w)] if key(w) in place else 1 + cell(w)
    row = lambda name: ((name * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - 15)
    softmax = lambda x, i: float(x[i] - np.log(np.exp(x.astype(float)).sum()))
    total, before, earlier = 0.0, 0, 0
    for w in words:
        names = [3 * before + 1, (before << 20) + 3 * earlier + 2, 3 * earlier + 3]
        c, s = divmod(cell(w), lm.SLOTS)
        total += softmax(shared.bias + sum(shared.weights[row(x)] for x in names), c) / math.log(10)
        total += softmax(shared.inner_bias[c] + sum(shared.inner[row(x * lm.CLASSES + c)] for x in names), s) / math.log(10)
        if cell(w) >= lm.HEAD:
            total += math.log10((count(w) + 0.5) / (cells[cell(w)] + 0.5 * (kinds[cell(w)] + 1)))
        before, earlier = feature(w), before
    return total


def test_blocks_hold_the_whole_texts(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 300)
    monkeypatch.setattr(lm, "PART", 64)
    monkeypatch.setattr(lm, "CACHE", 100)
    texts = [invented("cc", i, i) for i in range(60)] + [None, "", "y" * 1000, "a\x1cb\x0bC " * 400]
    batch = pa.RecordBatch.from_pylist([{"rid": i, "doc_id": i, "learn": i % 3 == 0, "text": t} for i, t in enumerate(texts)])
    rows = [row for out in lm._tokenize(iter([batch])) for row in out.to_struct_array()]
    assert len(rows) > 3 and [d for row in rows for d in row["doc_ids"].as_py()] == list(range(len(texts)))
    got = [k for row in rows for k in lm.Block(row).keys[lm.Block(row).words].tolist()]
    assert got == [lm.key_of(w) if w is not None else lm.END for t in texts for w in [*(t or "").encode().lower().split(), None]]
    learned = [k for row in rows for k in lm.Block(row, learning=True).keys[lm.Block(row, learning=True).words].tolist()]
    assert learned == [lm.key_of(w) if w is not None else lm.END for t in texts[::3] for w in [*(t or "").encode().lower().split(), None]]


@pytest.mark.parametrize("hot", [lm.HOT_WORDS, 40])
def test_scores_match_the_definition(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    rows = [(i, invented(["aa", "bb", "cc"][i % 3], i % 60, i // 2)) for i in range(200)] + [(1000, "x" * 300 + " The tHe \x1c\x0b. " + "word " * 700), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = lm.tokenized(docs, ~lm.held_out(F.col("doc_id")))
    shared, counts = lm.train_blocks(blocks)
    if hot < 1000:
        assert len(shared.hot_keys) <= hot < counts.count()
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(split(t))
    assert shared.total == sum(train.values()) and shared.kinds == len(train)
    got = {r["doc_id"]: r for r in lm.score_blocks(blocks, shared, counts).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["n_tokens"] == len(split(t)) and got[i]["n_known"] == sum(w in train for w in split(t))
        assert math.isclose(got[i]["score"], brute_score(split(t), shared, train), rel_tol=1e-4, abs_tol=1e-3)


def test_every_training_document_is_learned_from(spark):
    docs = spark.createDataFrame([(i, f"w{i} common") for i in range(500)], "doc_id long, text string").repartition(4)
    rows = lm.tokenized(docs, F.col("doc_id") % 3 == 0).select("turn", F.explode(F.arrays_zip("doc_ids", "learn")).alias("x")).select("turn", "x.*").collect()
    assert Counter(r["doc_ids"] for r in rows) == Counter(range(500)) and all(r["learn"] == (r["doc_ids"] % 3 == 0) and 0 <= r["turn"] < lm.ROUNDS for r in rows)


def test_cell_probabilities_sum_to_one(spark):
    """Class, slot and word probabilities multiply to a distribution over known words and one unknown word a cell."""
    rows = [(i, invented("aa", 30, i)) for i in range(60)]
    shared, counts = lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    feat = np.array([lm.CELLS + 3, 7, 0], np.uint64)
    names = lm.histories(feat, np.array([3]))[2:]
    outer = np.exp(lm.class_logs(shared.weights, shared.bias, lm.hashed(names)))[0]
    inner = np.exp(np.concatenate([lm.class_logs(shared.inner, shared.inner_bias[c], lm.within(names, np.array([c]))) for c in range(lm.CLASSES)]))
    cell = (outer[:, None] * inner).ravel()
    assert math.isclose(cell.sum(), 1, abs_tol=1e-4)
    inside = 10 ** -shared.spread * 0.5
    known = {r["key"]: r["n"] for r in counts.collect()}
    for k, n in known.items():
        if k not in shared.head:
            inside[k & (lm.CELLS - 1)] += (n + 0.5) * 10 ** -shared.spread[k & (lm.CELLS - 1)]
    assert np.allclose(inside[lm.HEAD :], 1)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(lm.DIMS, lm.CLASSES)).astype(np.float32), rng.normal(size=lm.CLASSES).astype(np.float32)
    rows = lm.history(np.arange(10, dtype=np.uint64), np.array([1, 4, 5]))
    assert np.allclose(np.exp(lm.class_logs(w, b, rows)).sum(1), 1, atol=1e-5)
    assert (rows[0] == rows[1]).all() and (rows[1] == rows[5]).all()  # starts have no history


# ---- personal data


def brute_base(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d[::-1][0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn % 10 == 0, "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out)


TEXTS = [
    "mail a.b+c@x-y.co.uk, a@b..c@d.e and @x.y a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.1.1.99999999999999999999", "4111-1111 1111 1111 x 4111  1111 1111 1111 4111111111111112",
    "+1 (415) 555-0100 +12 +49.30.1234567-", "𝔘 é a@b.cd 10.0.0.1\n+33 1 23 45 67 89 00 11", "4111111111111111 4111111111111111", "5500-0000-0000-0004- 12", "1 2 3 4 " * 5000, "7" * 20000, "x@" + "a." * 1500 + "b",
]


def test_base_spans_match_brute_force(spark, odd, none):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for frame in (docs, odd):
        got = Counter((r["doc_id"], tuple(sorted((s["kind"], s["start"], s["end"]) for s in r["base"]))) for r in pii.find(frame).collect())
        assert got == Counter((r["doc_id"], tuple(brute_base(r["text"] or ""))) for r in frame.collect())
    assert pii.find(none).count() == 0


def test_cards_grouped_by_ones_and_twos(spark):
    digits = "4111111111111111"
    texts = [f"pay {sep.join(digits[i : i + n] for i in range(0, 16, n))} now" for n in (1, 2) for sep in (" ", "-")]
    texts += [f"a {t} b  {t}" for t in texts] + ["41 11 11 11 11 1", "pay 41 11 11  11 11 11 11 11", "41 11 11 11 11 11 11 12"]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: sorted(spans) for i, spans in got.items()} == {i: sorted(brute_base(t)) for i, t in enumerate(texts)}
    assert [len(got[i]) for i in range(8)] == [1, 1, 1, 1, 2, 2, 2, 2]


def test_added_spans(spark):
    rows = [(i, f"filler {i} please call 415-555-{1000 + i} or phone +1 (212) 555-{1000 + i} today") for i in range(40)]
    rows += [(100 + i, f"plain text number {i} without anything") for i in range(40)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i]["base"]) == 1 for i in range(40)) and not any(got[100 + i]["base"] or got[100 + i]["added"] for i in range(40))
    text = dict(rows)
    for i in range(40):
        for s in got[i]["added"]:
            assert text[i][s["start"] : s["end"]] == f"415-555-{1000 + i}"


def test_many_matches_in_one_text(spark):
    """Thousands of matches: offsets run on over the parts that are folded at once, and the time stays in proportion."""
    text = " ".join(f"{'x' * (i % 7)} a{i}@b.co 10.0.{i % 256}.{i % 200} é" for i in range(8000))
    began = time.time()
    got = pii.find(spark.createDataFrame([(1, text), (2, "y " * 300 + "c@d.ef")], "doc_id long, text string")).collect()
    assert time.time() - began < 60
    assert {r["doc_id"]: sorted((s["kind"], s["start"], s["end"]) for s in r["base"]) for r in got} == {1: brute_base(text), 2: [("email", 600, 606)]}


@pytest.mark.parametrize("n", [3, 700])
def test_text_before_a_match(spark, n):
    text = "start " + " ".join(f"w{i} {i}@x.yz" for i in range(n))
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(pii.matches(F.col("text"), pii.EMAIL)).alias("x")).select("x.*").collect()
    assert len(rows) == n and all(r["before"] == text[max(0, r["start"] - pii.NEAR) : r["start"]] and r["s"] == text[r["start"] : r["end"]] for r in rows)


def test_secrets_are_added(spark):
    rows = [(i, f"some words {i} token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and more") for i in range(60)]
    rows += [(100 + i, f"see the page {'section' * 3}{i}/part-{i}-of-the-long-document for number {i}") for i in range(60)]
    text = dict(rows)
    got = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == [hashlib.sha1(str(i).encode()).hexdigest()] for i in range(60)) and not any(got[100 + i] for i in range(60))


def test_reliable_labelers_get_more_say():
    patterns = [(("a", 1, 1, 1), 50), (("a", 0, 0, 0), 50), (("a", 1, 1, 0), 5), (("a", 0, 1, 0), 5), (("a", 0, 0, 1), 20)]
    p = pii.reliabilities(patterns)
    assert p["a", 1, 1, 1] > 0.99 and p["a", 0, 0, 0] < 0.01 and p["a", 1, 1, 0] > p["a", 0, 0, 1]


def test_secrets_are_covered_whole(spark):
    """A key of any length is one span to its end, and a long candidate is judged by all of its text."""
    long = "".join("aB3dE5fG7h"[i % 10] for i in range(600))
    hexes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    rows = [(i, f'token = "{h}" and some words') for i, h in enumerate(hexes)] + [(100, f'token = "{long}" end'), (101, "key: " + "0123456789abcdef" * 30)]
    got = {r["doc_id"]: r["added"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[100]] == [("secret", 9, 609)]
    assert [tuple(s) for s in got[101]] == [("secret", 5, 485)]
    many = spark.createDataFrame([(7, rows[0][1])] * 3000 + [(8, "")] * 2000, "doc_id long, text string")
    assert Counter((r["doc_id"], len(r["added"])) for r in pii.find(many).collect()) == Counter({(7, 1): 3000, (8, 0): 2000})
