"""The registered queries and the pipeline over tables of odd and invented rows."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from orrery.llm import langid, mixing, packing, queries
from orrery.llm.queries import tokenizer_path
from pyspark.sql import functions as F
from test_models import SYLLABLES, brute_copies, invented

COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op3_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op7_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_simhash": ["doc_id", "fingerprint", "component_id"],
}


@pytest.fixture(scope="session")
def tables(spark, odd, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    rows = []
    for i in range(120):
        lang = list(SYLLABLES)[i % 3]
        text = invented(lang, 20 + i, i - i % 10 if i % 4 == 1 else i)  # some exact copies
        rows.append((1000 + i, text + (" idiot" if i % 7 == 0 else ""), lang, f"s{i % 4}", len(text), "x", 0.5, 1))
    both = odd.unionByName(spark.createDataFrame(rows, odd.schema))
    both.repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 7 == 0)) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    odd.where("false").write.parquet(f"{top}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/none/labels.parquet")
    return str(top)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_every_query(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = queries.queries()[name](spark, tables)
    assert [c for c in COLUMNS[name] if c not in got.columns] == []
    rows = got.collect()
    ids = Counter(r["doc_id"] for r in rows if name != "op2_packing" or r["start"] == 0)
    assert ids == Counter(r["doc_id"] for r in docs.collect())
    assert queries.queries()[name](spark, f"{tables}/none").count() == 0


def test_fingerprint_likeness(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"].encode()))
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in queries.op5_fingerprints(spark, tables).collect())
    want = Counter()
    for i, r in enumerate(order):
        n, half = len(r["text"]), len(r["text"]) // 2
        edited = r["text"][: n - half] + order[(i + 1) % len(order)]["text"][:half]
        want[r["doc_id"], n, hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert got == want


def test_pipeline_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    after_language = stages["language_id"](spark, docs, tables).collect()
    model_says = langid.identify(docs).where("_lang_pred <> 'und' AND _lang_score >= 0.5")
    assert Counter(r["text"] for r in after_language) == Counter(r["text"] for r in model_says.collect())
    assert all(any(c.isalpha() for c in r["text"]) for r in after_language)
    best = {}
    for r in after_language:
        best[r["text"]] = max((x for x in (best.get(r["text"]), r["doc_id"]) if x is not None), default=None)
    unique = [(i, t) for t, i in best.items()]
    roots = brute_copies([t for _, t in unique])  # SimHash's links and five-word similarity of all pairs
    least = {}
    for (i, _), root in zip(unique, roots, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    kept = Counter(t for (i, t), root in zip(unique, roots, strict=True) if i == least.get(root))
    frame = spark.createDataFrame(after_language, docs.schema)
    near = stages["near_dedup"](spark, stages["exact_dedup"](spark, frame, tables), tables)
    assert Counter(r["text"] for r in near.collect()) == kept
    fixed = spark.createDataFrame(near.collect(), docs.schema)
    mixed = stages["mix_sources"](spark, fixed, tables)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert {k: v for k, v in words.items() if v} == {r["doc_id"]: r["taken"] for r in mixing.take(fixed).collect() if r["taken"]}
    packed = corpus_pipeline.run(spark, tables).collect()
    cache = packing.word_cache(tokenizer_path())
    tokens = Counter((r["doc_id"], len(ids) // 4) for r, ids in zip(mixed.collect(), packing.token_bytes([r["text"] for r in mixed.collect()], cache), strict=True))
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in packed if r["start"] == 0) == tokens
    assert np.sum([r["length"] for r in packed]) == sum(n * c for (_, n), c in tokens.items())
