"""The numbered queries, their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import dedup, fingerprints, langid, lm, mixing, negatives, packing, pii, quality, ranking, sharding, simhash, toxicity
from orrery.llm.common import documents, staged, text_of


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", text_of().alias("text"))
    both = fingerprints.with_next(docs).withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    rows = both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprints.canonical(F.col("text")).alias("canonical"),
        fingerprints.canonical(F.col("edited")).alias("edited_canonical"), fingerprints.canonical(F.col("next_text")).alias("next_canonical"),
    )
    prints = rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.digest(F.col("canonical")).alias("digest"), fingerprints.digest(F.col("edited_canonical")).alias("edited_digest"),
        fingerprints.digest(F.col("next_canonical")).alias("next_digest"), F.sha2("canonical", 256).alias("wide"), F.sha2("edited_canonical", 256).alias("edited_wide"), F.sha2("next_canonical", 256).alias("next_wide"),
    )
    canon = docs.select(fingerprints.canonical(F.col("text")).alias("canonical")).withColumn("digest", fingerprints.digest(F.col("canonical")))
    mixed = staged(fingerprints.mixed_digests(canon, "digest", "canonical"), "mixed-digests")
    if mixed.isEmpty():  # no two texts share a digest: nothing to tell apart
        named = prints.select("doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), F.col("next_digest").alias("next_fingerprint"))
    else:
        named = prints
        for kind in ("", "edited_", "next_"):
            other = mixed.withColumnRenamed("_mixed", f"_{kind}mixed")
            named = named.join(other, F.col(f"{kind}digest") == F.col(f"_{kind}mixed"), "left")
            told = F.when(F.col(f"_{kind}mixed").isNull(), F.col(f"{kind}digest")).otherwise(F.concat_ws("-", f"{kind}digest", f"{kind}wide"))
            named = named.withColumn(f"{kind}fingerprint", told)
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir)).withColumn("law", F.lit("key"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two batches, so that the second is deduplicated against the index that the first has left."""
    return dedup.mark(documents(spark, sf_dir), batches=2)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.concat("base", "added")).alias("spans"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    blocks = lm.tokenized(docs, ~lm.held_out(F.col("doc_id")))
    shared, counts = lm.train_blocks(blocks)
    scored = lm.score_blocks(blocks, shared, counts)
    return scored.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(shared.total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, chain).select("doc_id", F.col("_toxicity.score").alias("score"), F.size("_toxicity.spans").alias("n_spans"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_spans")


OP11_SQL = """
WITH part AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS b, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM part a JOIN part b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON p.a = n.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b) QUALIFY row_number() OVER w <= 5
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH item AS (SELECT DISTINCT item_id, text FROM benchmark),
asked AS (SELECT item_id, text AS item_text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM item),
want AS (SELECT item_id, item_text, term, count(*) AS times FROM asked GROUP BY ALL),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
sized AS (SELECT r, doc_id, len(terms) AS n FROM doc WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
posting AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM doc) WHERE term IN (SELECT term FROM want) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), whole),
scored AS (
    SELECT item_id, item_text, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // whole.terms))))::BIGINT AS score
    FROM want JOIN weight USING (term) JOIN posting USING (term) JOIN sized USING (r), whole GROUP BY ALL
)
SELECT item_id, row_number() OVER w AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id, item_text ORDER BY score DESC, doc_id, r) QUALIFY row_number() OVER w <= 10
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, net).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("_quality").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def queries() -> dict:
    return {
        "op1_pii": op1_pii, "op2_packing": op2_packing, "op3_language_model": op3_language_model, "op4_toxicity": op4_toxicity, "op5_fingerprints": op5_fingerprints,
        "op6_sharding": op6_sharding, "op7_exact_dedup": op7_exact_dedup, "op8_mixing": op8_mixing, "op9_language_id": op9_language_id, "op10_simhash": op10_simhash,
        "op11_hard_negatives": op11_hard_negatives, "op12_lexical_search": op12_lexical_search, "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_lexical_search": OP12_SQL}
