"""Registered queries of this subpackage: each operator over its whole table, with its real settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from widecast.llm import bytebpe, conversations, decontaminate, html_text, langid, perplexity, quality, repair, resample, shards, simhash, topk, toxicity
from widecast.llm.common import id_crc, table

END_ID = 2
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHARDS = 16
SHARD_SEED = 2024
BEST = 20
QUERY_STEP = 20


def op1_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids through Re-Pair files and back: position, number and checksum."""
    folder = repair.file_folder(spark)
    repair.write(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), folder, END_ID)
    return repair.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to ids and back to bytes: number of ids and both digests."""
    path = public_tokenizers.path(BYTE_VOCABULARY)
    decoded = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best overlap with each benchmark item."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the ids is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 4 == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in 16 shards of the corpus's mixture of sources."""
    placed = shards.interleave(table(spark, sf_dir, "documents"), SHARDS, SHARD_SEED)
    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"]
    return placed.select(*columns)


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each vector whose id is divisible by 20."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, BEST)


def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth of the ids is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 5 == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.CUT_SCORE).cast("int").alias("predicted"))


def op10_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third of the ids is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 3 == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.CUT_SCORE).cast("int").alias("predicted"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents in a hundred, drawn by their likeness to the benchmark's texts."""
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage by a checksum of its rows' keys."""
    rows = table(spark, sf_dir, "conversations")
    report = conversations.Repair(conversations.damage(rows)).report
    numbers, words = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], ["audit", "repaired_sha256"]
    every = conversations.same(rows.select("conv_id").distinct(), report, [*numbers, *words])
    # Conversations that lost all rows.
    return every.fillna(0, numbers).fillna({"audit": "", "repaired_sha256": conversations.NO_ROWS_SHA256})


def op13_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document, perplexity bands of its language among them."""
    judged = perplexity.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *perplexity.BASE, "base_failed", "kept", "entropy")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


RUNS = (
    op1_repair_token_files, op2_byte_bpe, op3_decontaminate, op4_language_id, op5_main_text, op6_stratified_shards, op7_simhash_groups,
    op8_exact_topk, op9_pairwise_quality, op10_weak_toxicity, op11_importance_resample, op12_conversation_repair, op13_perplexity_rules, pipeline,
)
QUERIES = {f.__name__: f for f in RUNS}

TOPK_SQL = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({topk.SCALE} * x::DOUBLE) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {BEST}
"""
ORACLE_SQL: dict[str, str] = {"op8_exact_topk": TOPK_SQL}
