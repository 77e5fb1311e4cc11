"""Documents to training text: quality, language, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and gives a DataFrame
that is written as Parquet and read again as the next one's ``docs``. All but the last keep the columns
of ``docs``. Null texts and texts without a letter go with the language stage; rows without an id stay
up to the end; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from widecast.llm import bytebpe, decontaminate, langid, quality, simhash
from widecast.llm.common import fresh, id_crc, stored, table

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents from the quality cut up. The model learns from the labels outside the held-out fifth."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    name = fresh(docs, "quality_score")
    scored = quality.score(docs, model, name=name)
    return scored.filter(F.col(name) >= quality.CUT_SCORE).select(docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; without any letter there is none."""
    model = langid.fit(docs, id_crc() % 4 != 2)
    names = fresh(docs, "language"), fresh(docs, "language_score")
    named = langid.predict(docs, model, names=names)
    return named.filter(F.col(names[0]) != langid.UNDETERMINED).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that the near-copy operator finds, with its own settings."""
    return simhash.one_of_each(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's token ids, decoded again as a proof: digests of both."""
    path = public_tokenizers.path(BYTE_VOCABULARY)
    decoded = bytebpe.decode(bytebpe.encode(docs, path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_languages),
    ("near copies", keep_one_of_each),
    ("decontamination", keep_unseen),
    ("token ids", to_ids),
]

#: Scans, learned models and connected sets are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
