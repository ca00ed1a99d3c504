"""Corpus pipeline: language ID, exact dedup, near-dedup, source mixing, byte-level BPE.

Each stage takes what the one before it kept. Language ID learns from the
stage's own labelled rows and drops texts without letters and those it can't
place; exact dedup keeps one row of equal texts; near-dedup one document of
each group of similar ones (candidates by SimHash and by min-hash bands, Jaccard
similarity of five-word shingles verified at 0.8 and more); the mix repeats or cuts sources to their targets; the last stage encodes
and decodes. Without rows every stage returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm import bpe, exact_dedup, langid, mixing, overlap
from worktrail.llm.common import stored, table

LEAST_OVER_CHANCE = 1.2  # the least score of a language, as a multiple of chance: 0.3 of four languages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return langid.drop_unknown(docs, model, min(1.0, LEAST_OVER_CHANCE / len(model.languages)) if model else 0.0)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return overlap.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    return bpe.round_trip(docs, *paths).select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near-dedup", near), ("source mix", mix), ("byte-level BPE", encode)]

# Classifier and tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
