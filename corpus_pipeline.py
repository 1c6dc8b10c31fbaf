"""The corpus pipeline: five stages over ``documents``, each a function of (spark, docs, sf_dir).

Rows keep the columns of ``documents`` until the last stage, which gives token ids. Null or blank texts fail the
quality rules; an empty table stays empty through all stages; extra columns of any name are carried along until the last.
Rows equal in id and text are copies, of which one stays; of texts that tie for a class the least id stays. A very long
text is judged, compared, masked and encoded whole.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm import jaccard_join, mixing, piece_codec, quality, secrets
from packloom.plans.stash import discard, scratch, stash

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Small sources are read up to so many times; every kept document is read once at least.
MIX_TARGET = mixing.Target(repetition=2.0)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a rule rejects."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return jaccard_join.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret found in the texts."""
    model = secrets.train(secrets.default_samples(spark))
    clean = docs.withColumn("text", secrets.redact(F.col("text"), model))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources up to the target weights."""
    return mixing.repeat(docs, MIX_TARGET)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with whether they decode to it."""
    return piece_codec.codec(docs, Path(PIECE_MODEL).read_bytes(), decoded=False).select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("piece encoding", piece_encoding),
]

#: Similarity classes and model tokenisation are outside SQL; a brute-force version tests run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again; what no later stage reads is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as block:
            docs = stash(stage(spark, docs, sf_dir))
            made = block.take()
        discard(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
