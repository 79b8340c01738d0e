"""A training corpus in five stages: clean, distinct, free of benchmarks, mixed, encoded.

Every stage takes (session, documents, data folder) and returns a DataFrame; all
but the last keep the columns of ``documents``. ``run`` stores each stage's
result in the shared folder, so that the next one reads it as often as it needs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.cluster import scratch_path
from waymark.llm import dartminhash, mixing, qgram, tokenfiles, toxicity
from waymark.llm.batches import held_out, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return dartminhash.near_distinct(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return qgram.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, whole, once per epoch in which it takes them."""
    return mixing.mixed_texts(docs, whole=True)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: where each document starts, its length and a checksum of its ids."""
    path = scratch_path(spark, "corpus-tokens")
    tokenfiles.write_files(docs, path, VOCABULARY)
    return tokenfiles.read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token files", encode_tokens),
]

#: Classifier, alignment and tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = scratch_path(spark, f"corpus-{number}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
