"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cluster import scratch_path
from . import (
    contentsort, dartminhash, langid, licenses, linedup, mixing, pseudolm, qgram, spelling, sql, tokencount, tokenfiles, toxicity, whitening,
)
from .batches import held_out, table
from .registry import ORACLES, QUERIES, query  # noqa: F401

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@query("op10_content_sort", sql.CONTENT_SORT)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.content_sort(table(spark, sf_dir, "documents"))


@query("op8_source_schedule", sql.SOURCE_SCHEDULE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query("op5_line_hash_index", sql.LINE_HASH_INDEX)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.identify(docs, model).withColumn("held_out", held_out())


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score(docs, model).withColumn("held_out", held_out())
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenfiles.write_files(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return tokenfiles.read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), WORD_BPE)


@query("op2_dart_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_classes(table(spark, sf_dir, "documents"))


@query("op4_qgram_lemma")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qgram.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


@query("op3_pseudo_likelihood")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudolm.score(docs, *pseudolm.fit(docs, side=3))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), slip=199)


@query("op12_license_notices")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_notices(table(spark, sf_dir, "documents"))
    phrases = [i for i, n in enumerate(licenses.NOTICES) if n.base]
    length = F.array(*[F.lit(len(n.words)) for n in licenses.NOTICES])
    base = F.filter("spans", lambda s: (s["edits"] == 0) & s["notice"].isin(phrases))
    kinds = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    best = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / F.get(length, s["notice"])))
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["first_word"])).alias("last_word"), kinds(F.col("base")).alias("base_labels"), kinds(F.col("spans")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )


@query("op13_whitened_embeddings")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model, fitted = whitening.fit(vectors)
    error = whitening.identity_error(fitted, model)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    return whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, "at").alias("explained"), F.lit(error).alias("identity_error"),
    )
