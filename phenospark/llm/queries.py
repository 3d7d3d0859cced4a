"""The registered queries of the corpus operators, with their SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.llm import bisector, bpe, decontaminate, language, licenses, linededup, multiindex, pii, quality, secrets, simhash, toxicity, whitening
from phenospark.llm.common import held_out, table
from phenospark.llm.oracle import ORACLE  # noqa: F401

RANKS = "byte_bpe_50k.tiktoken"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    r = docs.select("doc_id", held_out().alias("held_out"), quality.scorer(spark, model).alias("score"))
    return r.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    r = docs.select("doc_id", held_out().alias("held_out"), toxicity.scorer(spark, model).alias("r"))
    return r.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.3).cast("int").alias("predicted"), "r.n_offending", "r.offending")


def op3_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = multiindex.usable(table(spark, sf_dir, "embeddings"))
    return multiindex.search(vectors, vectors.where("id % 100 = 0"), top=10)


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash.components(table(spark, sf_dir, "documents"), distance=4, width=4)
    return r.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.profiles(docs)
    return docs.select("doc_id", held_out().alias("held_out"), language.scorer(spark, model).alias("r")).select("doc_id", "held_out", "r.*")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.read_ranks(public_tokenizers.path(RANKS))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.digests(spark, tokens, public_tokenizers.PATTERN).alias("r")).select("doc_id", "r.*")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op11_bisector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector.report(table(spark, sf_dir, "embeddings"), k=8, rounds=10, salt=3)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"), components=4)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = licenses.report(table(spark, sf_dir, "documents"))
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"]))
    return r.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.array_join(listed, ",").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_toxicity, op3_multiindex, op4_linededup, op5_simhash, op6_language, op7_bpe, op8_pii, op9_decontaminate, op10_secrets,
                               op11_bisector, op12_whitening, op13_licenses)}
