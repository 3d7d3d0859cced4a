"""From raw documents to encoded training text: each stage calls one operator of ``phenospark.llm``.

A stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's ``docs``. All but
the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from phenospark.llm import bpe, decontaminate, linededup, quality, simhash
from phenospark.llm.common import table
from phenospark.sources.sinks import scratch_dir

RANKS = "byte_bpe_50k.tiktoken"
MIN_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least ``MIN_QUALITY``. The labels are joined to the texts of ``docs`` alone."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(spark, model, docs["text"]) >= MIN_QUALITY)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring template lines and without long lines that an earlier text holds; documents of which nothing
    but blanks is left go, if they had text before."""
    return linededup.dedup(docs, drop_empty=True, long_docs=2)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the smallest id stays."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, and the digests of ids and decoded text."""
    tokens = bpe.read_ranks(public_tokenizers.path(RANKS))
    return docs.select("doc_id", bpe.encoded(spark, tokens, public_tokenizers.PATTERN, docs["text"]).alias("r")).select("doc_id", "r.*")


STAGES = [
    ("quality", keep_quality),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_copies),
    ("decontamination", decontaminated),
    ("encoding", encode),
]
#: Nearest-neighbour votes, template trees and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet into the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
