"""The pipeline on the smallest tables, stage by stage against the operators' definitions."""

import hashlib

import corpus_pipeline as C
from pyspark.sql import functions as F
from tests.llm.helpers import hard

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registered():
    q = entry.queries()
    assert "pipeline" in q and {k.split("_")[0] for k in q if k.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, {r.doc_id for r in docs.collect()}
    assert 4 <= len(C.STAGES) <= 5
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= seen and 0.5 * len(seen) < len(ids)
        seen = ids
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert not bad & seen
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in C.STAGES[-1][1](spark, docs, SF).collect()}
    assert got.keys() == texts.keys()
    assert all(got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and len(got[d].ids) == got[d].n_tokens for d, t in texts.items())


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(C.run(spark, SF)) == key(docs)


def test_hard_rows_pass_through(spark):
    docs = hard(spark)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    assert C.STAGES[-1][1](spark, docs.where(F.lit(True)), SF).count() > 0
