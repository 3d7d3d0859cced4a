import json

import pytest
from pyspark.sql import functions as F

from phenospark.operators import airway as A
from phenospark.operators import catalog as G
from phenospark.operators import joins as J
from phenospark.operators import keys as K
from phenospark.operators import profile as Q
from phenospark.operators import rules as C
from phenospark.sources import sinks, tables
from phenospark.streaming import incremental as I


def test_feature_json(spark, tmp_path):
    good = '{"Patient_ID": "p1", "a::b": 1.5, "n": null, "t": "x", "d": 1, "d": 2}'
    for name, text in (("p1.json", good), ("p2.json", "[1, 2]"), ("p3.json", "{broken")):
        (tmp_path / name).write_text(text)
    facts, rejects = tables.read_feature_json(spark, str(tmp_path / "*.json"))
    got = {r.feature: r.value for r in facts.where("patient_id = 'p1'").collect()}
    assert got["a::b"] == 1.5 and got["n"] is None and got["t"] is None and got["d"] == 2.0
    assert {r.patient_id for r in rejects.collect()} == {"p2", "p3"}


def test_csv_bom_and_branch_files(spark, tmp_path):
    d = tmp_path / "p7_branches"
    d.mkdir()
    (d / "p7_full_metrics.csv").write_text("﻿generation,WA_pct\n1,50.5\n2,\n", encoding="utf-8")
    df = tables.read_branch_metrics(spark, str(tmp_path), "generation INT, WA_pct DOUBLE", glob="*_full_metrics.csv")
    assert sorted((r.patient, r.generation, r.WA_pct) for r in df.collect()) == [("p7", 1, 50.5), ("p7", 2, None)]


def test_patient_number(spark):
    info = {"Series": [{"SeriesFolder": "1", "Patient": {"PatientID": " 0042 "}}], "series_info": {"candidates": [{"series_info": {"Patient": {"PatientID": ""}}}]}}
    df = spark.createDataFrame([(json.dumps(info),)], "j string").select(F.from_json("j", tables.INFO_SCHEMA).alias("i"))
    assert df.select(tables.patient_number(F.col("i"))).first()[0] == "0042"


def test_versions_do_not_touch_the_read_table(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_table(spark.range(3), root, "a")
    cur = sinks.read_current(spark, root)
    sinks.write_table(cur.withColumn("x", F.lit(1)), root, "b")
    assert sinks.read_current(spark, root).columns == ["id", "x"]
    with pytest.raises(Exception):
        sinks.write_table(spark.range(1), root, "b")


def test_dedup_and_fuzzy(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 5)], "k int, v string, o int")
    assert sorted(tuple(r) for r in K.dedup_first(df, ["k"], ["o"]).collect()) == [(1, "a", 1), (2, "c", 5)]
    names = spark.createDataFrame([("P1",), ("P1.7",), ("P12_x",), ("Z",)], "name string")
    ids = spark.createDataFrame([("P1",), ("P12",)], "id string")
    assert {r["name"]: r["resolved"] for r in J.fuzzy_key_join(names, ids).collect()} == {"P1": "P1", "P1.7": "P1", "P12_x": "P12", "Z": "Z"}


def test_series_choice(spark):
    rows = [("a", "x", 100), ("a", "y", 300), ("a", "z", 200), ("b", "plain", 300), ("b", "ce", 120), ("c", "c1", 80), ("c", "c2", 90), ("e", "m", 5), ("e", "k", 5)]
    df = spark.createDataFrame(rows, "p string, name string, n int").withColumn("d", F.when(F.col("p").isin("b", "c") & F.col("name").startswith("c"), "chest +C").otherwise("x"))
    assert {r.p: r.series for r in C.select_series(df, "p", "d", "n", "name").collect()} == {"a": "y", "b": "ce", "c": "c2", "e": "k"}


def test_rules(spark):
    t = spark.createDataFrame([("急性心肌梗死",), ("心衰加重",), ("心衰病史多年，后因外伤住院治疗现感冒急性起病",), ("心力衰竭",)], "t string")
    hit = [r[0] for r in t.select(C.acute_rule(F.col("t"))).collect()]
    assert hit[0] == "急性关键词: 急性心肌梗死" and hit[1] == "慢性词+修饰: 心衰+加重" and hit[2] is None and hit[3] == "慢性词+修饰: 心力衰竭+衰竭"
    assert [r[0] for r in t.select(C.acute_rule(F.col("t"), exclude_term_from_window=True)).collect()][3] is None
    lab = spark.createDataFrame([("48", "ng/L"), ("0.04", "ng/mL")], "v string, u string").select(C.troponin_rule(F.col("v"), F.col("u"))).collect()
    assert [r[0] for r in lab] == [True, False]
    bnp = spark.createDataFrame([("600", "45"), ("600", "60"), ("600", None), ("600", "80")], "v string, a string").select(C.bnp_rule(F.col("v"), F.col("a"))).collect()
    assert [r[0] for r in bnp] == [True, False, True, False]
    icd = spark.createDataFrame([("J44.100",), ("J44.000",), ("J44.900",), ("J44.800",), ("J47.x00",)], "i string").select(C.icd_label(F.col("i"))).collect()
    assert [r[0] for r in icd] == [1, 1, 0, 0, None]


def test_composites_and_missing(spark):
    f = spark.createDataFrame([("p1", "CAC_Agatston", 1.0), ("p2", "CAC_Agatston", 3.0), ("p3", "CAC_Agatston", None), ("p1", "Pi10", 5.0)], "patient_id string, feature string, value double")
    got = {(r.patient_id, r.feature): r.value for r in G.composite_scores(f).collect()}
    assert got["p3", "CAC_score"] is None and abs(got["p2", "CAC_score"] - 0.70710678) < 1e-6 and ("p1", "CAC_Agatston") not in got
    assert spark.createDataFrame([(0.5,), (0.1,), (0.51,), (1.0,)], "r double").select(Q.missing_band(F.col("r"))).toPandas().iloc[:, 0].tolist() == ["10_to_50", "10_to_50", "over_50", "all"]


def test_branches(spark):
    rows = [("p", i, None if i == 0 else (i - 1) // 2, 0 if i == 0 else (1 if i < 3 else 2), None if i > 2 else 1, None if i > 2 else 2, 50.0) for i in range(7)]
    b = spark.createDataFrame(rows, "patient_id string, id int, parent int, generation int, children_1 int, children_2 int, WA_pct double")
    r = A.terminal_pruning(b).first()
    assert (r.n_terminal_total, r.n_terminal_gen5plus, r.pruning_ratio_gen5) == (4, 0, 0.0)
    g = A.tree_walk(b)
    assert {x.id: x.generation for x in g.collect()} == {i: rows[i][3] for i in range(7)}
    assert {x.id: x.subtree for x in A.subtree_sizes(b).collect()} == {0: 7, 1: 3, 2: 3, 3: 1, 4: 1, 5: 1, 6: 1}
    per = [("a", float(x), 1 + 0.2 * x) for x in (4, 6, 8, 10, 12, 14)] + [("b", float(x), 1.0) for x in range(1, 6)]
    p = {x.patient_id: x.Pi10 for x in A.pi10(spark.createDataFrame(per, "patient_id string, Pi_Perimeter_mm double, Sqrt_WallArea double")).collect()}
    assert abs(p["a"] - 3.0) < 1e-9 and p["b"] is None


def test_incremental(spark, tmp_path):
    src, facts, man, ck = (str(tmp_path / n) for n in ("src", "facts", "man", "ck"))
    run = lambda mode="add": I.ingest_new_patients(spark, src, facts, ck, man, mode).awaitTermination()
    put = lambda rows: spark.createDataFrame(rows, "patient_id string, record string").write.mode("append").parquet(src)
    put([("p1", '{"a": 1, "b": null}')])
    run()
    put([("p1", '{"a": 9, "c": 3}'), ("p2", "{broken")])
    run()
    run()  # nothing new
    read = lambda: {(r.patient_id, r.feature): r.value for r in I.current_facts(spark.read.schema(I.FACT_SCHEMA).parquet(facts)).collect()}
    assert read() == {("p1", "a"): 1.0, ("p1", "b"): None, ("p1", "c"): 3.0}
    put([("p1", '{"b": 2, "a": 7}')])
    run("fill")
    assert read()["p1", "b"] == 2.0 and read()["p1", "a"] == 1.0
    assert sorted(r.status for r in spark.read.parquet(man).collect()) == ["fail", "ok", "ok", "ok"]
