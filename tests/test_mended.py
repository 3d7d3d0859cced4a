"""Cases that an oracle on the stand-in tables cannot reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.operators import airway as A
from phenospark.operators import evaluate as E
from phenospark.operators import filters as L
from phenospark.operators import models as M
from phenospark.operators import rules as C
from phenospark.operators import screen as Z
from phenospark.operators.keys import to_wide
from phenospark.sources import tables as R
from phenospark.streaming import incremental as I


def chain(spark, n):
    return spark.createDataFrame([("p", i, i - 1 if i else None) for i in range(n)], "patient_id string, id int, parent int")


def test_deep_tree(spark):
    r = {x.id: (x.generation, x.subtree) for x in A.tree_measures(chain(spark, 100)).collect()}
    assert r == {i: (i, 100 - i) for i in range(100)}


def test_cycle_raises(spark):
    with pytest.raises(ValueError, match="cycle"):
        A.tree_walk(spark.createDataFrame([("p", 1, 2), ("p", 2, 1)], "patient_id string, id int, parent int"))


def facts(spark, cols):
    """cols: feature -> list of values, None where missing."""
    rows = [(i, f, v, i % 2) for f, vs in cols.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "patient_id int, feature string, value double, y int")


def pool(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, rank int")


def test_decorrelation_with_a_gap_in_every_row(spark):
    rng = np.random.default_rng(1)
    cols = {f"f{k}": rng.normal(size=80).tolist() for k in range(8)}
    cols["f1"] = list(cols["f0"])
    for i in range(80):
        cols[f"f{2 + i % 6}"][i] = None
    f = facts(spark, cols)
    assert Z.select_features(f, pool(spark, list(cols)), 30, 0.9) == [n for n in cols if n != "f1"]


def test_selection_falls_back_to_the_top_of_the_pool(spark):
    v = np.random.default_rng(2).normal(size=40).tolist()
    same = {f"f{k}": list(v) for k in range(8)}
    f = facts(spark, same)
    assert Z.select_features(f, pool(spark, list(same)), 30, 0.9) == list(same)
    free = {f"f{k}": np.random.default_rng(k).normal(size=40).tolist() for k in range(8)}
    assert Z.select_features(facts(spark, free), pool(spark, list(free)), 3, 0.9) == ["f0", "f1", "f2"]


def test_a_missing_correlation_is_an_error():
    with pytest.raises(KeyError):
        Z.greedy_decorrelate(["a", "b"], [])


def test_long_shift_and_thin_wrap(spark):
    def rows(n):
        return spark.createDataFrame([("p", z, 0, n, 1, 1, 1.0, 1.0, 1.0, [float(z)]) for z in range(n)],
                                     "patient_id string, z int, y int, nz int, ny int, nx int, dz double, dy double, dx double, a array<double>")

    out = {r.z: r.a[0] for r in L.convolve_axis(rows(200), "z", [(100, 1.0)], "zero").collect()}
    assert out == {z: float(z + 100) if z < 100 else 0.0 for z in range(200)}
    out = {r.z: r.a[0] for r in L.convolve_axis(rows(2), "z", [(-3, 1.0)], "wrap").collect()}
    assert out == {0: 1.0, 1: 0.0}


def test_last_value_of_a_repeated_key(spark):
    p = R.parse_records(spark.createDataFrame([("p", '{"a": 1, "b": 5, "a": 2}')], "patient_id string, t string"), "t")
    assert sorted((r.feature, r.value) for r in R.record_facts(p, "patient_id").collect()) == [("a", 2.0), ("b", 5.0)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    log, man = str(tmp_path / "log"), str(tmp_path / "man")
    b = spark.createDataFrame([("p1", "a", 1.0), ("p2", "a", 2.0)], "patient_id string, feature string, value double")
    for _ in range(2):
        I.upsert_features(b, log, manifest=man, batch_id=3)
    assert spark.read.schema(I.FACT_SCHEMA).parquet(log).count() == 2
    assert spark.read.schema(I.MANIFEST_SCHEMA).parquet(man).where("batch = 3").count() == 2
    v = I.compact_facts(spark, log, str(tmp_path / "t"), "1")
    assert spark.read.parquet(v).count() == 2


def test_wide_keeps_ids_without_the_features(spark):
    f = spark.createDataFrame([("p1", "a", 1.0), ("p2", "b", 2.0)], "patient_id string, feature string, value double")
    assert sorted((r.patient_id, r.a) for r in to_wide(f, ["patient_id"], ["a"]).collect()) == [("p1", 1.0), ("p2", None)]


def cohort_facts(spark, n=90):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.normal(size=n) > 0.8).astype(int)
    rows = [(i, "ABC"[i % 3], int(y[i]), f"g{k}", float(x[i, k])) for i in range(n) for k in range(4)]
    return spark.createDataFrame(rows, "patient_id int, cohort string, y int, feature string, value double")


def test_nested_folds_with_svm_and_extra_rows(spark):
    f = cohort_facts(spark)
    extra = f.where("patient_id < 9").withColumn("patient_id", F.col("patient_id") + 1000).drop("y")
    other = extra.where("cohort = 'A'").withColumns({"patient_id": F.col("patient_id") + 1000, "cohort": F.lit("Z")})
    oof, chosen = M.nested_loco(f, ["patient_id", "cohort", "y"], keep=3, cs=(1.0,), folds=2, score_all=extra.unionByName(other),
                                svm={"cs": (1.0,), "gammas": ("scale",), "folds": 2, "size": 32})
    p = oof.toPandas()
    assert len(p[p.in_train]) == 90 and len(p[~p.in_train]) == 9  # once each, and none of a cohort without a fold
    assert p.svm_proba.between(0, 1).all() and p.svm_score.notna().all() and set(p.svm_pred) <= {0, 1}
    assert chosen.count() >= 3


def test_saved_models_score_new_rows(spark, tmp_path):
    f = M.model_frame(cohort_facts(spark), ["patient_id", "cohort", "y"], ["g0", "g1", "g2", "g3"])
    for name, fit in {"logit": M.logit_l2, "mlp": lambda d: M.mlp(d, (3,), max_iter=5)}.items():
        got = {r.patient_id: r.proba for r in M.final_model(f, str(tmp_path / name), fit).collect()}
        prep = M.Preparation.fit(f, M.feature_columns(f))
        x = prep.apply(f)
        want = {r.patient_id: r.proba for r in M._scores(fit(M.balanced_weights(x)), x, ["patient_id"]).collect()}
        assert len(got) == 90 and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_modifier_near_a_later_occurrence(spark):
    term, mod = C.CHRONIC_TERMS[0], C.MODIFIERS[0]
    t = spark.createDataFrame([(f"{term}，{'x' * 20}{term}{mod}",)], "t string")
    r = t.select(C.acute_rule(F.col("t"), exclude_term_from_window=True).alias("a"), C.acute_rule(F.col("t"), exclude_term_from_window=True, all_occurrences=True).alias("b")).first()
    assert r.a is None and r.b == f"慢性词+修饰: {term}+{mod}"


def test_smooth_calibration_in_blocks(spark):
    rng = np.random.default_rng(3)
    p = rng.random(3000)
    d = spark.createDataFrame([(float(a), int(rng.random() < a)) for a in p], "proba double, y int")
    a, b = E.smooth_calibration(d).first(), E.smooth_calibration(d, points=200).first()
    assert a.points == 3000 and b.points <= 200 and abs(a.eavg - b.eavg) < 0.02
