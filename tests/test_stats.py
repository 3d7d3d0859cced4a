import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phenospark.operators import evaluate as E
from phenospark.operators import models as M
from phenospark.operators import screen as Z
from phenospark.operators import stats as P
from phenospark.operators import survive as R


def facts(spark, zero, one, name="f"):
    rows = [(f"z{i}", 0, name, float(v)) for i, v in enumerate(zero)] + [(f"o{i}", 1, name, float(v)) for i, v in enumerate(one)]
    return spark.createDataFrame(rows, "patient_id string, y int, feature string, value double")


def test_auc_and_symmetry(spark):
    f = facts(spark, (1, 2, 3), (2, 4, 5))
    assert abs(P.rank_auc(f).first()["auc"] - 7.5 / 9) < 1e-12
    assert abs(P.rank_auc(f.withColumn("value", -F.col("value"))).first()["auc"] - 1.5 / 9) < 1e-12
    assert P.rank_auc(facts(spark, (1, 1), (1, 1))).first()["auc"] == 0.5


def test_fdr_and_kruskal(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.04), ("e", None)], "feature string, p double")
    assert [r.fdr for r in P.bh_fdr(p).orderBy("feature").collect()] == [0.04, 0.04, 0.04, 0.04, None]
    k = spark.createDataFrame([(g, "f", float(v)) for g, vs in enumerate(((1, 2, 3), (4, 5, 6), (7, 8, 9))) for v in vs], "g int, feature string, value double")
    r = P.kruskal_wallis(k, "g", 3).first()
    assert abs(r.H - 7.2) < 1e-9 and abs(r.p - math.exp(-3.6)) < 1e-9


def test_bootstrap_covers_the_point_and_repeats(spark):
    df = spark.range(3000).selectExpr("id AS patient_id", "'t' AS task", "cast(id % 2 AS int) AS y", "pmod(xxhash64(id), 1000) / 1000.0D + (id % 2) * 0.2D AS score")
    a, b = (P.bootstrap_auc(df.repartition(n), ["task"], 60).first() for n in (2, 9))
    assert a.lo < a.auc < a.hi and a.used == 60 and (a.lo, a.hi) == (b.lo, b.hi)
    assert 0.01 < a.hi - a.lo < 0.08


def test_confusion_metrics_and_net_benefit(spark):
    rows = [(0, 0)] * 50 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(1, 1)] * 35
    df = spark.createDataFrame([(1, y, p, float(p) * 0.5 + 0.1) for y, p in rows], "k int, y int, pred int, proba double")
    m = E.binary_metrics(df, ["k"]).first()
    assert [round(m[c], 4) for c in ("sensitivity", "specificity", "ppv", "npv", "f1", "balanced_accuracy", "accuracy")] == [0.875, 0.8333, 0.7778, 0.9091, 0.8235, 0.8542, 0.85]
    d = E.decision_curve(df, [0.2]).first()
    assert abs(d["model"] - 0.325) < 1e-12 and abs(d["all"] - 0.25) < 1e-12
    g = spark.createDataFrame([(0, v) for v in (0.39, 0.40, 0.50, 0.60, 0.61)], "label3 int, proba double")
    r = E.risk_summary(g).first()
    assert [round(r[c], 3) for c in ("gray", "below", "above", "high")] == [0.6, 0.2, 0.2, 0.6]


def test_correlation_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    f = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(200) for j in range(3)], "patient_id int, feature string, value double")
    got = {(r.a, r.b): r.rho for r in P.correlation(f, ["f0", "f1", "f2"], "pearson").collect()}
    want = np.abs(np.corrcoef(x.T))
    assert all(abs(got[f"f{i}", f"f{j}"] - want[i, j]) < 1e-9 for i in range(3) for j in range(i + 1, 3))
    assert Z.greedy_decorrelate(["a", "b", "c"], [("a", "b", 0.95), ("a", "c", 0.1), ("b", "c", 0.2)]) == ["a", "c"]


def test_kaplan_meier(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 0), ("g", 3, 1), ("g", 4, 1)], "grp string, time int, status int")
    assert [round(r.survival, 6) for r in R.kaplan_meier(df, ["grp"]).orderBy("time").collect()] == [0.75, 0.75, 0.375, 0.0]


def brute_cox(x, t, d, rounds=30):
    """Efron partial likelihood by direct sums over risk sets."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        g, h = np.zeros_like(b), np.zeros((len(b), len(b)))
        w = np.exp(x @ b)
        for u in np.unique(t[d == 1]):
            risk, ev = t >= u, (t == u) & (d == 1)
            for l in range(ev.sum()):
                c = np.where(ev, 1 - l / ev.sum(), 1.0) * w * risk
                m = (c[:, None] * x).sum(0) / c.sum()
                h += (c[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / c.sum() - np.outer(m, m)
                g -= m
            g += x[ev].sum(0)
        b = b + np.linalg.solve(h, g)
    return b


def test_cox_and_concordance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2)).round(1)
    t, d = rng.integers(1, 25, 120), rng.integers(0, 2, 120)
    df = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), int(t[i]), int(d[i])) for i in range(120)], "patient_id int, a double, b double, time int, status int")
    fit = R.cox_multivariate(df, ["a", "b"])
    assert np.allclose(fit["coef"], brute_cox(x, t, d), atol=1e-7)
    long = df.unpivot(["patient_id", "time", "status"], ["a", "b"], "feature", "value")
    uni = {r.feature: r.coef for r in R.cox_univariate(long).collect()}
    assert abs(uni["a"] - brute_cox(x[:, :1], t, d)[0]) < 1e-7
    got = R.concordance_index(long.where("feature = 'a'"), ["feature"], "value").first()
    con = dis = tie = 0
    for i in range(120):
        for j in range(120):
            if d[i] and (t[j] > t[i] or (t[j] == t[i] and not d[j])):
                con, dis, tie = con + (x[i, 0] > x[j, 0]), dis + (x[i, 0] < x[j, 0]), tie + (x[i, 0] == x[j, 0] and i != j)
    assert (got.concordant, got.discordant, got.tied) == (con, dis, tie)


def test_concordance_in_blocks(spark, monkeypatch):
    """Any cut into blocks counts the same pairs, and few rows for each given one, whatever the number of scores."""
    rng = np.random.default_rng(8)
    n = 400
    x = np.where(rng.random(n) < 0.3, 0.5, rng.normal(size=n).round(2))
    t, d = rng.integers(1, 30, n), rng.integers(0, 2, n)
    df = spark.createDataFrame([(k, float(x[i]) * (1 if k == "a" else -2), int(t[i]), int(d[i])) for i in range(n) for k in "ab"], "feature string, value double, time int, status int")
    may = (d[:, None] == 1) & ((t[None] > t[:, None]) | ((t[None] == t[:, None]) & (d[None] == 0))) & ~np.eye(n, dtype=bool)
    con, dis, tie = (int((may & m).sum()) for m in (x[:, None] > x[None], x[:, None] < x[None], x[:, None] == x[None]))
    for block in (4, 50, 1 << 16):
        monkeypatch.setattr(R, "PAIR_BLOCK", block)
        got = {r.feature: (r.concordant, r.discordant, r.tied) for r in R.concordance_index(df, ["feature"], "value").collect()}
        assert got == {"a": (con, dis, tie), "b": (dis, con, tie)}
    counted, plain = [], R.value_counts
    monkeypatch.setattr(R, "value_counts", lambda df, *a, **k: counted.append(df.count()) or plain(df, *a, **k))
    R.concordance_index(df, ["feature"], "value").collect()
    assert sum(counted) <= 2 * df.count()


def test_cox_rounds_leave_the_rows_where_they_are(spark, monkeypatch):
    """The coefficients go to the rows: no join of a round shuffles the rows by feature."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([("ab"[i % 2], float(rng.normal()), int(rng.integers(1, 9)), int(i % 3 > 0)) for i in range(90)], "feature string, value double, time int, status int")
    plans, plain = [], R._risk_sums
    monkeypatch.setattr(R, "_risk_sums", lambda rows, *a: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or plain(rows, *a))
    R.cox_univariate(df).collect()
    assert plans and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)


def test_smaller_models_begin_at_the_larger_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    t, d = np.ceil(20 * rng.exponential(np.exp(-1.5 * x[:, 0]))).astype(int), (rng.random(200) < 0.8).astype(int)
    df = spark.createDataFrame([(float(x[i, 0]), float(x[i, 1]), float(x[i, 2]), int(t[i]), int(d[i])) for i in range(200)], "a double, b double, c double, time int, status int")
    path = R.backward_aic(df, ["a", "b", "c"])
    assert [p["names"] for p in path] == [["a", "b", "c"], ["a", "c"]]
    whole = R.cox_multivariate(df, ["a", "c"])
    assert abs(path[1]["aic"] - (4 - 2 * whole["loglik"])) < 1e-7
    assert path[1]["rounds"] < whole["rounds"]


def test_folds_and_ridge_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0.3).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(300)], "patient_id long, y int, f0 double, f1 double")
    folds = M.stratified_folds(df, 5)
    n = folds.groupBy("y", "fold").count().toPandas().groupby("y")["count"]
    assert (n.max() - n.min()).max() <= 1
    assert sorted(map(tuple, folds.select("patient_id", "fold").collect())) == sorted(map(tuple, M.stratified_folds(df.repartition(7), 5).select("patient_id", "fold").collect()))
    prep = M.Preparation.fit(df, ["f0", "f1"])
    m = M.logit_l2(M.balanced_weights(prep.apply(df)))
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, 150 / y.sum(), 150 / (300 - y.sum()))
    p = 1 / (1 + np.exp(-(z @ m.coefficients.toArray() + m.intercept)))
    assert np.abs(z.T @ (w * (p - y)) + m.coefficients.toArray()).max() < 1e-2 and abs((w * (p - y)).sum()) < 1e-2
    oof, _ = M.cross_validate(folds)
    assert oof.count() == 300 and P.rank_auc(oof.withColumn("k", F.lit(1)), ["k"], "y", "proba").first()["auc"] > 0.6


def test_correlation_over_common_rows(spark):
    rng = random.Random(8)
    wide = {f"f{j}": [rng.gauss(1000 * j, 1) if rng.random() < 0.6 else None for _ in range(300)] for j in range(4)}
    wide["f3"] = [None if a is None or i % 5 == 0 else a + rng.gauss(0, 0.5) for i, a in enumerate(wide["f1"])]
    wide["same"], wide["once"] = [7.0] * 300, [1.0] + [None] * 299
    facts = spark.createDataFrame([(i, f, v) for f, vs in wide.items() for i, v in enumerate(vs)], "patient_id bigint, feature string, value double")
    pd_ = pd.DataFrame(wide, dtype=float)
    for method, want in (("pearson", pd_.corr()), ("spearman", pd_.rank().corr())):
        got = {(r.a, r.b): r.rho for r in P.correlation(facts, list(wide), method).collect()}
        for a, b in got:
            if "same" in (a, b) or "once" in (a, b):
                assert got[a, b] is None
            else:
                assert abs(got[a, b] - abs(want.loc[a, b])) < 1e-9
        assert 6 + 4 < len(got) <= 6 + 4 + 5  # a pair without a common row is not listed


def test_splits_keep_totals_and_shares():
    rng = np.random.default_rng(1)
    total = np.full(4000, 50)
    cells = P.split_counts(rng, total, np.array([1, 0, 5, 4]))
    assert (cells.sum(axis=1) == 50).all() and not cells[:, 1].any()
    assert np.allclose(cells.mean(axis=0), [5, 0, 25, 20], atol=0.2) and abs(cells[:, 2].var() - 12.5) < 1


def test_stratified_bootstrap_keeps_classes(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("a", round(rng.gauss(y, 1), 1), y) for y in (0, 1) for _ in range(400 - 250 * y)] + [("b", 0.5, 1)] * 3 + [("c", 0.1, None)]
    df = spark.createDataFrame(rows, "task string, score double, y int")
    one = {}
    for blocks in ({}, {"sample_one_in": 1, "sample_per_block": 4}):
        whole = P.with_blocks
        monkeypatch.setattr(P, "with_blocks", lambda vc, keys, order, blocks=blocks, whole=whole: whole(vc, keys, order, **blocks))
        got = P.stratified_replicas(df, ["task"], 300).collect()
        monkeypatch.setattr(P, "with_blocks", whole)
        assert {(r.task, r.pos, r.neg) for r in got} == {("a", 150, 400), ("b", 3, 0)} and len(got) == 600
        a = np.array([r.auc for r in got if r.task == "a"])
        assert all(r.auc is None for r in got if r.task == "b")
        one[bool(blocks)] = a
    point = P.rank_auc(df, ["task"], "y", "score").where("task = 'a'").first().auc
    loose = np.array([r.auc for r in P.bootstrap_replicas(df, ["task"], 300).where("task = 'a'").collect()])
    for a in one.values():
        assert abs(a.mean() - point) < 0.005 and 0.8 < a.std() / loose.std() < 1.25
    again = [r.auc for r in P.stratified_replicas(df.repartition(7), ["task"], 300).orderBy("replica").where("task = 'a'").collect()]
    assert again == pytest.approx(sorted_auc(P.stratified_replicas(df, ["task"], 300)))


def sorted_auc(df):
    return [r.auc for r in df.where("task = 'a'").orderBy("replica").collect()]
