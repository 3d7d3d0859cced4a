"""Shared-pass models against single fits by plain numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from phenospark.operators import batched as B
from phenospark.operators import models as M

COLS = ["f0", "f1", "f2", "f3"]


def frame(spark, n=240, seed=5, folds=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(50, 3), rng.gauss(0, 1), rng.gauss(-900, 40), rng.gauss(0, 1) * 1e-3]
        p = 1 / (1 + math.exp(-((x[0] - 50) / 3 + 0.5 * x[1] - 0.4)))
        rows.append((i * 7 + 1, int(rng.random() < p), i % folds, *[None if rng.random() < 0.1 and j != 2 else v for j, v in enumerate(x)]))
    rows[3] = (rows[3][0], None, *rows[3][2:])
    return rows, spark.createDataFrame(rows, "patient_id bigint, y int, fold int, f0 double, f1 double, f2 double, f3 double").repartition(5)


def arrays(rows):
    r = [x for x in rows if x[1] is not None]
    return np.array([x[0] for x in r]), np.array([x[1] for x in r]), np.array([x[2] for x in r]), np.array([[np.nan if v is None else v for v in x[3:]] for x in r])


def prepared(x, y, train, w, balanced=True):
    """Filled and scaled rows, and row weights, from the training rows alone."""
    x = np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x)
    m = np.average(x[train], axis=0, weights=w[train])
    s = np.sqrt(np.average((x[train] - m) ** 2, axis=0, weights=w[train]))
    n = [w[train & (y == k)].sum() for k in (0, 1)]
    cw = np.array([sum(n) / (2 * k) for k in n]) if balanced else np.ones(2)
    return np.column_stack([np.ones(len(x)), (x - m) / s]), w * cw[y]


def ridge(a, y, w, c):
    b = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        pen = np.r_[0.0, np.ones(len(b) - 1)] / c
        b -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(pen), a.T @ (w * (p - y)) + pen * b)
    return b


def auc(score, y, w):
    gap = score[y == 1][:, None] - score[y == 0][None]
    ww = w[y == 1][:, None] * w[y == 0][None]
    return float((ww * ((gap > 0) + 0.5 * (gap == 0))).sum() / ww.sum())


def test_draws_are_poisson_and_fixed():
    w = B.draws(np.arange(20000), np.arange(20), 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert np.abs(np.corrcoef(w.T) - np.eye(20)).max() < 0.05
    assert (B.draws(np.array([7, -3, 1 << 40]), np.array([3]), 1) == B.draws(np.array([7, -3, 1 << 40]), np.array([0, 3]), 1)[:, 1:]).all()


def test_bootstrap_models_match_single_fits(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 17)
    rows, df = frame(spark)
    key, y, fold, x = arrays(rows)
    got, models = B.bootstrap_model_auc(df, COLS, 4, seed=9)
    got = {r.replica: r.auc for r in got.collect()}
    assert models.residual.max() < 1e-8 and models.passes < 15
    for b in range(4):
        w, score = B.draws(key, np.array([b]), 9)[:, 0], np.zeros(len(y))
        for f in range(3):
            train = fold != f
            a, ww = prepared(x, y, train, w)
            score[fold == f] = (a @ ridge(a[train], y[train], ww[train], 1.0))[fold == f]
        assert math.isclose(got[b], auc(score, y, w), rel_tol=1e-9)


def test_optimism_matches_single_fits(spark):
    rows, df = frame(spark)
    key, y, _, x = arrays(rows)
    got, models = B.bootstrap_optimism(df, COLS, 3, 0.4, seed=2)
    assert models.residual.max() < 1e-8
    for r in got.collect():
        w = B.draws(key, np.array([r.replica]), 2)[:, 0]
        a, ww = prepared(x, y, np.ones(len(y), bool), w, balanced=False)
        p = 1 / (1 + np.exp(-a @ ridge(a, y, ww, 1.0)))
        for v, s, n in ((w, r.slope_apparent, r.nb_apparent), (np.ones(len(y)), r.slope_test, r.nb_test)):
            assert math.isclose(s, np.average(p[y == 1], weights=v[y == 1]) - np.average(p[y == 0], weights=v[y == 0]), rel_tol=1e-8)
            hit = p >= 0.4
            assert math.isclose(n, (v[hit & (y == 1)].sum() - v[hit & (y == 0)].sum() * 0.4 / 0.6) / v.sum(), rel_tol=1e-8)


def test_path_is_stationary_and_scores_its_folds(spark):
    rows, df = frame(spark)
    key, y, fold, x = arrays(rows)
    cs, ratios = (0.003, 0.1, 3.0), (0.5, 1.0)
    path = B.penalty_path(df, COLS, cs, ratios, "auc")
    m = path.models
    assert len(m.set) == 4 * 6 and m.residual.max() < 1e-8
    aucs = {}
    for i in range(len(m.set)):
        held = m.rows.held[m.set[i]]
        train = fold != held
        a, w = prepared(x, y, train, np.ones(len(y)))
        b, l1, l2 = m.beta[i], m.l1_ratio[i] / m.c[i], (1 - m.l1_ratio[i]) / m.c[i]
        p = 1 / (1 + np.exp(-a @ b))
        g = a[train].T @ (w * (p - y))[train]
        assert abs(g[0]) < 1e-5
        for bj, gj in zip(b[1:], g[1:]):
            assert abs(gj + l2 * bj + l1 * np.sign(bj)) < 1e-5 if bj else abs(gj) <= l1 + 1e-5
        if held >= 0:
            aucs.setdefault((m.c[i], m.l1_ratio[i]), []).append(auc((a @ b)[fold == held], y[fold == held], np.ones((fold == held).sum())))
    assert (m.beta[m.c == 0.003, 1:] == 0).any()
    for c, r, mean, sd in path.table:
        assert math.isclose(mean, np.mean(aucs[c, r]), rel_tol=1e-9) and math.isclose(sd, np.std(aucs[c, r], ddof=1), rel_tol=1e-6, abs_tol=1e-12)
    best = path.table[path.best]
    assert best[2] == max(t[2] for t in path.table)
    a, w = prepared(x, y, np.ones(len(y), bool), np.ones(len(y)))
    want = {int(k): float(v) for k, v in zip(key, a @ m.beta[path.final[path.best]])}
    assert all(math.isclose(r.score, want[r.patient_id], rel_tol=1e-8, abs_tol=1e-10) and r.pred == (r.score > 0) for r in path.scored(df.where("y is not null")).collect())


def test_one_standard_error_and_log_loss(spark):
    _, df = frame(spark)
    loose = B.penalty_path(df, COLS, (0.01, 1.0, 100.0), (1.0,), "log_loss")
    tight = B.penalty_path(df, COLS, (0.01, 1.0, 100.0), (1.0,), "log_loss", one_se=True)
    assert np.allclose(loose.table, tight.table) and tight.table[tight.best][0] <= loose.table[loose.best][0]
    assert set(tight.kept) <= set(COLS) and all(t[2] < 0 for t in loose.table)


def test_one_class_and_no_rows(spark):
    _, df = frame(spark)
    got, models = B.bootstrap_model_auc(df.where("y = 1"), COLS, 2)
    assert all(r.auc is None for r in got.collect()) and np.isinf(models.residual).all() and not models.beta.any()
    assert B.penalty_path(df.limit(0), COLS, (1.0,)).table[0][2] == -math.inf


def test_coupling_recovers_one_distribution(spark):
    p = {0: 0.2, 1: 0.5, 2: 0.3}
    pair = {(a, b): F.lit(p[b] / (p[a] + p[b])) for a in p for b in p if a < b}
    got = spark.range(1).select(*[v.alias(f"p{k}") for k, v in M.coupled(pair, [0, 1, 2]).items()]).first()
    assert np.allclose(list(got), [0.2, 0.5, 0.3])


def test_three_classes_leave_one_cohort_out(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        c = rng.randrange(3)
        for j in range(4):
            rows.append((i, "abc"[i % 3], c, f"g{j}", rng.gauss(3 * (c == j), 1) if j < 3 else rng.gauss(0, 1)))
    facts = spark.createDataFrame(rows, "patient_id bigint, cohort string, label bigint, feature string, value double")
    oof, chosen = M.nested_multiclass(facts, ["patient_id", "cohort", "label"], "label", [0, 1, 2], keep=4, cs=(0.1, 1.0), folds=2)
    got = oof.collect()
    assert len(got) == 300 and len({r.patient_id for r in got}) == 300
    assert all(abs(r.proba_0 + r.proba_1 + r.proba_2 - 1) < 1e-9 for r in got)
    assert sum(r.pred == r.label for r in got) > 240
    assert {r.fold for r in chosen.collect()} == {0, 1, 2} and {r.pair for r in chosen.collect()} == {"0|1", "0|2", "1|2"}
