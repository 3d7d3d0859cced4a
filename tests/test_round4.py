"""Tests of the findings of round 4."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from phenospark.operators import batched as B
from phenospark.operators import filters as L
from phenospark.operators import models as M
from phenospark.operators import screen as Z
from phenospark.plans import q_texture as QX
from phenospark.plans import standin as S

SF = "/root/testdata/sf0.001"


def test_shape_query_has_the_principal_axes(spark):
    """axis lengths, elongation and flatness beside volume, surface and diameters, as by numpy."""
    got = {r["patient_id"]: r.asDict() for r in QX.x_shape(spark, SF).collect()}
    vox = S.ct(spark, SF).join(S.meta(spark, SF), "patient_id").select("patient_id", *[(F.col(a) * F.col(f"d{a}")).alias(a) for a in "zyx"]).toPandas()
    assert len(got) == vox["patient_id"].nunique()
    for k, p in vox.groupby("patient_id"):
        low, mid, top = np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(p[["z", "y", "x"]].to_numpy().T, bias=True)), 0))
        want = {"MajorAxisLength": 4 * top, "MinorAxisLength": 4 * mid, "LeastAxisLength": 4 * low, "Elongation": mid / top, "Flatness": low / top}
        assert all(abs(got[k][c] - v) < 2e-6 for c, v in want.items())
        assert got[k]["SurfaceArea"] > 0 and got[k]["Maximum3DDiameter"] > 0


def test_left_out_steps_equal_those_of_each_fold(spark):
    """pools, selections and inner folds of all left-out cohorts, taken together, are those of each cohort alone."""
    rng = np.random.default_rng(7)
    n = 240
    v = np.round(rng.normal(size=(n, 7)), 1)
    v[:, 5] = v[:, 0] + np.round(0.2 * rng.normal(size=n), 1)
    y = (v[:, 0] + rng.normal(size=n) > 0).astype(int)
    hole = rng.random((n, 7)) < 0.25
    data = [(i, "ABC"[i % 3], None if i % 50 == 7 else int(y[i]), f"g{j}", None if hole[i, j] else float(v[i, j])) for i in range(n) for j in range(7)]
    facts = M.group_folds(spark.createDataFrame(data, "patient_id long, cohort string, y int, feature string, value double")).cache()
    ids, folds = ["patient_id", "cohort", "y", "fold"], [0, 1, 2]
    got = Z.pool_binary_left_out(facts, "fold", folds)
    assert sorted(got.collect()) == sorted(Z.pool_binary(Z.training_rows(facts, "fold", folds), ["_fold"]).select(*got.columns).collect())
    used = [f"g{j}" for j in range(7)]
    wide = M.model_frame(facts, ids, used).cache()
    pools = {0: used, 1: used[::-1], 2: ["g5", "g0", "g3"]}
    chosen = Z.select_features_left_out(wide, dict(zip(used, M.feature_columns(wide))), pools, 4, 0.3)
    inner = M.inner_folds(wide.select(*ids), 3, "fold", folds, 7)
    for k in folds:
        pool = spark.createDataFrame(list(enumerate(pools[k])), "rank int, feature string")
        assert chosen[k] == Z.select_features(facts.where(F.col("fold") != k), pool, 4, 0.3)
        alone = M.stratified_folds(wide.where(F.col("fold") != k).select("patient_id", "y"), 3, 7)
        both = {(r[0], r[1]) for r in inner.where(f"inner_{k} is not null").select("patient_id", f"inner_{k}").collect()}
        assert both == {(r[0], r[1]) for r in alone.select("patient_id", "fold").collect()}


def test_medians_by_leading_bits(spark):
    """middle values outside each fold, with ties, gaps and values of any size, as by sorting."""
    rng = np.random.default_rng(8)
    n = 400
    v = np.stack([np.round(rng.normal(size=n), 1), -np.exp(20 * rng.normal(size=n)), rng.integers(0, 3, n) - 1.0, np.full(n, np.nan)], axis=1)
    v[rng.random((n, 4)) < 0.2] = np.nan
    df = spark.createDataFrame([(i % 3, *[None if np.isnan(x) else float(x) for x in v[i]]) for i in range(n)], "fold int, a double, b double, c double, d double")
    got = B.fold_medians(df, list("abcd"), [0, 1, 2, -1], few=4)
    for s, h in enumerate([0, 1, 2, -1]):
        for j in range(4):
            x = np.sort([w for i, w in enumerate(v[:, j]) if i % 3 != h and not np.isnan(w)])
            assert got.n[s, j] == len(x)
            for values, before, equal, at in ((got.low, got.low_before, got.low_n, (len(x) - 1) // 2), (got.high, got.high_before, got.high_n, len(x) // 2)):
                assert not len(x) or (values[s, j], before[s, j], equal[s, j]) == (x[at], (x < x[at]).sum(), (x == x[at]).sum())


def test_cohorts_share_their_passes(spark, monkeypatch):
    """sums of cohorts that are fitted side by side come from one job, the sums of each are its own."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    facts = spark.createDataFrame([(i, f"c{i % 5}", int(y[i]), f"g{j}", None if (i + j) % 7 == 3 else float(x[i, j])) for i in range(200) for j in range(4)],
                                  "patient_id long, cohort string, y int, feature string, value double")
    together, real, paths, path = [], B.SharedPasses._sums, [], M.penalty_path
    monkeypatch.setattr(B.SharedPasses, "_sums", lambda self, asked: together.append(len(asked)) or real(self, asked))
    monkeypatch.setattr(M, "penalty_path", lambda frame, *args, **more: paths.append((frame, args, path(frame, *args, **more))) or paths[-1][2])
    oof, _ = M.nested_loco(facts, ["patient_id", "cohort", "y"], cs=(0.1, 1.0))
    assert sorted(r["patient_id"] for r in oof.collect()) == list(range(200))
    assert max(together) == 5 and len(together) <= max(p.models.passes for *_, p in paths) + 1
    frame, args, shared = paths[0]
    alone = path(frame, *args)
    assert np.allclose(shared.models.coefficients(), alone.models.coefficients(), atol=1e-6) and np.allclose(shared.models.medians(), alone.models.medians())


def test_filters_of_many_small_volumes_hold_little(spark, monkeypatch):
    """a call over 48 volumes whose rim is five times the volume keeps to a few of them at a time."""
    calls = {}
    monkeypatch.setattr(L, "by_groups", lambda df, keys, fn, schema, rows: calls.update(df=df.sortWithinPartitions(*keys), fn=fn) or df)
    meta = spark.range(48).selectExpr("id AS patient_id", "0.5D AS dx", "0.5D AS dy", "1D AS dz", "16 AS nx", "16 AS ny", "16 AS nz")
    vox = spark.range(48 * 512).selectExpr("id % 48 AS patient_id", "CAST(id / 48 AS INT) % 16 AS z", "CAST(id / 768 AS INT) % 16 AS y", "CAST(id / 12288 AS INT) AS x", "CAST(id * 37 % 900 AS INT) AS hu")
    L.log_filter(L.pack_rows(vox, meta), meta, [1.0])
    table = calls["df"].coalesce(1).sortWithinPartitions("patient_id", "bz", "by").toArrow().combine_chunks()
    starts = np.flatnonzero(np.diff(table.column("patient_id").to_numpy(), prepend=-1))
    assert table.num_rows == 48 * 256 and len(starts) == 48
    tracemalloc.start()
    got = calls["fn"](table, starts)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert len(got["z"]) == 48 * 256 and peak < 50
