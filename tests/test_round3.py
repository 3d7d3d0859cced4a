"""Tests of the findings of round 3."""

from __future__ import annotations

import os
import time

import numpy as np
from pyspark.sql import functions as F

from phenospark.operators import airway as A
from phenospark.operators import batched as B
from phenospark.operators import filters as L
from phenospark.operators import models as M
from phenospark.sources import sinks, tables


def test_folders_one_file_each_and_patients_from_the_last_folder(spark, tmp_path):
    """a folder is one file, tasks are not merged by bytes, and the path search does not see the folders above."""
    root = str(tmp_path / "upper_b=7" / "all_branches")
    rows = spark.range(60).select(F.concat(F.col("id") % 20, F.lit("_branches")).alias("folder"), F.col("id").cast("int").alias("generation"))
    sinks.write_folders_csv(rows, root, "folder")
    files = [f for _, _, fs in os.walk(root) for f in fs if f.endswith(".csv")]
    assert len(files) == 20 and len({f.split("-")[1] for f in files}) > 1
    got = tables.read_branch_metrics(spark, root, "generation INT")
    assert {(r["patient"], r["n"], r["s"]) for r in got.groupBy("patient").agg(F.count("*").alias("n"), F.sum("generation").alias("s")).collect()} == {
        (str(i), 3, 3 * i + 60) for i in range(20)}
    assert "substring_index" in got._jdf.queryExecution().optimizedPlan().toString()


def test_replicas_start_near_their_optimum_in_one_task_per_core(spark):
    """small rows keep a task per core, replicas start at the plain models, and draws are those of the 64-bit formula."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    frame = spark.createDataFrame([(i, int(y[i]), i % 3, *map(float, x[i])) for i in range(400)], "patient_id long, y int, fold int, f0 double, f1 double, f2 double")
    rows = B.Rows(frame.coalesce(1), ["f0", "f1", "f2"])
    assert rows.df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    models = B.Models(rows, 8).fit()
    assert models.residual.max() <= 1e-9
    keys = rng.integers(0, 2**40, 500)
    lower, upper = (keys.astype(np.uint64) & np.uint64(0xFFFFFFFF)), keys.astype(np.uint64) >> np.uint64(32)
    start = B.mix32(lower ^ B.mix32(upper + np.uint64(42)))
    h = B.mix32(start[:, None] + np.arange(300, dtype=np.uint64)[None] * np.uint64(0x9E3779B9) & np.uint64(0xFFFFFFFF))
    assert (B.draws(keys, np.arange(300), 42) == np.searchsorted(np.array(B.STEPS, np.uint64), h, side="right")).all()


def test_weighted_auc_reads_its_scores_once_beside_the_sample(spark):
    """two readers of the scored rows (counts and sample), where there were three or more; ties and blocks as by all pairs."""
    rng = np.random.default_rng(4)
    data = [(int(k), int(y), float(w), float(s)) for k, y, w, s in zip(rng.integers(0, 2, 600), rng.integers(0, 2, 600), rng.integers(1, 4, 600), rng.integers(0, 40, 600))]
    scored = spark.createDataFrame(data, "k int, y int, w double, score double").mapInArrow(lambda it: it, "k int, y int, w double, score double")
    got = B.weighted_aucs(scored, ["k"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    for r in got.collect():
        pos, neg = ([(w, s) for k, y, w, s in data if k == r["k"] and y == v] for v in (1, 0))
        won = sum(a * b * ((s > t) + (s == t) / 2) for a, s in pos for b, t in neg)
        assert abs(r["auc"] - won / sum(a for a, _ in pos) / sum(b for b, _ in neg)) < 1e-12


def test_nested_folds_run_side_by_side(spark, monkeypatch):
    """cohorts are fitted at the same time, and the rows are those of one cohort after the other."""
    rng = np.random.default_rng(5)
    x, noise = rng.normal(size=(240, 3)), rng.normal(size=240)
    data = [(i, f"c{i % 3}", int(x[i, 0] + noise[i] > 0), f"g{j}", float(x[i, j])) for i in range(240) for j in range(3)]
    facts = spark.createDataFrame(data, "patient_id long, cohort string, y int, feature string, value double")
    now, most, real = [0], [0], M.penalty_path

    def watched(*args, **kwargs):
        now[0] += 1
        most[0] = max(most[0], now[0])
        time.sleep(3)
        try:
            return real(*args, **kwargs)
        finally:
            now[0] -= 1

    monkeypatch.setattr(M, "penalty_path", watched)
    oof, chosen = M.nested_loco(facts, ["patient_id", "cohort", "y"], cs=(0.1, 1.0))
    assert most[0] > 1 and {r["fold"] for r in chosen.collect()} == {0, 1, 2}
    assert sorted((r["patient_id"], r["fold"]) for r in oof.collect()) == [(i, i % 3) for i in range(240)]


def test_wavelet_energy_is_that_of_the_rows(spark):
    """sums of squares per image row, taken beside the filter, equal those of the sub-bands."""
    rng = np.random.default_rng(6)
    data = [(1, 1.0, 1.0, 1.0, 5, 4, 3, z, y, [float(v) for v in rng.normal(size=5)]) for z in range(3) for y in range(4)]
    rows = spark.createDataFrame(data, "patient_id long, dx double, dy double, dz double, nx int, ny int, nz int, z int, y int, a array<double>")
    whole = {(r["z"], r["y"]): r.asDict() for r in L.wavelet8(rows).collect()}
    sums = L.wavelet8(rows, energy=True).collect()
    assert len(sums) == 12
    for r in sums:
        for band in ("LLL", "HLH", "HHH"):
            assert abs(r[band] - sum(v * v for v in whole[r["z"], r["y"]][band])) < 1e-9


def test_profiles_fill_gaps(spark):
    rows = {1: {3: 10.0, 4: 12.0, 8: 4.0}, 2: {5: 7.0}, 3: {0: 1.0, 24: 25.0}, 4: {2: None}, 5: {0: 3.0, 1: None, 2: 5.0}}
    wall = spark.createDataFrame([(k, b * 0.2 + 0.1, v) for k, p in rows.items() for b, v in p.items()], "k int, d double, hu double")
    got = {(r.k, r.bin): r.hu for r in A.wall_profile(wall, ["k"]).collect()}
    assert len(got) == 25 * len(rows)
    for k, p in rows.items():
        seen = sorted((b, v) for b, v in p.items() if v is not None)
        for i in range(25):
            if i in dict(seen):
                want = dict(seen)[i]
            elif len(seen) < 2:
                want = None
            else:
                at = min(max(sum(b <= i for b, _ in seen) - 1, 0), len(seen) - 2)
                (a, u), (b, v) = seen[at: at + 2]
                want = u + (v - u) * ((i - a) / (b - a))
            assert got[k, i] == want


def test_profile_pca_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    wall = spark.range(2000).selectExpr("id % 40 AS k", "(id DIV 40) % 25 * 0.2 + 0.1 AS d", "CAST(hash(id) % 100 AS DOUBLE) AS v")
    got = A.profile_pca(A.wall_profile(wall.withColumn("hu", counted("v")).drop("v"), ["k"]), ["k"]).collect()
    assert len(got) == 1 and got[0].pca_explained_1 > 0
    assert read.value == 2000
