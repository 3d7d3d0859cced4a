"""Small groups share a call and large volumes are cut into blocks: the numbers must not tell."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from phenospark.operators import airway as A
from phenospark.operators import components as K
from phenospark.operators import texture as X
from phenospark.operators import voxel as V
from phenospark.session import by_groups


def cloud(spark, patients=40, edge=9, n=120, seed=3):
    rng = np.random.default_rng(seed)
    pts = {p: np.unique(rng.integers(0, edge, (n, 3)), axis=0) for p in range(patients)}
    rows = [(p, "r", *(int(k) for k in q), int(q.sum() % 2) + 1) for p, qs in pts.items() for q in qs]
    return pts, spark.createDataFrame(rows, "patient_id long, roi string, z int, y int, x int, g int")


def test_many_groups_share_a_call(spark):
    df = spark.range(300).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE id % 7 END AS k", "id").repartition(3)
    got = by_groups(df, ["k"], lambda t, s: {"k": t.column("k").take(s), "n": np.diff(np.append(s, t.num_rows)), "calls": np.full(len(s), len(s))}, "k long, n long, calls long", rows=40)
    assert {r.k: r.n for r in got.collect()} == {k: sum(1 for i in range(300) if (i % 7 or None) == k) for k in (None, 1, 2, 3, 4, 5, 6)}
    one = by_groups(df, ["k"], lambda t, s: {"n": [len(s)]}, "n long").collect()
    assert sum(r.n for r in one) == 7 and len(one) < 7
    assert by_groups(df.limit(0), ["k"], lambda t, s: {"n": [1]}, "n long").count() == 0


def test_components_cross_blocks(spark, monkeypatch):
    _, v = cloud(spark, 6, 12, 260)
    key = lambda c: sorted((r.patient_id, r.z, r.y, r.x0, r.x1, r.n, r.component) for r in c.collect())
    for same in (None, "g"):
        whole = key(K.connected_components(v, ["patient_id"], 26, same=same))
        edges = K.run_edges(K.x_runs(v, ["patient_id"], same), ["patient_id"], 26, same)
        plain = {(r.patient_id, r.node): r.component for r in K.spread_labels(edges, ["patient_id"]).collect()}
        assert all(w[6] == plain.get((w[0], (w[1] << 40) + (w[2] << 20) + w[3]), (w[1] << 40) + (w[2] << 20) + w[3]) for w in whole)
        for block in (4, 1):
            monkeypatch.setattr(K, "BLOCK", block)
            assert key(K.connected_components(v, ["patient_id"], 26, same=same)) == whole
        monkeypatch.setattr(K, "BLOCK", 64)
    # one volume in one block takes no star steps
    monkeypatch.setattr(K, "spread_labels", None)
    assert K.connected_components(v, ["patient_id"], 26).count() > 0


def test_diameters_and_degrees(spark, monkeypatch):
    pts, v = cloud(spark)
    meta = spark.createDataFrame([(p, 0.5, 0.75, 1.25, 9, 9, 9) for p in pts], "patient_id long, dx double, dy double, dz double, nx int, ny int, nz int")
    for block in (64, 4):
        monkeypatch.setattr(X, "BLOCK", block)
        degree = {(r.patient_id, r.z, r.y, r.x): r.degree for r in V.skeleton_degree(v).collect()}
        assert degree == {(p, *q): sum(1 for o in qs if max(abs(o - q)) == 1) for p, qs in pts.items() for q in qs}
    got = {r.patient_id: r for r in X.max_diameters(v, meta).collect()}
    for p, qs in pts.items():
        mm = qs * np.array([1.25, 0.75, 0.5])
        d = np.sqrt(((mm[:, None] - mm[None]) ** 2).sum(-1))
        flat = [max(d[i, j] for i, j in itertools.product(range(len(qs)), repeat=2) if qs[i][a] == qs[j][a]) for a in range(3)]
        want = (d.max(), *flat)
        r = got[p]
        assert np.allclose((r.Maximum3DDiameter, r.Maximum2DDiameterSlice, r.Maximum2DDiameterRow, r.Maximum2DDiameterColumn), want)


def test_axes_do_not_hang_on_row_order(spark):
    # corners of equal spread along two axes: the leading axis was picked by rounding errors of merged sums
    skel = spark.createDataFrame([(p, z, y, x) for p in range(60) for z, y, x in ((5, 5, 5), (5, 5, 6), (5, 6, 7), (5, 7, 7), (9, 9, 2), (10, 9, 2), (11, 8, 2))], "patient_id long, z int, y int, x int")
    meta = spark.createDataFrame([(p, 0.5, 0.75, 1.0, 16, 16, 16) for p in range(60)], "patient_id long, dx double, dy double, dz double, nx int, ny int, nz int")
    runs = [sorted(tuple(r) for r in V.skeleton_segments(skel.repartition(k, F.rand(k)), meta).collect()) for k in (1, 7)]
    assert runs[0] == runs[1] and len({r[1:] for r in runs[0]}) == 1


def test_branch_points_are_not_broadcast(spark):
    # points visit 27 cells each, but the plan estimates them at the size of the patient list
    v = spark.createDataFrame([(1, 0, 0, i) for i in range(20)], "patient_id long, z int, y int, x int")
    line = spark.createDataFrame([(1, 0, 0, 0, 3), (1, 1, 0, 0, 12)], "patient_id long, branch int, z int, y int, x int")
    got = A.voxel_to_branch(v, line)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.x: (r.branch, r.d) for r in got.collect()} == {i: min((abs(i - c), b) for b, c in ((0, 3), (1, 12)))[::-1] for i in range(19)}
