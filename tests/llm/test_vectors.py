"""Bisector clustering and whitening against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from phenospark.llm import bisector, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, cluster string, part int, w double"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, "x", "y", 7, 0.5) for i, v in zip(ids, vectors)], SCHEMA).repartition(3)


def gauss(n, dims, seed=0, spread=0.2):
    rng = random.Random(seed)
    return [[float(np.float32(rng.gauss(0, spread) + (j == i % 3))) for j in range(dims)] for i in range(n)]


def hard(n, dims, seed=0):
    v = gauss(n, dims, seed)
    bad = [None, [], [0.1] * (dims - 1), [None] + [0.1] * (dims - 1), [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [0.1] * (dims + 1), [3e38] * dims]
    return v + [v[0]] * 40 + [[0.0] * dims] * 2 + bad


def brute_clusters(rows, k, rounds, dims):
    """Plain integers: every distance to every centroid."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [x for _, x in sorted(kept, key=key)[:k]]
    near = lambda x: min(range(len(cents)), key=lambda c: (far(x, cents[c]), c))
    for _ in range(rounds):
        of = [near(x) for _, x in kept]
        cents = [[sum(col) // len(mine) for col in zip(*mine)] if (mine := [x for (_, x), o in zip(kept, of) if o == c]) else cents[c] for c in range(len(cents))]
    out = [(i, c := near(x), far(x, cents[c])) for i, x in kept]
    total = {c: sum(d for _, o, d in out if o == c) for c in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i if i is not None else -1), c, d, total[c], sum(total.values()), digest[c]) for i, c, d in out)


def got_clusters(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_on_hard_rows(spark):
    v = hard(60, 64)
    ids = [*range(len(v) - 3), 5, None, None]  # a repeated id and null ids
    got = got_clusters(bisector.report(table(spark, v, ids), k=8, rounds=10))
    assert got == brute_clusters(list(zip(ids, v)), 8, 10, 64)


def test_ties_and_empty_clusters(spark):
    v = [[0.0] * 4] * 30 + [[1.0, 0.0, 0.0, 0.0]] * 3 + [[0.5, 0.0, 0.0, 0.0]] * 3
    got = got_clusters(bisector.report(table(spark, v), k=8, rounds=3, dims=4))
    assert got == brute_clusters(list(enumerate(v)), 8, 3, 4)
    plane = bisector.Bisectors(np.array([[0, 0], [4, 0], [0, 0]]))
    assert plane.winners(np.array([[2, 9], [3, 0], [0, 0], [4, 0]])).tolist() == [0, 1, 0, 1]  # halfway and equal centroids: smaller number


def test_few_and_no_vectors(spark):
    v = gauss(3, 64)
    assert got_clusters(bisector.report(table(spark, v))) == brute_clusters(list(enumerate(v)), 8, 10, 64)
    assert bisector.report(table(spark, v).limit(0)).count() == 0 and bisector.report(table(spark, [None, [1.0]])).count() == 0


def brute_white(rows, dims, k=4):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 1e10 for x in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int(np.sum(values > 1e-12 * values.sum())))
    out = []
    for i, x in kept:
        w = (np.array(x) - np.array(sums) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        out.append((i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), w))
    return n, values[:k] / values.sum(), out


@pytest.mark.parametrize("block_rows", [whitening.BLOCK_ROWS, 7])
def test_whitening_on_hard_rows(spark, monkeypatch, block_rows):
    monkeypatch.setattr(whitening.Layout.__init__, "__defaults__", (block_rows,))
    monkeypatch.setattr(whitening, "TASK_BYTES", 2000)
    v = hard(50, 6, 3)
    n, shares, want = brute_white(list(enumerate(v)), 6)
    got = {}
    for r in whitening.report(table(spark, v)).collect():
        assert r.n == n and math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-9
        got.setdefault(r.vec_id, {})[r.component] = (r.whitened, r.deviation)
    assert got.keys() == {i for i, _, _ in want}
    sign = np.sign([got[0][c + 1][0] / want[0][2][c] for c in range(4)])
    for i, deviation, w in want:
        assert sorted(got[i]) == [1, 2, 3, 4] and all(x[1] == deviation for x in got[i].values())
        assert np.allclose([got[i][c + 1][0] for c in range(4)], sign * w, atol=1e-9)


def test_whitening_of_low_rank_and_large_entries(spark):
    line = [[float(i), 2.0 * i, 0.0] for i in range(9)]
    got = whitening.report(table(spark, line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and abs(got[0].explained - 1) < 1e-12
    assert whitening.report(table(spark, [[1.0, 2.0]] * 4)).count() == 0  # all rows equal
    assert whitening.report(table(spark, [None, []])).count() == 0
    big = [[1e8, 0.0], [0.0, 1e3], [-1e8, 5.0], [0.0, 0.0]]
    n, shares, want = brute_white(list(enumerate(big)), 2)
    deviations = {i: d if d < 1 << 63 else None for i, d, _ in want}
    assert None in deviations.values() and any(deviations.values())
    for r in whitening.report(table(spark, big)).collect():
        assert r.deviation == deviations[r.vec_id] and math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-6)
