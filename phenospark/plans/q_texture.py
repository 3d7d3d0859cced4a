"""Queries over texture, filters and regridding. The whole scanned volume of a patient is one structure, 'body'."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.operators import filters as L
from phenospark.operators import texture as X
from phenospark.plans import standin as S
from phenospark.plans.q_profile import rounded
from phenospark.plans.registry import query

WIDTH = 250


def _body(spark, sf):
    return S.ct(spark, sf).withColumn("roi", F.lit("body"))


def _grey(spark, sf):
    return X.grey_levels(_body(spark, sf), WIDTH)


G_SQL = f"+, lo AS (SELECT patient_id, floor(min(hu) / {WIDTH}.0) AS lo FROM ct GROUP BY 1), g AS (SELECT ct.*, CAST(floor(hu / {WIDTH}.0) - lo + 1 AS INTEGER) AS g FROM ct JOIN lo USING (patient_id))"
DIRS = ", dirs AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(X.DIRECTIONS)) + ") t(dir, dz, dy, dx))"
ALL26 = ", nb AS (SELECT a.patient_id, a.z, a.y, a.x, a.g, b.g AS h FROM g a JOIN (SELECT dz, dy, dx FROM dirs UNION ALL SELECT -dz, -dy, -dx FROM dirs) d ON TRUE JOIN g b ON b.patient_id = a.patient_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx)"


@query("X-01", S.cte("ct meta", """+, m AS (SELECT patient_id, count(*) AS N, avg(hu) AS mu, quantile_cont(hu, 0.1) AS p10, quantile_cont(hu, 0.9) AS p90, quantile_cont(hu, 0.25) AS q1, quantile_cont(hu, 0.75) AS q3 FROM ct GROUP BY 1),
 s AS (SELECT patient_id, sum(1e0 * hu * hu) AS e, min(hu)::DOUBLE AS lo, max(hu)::DOUBLE AS hi, avg(hu) AS mean, median(hu) AS med, avg(abs(hu - mu)) AS mad, avg(pow(hu - mu, 2)) AS m2, avg(pow(hu - mu, 3)) AS m3, avg(pow(hu - mu, 4)) AS m4, any_value(N) AS N FROM ct JOIN m USING (patient_id) GROUP BY 1),
 r AS (SELECT patient_id, avg(hu) AS mm FROM ct JOIN m USING (patient_id) WHERE hu BETWEEN p10 AND p90 GROUP BY 1), rm AS (SELECT patient_id, avg(abs(hu - mm)) AS rmad FROM ct JOIN m USING (patient_id) JOIN r USING (patient_id) WHERE hu BETWEEN p10 AND p90 GROUP BY 1),
 b AS (SELECT patient_id, sum(p * p) AS u, -sum(p * log2(p)) AS ent FROM (SELECT patient_id, count(*) / any_value(N) AS p FROM ct JOIN m USING (patient_id) GROUP BY patient_id, floor(hu / 25.0)) GROUP BY 1)
 SELECT patient_id, 'body' AS roi, round(e, 3) AS Energy, round(e * dx * dy * dz, 3) AS TotalEnergy, round(ent, 6) AS Entropy, lo AS Minimum, round(p10, 6) AS "10Percentile", round(p90, 6) AS "90Percentile", hi AS Maximum, round(mean, 6) AS Mean,
 round(med, 6) AS Median, round(q3 - q1, 6) AS InterquartileRange, hi - lo AS Range, round(mad, 6) AS MeanAbsoluteDeviation, round(rmad, 6) AS RobustMeanAbsoluteDeviation, round(sqrt(e / s.N), 6) AS RootMeanSquared,
 round(m3 / pow(m2, 1.5), 6) AS Skewness, round(m4 / (m2 * m2), 6) AS Kurtosis, round(m2, 5) AS Variance, round(u, 6) AS Uniformity FROM s JOIN m USING (patient_id) JOIN rm USING (patient_id) JOIN b USING (patient_id) JOIN meta USING (patient_id)"""))
def x_firstorder(spark, sf):
    return rounded(X.firstorder(_body(spark, sf), S.meta(spark, sf)), 6, Energy=3, TotalEnergy=3, Variance=5)


def _axes_sql(src):
    """Ascending eigenvalues ``l`` of the covariance matrices of voxel centres in ``src``: five sweeps of Jacobi rotations."""
    out = (f", j0 AS (SELECT patient_id, var_pop(z * dz) AS a11, var_pop(y * dy) AS a22, var_pop(x * dx) AS a33, covar_pop(z * dz, y * dy) AS a12, covar_pop(z * dz, x * dx) AS a13, "
           f"covar_pop(y * dy, x * dx) AS a23 FROM {src} GROUP BY 1)")
    for i, (p, q, r) in enumerate([(1, 2, 3), (1, 3, 2), (2, 3, 1)] * 5):
        pq, rp, rq = (f"a{min(u)}{max(u)}" for u in ((p, q), (r, p), (r, q)))
        theta = f"(a{q}{q} - a{p}{p}) / (2 * {pq})"
        out += (f", t{i} AS (SELECT *, CASE WHEN abs({pq}) <= 1e-18 * (a{p}{p} + a{q}{q}) THEN 0e0 WHEN {theta} < 0 THEN -1 / (sqrt(pow({theta}, 2) + 1) - {theta}) ELSE 1 / (sqrt(pow({theta}, 2) + 1) + {theta}) END AS t FROM j{i})"
                f", j{i + 1} AS (SELECT patient_id, a{p}{p} - t * {pq} AS a{p}{p}, a{q}{q} + t * {pq} AS a{q}{q}, a{r}{r}, CASE WHEN t = 0 THEN {pq} ELSE 0 END AS {pq}, ({rp} - t * {rq}) / sqrt(t * t + 1) AS {rp}, (t * {rp} + {rq}) / sqrt(t * t + 1) AS {rq} FROM t{i})")
    return out + ", e AS (SELECT patient_id, list_sort([greatest(a11, 0), greatest(a22, 0), greatest(a33, 0)]) AS l FROM j15)"


@query("X-02", S.cte("ct meta", """+, v AS (SELECT patient_id, z, y, x, dx, dy, dz FROM ct JOIN meta USING (patient_id)), n AS (SELECT patient_id, count(*) * any_value(dx * dy * dz) AS vol FROM v GROUP BY 1),
 f AS (SELECT v.patient_id, sum(CASE WHEN oz <> 0 THEN dx * dy WHEN oy <> 0 THEN dx * dz ELSE dy * dz END) AS area FROM v, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(oz, oy, ox)
   WHERE NOT EXISTS (SELECT 1 FROM ct w WHERE w.patient_id = v.patient_id AND w.z = v.z + oz AND w.y = v.y + oy AND w.x = v.x + ox) GROUP BY 1),
 d AS (SELECT a.patient_id, sqrt(max(pow((a.z - b.z) * a.dz, 2) + pow((a.y - b.y) * a.dy, 2) + pow((a.x - b.x) * a.dx, 2))) AS d3, sqrt(max(CASE WHEN a.z = b.z THEN pow((a.y - b.y) * a.dy, 2) + pow((a.x - b.x) * a.dx, 2) END)) AS dz_,
   sqrt(max(CASE WHEN a.y = b.y THEN pow((a.z - b.z) * a.dz, 2) + pow((a.x - b.x) * a.dx, 2) END)) AS dy_, sqrt(max(CASE WHEN a.x = b.x THEN pow((a.z - b.z) * a.dz, 2) + pow((a.y - b.y) * a.dy, 2) END)) AS dx_ FROM v a JOIN v b USING (patient_id) GROUP BY 1)""" + _axes_sql("v") + """
 SELECT patient_id, 'body' AS roi, round(vol, 6) AS VoxelVolume, round(area, 6) AS SurfaceArea, round(area / vol, 6) AS SurfaceVolumeRatio, round(pow(36 * pi() * vol * vol, 1 / 3e0) / area, 6) AS Sphericity,
 round(4 * sqrt(l[3]), 6) AS MajorAxisLength, round(4 * sqrt(l[2]), 6) AS MinorAxisLength, round(4 * sqrt(l[1]), 6) AS LeastAxisLength, round(sqrt(l[2] / nullif(l[3], 0)), 6) AS Elongation, round(sqrt(l[1] / nullif(l[3], 0)), 6) AS Flatness,
 round(d3, 6) AS Maximum3DDiameter, round(dz_, 6) AS Maximum2DDiameterSlice, round(dy_, 6) AS Maximum2DDiameterRow, round(dx_, 6) AS Maximum2DDiameterColumn FROM n JOIN f USING (patient_id) JOIN d USING (patient_id) JOIN e USING (patient_id)"""))
def x_shape(spark, sf):
    return rounded(X.shape(_body(spark, sf), S.meta(spark, sf)))


@query("X-02b")
def x_axes(spark, sf):
    return rounded(X.shape(_body(spark, sf), S.meta(spark, sf), diameters=False))


PAIRS = DIRS + ", pr AS (SELECT a.patient_id, dir, a.g AS i, b.g AS j, count(*) AS n FROM g a JOIN dirs ON TRUE JOIN g b ON b.patient_id = a.patient_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4)"


@query("X-03", S.cte("ct", G_SQL + PAIRS + """, s AS (SELECT patient_id, dir, i, j, sum(n) AS n FROM (SELECT * FROM pr UNION ALL SELECT patient_id, dir, j, i, n FROM pr) GROUP BY 1, 2, 3, 4),
 p AS (SELECT *, n / sum(n) OVER (PARTITION BY patient_id, dir) AS p FROM s), q AS (SELECT *, sum(i * p) OVER (PARTITION BY patient_id, dir) AS mu FROM p), v AS (SELECT *, sum(pow(i - mu, 2) * p) OVER (PARTITION BY patient_id, dir) AS var FROM q),
 f AS (SELECT patient_id, dir, sum(i * j * p) AS Autocorrelation, sum(pow(i - j, 2) * p) AS Contrast, sum(abs(i - j) * p) AS DifferenceAverage, sum(p * p) AS JointEnergy, -sum(p * log2(p)) AS JointEntropy, sum(p / (1 + pow(i - j, 2))) AS Idm, sum(p / (1 + abs(i - j))) AS Id,
  max(p) AS MaximumProbability, any_value(mu) AS JointAverage, any_value(var) AS SumSquares, sum(pow(i + j - 2 * mu, 2) * p) AS ClusterTendency, sum(pow(i + j - 2 * mu, 3) * p) AS ClusterShade, sum(pow(i + j - 2 * mu, 4) * p) AS ClusterProminence,
  coalesce(sum((i - mu) * (j - mu) * p) / CASE WHEN any_value(var) > 1e-12 THEN any_value(var) END, 1) AS Correlation FROM v GROUP BY 1, 2)
 SELECT patient_id, 'body' AS roi, """ + ", ".join(f"round(avg({c}), 6) AS {c}" for c in (
    "Autocorrelation", "Contrast", "DifferenceAverage", "JointEnergy", "JointEntropy", "Idm", "Id", "MaximumProbability", "JointAverage", "SumSquares", "ClusterTendency",
    "ClusterShade", "ClusterProminence", "Correlation")) + " FROM f GROUP BY 1"))
def x_glcm(spark, sf):
    return rounded(X.glcm(X.cooccurrence(_grey(spark, sf))))


def size_sql(src, keys, size, voxels, small, big, nu, pct):
    k = ", ".join(keys)
    return f""", tot AS (SELECT {k}, sum(n)::DOUBLE AS tt, {voxels}::DOUBLE AS vv, sum(n * i) / sum(n) AS mi, sum(n * {size}) / sum(n) AS ms FROM {src} GROUP BY {k}),
 gl AS (SELECT {k}, sum(c * c) AS g2 FROM (SELECT {k}, i, sum(n)::DOUBLE AS c FROM {src} GROUP BY {k}, i) GROUP BY {k}), sz AS (SELECT {k}, sum(c * c) AS s2 FROM (SELECT {k}, {size}, sum(n)::DOUBLE AS c FROM {src} GROUP BY {k}, {size}) GROUP BY {k}),
 f AS (SELECT {k}, sum(n / tt / (1e0 * {size} * {size})) AS {small}Emphasis, sum(n / tt * {size} * {size}) AS {big}Emphasis, sum(n / tt / (i * i)) AS LowGrayLevelEmphasis, sum(n / tt * i * i) AS HighGrayLevelEmphasis, sum(n / tt * pow(i - mi, 2)) AS GrayLevelVariance,
  sum(n / tt * pow({size} - ms, 2)) AS {nu}Variance, -sum(n / tt * log2(n / tt)) AS {nu}Entropy, any_value(g2) / any_value(tt) AS GrayLevelNonUniformity, any_value(s2) / any_value(tt) AS {nu}NonUniformity, any_value(tt) / any_value(vv) AS {pct}
  FROM {src} JOIN tot USING ({k}) JOIN gl USING ({k}) JOIN sz USING ({k}) GROUP BY {k})
 SELECT patient_id, 'body' AS roi, """ + ", ".join(f"round(avg({c}), 9) AS {c}" for c in (
        f"{small}Emphasis", f"{big}Emphasis", "LowGrayLevelEmphasis", "HighGrayLevelEmphasis", "GrayLevelVariance", f"{nu}Variance", f"{nu}Entropy", "GrayLevelNonUniformity",
        f"{nu}NonUniformity", pct)) + " FROM f GROUP BY 1"


RUNS = DIRS + """, t AS (SELECT patient_id, dir, g, CASE WHEN dz <> 0 THEN z * dz WHEN dy <> 0 THEN y * dy ELSE x * dx END AS t, z, y, x, dz, dy, dx FROM g, dirs),
 l AS (SELECT patient_id, dir, g, t, z - t * dz AS lz, y - t * dy AS ly, x - t * dx AS lx FROM t), e AS (SELECT *, t - row_number() OVER (PARTITION BY patient_id, dir, lz, ly, lx, g ORDER BY t) AS grp FROM l),
 rn AS (SELECT patient_id, dir, g AS i, len, count(*) AS n FROM (SELECT patient_id, dir, g, count(*) AS len FROM e GROUP BY patient_id, dir, lz, ly, lx, g, grp) GROUP BY 1, 2, 3, 4)"""
RUN_FEATURES = size_sql("rn", ["patient_id", "dir"], "len", "sum(n * len)", "ShortRun", "LongRun", "RunLength", "RunPercentage")
# A volume several blocks wide, from the lines of orders: up to 900 cells along x.
WIDE_CELLS = "SELECT l_suppkey % 2 AS patient_id, CAST(l_linenumber AS INTEGER) AS z, CAST(l_quantity % 3 AS INTEGER) AS y, CAST(l_orderkey % 900 AS INTEGER) AS x, CAST(1 + max(CASE WHEN l_discount > 0.07 THEN 1 ELSE 0 END) AS INTEGER) AS g FROM lineitem GROUP BY 1, 2, 3, 4"


@query("X-04", S.cte("ct", G_SQL + RUNS + RUN_FEATURES))
def x_glrlm(spark, sf):
    return rounded(X.glrlm(X.run_lengths(_grey(spark, sf))), 9)


@query("X-04b", f"WITH g AS ({WIDE_CELLS})" + RUNS + RUN_FEATURES)
def x_glrlm_wide(spark, sf):
    cells = S.table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") % 2).alias("patient_id"), F.col("l_linenumber").cast("int").alias("z"), (F.col("l_quantity") % 3).cast("int").alias("y"), (F.col("l_orderkey") % 900).cast("int").alias("x")).agg(
        (1 + F.max(F.when(F.col("l_discount") > 0.07, 1).otherwise(0))).cast("int").alias("g"))
    return rounded(X.glrlm(X.run_lengths(cells.withColumn("roi", F.lit("body")))), 9)


@query("X-05", S.cte("ct", G_SQL.replace("+,", "+/*RECURSE*/,") + """, v AS (SELECT *, z * 1048576 + y * 1024 + x AS k FROM g),
 ed AS MATERIALIZED (SELECT v.patient_id AS p, v.k AS a, w.k AS b FROM v JOIN v w ON w.patient_id = v.patient_id AND w.g = v.g AND abs(w.z - v.z) <= 1 AND abs(w.y - v.y) <= 1 AND abs(w.x - v.x) <= 1),
 reach(p, a, b) AS (SELECT p, a, a FROM ed UNION SELECT r.p, r.a, ed.b FROM reach r JOIN ed ON ed.p = r.p AND ed.a = r.b),
 comp AS (SELECT p AS patient_id, a AS k, min(b) AS c FROM reach GROUP BY 1, 2), z0 AS (SELECT patient_id, c, any_value(g) AS i, count(*) AS size FROM comp JOIN v USING (patient_id, k) GROUP BY 1, 2), zn AS (SELECT patient_id, i, size, count(*) AS n FROM z0 GROUP BY 1, 2, 3)"""
                    + size_sql("zn", ["patient_id"], "size", "sum(n * size)", "SmallArea", "LargeArea", "SizeZone", "ZonePercentage")))
def x_glszm(spark, sf):
    return rounded(X.glszm(X.zones(_grey(spark, sf))), 9)


@query("X-06", S.cte("ct", G_SQL + DIRS + ALL26 + """, dn AS (SELECT patient_id, z, y, x, g, 1 + coalesce(c, 0) AS dep FROM g LEFT JOIN (SELECT patient_id, z, y, x, count(*) FILTER (g = h) AS c FROM nb GROUP BY 1, 2, 3, 4) USING (patient_id, z, y, x)),
 dm AS (SELECT patient_id, g AS i, dep, count(*) AS n FROM dn GROUP BY 1, 2, 3)""" + size_sql("dm", ["patient_id"], "dep", "sum(n)", "SmallDependence", "LargeDependence", "Dependence", "DependencePercentage")))
def x_gldm(spark, sf):
    return rounded(X.gldm(X.dependences(_grey(spark, sf))), 9)


@query("X-07", S.cte("ct", G_SQL + DIRS + ALL26 + """, av AS (SELECT patient_id, z, y, x, any_value(g) AS g, avg(h) AS m FROM nb GROUP BY 1, 2, 3, 4), lv AS (SELECT patient_id, g AS i, count(*) AS n, sum(abs(g - m)) AS s FROM av GROUP BY 1, 2),
 p AS (SELECT *, n / sum(n) OVER (PARTITION BY patient_id) AS p, sum(n) OVER (PARTITION BY patient_id) AS tt, count(*) OVER (PARTITION BY patient_id) AS ng FROM lv), o AS (SELECT patient_id, sum(p * s) AS ps, sum(s) AS s, any_value(tt) AS tt, any_value(ng) AS ng FROM p GROUP BY 1),
 w AS (SELECT a.patient_id, sum(a.p * b.p * pow(a.i - b.i, 2)) AS c, sum(abs(a.i * a.p - b.i * b.p)) AS bu, sum(abs(a.i - b.i) * (a.p * a.s + b.p * b.s) / (a.p + b.p)) AS cx, sum((a.p + b.p) * pow(a.i - b.i, 2)) AS st FROM p a JOIN p b USING (patient_id) GROUP BY 1)
 SELECT patient_id, 'body' AS roi, round(1 / ps, 6) AS Coarseness, round(c / (ng * (ng - 1)) * s / tt, 6) AS Contrast, round(ps / bu, 6) AS Busyness, round(cx / tt, 6) AS Complexity, round(st / s, 6) AS Strength FROM o JOIN w USING (patient_id)"""))
def x_ngtdm(spark, sf):
    return rounded(X.ngtdm(X.neighbour_differences(_grey(spark, sf))))


# ---- filters ---------------------------------------------------------------------------------------------------------------

DENSE = """+, dn AS (SELECT m.patient_id, m.z, m.y, m.x, coalesce(ct.hu, -1024)::DOUBLE AS v, dx, dy, dz, nx, ny, nz FROM
 (SELECT *, unnest(range(nx)) AS x FROM (SELECT *, unnest(range(ny)) AS y FROM (SELECT *, unnest(range(nz)) AS z FROM meta))) m LEFT JOIN ct USING (patient_id, z, y, x))"""


def conv_sql(name, src, axis, taps, border="nearest"):
    at = f"s.{axis} + k" if border == "zero" else (f"greatest(0, least(s.{axis} + k, s.n{axis} - 1))" if border == "nearest" else f"((s.{axis} + k) % s.n{axis} + s.n{axis}) % s.n{axis}")
    on = " AND ".join(f"t.{a} = s.{a}" if a != axis else f"t.{a} = {at}" for a in ("z", "y", "x"))
    w = "CASE k " + " ".join(f"WHEN {k} THEN {e}" for k, e in taps) + " END"
    ks = "[" + ", ".join(str(k) for k, _ in taps) + "]"
    return (f", {name} AS (SELECT s.patient_id, s.z, s.y, s.x, sum(({w}) * t.v) AS v, any_value(s.dx) AS dx, any_value(s.dy) AS dy, any_value(s.dz) AS dz, any_value(s.nx) AS nx, any_value(s.ny) AS ny, any_value(s.nz) AS nz "
            f"FROM (SELECT *, unnest({ks}) AS k FROM {src}) s JOIN {src} t ON t.patient_id = s.patient_id AND {on} GROUP BY 1, 2, 3, 4)")


def gauss_sql(axis, sigma, reach, second=False):
    g = {k: f"exp(-(s.d{axis} * s.d{axis}) * {k * k}e0 / {2 * sigma * sigma}e0)" for k in range(-reach, reach + 1)}
    tot = "(" + " + ".join(g.values()) + ")"
    if not second:
        return [(k, f"{e} / {tot}") for k, e in g.items()]
    return [(k, f"{e} / {tot} * (s.d{axis} * s.d{axis} * {k * k}e0 / {sigma ** 4}e0 - {1 / sigma ** 2}e0)") for k, e in g.items()]


SLICES = " SELECT patient_id, CAST(z AS INTEGER) AS z, count(*) AS n, round(sum(v), 4) AS total, round(max(v), 6) AS peak FROM {t} GROUP BY 1, 2"


def _dense(spark, sf):
    meta = S.meta(spark, sf)
    return L.pack_rows(S.ct(spark, sf), meta), meta


def _slices(rows):
    return L.unpack_rows(rows).groupBy("patient_id", "z").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("peak"))


KERNEL = [(-1, 0.25), (0, 0.5), (2, 0.25)]


@query("X-08", S.cte("ct meta", DENSE + conv_sql("a", "dn", "y", KERNEL) + conv_sql("b", "a", "z", KERNEL, "zero") + conv_sql("c", "b", "x", KERNEL, "wrap") + SLICES.format(t="c")))
def x_convolve(spark, sf):
    r, _ = _dense(spark, sf)
    return _slices(L.convolve_axis(L.convolve_axis(L.convolve_axis(r, "y", KERNEL), "z", KERNEL, "zero"), "x", KERNEL, "wrap"))


@query("X-09", S.cte("ct meta", DENSE + conv_sql("a", "dn", "x", gauss_sql("x", 0.5, 3)) + conv_sql("b", "a", "y", gauss_sql("y", 0.5, 3)) + conv_sql("c", "b", "z", gauss_sql("z", 0.5, 3)) + SLICES.format(t="c")))
def x_smooth(spark, sf):
    return _slices(L.gaussian_smooth(*_dense(spark, sf)))


def _log_sql(sigma, reach):
    out = DENSE
    for s in "xyz":
        src = "dn"
        for a in "xyz":
            out += conv_sql(f"l{s}{a}", src, a, gauss_sql(a, sigma, reach, a == s))
            src = f"l{s}{a}"
    return out + f", lg AS (SELECT patient_id, z, y, x, (p.v + q.v + r.v) * {sigma * sigma}e0 AS v FROM lxz p JOIN lyz q USING (patient_id, z, y, x) JOIN lzz r USING (patient_id, z, y, x))"


@query("X-10", S.cte("ct meta", _log_sql(1.0, 6) + SLICES.format(t="lg")))
def x_log(spark, sf):
    return _slices(L.log_filter(*_dense(spark, sf), [1.0]).withColumnRenamed("log_1", "a"))


def _wave_sql():
    low = [(3 - k, f"({v!r}e0)".replace("e0)", ")")) for k, v in enumerate(L.COIF1_LOW)]
    high = [(3 - k, f"({v!r})") for k, v in enumerate(L.COIF1_HIGH)]
    out, bands = DENSE, {"": "dn"}
    for axis in "xyz":
        nxt = {}
        for name, src in bands.items():
            for tag, taps in (("L", low), ("H", high)):
                out += conv_sql(f"w{name}{tag}", src, axis, [(k, f"{w}::DOUBLE") for k, w in taps], "wrap")
                nxt[name + tag] = f"w{name}{tag}"
        bands = nxt
    return out + " ".join((" UNION ALL" if i else "") + f" SELECT patient_id, '{n}' AS band, round(sum(v * v), 2) AS energy FROM {t} GROUP BY 1" for i, (n, t) in enumerate(bands.items()))


@query("X-11", S.cte("ct meta", _wave_sql()))
def x_wavelet(spark, sf):
    rows = L.wavelet8(_dense(spark, sf)[0], energy=True)
    bands = [c for c in rows.columns if c not in ("patient_id", "z", "y")]
    return rows.groupBy("patient_id").agg(*[F.round(F.sum(c), 2).alias(c) for c in bands]).unpivot(["patient_id"], bands, "band", "energy")


def _lin(name, src, a, target):
    keep = ", ".join(f"s.{c}" for c in ("z", "y", "x") if c != a)
    on = " AND ".join(f"{{q}}.{c} = s.{c}" for c in ("z", "y", "x") if c != a)
    return f""", {name} AS (SELECT s.patient_id, {keep}, s.j AS {a}, CASE WHEN t <= n{a} - 0.5e0 THEN p.v + (q.v - p.v) * CASE WHEN i + 1 < n{a} THEN t - i ELSE 0 END ELSE -1024 END AS v, dx, dy, dz, nx, ny, nz FROM
 (SELECT *, j * {target} / d{a} AS t, CAST(floor(j * {target} / d{a} + 1e-9) AS INTEGER) AS i FROM (SELECT *, unnest(range(greatest(1, CAST(round_even(n{a} * d{a} / {target}, 0) AS INTEGER)))) AS j FROM {src} WHERE {a} = 0)) s
 JOIN (SELECT patient_id, z, y, x, v FROM {src}) p ON p.patient_id = s.patient_id AND p.{a} = least(i, n{a} - 1) AND {on.format(q='p')} JOIN (SELECT patient_id, z, y, x, v FROM {src}) q ON q.patient_id = s.patient_id AND q.{a} = least(i + 1, n{a} - 1) AND {on.format(q='q')})"""


@query("X-12", S.cte("ct meta", DENSE + _lin("a", "dn", "x", "0.8e0") + _lin("b", "a", "y", "0.8e0") + _lin("c", "b", "z", "0.8e0") + SLICES.format(t="c")))
def x_regrid(spark, sf):
    return _slices(L.regrid_linear(_dense(spark, sf)[0], 0.8))


@query("X-13", S.cte("mask meta", """+, t AS (SELECT patient_id, roi, z, y, x, dx, dy, dz, nx, ny, nz FROM mask JOIN meta USING (patient_id)), r AS (SELECT range AS i FROM range(64)),
 zz AS (SELECT t.*, r.i AS tz FROM t JOIN r ON floor(r.i * 0.8e0 / dz + 0.5e0 + 1e-9) = z AND r.i < round_even(nz * dz / 0.8e0, 0)),
 yy AS (SELECT zz.*, r.i AS ty FROM zz JOIN r ON floor(r.i * 0.8e0 / dy + 0.5e0 + 1e-9) = y AND r.i < round_even(ny * dy / 0.8e0, 0)),
 xx AS (SELECT yy.*, r.i AS tx FROM yy JOIN r ON floor(r.i * 0.8e0 / dx + 0.5e0 + 1e-9) = x AND r.i < round_even(nx * dx / 0.8e0, 0))
 SELECT patient_id, roi, count(*) AS n, CAST(sum(tz * 10000 + ty * 100 + tx) AS BIGINT) AS checksum FROM xx GROUP BY 1, 2"""))
def x_nearest(spark, sf):
    return L.regrid_nearest(S.mask(spark, sf), S.meta(spark, sf), 0.8).groupBy("patient_id", "roi").agg(
        F.count("*").alias("n"), F.sum(F.col("z") * 10000 + F.col("y") * 100 + F.col("x")).alias("checksum"))


@query("X-14", S.cte("mask", """+, i AS (SELECT DISTINCT patient_id, roi FROM mask), c AS (SELECT unnest(['firstorder', 'shape', 'glcm', 'glrlm', 'glszm']) AS cls), f AS (SELECT unnest(['original', 'wavelet', 'log-sigma-1']) AS filter)
 SELECT patient_id, roi, cls, filter FROM i, c, f WHERE CASE WHEN contains(roi, 'vessel') THEN cls = 'firstorder' AND filter = 'original' ELSE cls <> 'shape' OR filter = 'original' END"""))
def x_plan(spark, sf):
    return X.extract_plan(S.mask(spark, sf).select("patient_id", "roi").distinct(), "fast")


@query("X-15", S.cte("ct mask meta", """+, m AS (SELECT patient_id, roi, count(*) AS n, avg(hu) AS mean FROM mask JOIN ct USING (patient_id, z, y, x) GROUP BY 1, 2)
 SELECT patient_id, roi || '::original_firstorder_Mean' AS feature, round(mean, 6) AS value FROM m UNION ALL SELECT patient_id, roi || '::original_n', -n FROM m WHERE roi = 'heart' UNION ALL SELECT patient_id, roi || '::original_n', n FROM m WHERE roi <> 'heart'"""))
def x_assemble(spark, sf):
    m = S.mask(spark, sf).join(S.ct(spark, sf), ["patient_id", "z", "y", "x"]).groupBy("patient_id", "roi").agg(F.count("*").cast("double").alias("n"), F.avg("hu").alias("Mean"))
    late = m.where("roi = 'heart'").select("patient_id", "roi", (-F.col("n")).alias("n"))
    parts = [X.to_facts(m.select("patient_id", "roi", "Mean"), "original_firstorder"), X.to_facts(m.select("patient_id", "roi", "n"), "original"), X.to_facts(late, "original", 1)]
    return rounded(X.assemble_patient(parts))
