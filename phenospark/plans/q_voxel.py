"""Queries over voxel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.operators import components as K
from phenospark.operators import voxel as V
from phenospark.plans import standin as S
from phenospark.plans.q_profile import REACH, TOUCH26, rounded
from phenospark.plans.registry import query

LOBE_IN = "('" + "','".join(V.LOBES) + "')"
LOBE_CASE = "CASE roi " + " ".join(f"WHEN '{r}' THEN '{k}'" for r, k in V.LOBES.items()) + " END"
VV = "dx * dy * dz"


def _tabs(spark, sf):
    return S.ct(spark, sf), S.mask(spark, sf), S.meta(spark, sf)


@query("V-01", S.cte("ct mask meta", f"""+, g AS (SELECT patient_id, {LOBE_CASE} AS lobe, count(*) FILTER (hu < -950) / count(*) * 100 AS laa, quantile_cont(hu, 0.15) AS p15, count(*) AS n
 FROM mask JOIN ct USING (patient_id, z, y, x) WHERE roi IN {LOBE_IN} GROUP BY 1, 2)
 SELECT patient_id, lobe, round(laa, 6) AS LAA950_pct, round(p15, 6) AS Perc15_HU, round(n * {VV}, 6) AS Volume_mm3,
 round(n * {VV} / sum(n * {VV}) OVER (PARTITION BY patient_id), 6) AS Vol_pct_of_lung FROM g JOIN meta USING (patient_id)"""))
def v_lobes(spark, sf):
    return rounded(V.lobe_emphysema(*_tabs(spark, sf)))


def _count(roi):
    return f"count(*) FILTER (roi = '{roi}')"


@query("V-02", S.cte("mask meta", f"""+, c AS (SELECT patient_id, {_count('pulmonary_artery')} AS pa, {_count('aorta')} AS ao, {_count('heart_ventricle_right')} AS rv, {_count('heart_ventricle_left')} AS lv FROM mask GROUP BY 1)
 SELECT patient_id, round(CASE WHEN pa > 0 AND ao > 0 THEN pow(pa / ao, 1 / 3e0) END, 6) AS PA_Ao_Diameter_Ratio, round(CASE WHEN pa > 0 AND ao > 0 THEN pa / ao END, 6) AS PA_Ao_Volume_Ratio,
 round(CASE WHEN lv > 0 THEN rv / lv END, 6) AS RV_LV_Volume_Ratio, round(rv * {VV}, 6) AS RV_Volume_mm3, round(lv * {VV}, 6) AS LV_Volume_mm3 FROM c JOIN meta USING (patient_id)"""))
def v_heart(spark, sf):
    return rounded(V.heart_ratios(S.mask(spark, sf), S.meta(spark, sf)))


@query("V-03", S.cte("ct mask meta", f"""+, c AS (SELECT patient_id, count(*) FILTER (hu > 130 AND hu < 3000) AS n FROM mask JOIN ct USING (patient_id, z, y, x) WHERE roi = 'heart' GROUP BY 1)
 SELECT patient_id, round(n * {VV}, 6) AS CAC_Volume_mm3 FROM c JOIN meta USING (patient_id)"""))
def v_calcium(spark, sf):
    return rounded(V.calcium_volume(*_tabs(spark, sf)))


# all lines near the heart count as heart here, so that slices hold lesions of several voxels
HEART_SQL = "SELECT DISTINCT patient_id, 'heart' AS roi, z, y, x FROM mask WHERE roi LIKE 'heart%' OR roi LIKE 'lung%'"


def _heart(spark, sf):
    m = S.mask(spark, sf)
    return m.where("roi like 'heart%' or roi like 'lung%'").select("patient_id", F.lit("heart").alias("roi"), "z", "y", "x").distinct()


@query("V-04", S.cte("ct mask meta", f"+/*RECURSE*/, h AS ({HEART_SQL}), v AS (SELECT ct.*, z * 1048576 + y * 1024 + x AS k FROM h JOIN ct USING (patient_id, z, y, x) WHERE hu >= 130)"
                    + REACH.format(touch="w.z = v.z AND abs(w.y - v.y) + abs(w.x - v.x) <= 1") + f""",
 les AS (SELECT patient_id, component, count(*) AS n, max(hu) AS peak, sum(hu) AS total FROM comp JOIN v USING (patient_id, k) GROUP BY 1, 2),
 s AS (SELECT patient_id, sum(n * CASE WHEN peak < 200 THEN 1 WHEN peak < 300 THEN 2 WHEN peak < 400 THEN 3 ELSE 4 END)::DOUBLE AS a, sum(total)::DOUBLE AS t, sum(n)::DOUBLE AS n FROM les GROUP BY 1)
 SELECT patient_id, round(coalesce(a, 0) * dx * dy, 5) AS CAC_Agatston, round(coalesce(t, 0) * {VV} / 1000 / 110, 5) AS CAC_Mass_mg, round(coalesce(n, 0) * {VV}, 5) AS CAC_Volume_mm3
 FROM (SELECT DISTINCT patient_id FROM h) LEFT JOIN s USING (patient_id) JOIN meta USING (patient_id)"""))
def v_agatston(spark, sf):
    return rounded(V.agatston(S.ct(spark, sf), _heart(spark, sf), S.meta(spark, sf)), 5)


@query("V-05", S.cte("ct mask meta", f"""+, h AS (SELECT patient_id, z, y, x, greatest(1, CAST(round_even(8 / dz, 0) AS INTEGER)) AS s FROM mask JOIN meta USING (patient_id) WHERE roi = 'heart'),
 f AS (SELECT * FROM ct WHERE hu BETWEEN -190 AND -30),
 n AS (SELECT DISTINCT f.* FROM f JOIN h ON f.patient_id = h.patient_id AND f.z - h.z BETWEEN -(s // 2) AND s - 1 - s // 2 AND abs(f.y - h.y) <= 1 AND abs(f.x - h.x) <= 1),
 n3 AS (SELECT DISTINCT f.* FROM f JOIN h ON f.patient_id = h.patient_id AND f.z = h.z AND abs(f.y - h.y) <= 1 AND abs(f.x - h.x) <= 1)
 SELECT patient_id, round(coalesce(a.c, 0) * {VV}, 6) AS EpiFat_Volume_mm3, round(a.m, 6) AS EpiFat_Mean_HU, round(b.m, 6) AS FAI_pericoronary_HU FROM (SELECT DISTINCT patient_id FROM h) JOIN meta USING (patient_id)
 LEFT JOIN (SELECT patient_id, count(*) AS c, avg(hu) AS m FROM n GROUP BY 1) a USING (patient_id) LEFT JOIN (SELECT patient_id, avg(hu) AS m FROM n3 GROUP BY 1) b USING (patient_id)"""))
def v_fat(spark, sf):
    return rounded(V.epicardial_fat(*_tabs(spark, sf)))


AORTA_SQL = "SELECT DISTINCT patient_id, 'aorta' AS roi, z // 4 AS z, y // 4 AS y, x // 4 AS x FROM mask"


def _aorta(spark, sf):
    return S.mask(spark, sf).select("patient_id", F.lit("aorta").alias("roi"), *[F.floor(F.col(a) / 4).cast("int").alias(a) for a in ("z", "y", "x")]).distinct()


@query("V-06", S.cte("mask meta", f"""+, a AS ({AORTA_SQL}), m AS (SELECT a.*, {VV} AS vv, greatest(1, CAST(round_even(2 / dz, 0) AS INTEGER)) AS s FROM a JOIN meta USING (patient_id)),
 e AS (SELECT m.patient_id, m.z, m.y, m.x, any_value(m.s) AS s, count(*) AS c FROM m JOIN a ON a.patient_id = m.patient_id AND abs(a.y - m.y) <= 1 AND abs(a.x - m.x) <= 1
   AND a.z - m.z BETWEEN -(m.s // 2) AND m.s - 1 - m.s // 2 GROUP BY 1, 2, 3, 4),
 v AS (SELECT patient_id, count(*) AS n, count(DISTINCT z) AS sl, any_value(vv) AS vv FROM m GROUP BY 1),
 i AS (SELECT patient_id, count(*) AS n_in FROM e WHERE c = 9 * s GROUP BY 1),
 d AS (SELECT patient_id, 2 * sqrt(n * vv / (pi() * sl)) AS d, 1 - coalesce(n_in, 0) * vv / (n * vv) AS f FROM v LEFT JOIN i USING (patient_id))
 SELECT patient_id, round(d, 6) AS Aorta_Outer_Mean_Diameter_mm, round(f, 6) AS Aorta_Wall_Fraction, round(f * d / 2, 6) AS Aorta_Wall_Thickness_mm_approx FROM d"""))
def v_aorta(spark, sf):
    return rounded(V.aorta_wall(_aorta(spark, sf), S.meta(spark, sf)))


@query("V-07", S.cte("mask meta", f"""+, g AS (SELECT patient_id, roi, count(*) AS n, count(DISTINCT z) AS s FROM mask GROUP BY 1, 2)
 SELECT patient_id, roi, round(n * {VV}, 6) AS Volume_mm3, round(n * {VV} / s, 6) AS CSA_mean_mm2, round(2 * sqrt(n * {VV} / (pi() * s)), 6) AS Equivalent_Diameter_mm FROM g JOIN meta USING (patient_id)"""))
def v_diameter(spark, sf):
    return rounded(V.equivalent_diameter(S.mask(spark, sf), S.meta(spark, sf)))


@query("V-08", S.cte("mask", """+, p AS (SELECT patient_id, z, count(DISTINCT x) FILTER (roi = 'heart') AS h, count(DISTINCT x) FILTER (starts_with(roi, 'lung_')) AS l FROM mask GROUP BY 1, 2)
 SELECT patient_id, round(max(CASE WHEN h > 0 AND l > 0 THEN h / l END), 9) AS CardioThoracic_Ratio FROM p
 WHERE patient_id IN (SELECT patient_id FROM mask WHERE roi = 'heart' OR starts_with(roi, 'lung_')) GROUP BY 1"""))
def v_ctr(spark, sf):
    return rounded(V.cardiothoracic_ratio(S.mask(spark, sf)), 9)


@query("V-09", S.cte("mask meta", f"""SELECT patient_id, round(count(*) * any_value({VV}), 6) AS Vessel_Volume_mm3, round(count(*) * any_value({VV}) / count(DISTINCT z), 6) AS Vessel_CSA_mean_mm2
 FROM mask JOIN meta USING (patient_id) WHERE roi = 'lung_vessels' GROUP BY 1"""))
def v_vessel(spark, sf):
    return rounded(V.vessel_volume_csa(S.mask(spark, sf), S.meta(spark, sf)))


@query("V-10", S.cte("mask meta", f"""+, a AS (SELECT patient_id, z, y, x FROM mask WHERE roi = 'lung_trachea_bronchia'), t AS (SELECT patient_id, count(*) AS n FROM a GROUP BY 1),
 j AS (SELECT patient_id, roi, count(*) AS c FROM a JOIN mask USING (patient_id, z, y, x) WHERE roi IN {LOBE_IN} GROUP BY 1, 2)
 SELECT t.patient_id, round(n * {VV}, 6) AS Airway_Total_Volume_mm3, """ + ", ".join(
    f"round(coalesce((SELECT c FROM j WHERE j.patient_id = t.patient_id AND roi = '{r}'), 0) / n * 100, 6) AS Airway_Lobe_{k}_Volume_pct" for r, k in V.LOBES.items())
    + " FROM t JOIN meta USING (patient_id)"))
def v_coupling(spark, sf):
    return rounded(V.airway_lobe_coupling(S.mask(spark, sf), S.meta(spark, sf)))


@query("V-11", S.cte("mask", """+, l AS (SELECT * FROM mask WHERE roi LIKE 'lung_lower%'), b AS (SELECT patient_id, roi, max(z) AS z FROM l GROUP BY 1, 2)
 SELECT patient_id, roi, round(count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 9) AS fill_ratio FROM l JOIN b USING (patient_id, roi, z) GROUP BY 1, 2"""))
def v_diaphragm(spark, sf):
    return rounded(V.diaphragm_fill(S.mask(spark, sf)), 9)


@query("V-12", S.cte("ct meta", """+, s AS (SELECT patient_id, unnest([4, 8, 16]) AS s FROM meta), n AS (SELECT patient_id, s, count(DISTINCT (z // s, y // s, x // s)) AS n FROM ct JOIN s USING (patient_id) GROUP BY 1, 2)
 SELECT patient_id, round(-regr_slope(ln(n), ln(s)), 6) AS fractal_dimension FROM n GROUP BY 1"""))
def v_fractal(spark, sf):
    return rounded(V.box_fractal_dimension(S.ct(spark, sf), ["patient_id"], meta=S.meta(spark, sf)))


@query("V-12b", S.cte("mask", """+, b AS (SELECT patient_id, roi, min(z) AS z0, min(y) AS y0, min(x) AS x0 FROM mask GROUP BY 1, 2),
 n AS (SELECT patient_id, roi, s, count(DISTINCT ((z - z0) // s, (y - y0) // s, (x - x0) // s)) AS n FROM (SELECT *, unnest([2, 4, 8, 16, 32]) AS s FROM mask JOIN b USING (patient_id, roi)) GROUP BY 1, 2, 3)
 SELECT patient_id, roi, round(-regr_slope(ln(n), ln(s)), 6) AS fractal_dimension FROM n GROUP BY 1, 2"""))
def v_fractal_box(spark, sf):
    return rounded(V.box_fractal_dimension(S.mask(spark, sf), ["patient_id", "roi"]))


@query("V-13", S.cte("mask meta", f"""+, a AS ({AORTA_SQL}), o AS (SELECT i.i AS dz, j.i AS dy, k.i AS dx FROM (SELECT unnest([-1, 0, 1]) AS i) i, (SELECT unnest([-1, 0, 1]) AS i) j, (SELECT unnest([-1, 0, 1]) AS i) k),
 d AS (SELECT DISTINCT patient_id, z + dz AS z, y + dy AS y, x + dx AS x FROM a, o),
 e AS (SELECT patient_id, z - dz AS z, y - dy AS y, x - dx AS x FROM a, o GROUP BY 1, 2, 3, 4 HAVING count(*) = 27)
 SELECT patient_id, 'dilated' AS op, z, y, x FROM d UNION ALL SELECT patient_id, 'eroded', z, y, x FROM e"""))
def v_morphology(spark, sf):
    a = _aorta(spark, sf).select(*V.VOX)
    box = {"z": 3, "y": 3, "x": 3}
    d = V.dilate(a, V.VOX, box).withColumn("op", F.lit("dilated"))
    return d.unionByName(V.erode(a, V.VOX, box).withColumn("op", F.lit("eroded")))


@query("V-14", S.cte("skeleton", "+/*RECURSE*/, v AS (SELECT *, z * 1048576 + y * 1024 + x AS k FROM skeleton)" + REACH.format(touch=TOUCH26)
                    + ", s AS (SELECT patient_id, component, count(*) AS size FROM comp GROUP BY 1, 2) SELECT patient_id, size, count(*) AS n FROM s GROUP BY 1, 2"))
def v_components(spark, sf):
    c = K.connected_components(S.skeleton(spark, sf), ["patient_id"], 26)
    return c.groupBy("patient_id", "component").agg(F.sum("n").alias("size")).groupBy("patient_id", "size").agg(F.count("*").alias("n"))


EDT = """+, v AS (SELECT patient_id, z, y, x, {sx} AS sx, {sy} AS sy, {sz} AS sz, nx, ny, nz, dx * dy * dz AS vv FROM mask JOIN meta USING (patient_id) WHERE roi = 'lung_vessels'),
 r AS (SELECT unnest(range(-4, 5)) AS i), o AS (SELECT a.i AS oz, b.i AS oy, c.i AS ox FROM r a, r b, r c),
 c AS (SELECT v.*, sqrt(pow(oz * sz, 2) + pow(oy * sy, 2) + pow(ox * sx, 2)) AS d, z + oz AS bz, y + oy AS by_, x + ox AS bx FROM v, o WHERE pow(oz * sz, 2) + pow(oy * sy, 2) + pow(ox * sx, 2) < 3.2e0),
 g AS (SELECT * FROM c WHERE bz BETWEEN 0 AND nz - 1 AND by_ BETWEEN 0 AND ny - 1 AND bx BETWEEN 0 AND nx - 1
   AND NOT EXISTS (SELECT 1 FROM v w WHERE w.patient_id = c.patient_id AND w.z = bz AND w.y = by_ AND w.x = bx)),
 e AS (SELECT v.patient_id, v.z, v.y, v.x, any_value(v.vv) AS vv, min(d) AS r FROM v LEFT JOIN g USING (patient_id, z, y, x) GROUP BY 1, 2, 3, 4)"""


@query("V-15", S.cte("mask meta", EDT.format(sx="least(dx, dy)", sy="least(dx, dy)", sz="least(dx, dy)") + f""" SELECT patient_id, round(count(*) FILTER (r < {V.R5!r}e0) / count(*) * 100, 6) AS Vessel_BV5_pct,
 round(count(*) FILTER (r < {V.R10!r}e0) / count(*) * 100, 6) AS Vessel_BV10_pct FROM e GROUP BY 1"""))
def v_small_vessels(spark, sf):
    return rounded(V.small_vessel_fraction(S.mask(spark, sf), S.meta(spark, sf)))


@query("V-15b", S.cte("mask meta", EDT.format(sx="dx", sy="dy", sz="dz") + f""", l AS (SELECT patient_id, count(DISTINCT (z, y, x)) AS n FROM mask WHERE roi IN {LOBE_IN} GROUP BY 1)
 SELECT patient_id, round(count(*) FILTER (r <= 1.2615e0) * any_value(vv), 6) AS BV5_Volume_mm3, round(count(*) FILTER (r <= 1.2615e0) / any_value(n), 6) AS BV5_LV_Ratio FROM e LEFT JOIN l USING (patient_id) GROUP BY 1"""))
def v_small_vessels_true(spark, sf):
    return rounded(V.small_vessel_fraction(S.mask(spark, sf), S.meta(spark, sf), spacing="true"))


DEGREE = """+, d AS (SELECT a.patient_id, a.z, a.y, a.x, count(*) - 1 AS deg FROM skeleton a JOIN skeleton b ON a.patient_id = b.patient_id AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3, 4)"""


@query("V-16", S.cte("skeleton meta", DEGREE + """ SELECT patient_id, count(*) AS Vessel_Skeleton_Voxels, count(*) FILTER (deg >= 3) AS Vessel_Junction_Count, count(*) FILTER (deg = 1) AS Vessel_Endpoint_Count,
 round(count(*) * any_value(dx + dy + dz) / 3, 6) AS Vessel_Skeleton_Length_mm, round(count(*) FILTER (deg >= 3) / (count(*) * any_value(dx + dy + dz) / 3), 6) AS Vessel_Branching_Density_per_mm
 FROM d JOIN meta USING (patient_id) GROUP BY 1"""))
def v_nodes(spark, sf):
    return rounded(V.skeleton_nodes(S.skeleton(spark, sf), S.meta(spark, sf)))


@query("V-17")
def v_segments(spark, sf):
    return rounded(V.skeleton_segments(S.skeleton(spark, sf), S.meta(spark, sf)))


@query("V-18", S.cte("ct mask meta", f"""+, u AS (SELECT DISTINCT patient_id, z, y, x FROM mask WHERE roi IN {LOBE_IN})
 SELECT patient_id, round(count(*) FILTER (hu < -950) / count(*) * 100, 6) AS Lung_LAA950_pct, round(quantile_cont(hu, 0.15), 6) AS Lung_Perc15_HU, round(count(*) * any_value({VV}), 6) AS Lung_Volume_mm3
 FROM u JOIN ct USING (patient_id, z, y, x) JOIN meta USING (patient_id) GROUP BY 1"""))
def v_union(spark, sf):
    return rounded(V.union_lung(*_tabs(spark, sf)))


LAYERS = ["heart", "heart_myocardium", "heart_atrium_left", "heart_atrium_right", "heart_ventricle_left", "heart_ventricle_right"]


@query("V-19", S.cte("mask", "SELECT patient_id, z, y, x, CAST(max(CASE roi " + " ".join(f"WHEN '{r}' THEN {i + 1}" for i, r in enumerate(LAYERS))
                    + " END) AS INTEGER) AS label FROM mask WHERE roi IN ('" + "','".join(LAYERS) + "') GROUP BY 1, 2, 3, 4"))
def v_merge(spark, sf):
    return V.multi_label_merge(S.mask(spark, sf), LAYERS)


@query("V-20", S.cte("ct", "SELECT patient_id, count(*) FILTER (hu < -900) AS clipped, min(greatest(hu, -900)) AS min_hu, CAST(sum(greatest(hu, -900)) AS BIGINT) AS total FROM ct GROUP BY 1"))
def v_clip(spark, sf):
    return V.clip_floor(S.ct(spark, sf), -900).groupBy("patient_id").agg(
        F.count_if("clipped").alias("clipped"), F.min("hu").alias("min_hu"), F.sum("hu").alias("total"))


@query("V-21", S.cte("ct", "SELECT patient_id, CAST(floor((hu + 1024) / 25) * 25 - 1024 AS BIGINT) AS bin, count(*) AS n FROM ct GROUP BY 1, 2"))
def v_discretize(spark, sf):
    return S.ct(spark, sf).groupBy("patient_id", V.discretize(F.col("hu")).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query("V-22", S.cte("ct", """+, r AS (SELECT patient_id, min(hu) AS lo, max(hu) AS hi FROM ct GROUP BY 1) SELECT patient_id, z, y, x, round((least(greatest(hu, -1000), 400) + 1000) / 1400 * 255, 6) AS windowed,
 round(coalesce((hu - lo) / nullif(hi - lo, 0), 0), 6) AS scaled FROM ct JOIN r USING (patient_id)"""))
def v_window(spark, sf):
    return rounded(V.minmax(S.ct(spark, sf)).select("patient_id", "z", "y", "x", V.window_level(F.col("hu"), -1000, 400).alias("windowed"), "scaled"))


@query("V-23", S.cte("ct mask", """+, b AS (SELECT patient_id, greatest(min(z) - 2, 0) AS z0, least(max(z) + 2, 15) AS z1, greatest(min(y) - 2, 0) AS y0, least(max(y) + 2, 15) AS y1,
 greatest(min(x) - 2, 0) AS x0, least(max(x) + 2, 15) AS x1 FROM mask WHERE roi = 'heart' GROUP BY 1)
 SELECT patient_id, count(*) AS n, CAST(sum(hu) AS BIGINT) AS total FROM ct JOIN b USING (patient_id) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY 1"""))
def v_crop(spark, sf):
    m = S.mask(spark, sf).where("roi = 'heart'")
    return V.crop(S.ct(spark, sf), V.bounding_box(m, ["patient_id"], S.meta(spark, sf), 2)).groupBy("patient_id").agg(
        F.count("*").alias("n"), F.sum("hu").alias("total"))
