"""Queries over profiles, missing data, imputation, scaling and branch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.operators import airway as A
from phenospark.operators import catalog as G
from phenospark.operators import components as V
from phenospark.operators import profile as Q
from phenospark.plans import standin as S
from phenospark.plans.q_rules import BLOCK_SQL
from phenospark.plans.q_tables import CLIN_LONG
from phenospark.plans.registry import query


def rounded(df, digits=6, **per):
    return df.select(*[F.round(c, per.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("Q-01", S.cte("clinical", f"""+, x AS ({CLIN_LONG.replace('text', 'text').replace('AS feature', 'AS column_')}),
 p AS (SELECT column_, count(text) AS non_null, count(*) AS total, count(DISTINCT text) AS n_distinct,
  coalesce(bool_and(TRY_CAST(text AS DOUBLE) IS NOT NULL) FILTER (text IS NOT NULL), FALSE) AS is_numeric FROM x GROUP BY 1),
 m AS (SELECT *, 1 - non_null / total AS missing_rate FROM p)
 SELECT column_ AS "column", non_null, total, n_distinct, is_numeric, round(missing_rate, 9) AS missing_rate,
 CASE WHEN missing_rate > 0.5 THEN '排除' WHEN missing_rate > 0.2 THEN '谨慎使用' WHEN n_distinct = 1 THEN '排除' WHEN is_numeric AND n_distinct >= 5 THEN '连续自变量'
  WHEN is_numeric THEN '有序/分类自变量' WHEN n_distinct = 2 THEN '二分类变量' WHEN n_distinct <= 10 THEN '分类自变量' ELSE '文本变量' END AS role FROM m"""))
def q_profile(spark, sf):
    texts = S.clinical(spark, sf).unpivot(["k"], ["tni", "bnp", "age", "icd"], "column", "text")
    return rounded(Q.order_by_role(Q.profile_columns(texts)), 9)


# a wider null pattern: cells of some features are blanked by value
HOLES = """+, h AS (SELECT patient_id, cohort, feature, CASE WHEN feature = 'info_returned' THEN NULL WHEN feature = 'Vessel_BV5_pct' AND value > 35 THEN NULL
 WHEN feature = 'TD_ratio_all' AND value > 12 THEN NULL ELSE value END AS value FROM fact)"""


def _holes(spark, sf):
    f, v = F.col("feature"), F.col("value")
    hole = (f == "info_returned") | ((f == "Vessel_BV5_pct") & (v > 35)) | ((f == "TD_ratio_all") & (v > 12))
    return S.fact(spark, sf).select("patient_id", "cohort", "feature", F.when(~F.coalesce(hole, F.lit(False)), v).alias("value"))


@query("Q-02", S.cte("fact", HOLES + f""", r AS (SELECT feature, count(*) FILTER (value IS NULL) / count(*) AS rate FROM h GROUP BY 1)
 SELECT {BLOCK_SQL} AS block, CASE WHEN rate >= 1 THEN 'all' WHEN rate > 0.5 THEN 'over_50' WHEN rate >= 0.1 THEN '10_to_50' ELSE 'under_10' END AS band,
 count(*) AS features FROM r GROUP BY 1, 2"""))
def q_bands(spark, sf):
    return Q.column_missing_bands(_holes(spark, sf), G.feature_block(F.col("feature")))


@query("Q-03", S.cte("fact", HOLES + """, r AS (SELECT patient_id, count(*) FILTER (value IS NULL) / count(*) AS rate FROM h GROUP BY 1)
 SELECT round(median(rate), 9) AS median_rate, round(max(rate), 9) AS max_rate, count(*) FILTER (rate = 1) AS all_null, count(*) FILTER (rate > 0.5) AS over_half FROM r"""))
def q_rows(spark, sf):
    return rounded(Q.row_missing(_holes(spark, sf)), 9)


@query("Q-04", S.cte("fact", HOLES + f""", r AS (SELECT {BLOCK_SQL} AS block, patient_id, count(*) FILTER (value IS NULL) / count(*) AS rate FROM h GROUP BY 1, 2)
 SELECT block, count(*) FILTER (rate > 0.5) AS patients FROM r GROUP BY 1"""))
def q_block_rows(spark, sf):
    return Q.block_missing(_holes(spark, sf), G.feature_block(F.col("feature")))


@query("Q-05", S.cte("obs", """+, p AS (SELECT DISTINCT cohort, patient_id FROM obs)
 SELECT cohort, patient_id, 'no CAC' AS reason FROM p WHERE patient_id NOT IN (SELECT patient_id FROM obs WHERE feature = 'CAC_Agatston')
 UNION ALL SELECT cohort, patient_id, 'no Pi10' FROM p WHERE patient_id NOT IN (SELECT patient_id FROM obs WHERE feature = 'Pi10')"""))
def q_rerun(spark, sf):
    o = S.obs(spark, sf)
    p = o.select("cohort", "patient_id").distinct()
    lacks = lambda f: p.join(o.where(F.col("feature") == f).select("patient_id"), "patient_id", "left_anti")
    return Q.rerun_list({"no CAC": lacks("CAC_Agatston"), "no Pi10": lacks("Pi10")})


JOBS = {r: ("vessels" if r == "lung_vessels" else "heart_parts" if r.startswith("heart_") else "total") for r in S.ROIS}
PRESENT = """SELECT DISTINCT c.c_custkey AS patient_id, {pick} AS roi FROM {{customer}} c JOIN {{orders}} o ON o.o_custkey = c.c_custkey""".format(
    pick=S._pick("o.o_orderkey % 16", S.ROIS))


@query("Q-06", f"""WITH parts AS ({PRESENT.format(customer='customer', orders='orders')}), req AS (SELECT unnest(['{"','".join(S.ROIS)}']) AS roi),
 m AS (SELECT c_custkey AS patient_id, roi, CASE WHEN roi = 'lung_vessels' THEN 'vessels' WHEN roi LIKE 'heart\\_%' ESCAPE '\\' THEN 'heart_parts' ELSE 'total' END AS job
  FROM customer, req WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.patient_id = c_custkey AND p.roi = req.roi))
 SELECT patient_id, string_agg(roi, ',' ORDER BY roi) AS missing, CAST(count(*) AS INTEGER) AS n_missing, string_agg(DISTINCT job, ',' ORDER BY job) AS jobs FROM m GROUP BY 1""")
def q_parts(spark, sf):
    patients = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id"))
    return Q.missing_parts(patients, S._run(spark, sf, PRESENT), S.ROIS, JOBS)


@query("Q-07", S.cte("fact", HOLES + """, s AS (SELECT feature, count(*) FILTER (value IS NULL) / count(*) AS missing, stddev_samp(value) AS sd FROM h GROUP BY 1)
 SELECT feature, round(missing, 9) AS missing, CASE WHEN missing > 0.3 THEN 'missing' WHEN coalesce(sd, 0) < 1e-6 THEN 'const' END AS reason FROM s"""))
def q_drop(spark, sf):
    return rounded(Q.drop_features(_holes(spark, sf)).drop("sd"), 9)


@query("Q-08", S.cte("fact", HOLES + """ SELECT feature, count(value) AS n_obs FROM h GROUP BY 1
 HAVING count(value) >= greatest(20, 0.5 * count(*)) AND max(value) > min(value)"""))
def q_usable(spark, sf):
    return Q.usable_features(_holes(spark, sf))


@query("Q-09", S.cte("fact", """+, m AS (SELECT feature, median(value) AS med FROM fact WHERE cohort <> 'ASIA' GROUP BY 1)
 SELECT patient_id, feature, round(coalesce(value, med, 0), 6) AS value FROM fact LEFT JOIN m USING (feature)"""))
def q_impute(spark, sf):
    f = S.fact(spark, sf).select("patient_id", "cohort", "feature", "value")
    med = Q.fit_medians(f.where("cohort <> 'ASIA'"))
    return rounded(Q.median_impute(f, med).select("patient_id", "feature", "value"))


@query("Q-10", S.cte("fact", """SELECT patient_id, 'missing::' || feature AS feature, CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END AS value FROM fact
 WHERE feature IN (SELECT feature FROM fact WHERE value IS NULL)"""))
def q_indicator(spark, sf):
    return Q.missing_indicator(S.fact(spark, sf).select("patient_id", "feature", "value"))


@query("Q-11", S.cte("obs", """+, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3 FROM obs GROUP BY 1)
 SELECT patient_id, feature, round((value - m) / s, 5) AS standard, round((value - q2) / CASE WHEN q3 > q1 THEN q3 - q1 ELSE 1 END, 5) AS robust FROM obs JOIN s USING (feature)"""))
def q_scale(spark, sf):
    o = S.obs(spark, sf).select("patient_id", "feature", "value")
    a = Q.standardize(o, Q.fit_scaler(o)).withColumnRenamed("value", "standard")
    b = Q.standardize(o, Q.fit_scaler(o, "robust")).withColumnRenamed("value", "robust")
    return rounded(a.join(b, ["patient_id", "feature"]), 5)


@query("Q-12", S.cte("ct", """+, s AS (SELECT patient_id, z, count(*) FILTER (hu < -950) AS below, min(hu) AS lo, max(hu) AS hi FROM ct GROUP BY 1, 2)
 SELECT patient_id, CAST(sum(below) AS BIGINT) AS below, arg_max(z, below * 1000 - z) AS worst_slice, min(lo) AS min_hu, max(hi) AS max_hu FROM s GROUP BY 1"""))
def q_outliers(spark, sf):
    return Q.outlier_volume(Q.outlier_slices(S.ct(spark, sf), -950))


@query("Q-13", S.cte("mask", """+, a AS (SELECT patient_id, length(roi) AS label FROM mask), b AS (SELECT patient_id, length(roi) AS label FROM mask WHERE NOT (patient_id % 3 = 0 AND z > 3) AND patient_id % 7 <> 0),
 x AS (SELECT patient_id, list_sort(list(DISTINCT label)) AS s, count(*) AS n FROM a GROUP BY 1), y AS (SELECT patient_id, list_sort(list(DISTINCT label)) AS s, count(*) AS n FROM b GROUP BY 1)
 SELECT patient_id, coalesce(x.s = y.s, FALSE) AS same, x.n IS NOT NULL AND y.n IS NULL AS lost FROM x FULL JOIN y USING (patient_id)"""))
def q_labels(spark, sf):
    m = S.mask(spark, sf).withColumn("label", F.length("roi"))
    return Q.label_set_check(m, m.where("not (patient_id % 3 = 0 and z > 3) and patient_id % 7 <> 0"))


# ---- branch tables -------------------------------------------------------------------------------------------------------

def _sum_sql(cols, std):
    return ", ".join(f"round(avg({c}), 6) AS {c}_mean, round({std}({c}), 6) AS {c}_std" for c in cols)


@query("A-01", S.cte("branch", f"SELECT patient_id, count(*) AS n_branches, {_sum_sql(A.SUMMARY_COLUMNS, 'stddev_samp')} FROM branch GROUP BY 1"))
def a_summary(spark, sf):
    return rounded(A.branch_summary(S.branch(spark, sf)))


@query("A-02", S.cte("branch", "SELECT patient_id, " + ", ".join(
    f"count(*) FILTER (generation BETWEEN {lo} AND {hi}) AS {t}_count, " + ", ".join(
        f"round(avg({c}) FILTER (generation BETWEEN {lo} AND {hi}), 6) AS {t}_{c}_mean" for c in A.LAYER_COLUMNS)
    for t, lo, hi in A.GENERATION_BINS) + " FROM branch GROUP BY 1"))
def a_layers(spark, sf):
    return rounded(A.generation_layers(S.branch(spark, sf)))


TD = "(CASE WHEN Outer_Diameter_mm <> 0 THEN Wall_Thickness_mm / Outer_Diameter_mm END)"


@query("A-03", S.cte("branch", f"""SELECT patient_id, count(*) AS n_branches, round(avg(Inner_Diameter_mm), 6) AS Din_mean_all, round(avg(Outer_Diameter_mm), 6) AS Dout_mean_all,
 round(avg(WA_pct), 6) AS WA_pct_all, round(avg(WA_pct) FILTER (generation BETWEEN 3 AND 6), 6) AS WA_pct_gen3to6, round(avg({TD}), 6) AS TD_ratio_all,
 round(avg(LumenArea_mm2), 6) AS LA_mean_all, round(avg(WallArea_mm2), 6) AS WA_mean_all, round(avg(Pi_Perimeter_mm), 6) AS Pi_mean_all, """ + ", ".join(
    f"round(avg(Inner_Diameter_mm) FILTER (generation = {g}), 6) AS Din_mean_gen{g}, round(avg(WA_pct) FILTER (generation = {g}), 6) AS WA_pct_gen{g}, "
    f"round(avg({TD}) FILTER (generation = {g}), 6) AS TD_ratio_gen{g}" for g in (3, 4, 5)) + " FROM branch GROUP BY 1"))
def a_morphology(spark, sf):
    return rounded(A.morphology(S.branch(spark, sf)))


@query("A-04", S.cte("branch", """SELECT patient_id, max(generation) AS max_generation, round(avg(stats_tortuosity), 6) AS mean_tortuosity, round(stddev_pop(stats_tortuosity), 6) AS std_tortuosity,
 round(avg(stats_parent_deg), 6) AS mean_parent_angle, round(avg(stats_sibling_deg), 6) AS mean_sibling_angle, round(avg(stats_parent_deg) FILTER (generation = 3), 6) AS mean_parent_angle_gen3,
 round(avg(stats_parent_deg) FILTER (generation = 4), 6) AS mean_parent_angle_gen4 FROM branch GROUP BY 1"""))
def a_topology(spark, sf):
    return rounded(A.topology(S.branch(spark, sf)))


@query("A-05", S.cte("branch", """+, b AS (SELECT *, children_1 IS NULL AND children_2 IS NULL AS t FROM branch)
 SELECT patient_id, count(*) FILTER (t) AS n_terminal_total, count(*) FILTER (t AND generation >= 5) AS n_terminal_gen5plus, count(*) FILTER (t AND generation >= 6) AS n_terminal_gen6plus,
 round(count(*) FILTER (t AND generation >= 5) / greatest(1, count(*)), 9) AS pruning_ratio_gen5, round(count(*) FILTER (t AND generation >= 6) / greatest(1, count(*)), 9) AS pruning_ratio_gen6,
 round(avg(WA_pct) FILTER (t), 9) AS mean_WA_pct_terminal FROM b GROUP BY 1"""))
def a_pruning(spark, sf):
    return rounded(A.terminal_pruning(S.branch(spark, sf)), 9)


@query("A-06", S.cte("branch", f"""+, t AS (SELECT patient_id, generation, {TD} AS td FROM branch), x AS (SELECT * FROM t WHERE td IS NOT NULL),
 s AS (SELECT patient_id, avg(td) AS m, stddev_samp(td) AS sd, stddev_samp(td) FILTER (generation >= 5) AS sd5, regr_slope(td, generation) AS sl,
  avg(td) FILTER (generation >= 5) - avg(td) FILTER (generation <= 2) AS dp FROM x GROUP BY 1)
 SELECT patient_id, round(max(sd), 6) AS TD_sd, round(max(sd5), 6) AS TD_sd_gen5plus, round(max(sl), 6) AS TD_slope_generation, round(max(dp), 6) AS TD_distal_minus_proximal,
 round(max(sd / m), 6) AS TD_cv, round(avg(CASE WHEN abs((td - m) / sd) > 2 THEN 1 ELSE 0 END), 6) AS TD_outlier_share FROM x JOIN s USING (patient_id) GROUP BY 1"""))
def a_td(spark, sf):
    return rounded(A.td_change_markers(S.branch(spark, sf)))


@query("A-07", S.cte("branch", """SELECT patient_id, round(CASE WHEN regr_count(Sqrt_WallArea, x) > 5 THEN regr_intercept(Sqrt_WallArea, x) + 10 * regr_slope(Sqrt_WallArea, x) END, 6) AS Pi10
 FROM (SELECT *, CASE WHEN Pi_Perimeter_mm > 0 THEN Pi_Perimeter_mm END AS x FROM branch) GROUP BY 1"""))
def a_pi10(spark, sf):
    return rounded(A.pi10(S.branch(spark, sf)))


@query("A-08", """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 40 * 0.5e0 / (l_partkey % 30 + 1) AS la, l_tax * 10 + 0.5e0 AS wt FROM lineitem),
 b AS (SELECT *, 2 * sqrt(la / pi()) AS din FROM a), c AS (SELECT *, din + 2 * wt AS dout FROM b), d AS (SELECT *, pi() * (pow(dout / 2, 2) - pow(din / 2, 2)) AS wa FROM c)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(la, 5) AS LumenArea_mm2, round(din, 5) AS Inner_Diameter_mm, round(pi() * din, 5) AS Pi_Perimeter_mm, round(dout, 5) AS Outer_Diameter_mm,
 round(wa, 5) AS WallArea_mm2, round(sqrt(wa), 5) AS Sqrt_WallArea, round(100 * wa / (wa + la), 5) AS WA_pct FROM d""")
def a_geometry(spark, sf):
    li = S.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 40).alias("vox"), F.lit(0.5).alias("vv"),
        (F.col("l_partkey") % 30 + 1).alias("len"), (F.col("l_tax") * 10 + 0.5).alias("wt"))
    return rounded(A.branch_geometry(li, "vox", "vv", "len", "wt").drop("vox", "vv", "len", "wt"), 5)


# wall-zone voxels of a branch: distance from the lumen in hundredths, HU falling with it
WALL = """SELECT l_suppkey AS patient_id, l_linenumber AS generation, (l_partkey % 8) AS branch, (l_orderkey * 7 + l_partkey) % 500 / 1e2 AS d,
 floor(l_extendedprice / 2e2) - ((l_orderkey * 7 + l_partkey) % 500) AS hu FROM {lineitem}"""
WALL_CTE = f"""WITH wall AS ({WALL.format(lineitem='lineitem')}),
 seen AS (SELECT patient_id, generation, branch, CAST(least(floor(d / 0.2e0 + 1e-9), 24) AS INTEGER) AS bin, avg(hu) AS seen FROM wall GROUP BY 1, 2, 3, 4),
 grid AS (SELECT * FROM (SELECT DISTINCT patient_id, generation, branch FROM seen), (SELECT CAST(unnest(range(25)) AS INTEGER) AS bin)),
 f AS (SELECT g.*, s.seen FROM grid g LEFT JOIN seen s USING (patient_id, generation, branch, bin)),
 pn AS (SELECT *, max(CASE WHEN seen IS NOT NULL THEN bin END) OVER (PARTITION BY patient_id, generation, branch ORDER BY bin) AS pb,
   min(CASE WHEN seen IS NOT NULL THEN bin END) OVER (PARTITION BY patient_id, generation, branch ORDER BY bin DESC) AS nb FROM f),
 ends AS (SELECT patient_id, generation, branch, list(bin ORDER BY bin) AS bs FROM seen GROUP BY 1, 2, 3),
 ab AS (SELECT pn.*, CASE WHEN pb IS NULL THEN bs[1] WHEN nb IS NULL THEN bs[len(bs) - 1] ELSE pb END AS ab, CASE WHEN pb IS NULL THEN bs[2] WHEN nb IS NULL THEN bs[len(bs)] ELSE nb END AS bb
   FROM pn JOIN ends USING (patient_id, generation, branch)),
 prof AS (SELECT ab.patient_id, ab.generation, ab.branch, ab.bin, coalesce(ab.seen, a.seen + (b.seen - a.seen) * ((ab.bin - a.bin)::DOUBLE / nullif(b.bin - a.bin, 0))) AS hu FROM ab
   LEFT JOIN seen a ON (a.patient_id, a.generation, a.branch, a.bin) = (ab.patient_id, ab.generation, ab.branch, ab.ab)
   LEFT JOIN seen b ON (b.patient_id, b.generation, b.branch, b.bin) = (ab.patient_id, ab.generation, ab.branch, ab.bb)),
 pk AS (SELECT *, first_value(bin) OVER (PARTITION BY patient_id, generation, branch ORDER BY hu DESC, bin) AS pkb, max(hu) OVER (PARTITION BY patient_id, generation, branch) AS pkh
   FROM prof WHERE hu IS NOT NULL),
 lg AS (SELECT *, min(CASE WHEN bin >= pkb THEN hu END) OVER (PARTITION BY patient_id, generation, branch) AS lung FROM pk),
 fw AS (SELECT patient_id, generation, branch, max(pkh) AS peak_hu, max(lung) AS lung_hu, max(pkh) - max(lung) AS contrast,
   min(CASE WHEN bin >= pkb AND hu < (pkh + lung) / 2 THEN bin END) * 0.2e0 + 0.1e0 AS wall_thickness,
   (min(CASE WHEN bin >= pkb AND hu < lung + 0.1e0 * (pkh - lung) THEN bin END) - min(pkb)) * 0.2e0 AS transition_width FROM lg GROUP BY 1, 2, 3)"""
BKEYS = ["patient_id", "generation", "branch"]


def _fwhm(spark, sf):
    prof = A.wall_profile(S._run(spark, sf, WALL), BKEYS)
    return prof, A.fwhm_wall_thickness(prof, BKEYS)


@query("A-09", WALL_CTE + """ SELECT patient_id, generation, branch, round(peak_hu, 5) AS peak_hu, round(lung_hu, 5) AS lung_hu, round(contrast, 5) AS contrast,
 round(wall_thickness, 5) AS wall_thickness, round(transition_width, 5) AS transition_width FROM fw""")
def a_fwhm(spark, sf):
    return rounded(_fwhm(spark, sf)[1], 5)


@query("A-10", WALL_CTE + ", s AS (SELECT *, CASE WHEN transition_width <> 0 THEN contrast / transition_width END AS sharpness FROM fw) SELECT patient_id, " + ", ".join(
    f"round(avg({c}), 7) AS blur_{c}_mean, round(stddev_samp({c}), 7) AS blur_{c}_sd, round(avg({c}) FILTER (generation >= 5), 7) AS blur_{c}_gen5plus"
    for c in ("peak_hu", "lung_hu", "contrast", "transition_width", "sharpness")) + " FROM s GROUP BY 1")
def a_blur(spark, sf):
    return rounded(A.blur_features(_fwhm(spark, sf)[1]), 7)


@query("A-11", f"""WITH wall AS ({WALL.format(lineitem='lineitem')}), m AS (SELECT patient_id, avg(hu) AS m FROM wall GROUP BY 1),
 d AS (SELECT patient_id, hu, generation, hu - m AS c FROM wall JOIN m USING (patient_id))
 SELECT patient_id, round(avg(hu), 5) AS wall_hu_mean, round(stddev_samp(hu), 5) AS wall_hu_std, round(avg(c*c*c) / pow(avg(c*c), 1.5e0), 5) AS wall_hu_skew,
 round(avg(c*c*c*c) / pow(avg(c*c), 2) - 3, 5) AS wall_hu_kurt, round(avg(hu) FILTER (generation = 3), 5) AS wall_hu_mean_gen3, round(avg(hu) FILTER (generation = 4), 5) AS wall_hu_mean_gen4,
 round(avg(hu) FILTER (generation = 5), 5) AS wall_hu_mean_gen5 FROM d GROUP BY 1""")
def a_density(spark, sf):
    return rounded(A.wall_density(S._run(spark, sf, WALL)), 5)


@query("A-11b")
def a_pca(spark, sf):
    return A.profile_pca(_fwhm(spark, sf)[0], BKEYS)


LINE = "SELECT DISTINCT s_suppkey AS patient_id, CAST(b AS INT) AS branch, CAST(b * 4 AS INT) AS z, CAST((s_suppkey + b * 5) % 16 AS INT) AS y, CAST((s_suppkey * 3 + b * 7) % 16 AS INT) AS x FROM "
STEPS = "(SELECT explode(sequence(0, 3)) AS b)"


@query("A-12", S.cte("ct", f"""+, line AS ({LINE} supplier, (SELECT unnest(range(4)) AS b)),
 n AS (SELECT c.patient_id, c.z, c.y, c.x, l.branch, pow(c.z - l.z, 2) + pow(c.y - l.y, 2) + pow(c.x - l.x, 2) AS d2 FROM ct c JOIN line l ON l.patient_id = c.patient_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, z, y, x ORDER BY d2, branch) AS rn FROM n WHERE d2 <= 36)
 SELECT patient_id, z, y, x, branch, round(sqrt(d2), 6) AS d FROM r WHERE rn = 1"""))
def a_voronoi(spark, sf):
    line = S.table(spark, sf, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b")).selectExpr(
        "s_suppkey AS patient_id", "CAST(b AS INT) AS branch", "CAST(b * 4 AS INT) AS z", "CAST((s_suppkey + b * 5) % 16 AS INT) AS y",
        "CAST((s_suppkey * 3 + b * 7) % 16 AS INT) AS x")
    return rounded(A.voxel_to_branch(S.ct(spark, sf).drop("hu"), line))


@query("A-13", S.cte("branch", """+, a AS (SELECT patient_id, avg(Inner_Diameter_mm) AS din FROM branch GROUP BY 1), v AS (SELECT s_suppkey AS patient_id, s_acctbal / 1e2 AS d FROM supplier)
 SELECT patient_id, round(CASE WHEN d <> 0 AND din / d > 0 THEN din / d END, 6) AS BronchoArtery_Ratio FROM a JOIN v USING (patient_id)"""))
def a_bar(spark, sf):
    a = S.branch(spark, sf).groupBy("patient_id").agg(F.avg("Inner_Diameter_mm").alias("din"))
    v = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("patient_id"), (F.col("s_acctbal") / 100).alias("d"))
    return rounded(A.bronchus_artery_ratio(a, v, "din", "d"))


def _tree(spark, sf):
    p = S.table(spark, sf, "part").select(F.lit(0).alias("patient_id"), F.col("p_partkey").alias("id"))
    return p.withColumn("parent", F.when(F.col("id") > 0, ((F.col("id") - 1) / 2).cast("bigint")))


@query("A-14", """WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent FROM part),
 up AS (SELECT id, id AS node, parent, 0 AS d FROM t UNION ALL SELECT up.id, t.id, t.parent, d + 1 FROM up JOIN t ON t.id = up.parent)
 SELECT g.id, g.generation, s.subtree FROM (SELECT id, CAST(max(d) AS INTEGER) AS generation FROM up GROUP BY 1) g JOIN (SELECT node AS id, count(*) AS subtree FROM up GROUP BY 1) s USING (id)""")
def a_tree(spark, sf):
    e = _tree(spark, sf)
    return A.tree_measures(e).select("id", F.col("generation").cast("int").alias("generation"), "subtree")


REACH = """, reach(p, a, b) AS (SELECT v.patient_id, v.k, v.k FROM v UNION
 SELECT r.p, r.a, w.k FROM reach r JOIN v ON v.patient_id = r.p AND v.k = r.b JOIN v w ON w.patient_id = v.patient_id AND {touch}),
 comp AS (SELECT p AS patient_id, a AS k, min(b) AS component FROM reach GROUP BY 1, 2)"""
TOUCH26 = "abs(w.z - v.z) <= 1 AND abs(w.y - v.y) <= 1 AND abs(w.x - v.x) <= 1"


@query("A-15", S.cte("skeleton", "/*RECURSE*/+, v AS (SELECT *, z * 1048576 + y * 1024 + x AS k FROM skeleton)".replace("/*RECURSE*/+", "+/*RECURSE*/")
                    + REACH.format(touch=TOUCH26) + """, sz AS (SELECT patient_id, component, count(*) AS n FROM comp GROUP BY 1, 2),
 best AS (SELECT patient_id, component FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY n DESC, component) AS rn FROM sz) WHERE rn = 1)
 SELECT v.patient_id, v.z, v.y, v.x FROM v JOIN comp USING (patient_id, k) JOIN best USING (patient_id, component)"""))
def a_largest(spark, sf):
    return V.largest_component(S.skeleton(spark, sf), ["patient_id"]).select("patient_id", "z", "y", "x")
