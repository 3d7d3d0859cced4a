"""Queries over statistics, evaluation and survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.functions.special import chi2_tail_sql, normal_two_sided_sql
from phenospark.operators import evaluate as E
from phenospark.operators import stats as P
from phenospark.operators import survive as R
from phenospark.plans import standin as S
from phenospark.plans.q_profile import rounded
from phenospark.plans.registry import query

# average ranks and AUC in plain SQL windows, per feature
RANKS = """, rk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY {k}, {v}) AS t FROM {src} WHERE {v} IS NOT NULL),
 a AS (SELECT {k}, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1e0) / 2) / (1e0 * sum(y) * (count(*) - sum(y))) AS auc, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM rk GROUP BY {k})"""
FEAT = RANKS.format(k="feature", v="value", src="obs")


def mw_sql(mode, src="a"):
    gap = "abs(auc - 0.5e0) * n_pos * (n - n_pos)"
    if mode == "plain":
        var = "1e0 * n_pos * (n - n_pos) * (n + 1) / 12"
    else:
        var = "1e0 * n_pos * (n - n_pos) / 12 * ((n + 1) - ties / (1e0 * n * (n - 1)))"
        gap = f"greatest({gap} - 0.5e0, 0)"
    return f"(SELECT *, {gap} / sqrt({var}) / sqrt(2e0) AS z FROM {src})"


P_SQL = f"least({normal_two_sided_sql('z')}, 1e0)"


def _obs(spark, sf):
    return S.obs(spark, sf).select("patient_id", "cohort", "y", "label3", "feature", "value")


@query("S-01", S.cte("obs", "+" + FEAT + " SELECT feature, n, n_pos, round(auc, 9) AS auc FROM a"))
def s_auc(spark, sf):
    return rounded(P.rank_auc(_obs(spark, sf)), 9)


EMB = """WITH obs AS (SELECT vec_id AS patient_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, 'dim' || i AS feature, embedding[i] AS value FROM embeddings, (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM embeddings))) AS i))"""


@query("S-01b", EMB + FEAT + " SELECT feature, n, n_pos, round(auc, 9) AS auc FROM a")
def s_auc_wide(spark, sf):
    e = S.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("patient_id"), (F.col("label") < 5).cast("int").alias("y"), F.posexplode("embedding").alias("i", "value"))
    return rounded(P.rank_auc(e.withColumn("feature", F.concat(F.lit("dim"), F.col("i") + 1))), 9)


@query("S-02", S.cte("obs", "+" + FEAT + f", c AS {mw_sql('corrected')}, q AS {mw_sql('plain')} SELECT c.feature, round(c.auc, 9) AS auc, round(c.p, 6) AS p, round(q.p, 6) AS p_plain "
                    f"FROM (SELECT *, {P_SQL} AS p FROM c) c JOIN (SELECT feature, {P_SQL} AS p FROM q) q USING (feature)"))
def s_mw(spark, sf):
    o = _obs(spark, sf)
    a = P.mann_whitney(o).select("feature", "auc", "p")
    return a.join(P.mann_whitney(o, mode="plain").select("feature", F.col("p").alias("p_plain")), "feature").select(
        "feature", F.round("auc", 9).alias("auc"), F.round("p", 6).alias("p"), F.round("p_plain", 6).alias("p_plain"))


D_SQL = """SELECT feature, avg(value) FILTER (y = 0) AS mean0, avg(value) FILTER (y = 1) AS mean1, (avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0)) /
 sqrt(({f}(value) FILTER (y = 1) + {f}(value) FILTER (y = 0)) / 2) AS d FROM obs GROUP BY 1"""


@query("S-03", S.cte("obs", f"+, p AS ({D_SQL.format(f='var_pop')}), s AS ({D_SQL.format(f='var_samp')}) SELECT p.feature, round(p.d, 8) AS d_pop, round(s.d, 8) AS d_samp FROM p JOIN s USING (feature)"))
def s_d(spark, sf):
    o = _obs(spark, sf)
    a = P.cohens_d(o).select("feature", F.round("d", 8).alias("d_pop"))
    return a.join(P.cohens_d(o, sd="samp").select("feature", F.round("d", 8).alias("d_samp")), "feature")


@query("S-04", S.cte("fact", "+, obs AS (SELECT * FROM fact WHERE value IS NOT NULL), med AS (SELECT feature, median(value) AS m FROM obs GROUP BY 1), "
                    "f AS (SELECT feature, y, coalesce(value, m) AS value FROM fact JOIN med USING (feature))"
                    + RANKS.format(k="feature", v="value", src="obs") + RANKS.format(k="feature", v="value", src="f").replace("rk AS", "rk2 AS").replace("FROM rk ", "FROM rk2 ").replace(" a AS", " a2 AS")
                    + f", z AS {mw_sql('corrected')}, d AS ({D_SQL.format(f='var_pop')}) SELECT d.feature, round(mean0, 4) AS mean0, round(mean1, 4) AS mean1, round(d, 8) AS d, round(a2.auc, 9) AS auc, round({P_SQL}, 6) AS p "
                    "FROM d JOIN z USING (feature) JOIN a2 USING (feature)"))
def s_summary(spark, sf):
    f = S.fact(spark, sf).select("feature", "y", "value")
    return P.univariate_summary(f).select("feature", F.round("mean0", 4).alias("mean0"), F.round("mean1", 4).alias("mean1"), F.round("d", 8).alias("d"),
                                          F.round("auc", 9).alias("auc"), F.round("p", 6).alias("p"))


@query("S-05", S.cte("obs", "+" + FEAT + f", z AS {mw_sql('corrected')}, d AS ({D_SQL.format(f='var_pop')}) SELECT feature, n, n_pos, round(auc, 9) AS auc, round({P_SQL}, 6) AS p, round(mean0, 4) AS mean0, round(mean1, 4) AS mean1 FROM z JOIN d USING (feature) WHERE n >= 10"))
def s_observed(spark, sf):
    return P.univariate_auc_observed(_obs(spark, sf)).select(
        "feature", "n", "n_pos", F.round("auc", 9).alias("auc"), F.round("p", 6).alias("p"), F.round("mean0", 4).alias("mean0"), F.round("mean1", 4).alias("mean1"))


KW = """, rk3 AS (SELECT feature, {g} AS g, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2e0 AS r,
 count(*) OVER (PARTITION BY feature, value) AS t FROM obs), gs AS (SELECT feature, g, sum(r) AS R, count(*) AS ng FROM rk3 GROUP BY 1, 2),
 tt AS (SELECT feature, count(*) * 1e0 AS N, sum(1e0 * t * t - 1) AS t FROM rk3 GROUP BY 1),
 h0 AS (SELECT feature, sum(R * R / ng) AS s FROM gs GROUP BY 1),
 h AS (SELECT feature, (12 / (N * (N + 1)) * s - 3 * (N + 1)) / (1 - t / (N * N * N - N)) AS H FROM h0 JOIN tt USING (feature)),
 hp AS (SELECT feature, H, greatest(H, 0) AS c, sqrt(greatest(H, 0) / 2) AS z FROM h)"""


@query("S-06", S.cte("obs", "+" + KW.format(g="label3") + f" SELECT feature, round(H, 6) AS H, round({chi2_tail_sql('c', 'z', 2)}, 6) AS p FROM hp"))
def s_kw(spark, sf):
    return rounded(P.kruskal_wallis(_obs(spark, sf), "label3", 3))


PAIRS3 = ", pr AS (SELECT feature, value, pair, CASE WHEN {g} = b THEN 1 ELSE 0 END AS y FROM obs JOIN ({pairs}) ON {g} = a OR {g} = b)"
P3 = " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, '{a}|{b}' AS pair" for a, b in ((0, 1), (0, 2), (1, 2)))
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
P5 = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, '{a}|{b}' AS pair" for i, a in enumerate(REGIONS) for b in REGIONS[i + 1:])


@query("S-07", S.cte("obs", "+" + PAIRS3.format(g="label3", pairs=P3) + RANKS.format(k="feature, pair", v="value", src="pr") + " SELECT feature, round(avg(greatest(auc, 1 - auc)), 9) AS auc_macro FROM a GROUP BY 1"))
def s_pairs(spark, sf):
    return rounded(P.pairwise_auc_macro(_obs(spark, sf), "label3", [0, 1, 2]), 9)


@query("S-08", S.cte("obs", "+" + PAIRS3.format(g="cohort", pairs=P5) + RANKS.format(k="feature, pair", v="value", src="pr") + f", mw AS {mw_sql('corrected')}, mp AS (SELECT feature, min(p) AS p FROM (SELECT feature, {P_SQL} AS p FROM mw) GROUP BY 1)"
                    + KW.format(g="cohort") + f" SELECT feature, round(mp.p, 6) AS min_pair_p, round({chi2_tail_sql('c', 'z', 4)}, 6) AS kw_p, mp.p > 0.05 AND {chi2_tail_sql('c', 'z', 4)} > 0.05 AS stable FROM mp JOIN hp USING (feature)"))
def s_stable(spark, sf):
    return rounded(P.stable_features(_obs(spark, sf), "cohort", REGIONS))


@query("S-09", S.cte("obs", """+, g AS (SELECT feature, avg(value) FILTER (y = 0) AS m0, avg(value) FILTER (y = 1) AS m1, var_samp(value) FILTER (y = 0) / count(*) FILTER (y = 0) AS a, var_samp(value) FILTER (y = 1) / count(*) FILTER (y = 1) AS b,
 count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM obs GROUP BY 1), w AS (SELECT feature, (m1 - m0) / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1)) AS df FROM g),
 q AS (SELECT feature, t, df, sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(atan(abs(t) / sqrt(df)) + (pi() / 2 - atan(abs(t) / sqrt(df))) * i / 2000), df - 1)) * (pi() / 2 - atan(abs(t) / sqrt(df))) AS up,
  sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(pi() / 2 * i / 2000), df - 1)) * pi() / 2 AS whole FROM w, range(2001) r(i) GROUP BY 1, 2, 3)
 SELECT feature, round(t, 7) AS t, round(df, 5) AS df, round(up / whole, 6) AS p FROM q"""))
def s_welch(spark, sf):
    return P.welch_t_test(_obs(spark, sf)).select("feature", F.round("t", 7).alias("t"), F.round("df", 5).alias("df"), F.round("p", 6).alias("p"))


@query("S-10", S.cte("obs", "+" + FEAT + f", z AS {mw_sql('corrected')}, p AS (SELECT feature, {P_SQL} AS p FROM z), r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS rn, count(*) OVER () AS m FROM p) "
                    "SELECT feature, round(p, 6) AS p, round(least(min(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS fdr FROM r"))
def s_fdr(spark, sf):
    return rounded(P.bh_fdr(P.mann_whitney(_obs(spark, sf)).select("feature", "p")))




@query("S-11", S.cte("obs", """+, r AS (SELECT patient_id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2e0 AS r FROM obs)
 SELECT x.feature AS a, y.feature AS b, CASE WHEN count(*) > 1 AND min(x.r) < max(x.r) AND min(y.r) < max(y.r) THEN round(abs(corr(x.r, y.r)), 8) END AS rho FROM r x JOIN r y ON x.patient_id = y.patient_id AND x.feature < y.feature GROUP BY 1, 2"""))
def s_corr(spark, sf):
    return rounded(P.correlation(_obs(spark, sf), list(S.FEATURES)), 8)


@query("S-12")
def s_bootstrap(spark, sf):
    return P.bootstrap_auc(S.oof(spark, sf), ["cohort"], 200, score="proba")


@query("S-12b")
def s_bootstrap_stratified(spark, sf):
    return P.bootstrap_auc(S.oof(spark, sf), ["cohort"], 200, stratified=True, score="proba")


@query("S-12c", S.cte("oof", """+, c AS (SELECT cohort, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM oof GROUP BY 1)
 SELECT cohort, CAST(range AS INTEGER) AS replica, pos, neg, pos > 0 AND neg > 0 AS scored FROM c, range(200)"""))
def s_strata(spark, sf):
    """Class sizes of every replica, which a bootstrap within classes must keep."""
    r = P.stratified_replicas(S.oof(spark, sf), ["cohort"], 200, score="proba")
    return r.select("cohort", "replica", "pos", "neg", F.col("auc").isNotNull().alias("scored"))


@query("S-13")
def s_direction(spark, sf):
    o = _obs(spark, sf)
    best = P.top_k(P.rank_auc(o), 5)
    few = o.join(best.select("feature"), "feature", "left_semi")
    return P.direction_stability(P.bootstrap_replicas(few, ["feature"], 100, score="value"), best, ["feature"])


TASKS = "SELECT *, cohort AS task FROM obs"
BYTASK = "+, ot AS (SELECT *, cohort AS task FROM obs)" + RANKS.format(k="task, feature", v="value", src="ot")


def _by_task(spark, sf):
    return P.rank_auc(_obs(spark, sf).withColumn("task", F.col("cohort")), ["task", "feature"])


@query("S-14", S.cte("obs", BYTASK + " SELECT task, count(*) FILTER (abs(auc - 0.5) > 0.05) AS with_signal, count(auc) AS features FROM a GROUP BY 1"))
def s_signal(spark, sf):
    return P.signal_count(_by_task(spark, sf), by=["task"])


@query("S-15", S.cte("obs", BYTASK + ", b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY abs(auc - 0.5) DESC, feature) AS rn FROM a) SELECT task, feature, round(auc, 9) AS auc FROM b WHERE rn = 1"))
def s_best(spark, sf):
    return rounded(P.best_per_task(_by_task(spark, sf)), 9)


@query("S-16", S.cte("obs", BYTASK + ", b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY abs(auc - 0.5) DESC, feature) AS rn FROM a) SELECT task, feature, round(auc, 9) AS auc, CAST(rn AS INTEGER) AS rank FROM b WHERE rn <= 8"))
def s_top(spark, sf):
    return P.top_k(_by_task(spark, sf), 8, ["task"]).select("task", "feature", F.round("auc", 9).alias("auc"), "rank")


@query("S-17", S.cte("obs", "SELECT feature, y, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM obs GROUP BY 1, 2"))
def s_five(spark, sf):
    return P.five_number_by_class(_obs(spark, sf)).select("feature", "y", "min", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"), F.round("q3", 6).alias("q3"), "max")


@query("S-18", S.cte("oof", "SELECT y, CAST(least(floor(proba * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM oof GROUP BY 1, 2"))
def s_hist(spark, sf):
    return P.histogram(S.oof(spark, sf), "proba", 0, 1, 30, ["y"])


@query("S-19")
def s_mrmr(spark, sf):
    o = _obs(spark, sf).where(F.col("feature").isin(*list(S.FEATURES)))
    names = P.mrmr(P.label_relevance(o), P.correlation(o, list(S.FEATURES), "pearson"), 8)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "position int, feature string")


# ---- evaluation ------------------------------------------------------------------------------------------------------------

@query("E-01", S.cte("oof", """SELECT fold, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp,
 round(count(*) FILTER (y = 0 AND pred = 0) / count(*) FILTER (y = 0), 9) AS tn_share, round(count(*) FILTER (y = 1 AND pred = 1) / count(*) FILTER (y = 1), 9) AS tp_share FROM oof GROUP BY 1"""))
def e_confusion(spark, sf):
    return rounded(E.confusion(S.oof(spark, sf), ["fold"]), 9)


OOFR = RANKS.format(k="{k}", v="proba", src="oof")
STEPS = """, sc AS (SELECT {k}, proba, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM oof GROUP BY {k}, proba),
 st AS (SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY proba DESC) AS tp, sum(neg) OVER (PARTITION BY {k} ORDER BY proba DESC) AS fp, sum(pos) OVER (PARTITION BY {k}) AS P, sum(neg) OVER (PARTITION BY {k}) AS Q FROM sc)"""


@query("E-02", S.cte("oof", "+" + OOFR.format(k="fold") + STEPS.format(k="fold") + """, c AS (SELECT fold, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM oof GROUP BY 1),
 ap AS (SELECT fold, sum(pos / P * tp / (tp + fp)) AS ap FROM st GROUP BY 1)
 SELECT fold, tn + fp + fn + tp AS n, round((tp + tn) / (tn + fp + fn + tp), 8) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 8) AS balanced_accuracy, round(tp / (tp + fn), 8) AS sensitivity, round(tn / (tn + fp), 8) AS specificity,
 round(tp / (tp + fp), 8) AS ppv, round(tn / (tn + fn), 8) AS npv, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round(auc, 8) AS auc, round(ap, 8) AS ap FROM c JOIN a USING (fold) JOIN ap USING (fold)"""))
def e_metrics(spark, sf):
    return rounded(E.binary_metrics(S.oof(spark, sf), ["fold"]), 8)


@query("E-03", S.cte("oof", "+" + STEPS.format(k="cohort") + " SELECT cohort, round(sum(pos / P * tp / (tp + fp)), 8) AS ap FROM st GROUP BY 1"))
def e_ap(spark, sf):
    return rounded(E.average_precision(S.oof(spark, sf), ["cohort"]), 8)


PROBS = "SELECT fold, label3, (1 - proba) * 0.6e0 AS p0, (1 - proba) * 0.4e0 AS p1, proba AS p2, CASE WHEN proba > 0.5 THEN 2 WHEN proba > 0.3 THEN 1 ELSE 0 END AS pred3 FROM oof"


@query("E-04", S.cte("oof", f"+, m AS ({PROBS}), u AS (SELECT fold, 0 AS cls, p0 AS p, (label3 = 0)::INT AS y FROM m UNION ALL SELECT fold, 1, p1, (label3 = 1)::INT FROM m UNION ALL SELECT fold, 2, p2, (label3 = 2)::INT FROM m)"
                    + RANKS.format(k="fold, cls", v="p", src="u") + ", k AS (SELECT fold, " + ", ".join(
    f"count(*) FILTER (label3 = {i}) AS n{i}, count(*) FILTER (pred3 = {i}) AS q{i}, count(*) FILTER (label3 = {i} AND pred3 = {i}) AS t{i}" for i in (0, 1, 2))
    + """, count(*) AS n, avg((label3 = pred3)::INT) AS accuracy, avg(-ln(CASE label3 WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS ll FROM m GROUP BY 1)
 SELECT fold, n, round(accuracy, 8) AS accuracy, round((t0 / n0 + t1 / n1 + t2 / n2) / 3, 8) AS balanced_accuracy, round((2 * t0 / (n0 + q0) + 2 * t1 / (n1 + q1) + 2 * t2 / (n2 + q2)) / 3, 8) AS macro_f1, round(ll, 8) AS log_loss,
 round((SELECT avg(auc) FROM a WHERE a.fold = k.fold), 8) AS macro_ovr_auc FROM k"""))
def e_multi(spark, sf):
    m = S.oof(spark, sf).selectExpr("fold", "label3", "(1 - proba) * 0.6D AS p0", "(1 - proba) * 0.4D AS p1", "proba AS p2",
                                    "CASE WHEN proba > 0.5 THEN 2 WHEN proba > 0.3 THEN 1 ELSE 0 END AS pred3")
    return rounded(E.multiclass_metrics(m, ["fold"], "label3", "pred3", {0: "p0", 1: "p1", 2: "p2"}), 8)


@query("E-05", S.cte("oof", "+" + STEPS.format(k="fold") + " SELECT fold, proba AS score, round(fp / Q, 9) AS fpr, round(tp / P, 9) AS tpr FROM st"))
def e_roc(spark, sf):
    return rounded(E.roc_curve(S.oof(spark, sf), ["fold"]), 9)


@query("E-05b", S.cte("oof", "+" + STEPS.format(k="fold") + " SELECT fold, proba AS score, round(tp / P, 9) AS recall, round(tp / (tp + fp), 9) AS precision FROM st"))
def e_pr(spark, sf):
    return rounded(E.pr_curve(S.oof(spark, sf), ["fold"]), 9)


@query("E-06", S.cte("oof", "+" + STEPS.format(k="fold") + """, pt AS (SELECT fold, fp / Q AS x, tp / P AS y FROM st UNION ALL SELECT DISTINCT fold, 0e0, 0e0 FROM oof), g AS (SELECT i, i / 100e0 AS x FROM range(101) r(i)),
 l AS (SELECT fold, i, g.x AS gx, max(pt.x) AS x0, max(pt.y) AS y0 FROM g JOIN pt ON pt.x <= g.x + 1e-12 GROUP BY 1, 2, 3), u AS (SELECT fold, i, min(pt.x) AS x1, min(pt.y) AS y1 FROM g JOIN pt ON pt.x > g.x + 1e-12 GROUP BY 1, 2),
 v AS (SELECT fold, i, CASE WHEN i = 0 THEN 0 WHEN i = 100 THEN 1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (gx - x0) / (x1 - x0) END AS t FROM l LEFT JOIN u USING (fold, i))
 SELECT round(i / 100e0, 6) AS fpr, round(avg(t), 7) AS mean_tpr, round(stddev_pop(t), 7) AS sd_tpr FROM v GROUP BY i"""))
def e_mean_roc(spark, sf):
    return E.mean_roc(S.oof(spark, sf), "fold").select(F.round("fpr", 6).alias("fpr"), F.round("mean_tpr", 7).alias("mean_tpr"), F.round("sd_tpr", 7).alias("sd_tpr"))


@query("E-07", S.cte("oof", "+" + OOFR.format(k="cohort") + " SELECT cohort, n, n_pos, round(auc, 9) AS auc FROM a"))
def e_cohort(spark, sf):
    return rounded(E.per_cohort_auc(S.oof(spark, sf)), 9)


@query("E-08", S.cte("oof", """SELECT label3, count(*) AS n, round(avg(proba), 8) AS mean, round(avg((proba BETWEEN 0.4 AND 0.6)::INT), 8) AS gray, round(avg((proba < 0.4)::INT), 8) AS below, round(avg((proba > 0.6)::INT), 8) AS above,
 round(avg((proba >= 0.5)::INT), 8) AS high, round(quantile_cont(proba, 0.25), 8) AS q25, round(median(proba), 8) AS median, round(quantile_cont(proba, 0.75), 8) AS q75 FROM oof GROUP BY 1"""))
def e_risk(spark, sf):
    return rounded(E.risk_summary(S.oof(spark, sf)), 8)


@query("E-09", S.cte("oof", "SELECT patient_id, round(1 / (1 + exp(-(proba - 0.5) * 10)), 9) AS risk FROM oof"))
def e_sigmoid(spark, sf):
    return S.oof(spark, sf).select("patient_id", F.round(E.sigmoid_risk((F.col("proba") - 0.5) * 10), 9).alias("risk"))


GROUPS = "+, c AS (SELECT list_distinct([" + ", ".join(f"quantile_cont(proba, {i / 10})" for i in range(1, 10)) + "]) AS cs FROM oof), g AS (SELECT CAST(len(list_filter(cs, lambda c: proba > c)) AS INTEGER) AS grp, proba, y FROM oof, c)"


@query("E-10", S.cte("oof", GROUPS + " SELECT grp, count(*) AS n, round(avg(proba), 8) AS mean_p, round(avg(y), 8) AS mean_y, round(sum(proba), 5) AS expected, CAST(sum(y) AS DOUBLE) AS observed FROM g GROUP BY 1"))
def e_hl(spark, sf):
    return E.hosmer_lemeshow(S.oof(spark, sf))[0].select("grp", "n", F.round("mean_p", 8).alias("mean_p"), F.round("mean_y", 8).alias("mean_y"), F.round("expected", 5).alias("expected"), "observed")


@query("E-10b", S.cte("oof", GROUPS + f", t AS (SELECT grp, count(*) AS n, sum(proba) AS e, sum(y) AS o FROM g GROUP BY 1), x AS (SELECT sum((o - e) * (o - e) / (e * (1 - e / n))) AS chi2, count(*) AS groups FROM t), z AS (SELECT *, sqrt(chi2 / 2) AS _z FROM x) "
                     f"SELECT round(chi2, 5) AS chi2, groups, round({chi2_tail_sql('chi2', '_z', 8)}, 8) AS p FROM z"))
def e_hl_test(spark, sf):
    return E.hosmer_lemeshow(S.oof(spark, sf))[1].select(F.round("chi2", 5).alias("chi2"), "groups", F.round("p", 8).alias("p"))


@query("E-11", S.cte("oof", """+, t AS (SELECT i, i / 100e0 AS t FROM range(1, 100) r(i)), c AS (SELECT i, t, count(*) FILTER (y = 1 AND proba >= t) AS tp, count(*) FILTER (y = 0 AND proba >= t) AS fp, count(*) AS n, sum(y) AS p FROM oof, t GROUP BY 1, 2)
 SELECT t, round(CASE WHEN (tp - fp * t / (1 - t)) / n > -1 THEN (tp - fp * t / (1 - t)) / n END, 8) AS model, round(CASE WHEN (p - (n - p) * t / (1 - t)) / n > -1 THEN (p - (n - p) * t / (1 - t)) / n END, 8) AS "all", 0e0 AS "none" FROM c"""))
def e_decision(spark, sf):
    return rounded(E.decision_curve(S.oof(spark, sf), [i / 100 for i in range(1, 100)]), 8)


@query("E-12")
def e_calibration(spark, sf):
    return rounded(E.calibration(S.oof(spark, sf)), 8)


@query("E-12b", S.cte("oof", "SELECT round(avg(pow(y - proba, 2)), 8) AS brier, round(1 - avg(pow(y - proba, 2)) / (avg(y) * (1 - avg(y))), 8) AS brier_scaled FROM oof"))
def e_brier(spark, sf):
    return rounded(E.calibration(S.oof(spark, sf)).select("brier", "brier_scaled"), 8)


@query("E-13", S.cte("oof", GROUPS + """, q AS (SELECT grp, count(*) AS n, avg(proba) AS p, avg(y) AS o FROM g GROUP BY 1)
 SELECT grp, n, round(p, 8) AS predicted, round(o, 8) AS observed, round(greatest(o - 1.96 * sqrt(o * (1 - o) / n), 0), 8) AS lo, round(least(o + 1.96 * sqrt(o * (1 - o) / n), 1), 8) AS hi FROM q"""))
def e_cal_groups(spark, sf):
    return rounded(E.calibration_groups(S.oof(spark, sf)), 8)


@query("E-14")
def e_smooth(spark, sf):
    return rounded(E.smooth_calibration(S.oof(spark, sf)), 8)


@query("E-15", S.cte("oof", """+, v AS (SELECT cohort, y, (rank() OVER (PARTITION BY cohort ORDER BY proba) + (count(*) OVER (PARTITION BY cohort, proba) - 1) / 2e0) - (rank() OVER (PARTITION BY cohort, y ORDER BY proba) + (count(*) OVER (PARTITION BY cohort, y, proba) - 1) / 2e0) AS other,
  count(*) FILTER (y = 1) OVER (PARTITION BY cohort) AS P, count(*) FILTER (y = 0) OVER (PARTITION BY cohort) AS Q FROM oof), w AS (SELECT cohort, y, P, Q, CASE WHEN y = 1 THEN other / Q ELSE 1 - other / P END AS pl FROM v),
 g AS (SELECT cohort, avg(pl) FILTER (y = 1) AS c, sqrt(var_samp(pl) FILTER (y = 1) / any_value(P) + var_samp(pl) FILTER (y = 0) / any_value(Q)) AS se FROM w GROUP BY 1)
 SELECT cohort, round(c, 8) AS c, round(se, 8) AS se, round(c - 1.96 * se, 8) AS lo, round(c + 1.96 * se, 8) AS hi FROM g"""))
def e_c(spark, sf):
    return rounded(E.c_statistic_ci(S.oof(spark, sf), ["cohort"]), 8)


@query("E-16", S.cte("oof", "SELECT cohort, round(avg(proba) FILTER (y = 1) - avg(proba) FILTER (y = 0), 9) AS slope FROM oof GROUP BY 1"))
def e_slope(spark, sf):
    return rounded(E.discrimination_slope(S.oof(spark, sf), ["cohort"]), 9)


@query("E-17", S.cte("obs", "+, c AS (SELECT feature, cohort, corr(value, y) AS coef FROM obs GROUP BY 1, 2) SELECT feature, round(avg(coef), 8) AS mean, round(stddev_samp(coef), 8) AS sd, round(abs(avg(coef)), 8) AS abs_mean FROM c GROUP BY 1"))
def e_coefs(spark, sf):
    c = _obs(spark, sf).groupBy("feature", "cohort").agg(F.corr("value", F.col("y").cast("double")).alias("coef"))
    return rounded(E.coefficient_summary(c), 8)


@query("E-18", S.cte("oof", "SELECT cohort, count(*) FILTER (label3 = 0) AS label_0, count(*) FILTER (label3 = 1) AS label_1, count(*) FILTER (label3 = 2) AS label_2 FROM oof GROUP BY 1"))
def e_counts(spark, sf):
    return E.cohort_label_counts(S.oof(spark, sf))


@query("E-19", S.cte("obs", BYTASK + " SELECT feature, " + ", ".join(f"round(max(auc) FILTER (task = '{r}'), 9) AS \"{r}\"" for r in REGIONS) + " FROM a GROUP BY 1"))
def e_matrix(spark, sf):
    return rounded(E.result_matrix(_by_task(spark, sf), ["feature"], "task", REGIONS).select("feature", *[F.col(f"`{r}`") for r in REGIONS]), 9)


# ---- survival ----------------------------------------------------------------------------------------------------------------

@query("R-01", S.cte("surv", """+, t AS (SELECT grp, time, count(*) AS n, CAST(sum(status) AS BIGINT) AS d FROM surv GROUP BY 1, 2), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY grp ORDER BY time DESC) AS BIGINT) AS at_risk FROM t),
 k AS (SELECT *, CASE WHEN max((d = at_risk)::INT) OVER (PARTITION BY grp ORDER BY time) = 1 THEN 0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER (PARTITION BY grp ORDER BY time)) END AS s,
  sqrt(sum(CASE WHEN d < at_risk THEN d / (1e0 * at_risk * (at_risk - d)) ELSE 0 END) OVER (PARTITION BY grp ORDER BY time)) AS se FROM r)
 SELECT grp, time, at_risk, d, round(s, 8) AS survival, round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(1.96 * se / abs(ln(s)))) END, 8) AS lo, round(CASE WHEN s > 0 AND s < 1 THEN pow(s, 1 / exp(1.96 * se / abs(ln(s)))) END, 8) AS hi FROM k"""))
def r_km(spark, sf):
    return rounded(R.kaplan_meier(S.surv(spark, sf), ["grp"]), 8)


@query("R-02", S.cte("surv", """+, s AS (SELECT time, status, (grp = '1-URGENT')::INT AS g FROM surv WHERE grp IN ('1-URGENT', '5-LOW')), t AS (SELECT time, count(*) AS m, sum(g) AS m1, sum(status) AS d, sum(status * g) AS d1 FROM s GROUP BY 1),
 r AS (SELECT *, (sum(m) OVER (ORDER BY time DESC))::DOUBLE AS n, (sum(m1) OVER (ORDER BY time DESC))::DOUBLE AS n1 FROM t),
 g AS (SELECT sum(d1)::DOUBLE AS o1, sum(d - d1)::DOUBLE AS o2, sum(d * n1 / n) AS e1, sum(d * (n - n1) / n) AS e2, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) END) AS v FROM r),
 c AS (SELECT *, pow(o1 - e1, 2) / v AS chi2, sqrt(pow(o1 - e1, 2) / v / 2) AS z, (o2 / e2) / (o1 / e1) AS hr FROM g)
 SELECT o1, o2, round(e1, 6) AS e1, round(e2, 6) AS e2, round(chi2, 7) AS chi2, round(""" + chi2_tail_sql("chi2", "z", 1) + """, 7) AS p, round(hr, 7) AS hr, round(exp(ln(hr) - 1.96 * sqrt(1 / e1 + 1 / e2)), 7) AS hr_lo, round(exp(ln(hr) + 1.96 * sqrt(1 / e1 + 1 / e2)), 7) AS hr_hi FROM c"""))
def r_logrank(spark, sf):
    return rounded(R.log_rank(S.surv(spark, sf), "grp", "1-URGENT", "5-LOW"), 7, e1=6, e2=6)


def _surv_long(spark, sf):
    return S.surv(spark, sf).unpivot(["patient_id", "time", "status"], ["x1", "x2", "x3"], "feature", "value")


@query("R-03")
def r_cox(spark, sf):
    return rounded(R.cox_univariate(_surv_long(spark, sf), concordance=True), 7)


@query("R-04")
def r_cox_multi(spark, sf):
    return rounded(R.cox_table(spark, R.cox_multivariate(S.surv(spark, sf), ["x1", "x2", "x3"], strata="grp")), 7)


@query("R-05")
def r_ph(spark, sf):
    s = S.surv(spark, sf)
    return rounded(R.ph_check(s, R.cox_multivariate(s, ["x1", "x2"])), 7)


@query("R-06", S.cte("surv", """+, p AS (SELECT 'x1' AS feature, patient_id, time, status, x1 AS v FROM surv UNION ALL SELECT 'x2', patient_id, time, status, x2 FROM surv UNION ALL SELECT 'x3', patient_id, time, status, x3 FROM surv), t AS (SELECT feature, v, time, sum(status) AS e, count(*) - sum(status) AS c FROM p GROUP BY 1, 2, 3),
 q AS (SELECT a.feature, CASE WHEN a.v > b.v THEN 'c' WHEN a.v < b.v THEN 'd' ELSE 't' END AS k, sum(a.e * CASE WHEN b.time > a.time THEN b.e + b.c ELSE b.c END) AS n FROM t a JOIN t b ON a.feature = b.feature AND b.time >= a.time GROUP BY 1, 2)
 SELECT feature, CAST(sum(n) FILTER (k = 'c') AS BIGINT) AS concordant, CAST(sum(n) FILTER (k = 'd') AS BIGINT) AS discordant, CAST(sum(n) FILTER (k = 't') AS BIGINT) AS tied,
 round((sum(n) FILTER (k = 'c') + sum(n) FILTER (k = 't') / 2) / sum(n), 8) AS c_index FROM q GROUP BY 1"""))
def r_concordance(spark, sf):
    return rounded(R.concordance_index(_surv_long(spark, sf), ["feature"], "value"), 8)


@query("R-07", S.cte("surv", "SELECT patient_id, CASE WHEN x1 > 2.5 THEN 1 ELSE -1 END AS risk_group FROM surv"))
def r_groups(spark, sf):
    return R.risk_group(S.surv(spark, sf), "x1", 2.5).select("patient_id", "risk_group")


@query("R-08")
def r_aic(spark, sf):
    path = R.backward_aic(S.surv(spark, sf), ["x1", "x2", "x3"])
    return spark.createDataFrame([(i, ",".join(p["names"]), round(float(p["aic"]), 5)) for i, p in enumerate(path)], "step int, names string, aic double")
