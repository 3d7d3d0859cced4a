"""Queries over screening, models and incremental ingest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenospark.functions.special import chi2_tail_sql
from phenospark.operators import batched as B
from phenospark.operators import models as M
from phenospark.operators import screen as Z
from phenospark.operators import stats as P
from phenospark.plans import standin as S
from phenospark.plans.q_profile import rounded
from phenospark.plans.q_stats import FEAT, KW, P3, P_SQL, PAIRS3, RANKS, mw_sql
from phenospark.plans.registry import query
from phenospark.session import checkpointed
from phenospark.sources import sinks
from phenospark.streaming import incremental as I

IDS = ["patient_id", "cohort", "y"]
MODEL_FEATURES = ["Pi10", "TD_ratio_all", "Vessel_BV5_pct", "EpiFat_Mean_HU", "CAC_Agatston", "BronchoArtery_Ratio"]
ALL_FEATURES = list(S.FEATURES)
IN6 = "('" + "','".join(MODEL_FEATURES) + "')"


def _facts(spark, sf):
    return S.fact(spark, sf).select(*IDS, "label3", "feature", "value")


def _frame(spark, sf, k=3):
    return M.stratified_folds(M.model_frame(_facts(spark, sf), IDS, MODEL_FEATURES), k)


def _prepared(spark, sf):
    f = _frame(spark, sf)
    x = M.Preparation.fit(f, M.feature_columns(f)).apply(f)
    return checkpointed(M.balanced_weights(x).select("patient_id", "cohort", "y", "w", "features"))


# ---- screening -------------------------------------------------------------------------------------------------------------------

GATE = """, ga AS (SELECT feature, {g} AS g, count(value) AS n, count(*) AS al, coalesce(max(value) > min(value), FALSE) AS v FROM fact GROUP BY 1, 2), ok AS (SELECT feature FROM ga GROUP BY 1
 HAVING sum(n) >= greatest(20, sum(al) * 0.5) AND count(*) FILTER (n >= 3 AND v) = {k})"""
POOL = """, q AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS rn, count(*) OVER () AS m FROM st), f AS (SELECT *, least(min(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS fdr FROM q),
 o AS (SELECT *, row_number() OVER (ORDER BY strength DESC, fdr, feature) AS rank FROM f WHERE fdr < 0.05 OR NOT (SELECT bool_or(fdr < 0.05) FROM f))
 SELECT feature, round(p, 6) AS p, round(strength, 9) AS strength, round(fdr, 6) AS fdr, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 250"""


@query("F-01", S.cte("fact obs", "+" + GATE.format(g="y", k=2)[0:] + FEAT + f", z AS {mw_sql('corrected')}, st AS (SELECT feature, {P_SQL} AS p, greatest(auc, 1 - auc) AS strength FROM z WHERE feature IN (SELECT feature FROM ok))" + POOL))
def f_pool(spark, sf):
    return Z.pool_binary(_facts(spark, sf)).select("feature", F.round("p", 6).alias("p"), F.round("strength", 9).alias("strength"), F.round("fdr", 6).alias("fdr"), "rank")


@query("F-02", S.cte("fact obs", "+" + GATE.format(g="label3", k=3) + KW.format(g="label3") + PAIRS3.format(g="label3", pairs=P3) + RANKS.format(k="feature, pair", v="value", src="pr")
                    + f", st AS (SELECT feature, {chi2_tail_sql('c', 'z', 2)} AS p, s AS strength FROM hp JOIN (SELECT feature, avg(greatest(auc, 1 - auc)) AS s FROM a GROUP BY 1) USING (feature) WHERE feature IN (SELECT feature FROM ok))" + POOL))
def f_pool3(spark, sf):
    return Z.pool_multiclass(_facts(spark, sf), "label3", [0, 1, 2]).select(
        "feature", F.round("p", 6).alias("p"), F.round("strength", 9).alias("strength"), F.round("fdr", 6).alias("fdr"), "rank")


def _listed(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, feature string")


@query("F-03")
def f_greedy(spark, sf):
    f = _facts(spark, sf)
    return _listed(spark, Z.select_features(f, Z.pool_binary(f), keep=8, cut=0.6))


@query("F-04")
def f_protected(spark, sf):
    f = _facts(spark, sf)
    return _listed(spark, Z.select_features(f, Z.pool_binary(f), keep=8, cut=0.6, protected=["Pi10", "CAC_Agatston"]))


@query("F-05", "SELECT c_custkey, c_mktsegment, round(n / (5e0 * c), 9) AS w FROM customer JOIN (SELECT c_mktsegment, count(*) AS c, sum(count(*)) OVER () AS n FROM customer GROUP BY 1) USING (c_mktsegment)")
def f_weights(spark, sf):
    c = S.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return rounded(M.balanced_weights(c, "c_mktsegment"), 9)


# ---- models -------------------------------------------------------------------------------------------------------------------------

def _coefs(spark, model):
    m = model.coefficientMatrix.toArray()
    return spark.createDataFrame([(c, MODEL_FEATURES[i], round(float(v), 6)) for c, row in enumerate(m) for i, v in enumerate(row)], "cls int, feature string, coef double")


@query("F-06")
def f_ridge(spark, sf):
    return _coefs(spark, M.logit_l2(_prepared(spark, sf)))


GRID = "(SELECT unnest([0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1, 3, 10, 30, 100, 300]) AS c)"


def _stationary(spark, path):
    """(c, l1_ratio, sets, stationary): the optimality conditions of every model of a path, with gradients recomputed from the
    coefficients by Spark SQL over the stored rows, model by model and column by column."""
    m = path.models
    cols, coef, fill = m.rows.cols, m.coefficients(), m.medians()
    rows = m.rows.df.select("y", "fold", *cols)
    out = []
    for s, held in enumerate(m.rows.held):
        mine = [i for i in range(len(m.set)) if m.set[i] == s]
        train = rows.where(F.col("fold") != held)
        fills = {c: F.coalesce(F.col(c), F.lit(float(fill[mine[0]][j]))) for j, c in enumerate(cols)}
        z = train.select("y", *[((e - float(m.mean[mine[0]][j] * m.rows.spread[j] + m.rows.center[j])) / float(m.scale[mine[0]][j] * m.rows.spread[j])).alias(c) for j, (c, e) in enumerate(fills.items())])
        size = z.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
        w = F.when(F.col("y") == 1, size["n"] / (2 * size["p"])).otherwise(size["n"] / (2 * (size["n"] - size["p"])))
        miss = {i: w * (1 / (1 + F.exp(-sum((F.col(c) * float(v) for c, v in zip(cols, m.beta[i][1:])), F.lit(float(m.beta[i][0]))))) - F.col("y")) for i in mine}
        z = z.select(*cols, *[e.alias(f"r{i}") for i, e in miss.items()])
        g = z.agg(*[F.sum(F.col(f"r{i}") * (F.lit(1.0) if c is None else F.col(c))).alias(f"g{i}_{j}") for i in mine for j, c in enumerate([None, *cols])]).first()
        for i in mine:
            l1, l2, ok = m.l1[i], m.l2[i], abs(g[f"g{i}_0"]) <= 1e-6 * size["n"]
            for j in range(len(cols)):
                v, b = g[f"g{i}_{j + 1}"], m.beta[i][j + 1]
                ok &= abs(v + l2 * b + l1 * (1 if b > 0 else -1)) <= 1e-6 * size["n"] if b else abs(v) <= l1 + 1e-6 * size["n"]
            out.append((float(m.c[i]), float(m.l1_ratio[i]), bool(ok)))
    return spark.createDataFrame(out, "c double, l1_ratio double, ok boolean").groupBy("c", "l1_ratio").agg(F.count("*").alias("sets"), F.every("ok").alias("stationary"))


def _path(spark, sf, folds, **options):
    f = M.stratified_folds(M.model_frame(_facts(spark, sf), IDS, ALL_FEATURES), folds, 7)
    return B.penalty_path(f, M.feature_columns(f), M.C_GRID, **options)


def _table(spark, path):
    return spark.createDataFrame([(float(c), float(r), float(a), float(s), i == path.best) for i, (c, r, a, s) in enumerate(path.table)],
                                 "c double, l1_ratio double, score double, sd double, best boolean")


@query("F-07")
def f_lasso(spark, sf):
    path = _path(spark, sf, 3)
    kept = [ALL_FEATURES[int(c[1:])] for c in path.kept]
    return _table(spark, path).withColumn("kept", F.lit(",".join(kept)))


@query("F-07b", f"SELECT CAST(c AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS l1_ratio, CAST(4 AS BIGINT) AS sets, TRUE AS stationary FROM {GRID}")
def f_lasso_stationary(spark, sf):
    return _stationary(spark, _path(spark, sf, 3))


@query("F-08")
def f_enet(spark, sf):
    return _table(spark, _path(spark, sf, 3, l1_ratios=(0.5, 0.8, 1.0), scoring="auc", one_se=True))


@query("F-08b", f"SELECT CAST(c AS DOUBLE) AS c, CAST(r AS DOUBLE) AS l1_ratio, CAST(4 AS BIGINT) AS sets, TRUE AS stationary FROM {GRID}, (SELECT unnest([0.5, 0.8, 1]) AS r)")
def f_enet_stationary(spark, sf):
    return _stationary(spark, _path(spark, sf, 3, l1_ratios=(0.5, 0.8, 1.0), scoring="auc"))


@query("F-09")
def f_multinomial(spark, sf):
    f = M.model_frame(_facts(spark, sf), ["patient_id", "label3"], MODEL_FEATURES).withColumnRenamed("label3", "y")
    x = M.balanced_weights(M.Preparation.fit(f, M.feature_columns(f)).apply(f)).select("patient_id", "y", "w", "features")
    return _coefs(spark, M.multinomial_lasso(x)[0])


@query("F-10")
def f_svm(spark, sf):
    _, _, scores = M.linear_svm_cv(_prepared(spark, sf))
    return spark.createDataFrame([(float(c), float(s)) for c, s in scores], "c double, balanced_accuracy double")


@query("F-11")
def f_rbf(spark, sf):
    _, _, _, scores = M.rbf_svm_cv(_prepared(spark, sf))
    return spark.createDataFrame([(float(g), float(c), float(s)) for g, c, s in scores], "gamma double, c double, balanced_accuracy double")


@query("F-12")
def f_platt(spark, sf):
    o = S.oof(spark, sf).withColumn("score", F.ln(F.col("proba") / (1 - F.col("proba"))))
    return M.platt_proba(o.where("fold <> 0"), o.where("fold = 0").drop("proba")).select("patient_id", "y", F.round("proba", 6).alias("proba"))


@query("F-13", S.cte("wide", "+, c AS (SELECT y, count(*) AS n FROM wide GROUP BY 1), k AS (SELECT CAST(range AS INTEGER) AS fold FROM range(5)) SELECT y, fold, CAST((n - fold + 4) // 5 AS BIGINT) AS n FROM c, k"))
def f_folds(spark, sf):
    return M.stratified_folds(S.wide(spark, sf).select("patient_id", "y"), 5).groupBy("y", "fold").agg(F.count("*").alias("n"))


@query("F-14", S.cte("wide", "SELECT patient_id, cohort, CAST(dense_rank() OVER (ORDER BY cohort) - 1 AS INTEGER) AS fold FROM wide"))
def f_groups(spark, sf):
    return M.group_folds(S.wide(spark, sf).select("patient_id", "cohort"))


@query("F-15")
def f_cv(spark, sf):
    oof, _ = M.cross_validate(_frame(spark, sf))
    return rounded(M.fold_metrics(oof))


@query("F-16")
def f_external(spark, sf):
    return rounded(M.external_validate(M.model_frame(_facts(spark, sf), IDS, MODEL_FEATURES), "ASIA"))


@query("F-17")
def f_ablation(spark, sf):
    return rounded(M.ablation(_facts(spark, sf), IDS, {"all": MODEL_FEATURES, "airway": ["Pi10", "TD_ratio_all"]}, 3))


@query("F-18")
def f_nested(spark, sf):
    """Screening and LASSO path inside every left-out cohort, at their own settings."""
    oof, _ = M.nested_loco(_facts(spark, sf), IDS)
    return rounded(P.rank_auc(oof, ["cohort"], "y", "proba"))


@query("F-18b", S.cte("wide", "SELECT cohort, count(*) AS n, count(*) FILTER (y = 1) AS positives, TRUE AS scored FROM wide GROUP BY 1"))
def f_nested_rows(spark, sf):
    """Every row once, in the fold that left its cohort out, with a probability from the path that chose its penalty there."""
    oof, _ = M.nested_loco(_facts(spark, sf), IDS)
    return oof.groupBy("cohort").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("positives"), F.every(F.col("proba").between(0, 1) & F.col("in_train")).alias("scored"))


@query("F-19")
def f_drop(spark, sf):
    f = _facts(spark, sf)
    task = f.where("label3 <> 1").withColumn("y", (F.col("label3") == 2).cast("int"))
    oof, _ = M.nested_loco(task, IDS, score_all=f.where("label3 = 1").drop("y"))
    return oof.groupBy("in_train", "cohort").agg(F.count("*").alias("n"), F.round(F.avg("proba"), 5).alias("mean_risk"))


CHOSEN = "SELECT CAST(patient_id % 5 AS INTEGER) AS fold, feature FROM obs WHERE value > 100 AND feature <> 'Pi10'"


@query("F-20", S.cte("fact obs", f"+, c AS (SELECT feature, count(DISTINCT fold) AS t FROM ({CHOSEN}) GROUP BY 1) SELECT feature, coalesce(t, 0) AS times, round(coalesce(t, 0) / 5, 6) AS frequency FROM (SELECT DISTINCT feature FROM fact) LEFT JOIN c USING (feature)"))
def f_frequency(spark, sf):
    o = S.obs(spark, sf)
    chosen = o.where("value > 100 AND feature <> 'Pi10'").select((F.col("patient_id") % 5).cast("int").alias("fold"), "feature")
    return rounded(M.selection_frequency(chosen, S.fact(spark, sf), 5))


@query("F-21", S.cte("wide", "+, c AS (SELECT y, count(*) AS n FROM wide GROUP BY 1) SELECT y, (SELECT min(n) FROM c) AS n FROM c"))
def f_downsample(spark, sf):
    return M.downsample_majority(S.wide(spark, sf).select("patient_id", "y")).groupBy("y").agg(F.count("*").alias("n"))


def _mix32(x):
    """The mixing function of :func:`batched.mix32` in SQL; lists bind a value to a name."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = f"list_transform([{x}], lambda v: CAST((CAST(xor(v, v >> {shift}) AS UHUGEINT) * {factor}) % 4294967296 AS UBIGINT))[1]"
    return f"list_transform([{x}], lambda v: xor(v, v >> 16))[1]"


# ids under 2**32, so the upper half of the key is zero
DRAWS = f""", r AS (SELECT unnest(range(200)) AS replica), k AS (SELECT y, {_mix32("xor(CAST(patient_id AS UBIGINT) % 4294967296, {high})")} AS k FROM wide),
 h AS (SELECT replica, y, {_mix32("CAST((k + CAST(replica AS UBIGINT) * 2654435769) % 4294967296 AS UBIGINT)")} AS h FROM k, r),
 d AS (SELECT replica, y, len(list_filter({B.STEPS}, lambda s: s <= h)) AS w FROM h)"""
HIGH = int(B.mix32(np.array([42], np.uint64))[0])


def _resampled(models, replicas=200):
    """(replica, n, n_pos, settled): size and positives of a replica from its class totals, over all its sets."""
    whole = [int(round(v)) for v in models.class_n.sum(axis=1)], [int(round(v)) for v in models.class_n[:, 1]]
    sets = len(models.rows.held)
    per = max(sets - 1, 1)  # a row trains in all sets but one
    rows = []
    for b in range(replicas):
        mine = [i for i in range(len(models.set)) if models.replica[i] == b]
        rows.append((b, sum(whole[0][i] for i in mine) // per, sum(whole[1][i] for i in mine) // per, bool((models.residual[mine] <= 1e-9).all())))
    return rows


@query("F-22")
def f_boot(spark, sf):
    f = M.stratified_folds(M.model_frame(_facts(spark, sf), IDS, ALL_FEATURES), 5)
    return rounded(B.bootstrap_model_auc(f, M.feature_columns(f), 200)[0])


@query("F-22b", S.cte("wide", "+" + DRAWS.replace("{high}", str(HIGH)) + " SELECT CAST(replica AS INTEGER) AS replica, CAST(sum(w) AS BIGINT) AS n, CAST(coalesce(sum(w) FILTER (y = 1), 0) AS BIGINT) AS n_pos, TRUE AS settled FROM d WHERE y IS NOT NULL GROUP BY 1"))
def f_boot_settled(spark, sf):
    f = M.stratified_folds(M.model_frame(_facts(spark, sf), IDS, ALL_FEATURES), 5)
    models = B.Models(B.Rows(f, M.feature_columns(f)), 200).fit()
    return spark.createDataFrame(_resampled(models), "replica int, n bigint, n_pos bigint, settled boolean")


@query("F-23", "SELECT DISTINCT o_custkey % 50 AS config, o_orderpriority AS strategy FROM orders EXCEPT SELECT o_custkey % 50, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000")
def f_sweep(spark, sf):
    o = S.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("config"), F.col("o_orderpriority").alias("strategy"), "o_orderstatus", "o_totalprice")
    return M.remaining_configs(o.select("config", "strategy").distinct(), o.where("o_orderstatus = 'F' AND o_totalprice > 400000"), ["config", "strategy"])


@query("F-24")
def f_final(spark, sf):
    f = M.model_frame(_facts(spark, sf), IDS, MODEL_FEATURES)
    return M.final_model(f, sinks.scratch_dir(spark, "model")).select("patient_id", "y", F.round("proba", 5).alias("proba"))


@query("F-25")
def f_mlp(spark, sf):
    x = _prepared(spark, sf)
    return M.mlp(x).transform(x).groupBy("y", F.col("prediction").cast("int").alias("pred")).agg(F.count("*").alias("n"))


@query("F-26")
def f_optimism(spark, sf):
    f = M.model_frame(_facts(spark, sf), IDS, ALL_FEATURES)
    return rounded(B.bootstrap_optimism(f, M.feature_columns(f), 200)[0])


@query("F-26b", S.cte("wide", "+" + DRAWS.replace("{high}", str(HIGH)) + " SELECT CAST(replica AS INTEGER) AS replica, CAST(sum(w) AS BIGINT) AS n, CAST(coalesce(sum(w) FILTER (y = 1), 0) AS BIGINT) AS n_pos, TRUE AS settled FROM d WHERE y IS NOT NULL GROUP BY 1"))
def f_optimism_settled(spark, sf):
    f = M.model_frame(_facts(spark, sf), IDS, ALL_FEATURES)
    models = B.bootstrap_optimism(f, M.feature_columns(f), 200)[1]
    return spark.createDataFrame(_resampled(models), "replica int, n bigint, n_pos bigint, settled boolean")


@query("F-27")
def f_holdout(spark, sf):
    f = M.model_frame(_facts(spark, sf), IDS, MODEL_FEATURES).withColumn("fold", M.holdout(F.col("patient_id")).cast("int"))
    train, test = f.where("fold = 0"), f.where("fold = 1")
    prep = M.Preparation.fit(train, M.feature_columns(f))
    model = M.logit_l2(M.balanced_weights(prep.apply(train)))
    return rounded(M.misclassification(M._scores(model, prep.apply(test), ["patient_id"])))


# ---- incremental ------------------------------------------------------------------------------------------------------------------------

@query("ST-01", """SELECT CASE WHEN user_id % 10 = 0 THEN 'fail' WHEN user_id % 10 = 1 THEN 'no_mask' ELSE 'ok' END AS status, count(*) AS n, CAST(coalesce(sum(CASE WHEN user_id % 10 > 1 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END), 0) AS DOUBLE) AS total FROM events GROUP BY 1""")
def st_ingest(spark, sf):
    """Events of each day arrive as files of (patient, record) and are drained by one available-now stream."""
    src, facts, manifest, ck = (sinks.scratch_dir(spark, n) for n in ("in", "facts", "manifest", "stream"))
    u = F.col("user_id") % 10
    ev = S.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("patient_id"), F.when(u == 0, "{broken").when(u == 1, "{}").otherwise(F.col("props")).alias("record"))
    ev.repartition(4).write.parquet(src)
    I.ingest_new_patients(spark, src, facts, ck, manifest, files_per_batch=2).awaitTermination()
    m = spark.read.schema("item STRING, status STRING, reason STRING, batch INT").parquet(manifest)
    f = I.current_facts(spark.read.schema(I.FACT_SCHEMA).parquet(facts)).groupBy(F.col("patient_id").alias("item")).agg(F.sum("value").alias("v"))
    return m.join(f, "item", "left").groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))


@query("ST-02", S.cte("obs fact", """+, base AS (SELECT patient_id, feature, value FROM fact WHERE feature IN ('CAC_Agatston', 'Pi10')), late AS (SELECT patient_id, feature, coalesce(value, -1) + 1 AS value FROM fact WHERE feature IN ('CAC_Agatston', 'TD_ratio_all'))
 SELECT feature, count(*) AS n, count(value) AS present, round(sum(value), 4) AS total FROM (SELECT feature, coalesce(b.value, l.value) AS value FROM base b FULL JOIN late l USING (patient_id, feature)) GROUP BY 1"""))
def st_upsert(spark, sf):
    path = sinks.scratch_dir(spark, "log")
    f = S.fact(spark, sf).select(F.col("patient_id").cast("string").alias("patient_id"), "feature", "value")
    I.upsert_features(f.where("feature in ('CAC_Agatston', 'Pi10')"), path)
    late = f.where("feature in ('CAC_Agatston', 'TD_ratio_all')").withColumn("value", F.coalesce("value", F.lit(-1.0)) + 1)
    for _ in range(2):  # the second run of the same batch changes nothing
        I.upsert_features(late, path, "fill")
    cur = I.current_facts(spark.read.schema(I.FACT_SCHEMA).parquet(path))
    return cur.groupBy("feature").agg(F.count("*").alias("n"), F.count("value").alias("present"), F.round(F.sum("value"), 4).alias("total"))
