"""Evaluation of predictions: curves, metrics, calibration, net benefit.

Curves start from one row per distinct score and running sums that are cut into blocks, so a billion scores do not meet
in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phenospark.functions.prefix import exact_quantiles, prefix_sums, value_counts
from phenospark.functions.special import chi2_tail_sql
from phenospark.operators.stats import rank_auc


def confusion(df: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    a, b = F.col(y), F.col(pred)
    g = df.groupBy(*keys).agg(
        F.count_if((a == 0) & (b == 0)).alias("tn"), F.count_if((a == 0) & (b == 1)).alias("fp"),
        F.count_if((a == 1) & (b == 0)).alias("fn"), F.count_if((a == 1) & (b == 1)).alias("tp"))
    d = lambda n, m: F.try_divide(F.col(n).cast("double"), F.col(n) + F.col(m))
    return g.withColumns({"tn_share": d("tn", "fp"), "tp_share": d("tp", "fn")})


def _score_table(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """One row per distinct score, highest first: tp/fp up to and including it, totals."""
    vc = value_counts(df.where(F.col(y).isNotNull()), keys, score, {"pos": (F.col(y) == 1).cast("int"), "neg": (F.col(y) == 0).cast("int")})
    pre = prefix_sums(vc, keys, score, ["pos", "neg"], descending=True)
    return pre.select(*keys, F.col(score).alias("score"), "pos", "neg", (F.col("before_pos") + F.col("pos")).alias("tp"),
                      (F.col("before_neg") + F.col("neg")).alias("fp"), "total_pos", "total_neg")


def average_precision(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "proba") -> DataFrame:
    """Sum over thresholds of (recall step) x precision; equal scores form one threshold."""
    t = _score_table(df, keys, y, score)
    return t.groupBy(*keys).agg(F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("total_pos") * (F.col("tp") + F.col("fp")))).alias("ap"))


def binary_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred", score: str = "proba") -> DataFrame:
    keys = list(keys)
    c = confusion(df, keys, y, pred).drop("tn_share", "tp_share")
    r = lambda a, b: F.try_divide(a.cast("double"), b)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    sens, spec = r(tp, tp + fn), r(tn, tn + fp)
    m = c.select(*keys, n.alias("n"), r(tp + tn, n).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"), sens.alias("sensitivity"),
                 spec.alias("specificity"), r(tp, tp + fp).alias("ppv"), r(tn, tn + fn).alias("npv"), r(2 * tp, 2 * tp + fp + fn).alias("f1"))
    return m.join(rank_auc(df, keys, y, score).select(*keys, "auc"), keys).join(average_precision(df, keys, y, score), keys)


def multiclass_metrics(df: DataFrame, keys: Sequence[str], label: str, pred: str, probs: dict[int, str], clip: float = 1e-7) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1, log-loss and one-versus-rest AUC (macro). ``probs``: class -> column."""
    keys = list(keys)
    p_true = reduce(lambda acc, kv: acc.when(F.col(label) == kv[0], F.col(kv[1])), list(probs.items())[1:],
                    F.when(F.col(label) == list(probs)[0], F.col(list(probs.values())[0])))
    p_true = F.least(F.greatest(p_true, F.lit(clip)), F.lit(1 - clip))
    aggs, sens, f1 = [], [], []
    for k in probs:
        a, b = F.col(label) == k, F.col(pred) == k
        tp, nt, npred = F.count_if(a & b), F.count_if(a), F.count_if(b)
        sens.append(F.try_divide(tp.cast("double"), nt))
        f1.append(F.coalesce(F.try_divide((2 * tp).cast("double"), nt + npred), F.lit(0.0)))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
        (sum(sens[1:], sens[0]) / len(sens)).alias("balanced_accuracy"), (sum(f1[1:], f1[0]) / len(f1)).alias("macro_f1"),
        F.avg(-F.ln(p_true)).alias("log_loss"))
    ovr = df.select(*keys, F.col(label).alias("_l"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(c).alias("p")) for k, c in probs.items()])).alias("_c"))
    ovr = ovr.select(*keys, F.col("_c.k").alias("cls"), F.col("_c.p").alias("p"), (F.col("_l") == F.col("_c.k")).cast("int").alias("y"))
    auc = rank_auc(ovr, [*keys, "cls"], "y", "p").groupBy(*keys).agg(F.avg("auc").alias("macro_ovr_auc"))
    return out.join(auc, keys)


def roc_curve(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "proba") -> DataFrame:
    t = _score_table(df, keys, y, score)
    return t.select(*keys, "score", F.try_divide(F.col("fp").cast("double"), "total_neg").alias("fpr"), F.try_divide(F.col("tp").cast("double"), "total_pos").alias("tpr"))


def pr_curve(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "proba") -> DataFrame:
    t = _score_table(df, keys, y, score)
    return t.select(*keys, "score", F.try_divide(F.col("tp").cast("double"), "total_pos").alias("recall"),
                    F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"))


def mean_roc(df: DataFrame, fold: str, points: int = 101, y: str = "y", score: str = "proba") -> DataFrame:
    """Per-fold ROC read off at a common grid, then mean and sd; the ends are pinned at 0 and 1.

    Every curve step covers the grid points up to its own rate, so each step emits its grid points itself and no
    window over whole curves is needed: the step's left end comes from its own counts.
    """
    t = _score_table(df, [fold], y, score)
    x1, x0 = F.col("fp") / F.col("total_neg"), (F.col("fp") - F.col("neg")) / F.col("total_neg")
    y1, y0 = F.col("tp") / F.col("total_pos"), (F.col("tp") - F.col("pos")) / F.col("total_pos")
    m = points - 1
    lo, hi = F.ceil(x0 * m - 1e-9), F.floor(x1 * m + 1e-9)
    g = t.where(lo <= hi).select(fold, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"),
                                 F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("i"))
    at = F.col("i") / m
    # a vertical step ends at its upper point, which is where interpolation over the curve's points reads it
    tpr = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("y1") - F.col("y0")) * F.least(F.greatest(F.try_divide(at - F.col("x0"), F.col("x1") - F.col("x0")), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("y1"))
    per = g.select(fold, "i", tpr.alias("tpr")).groupBy(fold, "i").agg(F.max("tpr").alias("tpr"))
    per = per.withColumn("tpr", F.when(F.col("i") == 0, 0.0).when(F.col("i") == m, 1.0).otherwise(F.col("tpr")))
    return per.groupBy("i").agg(F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("sd_tpr")).select(
        (F.col("i") / m).alias("fpr"), "mean_tpr", "sd_tpr")


def per_cohort_auc(df: DataFrame, cohort: str = "cohort", y: str = "y", score: str = "proba") -> DataFrame:
    """AUC by cohort; one-class cohorts are left out."""
    return rank_auc(df, [cohort], y, score).where("auc is not null")


def risk_summary(df: DataFrame, label: str = "label3", score: str = "proba") -> DataFrame:
    p = F.col(score)
    share = lambda c: F.avg(c.cast("double"))
    g = df.groupBy(label).agg(F.count("*").alias("n"), F.avg(p).alias("mean"), share(p.between(0.4, 0.6)).alias("gray"),
                              share(p < 0.4).alias("below"), share(p > 0.6).alias("above"), share(p >= 0.5).alias("high"))
    return g.join(exact_quantiles(df, [label], score, {"q25": 0.25, "median": 0.5, "q75": 0.75}), label)


def sigmoid_risk(score: Column, clip: float = 500.0) -> Column:
    s = F.least(F.greatest(score, F.lit(-clip)), F.lit(clip))
    return 1 / (1 + F.exp(-s))


def _quantile_groups(df: DataFrame, score: str, groups: int) -> DataFrame:
    """Group 0..g-1 by distinct quantile cuts (right-closed), cuts from the exact quantiles (at most g numbers)."""
    probs = {f"c{i}": i / groups for i in range(1, groups)}
    one = df.withColumn("_all", F.lit(0))
    cuts = exact_quantiles(one, ["_all"], score, probs).select(F.array_distinct(F.array(*probs)).alias("cuts"))
    cut = cuts.first()["cuts"]
    return df.withColumn("grp", sum([(F.col(score) > c).cast("int") for c in cut], F.lit(0)))


def hosmer_lemeshow(df: DataFrame, groups: int = 10, df_minus: int = 2, y: str = "y", score: str = "proba") -> tuple[DataFrame, DataFrame]:
    """(groups table, chi-square and p)."""
    g = _quantile_groups(df, score, groups).groupBy("grp").agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"),
        F.sum(score).alias("expected"), F.sum(F.col(y).cast("double")).alias("observed"))
    e, o, n = F.col("expected"), F.col("observed"), F.col("n")
    chi = g.agg(F.sum(F.try_divide((o - e) * (o - e), e * (1 - e / n))).alias("chi2"), F.count("*").alias("groups"))
    chi = chi.withColumn("_z", F.sqrt(F.col("chi2") / 2))
    return g, chi.select("chi2", "groups", F.expr(chi2_tail_sql("chi2", "_z", groups - df_minus)).alias("p"))


def decision_curve(df: DataFrame, thresholds: Sequence[float], ymin: float = -1.0, y: str = "y", score: str = "proba") -> DataFrame:
    """Net benefit of model and treat-all per threshold. Rows are counted per threshold interval first, then summed
    over the (few) intervals, so no row is copied per threshold."""
    ts = sorted(thresholds)
    at = sum([(F.col(score) >= t).cast("int") for t in ts], F.lit(0))
    c = df.groupBy(at.alias("k")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ts)], "j int, t double")
    tot = c.agg(F.lit(1).alias("_one"), F.sum("pos").alias("P"), F.sum("neg").alias("Q"))
    got = c.where("k > 0").select(F.explode(F.sequence(F.lit(1), "k")).alias("j"), "pos", "neg").groupBy("j").agg(
        F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    j = grid.join(got, "j", "left").withColumn("_one", F.lit(1)).join(tot, "_one")
    n, odds = F.col("P") + F.col("Q"), F.col("t") / (1 - F.col("t"))
    nb = (F.coalesce("tp", F.lit(0)) - F.coalesce("fp", F.lit(0)) * odds) / n
    al = (F.col("P") - F.col("Q") * odds) / n
    keep = lambda c: F.when(c > ymin, c)
    return j.select("t", keep(nb).alias("model"), keep(al).alias("all"), F.lit(0.0).alias("none"))


def calibration(df: DataFrame, y: str = "y", score: str = "proba", rounds: int = 25, tol: float = 1e-10) -> DataFrame:
    """Logistic recalibration (intercept, slope) by Newton steps on five sums per round, Brier, scaled Brier, R2, U, D, Q
    and the largest shift on a grid. One small aggregate per round; nothing but the sums reaches the driver."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    d = df.select(F.ln(p / (1 - p)).alias("x"), F.col(y).cast("double").alias("y"), p.alias("p")).where("x is not null and y is not null")
    a, b = 0.0, 1.0
    for _ in range(rounds):
        m = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w = m * (1 - m)
        r = d.agg(F.sum(F.col("y") - m), F.sum((F.col("y") - m) * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
        det = r[2] * r[4] - r[3] * r[3]
        da, db = (r[4] * r[0] - r[3] * r[1]) / det, (r[2] * r[1] - r[3] * r[0]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < tol:
            break
    ll = lambda q: F.sum(F.when(F.col("y") == 1, F.ln(q)).otherwise(F.ln(1 - q)))
    m = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
    s = d.agg(F.count("*").alias("n"), F.avg("y").alias("ybar"), F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("brier"), ll(F.col("p")).alias("l1"), ll(m).alias("l2"))
    n = F.col("n")
    l0 = n * (F.col("ybar") * F.ln("ybar") + (1 - F.col("ybar")) * F.ln(1 - F.col("ybar")))
    big_d = (2 * (F.col("l2") - l0) - 1) / n
    big_u = (2 * (F.col("l2") - F.col("l1")) - 2) / n
    grid = [i / 100 for i in range(1, 100)]
    emax = max(abs(g - 1 / (1 + math.exp(-(a + b * math.log(g / (1 - g)))))) for g in grid)
    r2 = (1 - F.exp(2 * (l0 - F.col("l2")) / n)) / (1 - F.exp(2 * l0 / n))
    return s.select(F.lit(a).alias("intercept"), F.lit(b).alias("slope"), "brier", (1 - F.col("brier") / (F.col("ybar") * (1 - F.col("ybar")))).alias("brier_scaled"),
                    F.lit(emax).alias("emax"), r2.alias("r2"), big_u.alias("u"), big_d.alias("d"), (big_d - big_u).alias("q"))


def calibration_groups(df: DataFrame, groups: int = 10, y: str = "y", score: str = "proba") -> DataFrame:
    g = _quantile_groups(df, score, groups).groupBy("grp").agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    half = 1.96 * F.sqrt(F.col("observed") * (1 - F.col("observed")) / F.col("n"))
    return g.withColumns({"lo": F.greatest(F.col("observed") - half, F.lit(0.0)), "hi": F.least(F.col("observed") + half, F.lit(1.0))})


def smooth_calibration(df: DataFrame, y: str = "y", score: str = "proba", points: int = 100_000) -> DataFrame:
    """Monotone calibration curve and its mean absolute distance from the score (isotonic in place of local regression).

    Scores are first pooled in at most ``points`` blocks of equal rank width, a bound on what the fit gathers; up to so many
    rows every distinct score is a block of its own."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    t = prefix_sums(value_counts(df, [], score, {"n": F.lit(1), "pos": F.col(y)}), [], score, ["n"])
    block = F.floor(F.col("before_n") * F.lit(float(points)) / F.greatest(F.col("total_n"), F.lit(float(points))))
    d = t.groupBy(block.alias("_b")).agg((F.sum(F.col(score) * F.col("n")) / F.sum("n")).alias("p"), (F.sum("pos") / F.sum("n")).alias("label"), F.sum("n").cast("double").alias("w"))
    d = d.withColumn("features", array_to_vector(F.array("p")))
    model = IsotonicRegression(weightCol="w").fit(d)
    return model.transform(d).agg((F.sum(F.abs(F.col("prediction") - F.col("p")) * F.col("w")) / F.sum("w")).alias("eavg"), F.count("*").alias("points"))


def c_statistic_ci(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "proba") -> DataFrame:
    """c with +-1.96 standard errors from the variance of placement values (one row per distinct score)."""
    vc = value_counts(df, keys, score, {"pos": (F.col(y) == 1).cast("int"), "neg": (F.col(y) == 0).cast("int")})
    t = prefix_sums(vc, keys, score, ["pos", "neg"])
    vp = (F.col("before_neg") + F.col("neg") / 2) / F.col("total_neg")
    vn = 1 - (F.col("before_pos") + F.col("pos") / 2) / F.col("total_pos")
    g = t.groupBy(*keys).agg(
        F.max("total_pos").alias("P"), F.max("total_neg").alias("Q"), (F.sum(F.col("pos") * vp) / F.max("total_pos")).alias("c"),
        F.sum(F.col("pos") * vp * vp).alias("sp"), F.sum(F.col("neg") * vn * vn).alias("sn"))
    var = (F.col("sp") / F.col("P") - F.col("c") ** 2) / (F.col("P") - 1) + (F.col("sn") / F.col("Q") - F.col("c") ** 2) / (F.col("Q") - 1)
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    return g.select(*keys, "c", se.alias("se"), (F.col("c") - 1.96 * se).alias("lo"), (F.col("c") + 1.96 * se).alias("hi"))


def discrimination_slope(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "proba") -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(F.when(F.col(y) == 1, F.col(score))) - F.avg(F.when(F.col(y) == 0, F.col(score)))).alias("slope"))


def coefficient_summary(coefs: DataFrame) -> DataFrame:
    """(feature, fold, coef) -> mean, sd, |mean|, largest first."""
    return coefs.groupBy("feature").agg(F.avg("coef").alias("mean"), F.stddev_samp("coef").alias("sd"), F.abs(F.avg("coef")).alias("abs_mean")).orderBy(
        F.desc("abs_mean"), "feature")


def cohort_label_counts(df: DataFrame, cohort: str = "cohort", label: str = "label3", labels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    return df.groupBy(cohort).agg(*[F.count_if(F.col(label) == k).alias(f"label_{k}") for k in labels])


def result_matrix(results: DataFrame, row: Sequence[str], column: str, columns: Sequence[str], value: str = "auc") -> DataFrame:
    """Long results -> one row per (task, configuration), one column per cohort."""
    return results.groupBy(*row).pivot(column, list(columns)).agg(F.first(value))
