"""Risk models on Spark ML. Frames reaching a model hold the selected features only (a few dozen columns)."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenospark.functions.prefix import prefix_sums, value_counts
from phenospark.operators.batched import SharedPasses, View, fold_medians, penalty_path
from phenospark.operators.evaluate import binary_metrics
from phenospark.operators.keys import to_long, to_wide
from phenospark.operators.profile import fit_medians
from phenospark.operators.screen import pool_binary_left_out, pool_multiclass, select_features, select_features_left_out, training_rows
from phenospark.operators.stats import rank_auc
from phenospark.session import checkpointed
from phenospark.sources.sinks import scratch_dir

C_GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0)


# ---- rows, folds and weights ---------------------------------------------------------------------------------------------------

def balanced_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Add ``w`` = n / (k * n_class): class counts are a handful of rows joined back."""
    n = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("_c"))
    tot = n.withColumn("_t", F.sum("_c").over(W.partitionBy(F.lit(0)))).withColumn("_k", F.count("*").over(W.partitionBy(F.lit(0))))
    return df.join(tot.select(y, (F.col("_t") / (F.col("_k") * F.col("_c"))).alias("w")), y)


def _hash_rank(df: DataFrame, by: Sequence[str], id_: str, seed: int) -> DataFrame:
    """Add ``_r``: 0-based position by seeded hash within ``by``, without sorting a class in one task."""
    d = df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(id_)))
    pre = prefix_sums(value_counts(d, by, "_hash"), by, "_hash", ["n"]).select(*by, "_hash", F.col("before_n").alias("_r"))
    return d.join(pre, [*by, "_hash"]).drop("_hash")


def stratified_folds(df: DataFrame, k: int, seed: int = 42, y: str = "y", id_: str = "patient_id") -> DataFrame:
    """Add ``fold``: seeded shuffle per class, dealt round robin. Stable under any partitioning."""
    return _hash_rank(df, [y], id_, seed).withColumn("fold", F.pmod("_r", F.lit(k)).cast("int")).drop("_r")


def inner_folds(df: DataFrame, k: int, fold: str, folds: Sequence[int], seed: int = 42, y: str = "y", id_: str = "patient_id") -> DataFrame:
    """Add ``inner_<j>`` per fold j: :func:`stratified_folds` of the rows outside fold j. A row's position there is its position among
    all rows less the rows of fold j before it, so one table of positions serves all."""
    d = df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(id_)))
    counts = {"n": F.lit(1)} | {f"n{j}": (F.col(fold) == j).cast("int") for j in folds}
    pre = prefix_sums(value_counts(d, [y], "_hash", counts), [y], "_hash", list(counts))
    at = [F.when(F.col(fold) != j, F.pmod(F.col("before_n") - F.col(f"before_n{j}"), F.lit(k))).cast("int").alias(f"inner_{j}") for j in folds]
    return d.join(pre.drop("n", *[f"n{j}" for j in folds]), [y, "_hash"], "left").select(*df.columns, *at)


def _stored_columns(df: DataFrame, key: str) -> DataFrame:
    """Rows as Parquet in the shared folder, for passes that read some of the columns, in at least one file per core."""
    def written(d: DataFrame) -> DataFrame:
        path = scratch_dir(d.sparkSession, "frame")
        d.write.parquet(path)
        return d.sparkSession.read.schema(df.schema).parquet(path)

    n = df.sparkSession.sparkContext.defaultParallelism
    got = written(df)
    return got if got.rdd.getNumPartitions() >= n else written(got.repartition(n, key))


def group_folds(df: DataFrame, group: str = "cohort") -> DataFrame:
    """Add ``fold`` = number of the cohort, for leave-one-cohort-out."""
    g = df.select(group).distinct()
    g = g.withColumn("fold", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(group)) - 1).cast("int"))  # one row per cohort
    return df.join(g, group)


def downsample_majority(df: DataFrame, seed: int = 42, y: str = "y", id_: str = "patient_id") -> DataFrame:
    """Equal class sizes by seeded hash order."""
    low = df.groupBy(y).agg(F.count("*").alias("_c")).agg(F.min("_c")).first()[0]
    return _hash_rank(df, [y], id_, seed).where(F.col("_r") < low).drop("_r")


def holdout(id_: Column, frac: float = 0.2, seed: int = 42) -> Column:
    """True for the test part; depends on the id only."""
    return F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(1_000_000)) < int(frac * 1_000_000)


# ---- preparation ------------------------------------------------------------------------------------------------------------------

def model_frame(facts: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Selected long facts -> wide frame with columns f0, f1, ... in the order of ``features``."""
    w = to_wide(facts.where(F.col("feature").isin(*features)), ids, features)
    return w.select(*ids, *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(features)])


class Preparation:
    """Median, mean and scale per column, fitted on training rows (a few numbers per selected feature)."""

    def __init__(self, cols: Sequence[str], median: dict, mean: dict, scale: dict):
        self.cols, self.median, self.mean, self.scale = list(cols), median, mean, scale

    @classmethod
    def fit(cls, train: DataFrame, cols: Sequence[str]) -> Preparation:
        holes = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
        med = {c: 0.0 for c in cols}
        gaps = [c for c in cols if holes[c]]
        if gaps:
            long = to_long(train.select(*gaps), [], gaps)
            med |= {r["feature"]: r["median"] if r["median"] is not None else 0.0 for r in fit_medians(long).collect()}
        filled = {c: F.coalesce(F.col(c), F.lit(float(med[c]))) for c in cols}
        s = train.agg(*[F.avg(e).alias(f"m{c}") for c, e in filled.items()], *[F.stddev_pop(e).alias(f"s{c}") for c, e in filled.items()]).first()
        return cls(cols, med, {c: s[f"m{c}"] or 0.0 for c in cols}, {c: s[f"s{c}"] or 1.0 for c in cols})

    def apply(self, df: DataFrame) -> DataFrame:
        """Add the scaled ``features`` vector."""
        v = F.array(*[(F.coalesce(F.col(c), F.lit(float(self.median[c]))) - float(self.mean[c])) / float(self.scale[c]) for c in self.cols])
        return df.withColumn("features", array_to_vector(v))

    def pipeline(self, model) -> PipelineModel:
        """The preparation and a fitted model as one saved unit that scores new rows of the same columns."""
        ready = [f"(coalesce({c}, {float(self.median[c])!r}D) - {float(self.mean[c])!r}D) / {float(self.scale[c])!r}D AS _{c}" for c in self.cols]
        sql = SQLTransformer(statement=f"SELECT *, {', '.join(ready)} FROM __THIS__")
        return PipelineModel([sql, VectorAssembler(inputCols=[f"_{c}" for c in self.cols], outputCol="features"), model])


def feature_columns(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[0] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:]))


# ---- estimators ---------------------------------------------------------------------------------------------------------------------

def _reg(c: float, total: float) -> float:
    return 1.0 / (c * total)


def _total(df: DataFrame, w: str) -> float:
    return float(df.agg(F.sum(w)).first()[0])


def logit_l2(train: DataFrame, c: float = 1.0, w: str = "w"):
    """Ridge logistic regression with the objective sum(w*loss) + |b|^2/(2c), intercept unpenalised."""
    return LogisticRegression(labelCol="y", weightCol=w, regParam=_reg(c, _total(train, w)), elasticNetParam=0.0, standardization=False, maxIter=100).fit(train)


def _cv(est, grid, evaluator, train: DataFrame, folds: int, parallelism: int = 4):
    f = stratified_folds(train, folds, 7) if "fold_in" not in train.columns else train.withColumnRenamed("fold_in", "fold")
    # the few selected columns are cut from their lineage once; every candidate model then reads this small table
    f = checkpointed(f.select("patient_id", "y", "w", "fold", *[c for c in ("features", "rff") if c in f.columns]))
    return CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=parallelism).fit(f)


def lasso_logit_cv(train: DataFrame, cs: Sequence[float] = C_GRID, l1_ratios: Sequence[float] = (1.0,), folds: int = 3, scoring: str = "log_loss",
                   one_se: bool = False, w: str = "w", family: str = "auto"):
    """L1 or elastic-net logistic regression tuned by inner folds. Returns (model, kept positions, table of scores).

    Kept: |coefficient| > 1e-7 in any class, or the three largest. ``one_se`` takes the strongest penalty whose mean score is
    within one standard error of the best."""
    train = checkpointed(train.select("patient_id", "y", w, "features"))
    tot = _total(train, w)
    est = LogisticRegression(labelCol="y", weightCol=w, standardization=False, maxIter=60, family=family)
    grid = ParamGridBuilder().addGrid(est.regParam, [_reg(c, tot) for c in cs]).addGrid(est.elasticNetParam, list(l1_ratios)).build()
    ev = {"log_loss": MulticlassClassificationEvaluator(labelCol="y", metricName="logLoss"), "auc": BinaryClassificationEvaluator(labelCol="y", numBins=0),
          "accuracy": MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")}[scoring]
    cv = _cv(est, grid, ev, train, folds)
    sign = 1.0 if ev.isLargerBetter() else -1.0
    avg, sd = [sign * a for a in cv.avgMetrics], cv.stdMetrics
    best = int(np.argmax(avg))
    if one_se:
        ok = [i for i in range(len(grid)) if avg[i] >= avg[best] - sd[best] / math.sqrt(folds)]
        best = max(ok, key=lambda i: grid[i][est.regParam])
    model = est.fit(train, grid[best])
    coef = np.abs(model.coefficientMatrix.toArray()).max(axis=0)
    kept = [i for i, v in enumerate(coef) if v > 1e-7] or sorted(int(i) for i in np.argsort(-coef)[:3])
    table = [(1 / (g[est.regParam] * tot), g[est.elasticNetParam], a, s) for g, a, s in zip(grid, avg, sd)]
    return model, kept, table


def multinomial_lasso(train: DataFrame, cs: Sequence[float] = C_GRID, folds: int = 3, w: str = "w"):
    return lasso_logit_cv(train, cs, (1.0,), folds, "log_loss", False, w, "multinomial")


def linear_svm_cv(train: DataFrame, cs: Sequence[float] = (0.01, 0.1, 1, 10, 100), folds: int = 3, w: str = "w"):
    """Linear SVM; inner score is balanced accuracy, which is accuracy under balanced weights. Returns (model, c, scores)."""
    train = checkpointed(train.select("patient_id", "y", w, "features"))
    tot = _total(train, w)
    est = LinearSVC(labelCol="y", weightCol=w, standardization=False, maxIter=40)
    grid = ParamGridBuilder().addGrid(est.regParam, [_reg(c, tot) for c in cs]).build()
    cv = _cv(est, grid, MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy", weightCol=w), train, folds)
    best = int(np.argmax(cv.avgMetrics))
    return cv.bestModel, cs[best], list(zip(cs, cv.avgMetrics))


def fourier_features(df: DataFrame, gamma: float, size: int = 128, seed: int = 7, col: str = "features", out: str = "rff") -> DataFrame:
    """Random Fourier features of the RBF kernel exp(-gamma*|u-v|^2), drawn once from ``seed``: an approximation whose error
    falls with ``size``."""
    p = len(df.select(vector_to_array(col).alias("v")).first()["v"])
    rng = np.random.default_rng(seed)
    wts, off = rng.normal(0.0, math.sqrt(2 * gamma), (p, size)), rng.uniform(0, 2 * math.pi, size)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.cos(np.vstack(v.to_numpy()) @ wts + off) * math.sqrt(2 / size)))

    return df.withColumn(out, array_to_vector(project(vector_to_array(col))))


def rbf_svm_cv(train: DataFrame, cs: Sequence[float] = (0.1, 1, 10, 100), gammas: Sequence[float | str] = ("scale", 0.01, 0.1, 1.0), folds: int = 3, w: str = "w",
               classes: int = 2, size: int = 128):
    """RBF support vector machine through random Fourier features. Returns (model, gamma, c, scores); several classes use
    one-versus-rest. The gamma ``scale`` is one over the number of features times the variance of all their values."""
    train = checkpointed(train.select("patient_id", "y", w, "features"))
    if "scale" in gammas:
        a = vector_to_array("features")
        s = train.select(F.size(a).alias("k"), F.aggregate(a, F.lit(0.0), lambda t, v: t + v).alias("s"), F.aggregate(a, F.lit(0.0), lambda t, v: t + v * v).alias("q")).agg(
            F.max("k").alias("k"), F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
        var = s["q"] / s["n"] - (s["s"] / s["n"]) ** 2
        gammas = [1 / (s["k"] * var) if g == "scale" and var > 0 else 1.0 if g == "scale" else g for g in gammas]
    tot, best, scores = _total(train, w), None, []
    for gamma in gammas:
        f = fourier_features(train, gamma, size)
        svc = LinearSVC(labelCol="y", weightCol=w, featuresCol="rff", standardization=False, maxIter=30)
        est = svc if classes == 2 else OneVsRest(classifier=svc, labelCol="y", featuresCol="rff", weightCol=w)
        grid = ParamGridBuilder().addGrid(svc.regParam, [_reg(c, tot) for c in cs]).build() if classes == 2 else None
        ev = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy", weightCol=w)
        if classes == 2:
            cv = _cv(est, grid, ev, f, folds)
            i = int(np.argmax(cv.avgMetrics))
            got = (cv.avgMetrics[i], cv.bestModel, gamma, cs[i])
            scores += [(gamma, c, m) for c, m in zip(cs, cv.avgMetrics)]
        else:
            tries = []
            for c in cs:
                ovr = OneVsRest(classifier=LinearSVC(labelCol="y", weightCol=w, featuresCol="rff", standardization=False, maxIter=30, regParam=_reg(c, tot)),
                                labelCol="y", featuresCol="rff", weightCol=w)
                cv = _cv(ovr, [{}], ev, f, folds)
                tries.append((cv.avgMetrics[0], cv.bestModel, gamma, c))
                scores.append((gamma, c, cv.avgMetrics[0]))
            got = max(tries, key=lambda t: t[0])
        best = got if best is None or got[0] > best[0] else best
    return best[1], best[2], best[3], scores


def margin(df: DataFrame | None = None, col: str = "rawPrediction") -> Column:
    return vector_to_array(col)[1]


def platt_proba(held_out: DataFrame, apply_to: DataFrame, score: str = "score", w: str | None = None) -> DataFrame:
    """Probability from a margin: a one-feature logistic model fitted on held-out scores."""
    fit = held_out.withColumn("_s", array_to_vector(F.array(F.col(score))))
    m = LogisticRegression(labelCol="y", featuresCol="_s", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred", **({"weightCol": w} if w else {})).fit(fit)
    a, b = float(m.intercept), float(m.coefficients[0])
    return apply_to.withColumn("proba", 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col(score)))))


def mlp(train: DataFrame, hidden: Sequence[int] = (8,), classes: int = 2, seed: int = 7, max_iter: int = 60):
    p = len(train.select(vector_to_array("features").alias("v")).first()["v"])
    return MultilayerPerceptronClassifier(labelCol="y", layers=[p, *hidden, classes], seed=seed, maxIter=max_iter).fit(train)


# ---- validation -----------------------------------------------------------------------------------------------------------------------

Fit = Callable[[DataFrame], object]


def _scores(model, df: DataFrame, ids: Sequence[str]) -> DataFrame:
    out = model.transform(df)
    raw = vector_to_array("rawPrediction")[1]
    p = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-raw))
    return out.select(*ids, "y", raw.alias("score"), p.alias("proba"), F.col("prediction").cast("int").alias("pred"))


def cross_validate(df: DataFrame, fit: Fit = logit_l2, fold: str = "fold", ids: Sequence[str] = ("patient_id",), workers: int = 4):
    """Per fold: prepare and fit on the other folds, score this one. Returns (out-of-fold rows, coefficient rows)."""
    cols = feature_columns(df)
    df = checkpointed(df)
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]

    def one(k):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        prep = Preparation.fit(train, cols)
        model = fit(balanced_weights(prep.apply(train)))
        coef = [(int(k), i, float(c)) for i, c in enumerate(model.coefficients)] if hasattr(model, "coefficients") else []
        return _scores(model, prep.apply(test), [*ids, fold]), coef

    with ThreadPoolExecutor(workers) as pool:
        parts = list(pool.map(one, folds))
    oof = parts[0][0]
    for p, _ in parts[1:]:
        oof = oof.unionByName(p)
    return oof, [c for _, cs in parts for c in cs]


def fold_metrics(oof: DataFrame, fold: str = "fold") -> DataFrame:
    return binary_metrics(oof, [fold])


def cv_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[f(c).alias(f"{c}_{n}") for c in ("auc", "accuracy", "sensitivity", "specificity") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def external_validate(df: DataFrame, train_cohort: str, fit: Fit = logit_l2, ids: Sequence[str] = ("patient_id", "cohort")) -> DataFrame:
    """Fit once on one cohort, AUC on every other."""
    cols = feature_columns(df)
    df = checkpointed(df)
    train = df.where(F.col("cohort") == train_cohort)
    prep = Preparation.fit(train, cols)
    model = fit(balanced_weights(prep.apply(train)))
    return rank_auc(_scores(model, prep.apply(df.where(F.col("cohort") != train_cohort)), ids), ["cohort"], "y", "proba")


def ablation(facts: DataFrame, ids: Sequence[str], sets: Mapping[str, Sequence[str]], k: int = 5, fit: Fit = logit_l2) -> DataFrame:
    """Cross-validated metrics per feature set, same folds for every set."""
    out = None
    for name, features in sets.items():
        frame = stratified_folds(model_frame(facts, ids, features), k)
        m = fold_metrics(cross_validate(frame, fit)[0]).withColumn("set_name", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def svm_chain(train: DataFrame, kept: Sequence[int], cs: Sequence[float] = (0.1, 1, 10, 100), gammas: Sequence[float | str] = ("scale", 0.01, 0.1, 1.0), folds: int = 3,
              size: int = 128):
    """RBF support vector machine on the features at ``kept``, tuned on the training rows, with Platt's scaling fitted on margins
    of inner folds. Returns a function that scores prepared rows: svm_score, svm_proba and svm_pred are added."""
    at = F.array(*[F.lit(int(i)) for i in kept])
    small = lambda d: d.withColumn("features", array_to_vector(F.transform(at, lambda i: F.get(vector_to_array("features"), i))))
    tr = checkpointed(small(train).select("patient_id", "y", "w", "features"))
    model, gamma, c, _ = rbf_svm_cv(tr, cs, gammas, folds, size=size)
    f = checkpointed(fourier_features(stratified_folds(tr, folds, 7), gamma, size))
    svc = LinearSVC(labelCol="y", weightCol="w", featuresCol="rff", standardization=False, maxIter=30, regParam=_reg(c, _total(tr, "w")))
    inner = None
    for j in range(folds):
        part = svc.fit(f.where(F.col("fold") != j)).transform(f.where(F.col("fold") == j)).select("y", margin().alias("score"))
        inner = part if inner is None else inner.unionByName(part)
    inner = checkpointed(inner)

    def score(rows: DataFrame) -> DataFrame:
        out = model.transform(fourier_features(small(rows), gamma, size)).withColumn("score", margin())
        return platt_proba(inner, out).withColumnsRenamed({"score": "svm_score", "proba": "svm_proba"}).withColumn("svm_pred", F.col("prediction").cast("int"))

    return score


def nested_loco(facts: DataFrame, ids: Sequence[str], cohort: str = "cohort", keep: int = 30, cs: Sequence[float] = C_GRID, folds: int = 3,
                protected: Sequence[str] = (), score_all: DataFrame | None = None, svm: Mapping | None = None, workers: int = 5):
    """Leave one cohort out: screen and decorrelate on the training cohorts (all folds in one job), tune and fit L1 there, score the
    rest.

    Returns (out-of-fold rows, selection rows (fold, feature)). ``score_all`` adds rows outside the task (y null), each scored
    in the fold that holds out its cohort; rows of a cohort without a fold are not scored. ``svm`` (options of
    :func:`svm_chain`) adds a support vector machine on the features that the LASSO keeps: svm_score, svm_proba, svm_pred.

    All folds read one stored frame, a column per feature that any of them selects and one per fold with its inner folds: neither
    the facts nor the rows of a fold are stored or shuffled again."""
    spark = facts.sparkSession
    number = {r[0]: r["fold"] for r in group_folds(facts.select(cohort).distinct(), cohort).collect()}
    names = sorted(number.values())

    def folded(df: DataFrame) -> DataFrame:
        at = F.coalesce(*[F.when(F.col(cohort) == F.lit(c), F.lit(k)) for c, k in number.items()])
        return df.withColumn("fold", at).where("fold is not null")

    f = folded(facts)
    pools: dict[int, list[str]] = {k: [] for k in names}
    for r in sorted(pool_binary_left_out(f, "fold", names).select("_fold", "rank", "feature").collect()):
        pools[r["_fold"]].append(r["feature"])
    used = list(dict.fromkeys([*protected, *[n for k in names for n in pools[k]]]))
    known = inner_folds(f.select(*ids, "fold").distinct(), folds, "fold", names, 7, id_=ids[0])
    wide = model_frame(f, ids, used)
    same = [F.col(f"_i.`{c}`").eqNullSafe(F.col(f"_w.`{c}`")) for c in ids]
    cols = feature_columns(wide)
    frame = _stored_columns(known.alias("_i").join(wide.alias("_w"), same).select("_i.*", *[F.col(f"_w.{c}") for c in cols]), ids[0])
    chosen = select_features_left_out(frame, dict(zip(used, cols)), pools, keep, protected=protected, id_=ids[0])
    extra = None
    if score_all is not None:
        # a row outside the task is scored once, by the models that never saw its cohort
        some = list(dict.fromkeys(n for k in names for n in chosen[k]))
        extra = _stored_columns(model_frame(folded(score_all), [*[c for c in ids if c != "y"], "fold"], some).withColumn("y", F.lit(None).cast("int")), ids[0])
        place = dict(zip(some, feature_columns(extra)))

    keyed = F.col(ids[0]) if dict(frame.dtypes)[ids[0]] == "bigint" else F.xxhash64(ids[0])
    rows = frame.where("y is not null").select(keyed.alias("key"), F.col("y").cast("int").alias("y"), "fold", *[f"inner_{k}" for k in names],
                                               *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    center, spread = {c: stats[f"m_{c}"] or 0.0 for c in cols}, {c: stats[f"s_{c}"] or 1.0 for c in cols}
    pairs = [(k, cols[used.index(n)]) for k in names for n in chosen[k]]
    med = fold_medians(rows, [c for _, c in pairs], [*range(folds), -1], [f"inner_{k}" for k, _ in pairs])
    median = np.where(med.n > 0, (med.low + med.high) / 2, [center[c] for _, c in pairs])
    known_fold = [F.coalesce(f"inner_{k}", F.lit(-2)).alias(f"inner_{k}") for k in names]  # a number in the rows of fold k, too
    passes = SharedPasses(rows.select("key", "y", "fold", *known_fold, *cols), len(names), workers)

    def one(k):
        sel = chosen[k]
        renamed = [F.col(cols[used.index(n)]).alias(f"f{i}") for i, n in enumerate(sel)]
        here = [f"f{i}" for i in range(len(sel))]
        te = frame.where(F.col("fold") == k).select(*ids, "fold", *renamed)
        tr = frame.where(F.col("fold") != k).select(*ids, "fold", F.col(f"inner_{k}").alias("_inner"), *renamed)
        mine = [cols[used.index(n)] for n in sel]
        view = View(passes, f"inner_{k}", mine, ("fold", k), range(folds), np.array([center[c] for c in mine]), np.array([spread[c] for c in mine]),
                    median[:, [i for i, (j, _) in enumerate(pairs) if j == k]])
        try:
            path = penalty_path(tr.drop("fold").withColumnRenamed("_inner", "fold"), here, cs, id_=ids[0], view=view)
        finally:
            passes.leave()  # the others need not wait for the machine
        kept = [here.index(c) for c in path.kept]
        chain = prep = None
        if svm is not None:  # only the machine reads prepared features; the path has its own fills and scales
            prep = Preparation.fit(tr, here)
            chain = svm_chain(balanced_weights(prep.apply(tr)).drop("fold", "_inner"), kept, **svm)

        def scored(rows: DataFrame, inside: bool) -> DataFrame:
            key = [*ids[:2], "fold"]
            out = path.scored(rows).select(*key, "y", "score", "proba", "pred").withColumn("in_train", F.lit(inside))
            return out if chain is None else out.join(chain(prep.apply(rows)).select(*key, "svm_score", "svm_proba", "svm_pred"), key, "left")

        part = scored(te, True)
        if extra is not None:
            part = part.unionByName(scored(extra.where(F.col("fold") == k).select(*ids[:2], "fold", "y", *[F.col(place[n]).alias(f"f{i}") for i, n in enumerate(sel)]), False))
        return part, [(int(k), sel[i]) for i in kept]

    # folds run side by side: their passes over the frame are one job, and their other jobs are short
    with ThreadPoolExecutor(workers) as pool:
        done = list(pool.map(one, names))
    oof = done[0][0]
    for part, _ in done[1:]:
        oof = oof.unionByName(part)
    return oof, spark.createDataFrame([c for _, cs_ in done for c in cs_], "fold int, feature string")


def coupled(pair: Mapping[tuple[int, int], Column], classes: Sequence[int]) -> dict[int, Column]:
    """Class probabilities from ``pair[a, b]`` = P(b | a or b) of one-versus-one models: 1 / (sum over others of 1 / r - (k - 2)),
    normalised. Exact where the pairwise probabilities agree with one distribution."""
    def raw(a: int) -> Column:
        inverse = [1 / F.greatest(1 - pair[a, b] if (a, b) in pair else pair[b, a], F.lit(1e-12)) for b in classes if b != a]
        return 1 / (sum(inverse[1:], inverse[0]) - (len(classes) - 2))

    each = {a: raw(a) for a in classes}
    total = sum(list(each.values())[1:], each[classes[0]])
    return {a: v / total for a, v in each.items()}


def nested_multiclass(facts: DataFrame, ids: Sequence[str], label: str, classes: Sequence[int], cohort: str = "cohort", keep: int = 30, cs: Sequence[float] = C_GRID,
                      folds: int = 3, protected: Sequence[str] = ()):
    """Leave one cohort out with several classes: screen over all classes on the training cohorts (all folds in one job), tune an L1
    path for every pair of classes there, and couple the pairs' probabilities on the cohort left out.

    Returns (out-of-fold rows with label, proba_<class>, pred; selection rows (fold, pair, feature)). ``ids`` holds the id first
    and the label column; rows without a label are not used."""
    spark = facts.sparkSession
    f = checkpointed(group_folds(facts.where(F.col(label).isin(*classes)), cohort))
    names = [r[0] for r in f.select("fold").distinct().orderBy("fold").collect()]
    pools = checkpointed(pool_multiclass(training_rows(f, "fold", names), label, classes, ["_fold"]))
    oof, chosen = None, []
    for k in names:
        sel = select_features(f.where(F.col("fold") != k), pools.where(F.col("_fold") == k), keep, protected=protected)
        frame = checkpointed(model_frame(f, [*ids, "fold"], sel))
        cols = feature_columns(frame)
        inner = checkpointed(stratified_folds(frame.where(F.col("fold") != k).drop("fold"), folds, 7, y=label, id_=ids[0]))
        pair = {}
        for i, a in enumerate(classes):
            for b in classes[i + 1:]:
                path = penalty_path(inner.where(F.col(label).isin(a, b)).withColumn("y", (F.col(label) == b).cast("int")), cols, cs, id_=ids[0])
                pair[a, b] = 1 / (1 + F.exp(-path.models.margin(int(path.final[path.best]))))
                chosen += [(int(k), f"{a}|{b}", sel[cols.index(c)]) for c in path.kept]
        proba = coupled(pair, list(classes))
        best = F.array_max(F.array(*[F.struct(v.alias("p"), F.lit(-c).alias("c")) for c, v in proba.items()]))  # ties to the smaller class
        part = frame.where(F.col("fold") == k).select(*ids, "fold", *[v.alias(f"proba_{c}") for c, v in proba.items()], (-best["c"]).alias("pred"))
        oof = part if oof is None else oof.unionByName(part)
    return oof, spark.createDataFrame(chosen, "fold int, pair string, feature string")


def selection_frequency(chosen: DataFrame, features: DataFrame, folds: int) -> DataFrame:
    """Times chosen over all features, zeros included."""
    n = chosen.groupBy("feature").agg(F.count_distinct("fold").alias("times"))
    return features.select("feature").distinct().join(n, "feature", "left").select(
        "feature", F.coalesce("times", F.lit(0)).alias("times"), (F.coalesce("times", F.lit(0)) / folds).alias("frequency"))


def remaining_configs(configs: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Configurations without a stored result."""
    return configs.join(results.select(*keys).distinct(), list(keys), "left_anti")


def final_model(df: DataFrame, path: str, fit: Fit = logit_l2) -> DataFrame:
    """Refit on all labelled rows, save preparation and model with Spark ML persistence, read back and score everything. ``fit``
    may return any Spark ML model with a probability."""
    df = checkpointed(df)
    prep = Preparation.fit(df.where("y is not null"), feature_columns(df))
    x = prep.apply(df)
    model = fit(balanced_weights(x.where("y is not null")))
    prep.pipeline(model).write().overwrite().save(path)
    return _scores(PipelineModel.load(path), df, ["patient_id"])


def misclassification(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.avg((F.col("pred") != F.col("y")).cast("double")).alias("error_rate"))
