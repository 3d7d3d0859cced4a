"""Feature screening. The fold is one more key, so all folds are screened in one job; only the bounded pool of strong
features (<= pool size per fold) goes through the sequential decorrelation step."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phenospark.functions.prefix import prefix_sums, value_counts
from phenospark.functions.text import clean_double
from phenospark.operators.batched import fold_medians
from phenospark.operators.profile import fit_medians
from phenospark.operators.stats import bh_fdr, correlation, kruskal_wallis, mann_whitney, mann_whitney_of, pairwise_auc_macro, rank_sums_left_out
from phenospark.session import checkpointed

POOL, KEEP, CUT, ALPHA = 250, 30, 0.90, 0.05


def training_rows(facts: DataFrame, fold: str, folds: Sequence[int]) -> DataFrame:
    """Each row once per fold it trains in (folds - 1 copies), with the fold as ``_fold``."""
    fs = F.array(*[F.lit(f) for f in folds])
    return facts.withColumn("_fold", F.explode(F.filter(fs, lambda f: f != F.col(fold))))


def _gates(facts: DataFrame, keys: Sequence[str], group: str, classes: int, min_rows: int, share: float, min_class: int) -> DataFrame:
    """Keys with enough observed rows, enough rows per class and a value that varies within every class."""
    per = facts.groupBy(*keys, group).agg(F.count("value").alias("_n"), F.count("*").alias("_all"), (F.max("value") > F.min("value")).alias("_v"))
    return _passed(per, keys, classes, min_rows, share, min_class)


def _passed(per: DataFrame, keys: Sequence[str], classes: int, min_rows: int, share: float, min_class: int) -> DataFrame:
    """:func:`_gates` from the counts of each key and class."""
    ok = per.groupBy(*keys).agg(F.sum("_n").alias("_obs"), F.sum("_all").alias("_rows"), F.count_if((F.col("_n") >= min_class) & F.col("_v")).alias("_good"))
    return ok.where((F.col("_obs") >= F.greatest(F.lit(min_rows), F.col("_rows") * share)) & (F.col("_good") == classes)).select(*keys)


def _pool(stats: DataFrame, by: Sequence[str], pool: int) -> DataFrame:
    """FDR-significant features (all of them when a fold has none), strongest first, at most ``pool`` per fold."""
    s = bh_fdr(stats, "p", by)
    any_sig = s.groupBy(*by).agg(F.bool_or(F.col("fdr") < ALPHA).alias("_any")) if by else s.agg(F.bool_or(F.col("fdr") < ALPHA).alias("_any"))
    if by:
        s = s.join(any_sig, list(by))
    else:
        s = s.withColumn("_k", F.lit(0)).join(any_sig.withColumn("_k", F.lit(0)), "_k").drop("_k")
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("strength"), "fdr", "feature")
    return s.where(~F.col("_any") | (F.col("fdr") < ALPHA)).drop("_any").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)


def pool_binary(facts: DataFrame, by: Sequence[str] = (), pool: int = POOL, min_rows: int = 20, share: float = 0.5, min_class: int = 3) -> DataFrame:
    keys = [*by, "feature"]
    ok = _gates(facts.where("y is not null"), keys, "y", 2, min_rows, share, min_class)
    seen = facts.where("value is not null and y is not null").join(ok, keys, "left_semi")
    st = mann_whitney(seen, keys).select(*keys, "p", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("strength"))
    return _pool(st, by, pool)


def pool_binary_left_out(facts: DataFrame, fold: str, folds: Sequence[int], pool: int = POOL, min_rows: int = 20, share: float = 0.5, min_class: int = 3) -> DataFrame:
    """:func:`pool_binary` of the rows outside each fold, with the fold as ``_fold``; no row is copied per fold."""
    keys, seen = ["_fold", "feature"], facts.where("y is not null")
    cells = seen.groupBy("feature", "y", fold).agg(F.count("value").alias("_n"), F.count("*").alias("_all"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    per = training_rows(cells, fold, folds).groupBy(*keys, "y").agg(F.sum("_n").alias("_n"), F.sum("_all").alias("_all"), (F.max("_hi") > F.min("_lo")).alias("_v"))
    ok = _passed(per, keys, 2, min_rows, share, min_class)
    # a row per fold and feature from here on; without the cut every later step would plan all of the above again
    st = mann_whitney_of(checkpointed(rank_sums_left_out(seen, fold, folds).join(ok, keys, "left_semi")), keys)
    return _pool(st.select(*keys, "p", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("strength")), ["_fold"], pool)


def pool_multiclass(facts: DataFrame, label: str, classes: Sequence[int], by: Sequence[str] = (), pool: int = POOL, min_rows: int = 20,
                    share: float = 0.5, min_class: int = 3) -> DataFrame:
    keys = [*by, "feature"]
    ok = _gates(facts.where(F.col(label).isNotNull()), keys, label, len(classes), min_rows, share, min_class)
    seen = facts.where(F.col("value").isNotNull() & F.col(label).isNotNull()).join(ok, keys, "left_semi")
    st = kruskal_wallis(seen, label, len(classes), keys).select(*keys, "p").join(
        pairwise_auc_macro(seen, label, classes, keys).withColumnRenamed("auc_macro", "strength"), keys)
    return _pool(st, by, pool)


def median_filled(facts: DataFrame, features: Sequence[str]) -> DataFrame:
    """(patient_id, feature, value) with one row per patient and listed feature; gaps hold the median of the feature, or 0."""
    f = facts.where(F.col("feature").isin(*features)).select("patient_id", "feature", clean_double("value").alias("value"))
    med = fit_medians(f).select("feature", F.col("median").alias("_m"))
    grid = facts.select("patient_id").distinct().withColumn("feature", F.explode(F.array(*[F.lit(n) for n in features])))
    seen = f.groupBy("patient_id", "feature").agg(F.first("value", ignorenulls=True).alias("value"))
    return grid.join(seen, ["patient_id", "feature"], "left").join(med, "feature", "left").select(
        "patient_id", "feature", F.coalesce("value", "_m", F.lit(0.0)).alias("value"))


def greedy_decorrelate(order: Sequence[str], corr: Iterable[tuple[str, str, float]], cut: float = CUT, keep: int = KEEP,
                       protected: Sequence[str] = ()) -> list[str]:
    """Keep a feature if its largest |rho| with those kept is below ``cut``. Inherently sequential over <= pool names. A pair
    without a correlation is an error."""
    rho = {}
    for a, b, r in corr:
        rho[a, b] = rho[b, a] = r if r is not None else 0.0  # a constant feature goes with nothing
    kept = list(dict.fromkeys(protected))
    for f in order:
        if len(kept) >= max(keep, len(protected)):
            break
        if f not in kept and all(rho[f, g] < cut for g in kept):
            kept.append(f)
    return kept


def select_features(facts: DataFrame, pool: DataFrame, keep: int = KEEP, cut: float = CUT, protected: Sequence[str] = ()) -> list[str]:
    """Pool (one fold) -> the decorrelated list. Correlations are taken over all rows, with gaps filled by the feature's median.
    If fewer than ``min(5, keep)`` features survive, the top ``keep`` of the pool are used as they are."""
    order = [r["feature"] for r in pool.orderBy("rank").select("feature").collect()]
    names = list(dict.fromkeys([*protected, *order]))
    if len(names) < 2:
        return names
    corr = [(r["a"], r["b"], r["rho"]) for r in correlation(median_filled(facts, names), names).collect()]
    return _decorrelated(order, corr, keep, cut, protected)


def _decorrelated(order: Sequence[str], corr: Iterable[tuple[str, str, float]], keep: int, cut: float, protected: Sequence[str]) -> list[str]:
    kept = greedy_decorrelate(order, corr, cut, keep, protected)
    return kept if len(kept) >= min(5, keep) else list(dict.fromkeys([*protected, *order[:keep]]))


def select_features_left_out(wide: DataFrame, cols: Mapping[str, str], pools: Mapping[int, Sequence[str]], keep: int = KEEP, cut: float = CUT, protected: Sequence[str] = (),
                             id_: str = "patient_id", fold: str = "fold") -> dict[int, list[str]]:
    """:func:`select_features` for the rows outside each fold, all folds in one job.

    ``wide`` is a stored frame with one row per patient, ``cols`` the column of a feature, ``pools`` the pool of a fold, strongest
    first. A value's rank outside a fold follows from one table of (feature, value) counts by fold. Gaps need no rows: filled with
    the median they share one rank, and the values above it move up by their number."""
    names = {k: list(dict.fromkeys([*protected, *order])) for k, order in pools.items()}
    folds = [k for k in names if len(names[k]) > 1]
    used = sorted({n for k in folds for n in names[k]})
    if not folds:
        return names
    rows = wide.select(F.col(id_).alias("_id"), F.col(fold).alias("fold"), *[clean_double(F.col(cols[n]).cast("double")).alias(f"f{i}") for i, n in enumerate(used)])
    all_ = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    size = {k: sum(n for j, n in all_.items() if j != k) for k in folds}
    med = fold_medians(rows, [f"f{i}" for i in range(len(used))], folds)
    gaps = np.array([[size[k]] for k in folds]) - med.n
    at = np.where(med.n > 0, med.low + (med.high - med.low) * np.where(med.n % 2 == 0, 0.5, 0.0), 0.0)
    inside = (at > med.low) & (at < med.high)  # between two values: no row holds it, all up to the lower are before it
    before = np.where(inside, med.high_before, np.where(at == med.low, med.low_before, med.high_before))
    equal = np.where(inside, 0, np.where(at == med.low, med.low_n, med.high_n))
    fill = np.where(med.n > 0, before + (equal + gaps + 1) / 2, (gaps + 1) / 2)
    spread = [F.struct(F.lit(i).alias("i"), F.col(f"f{i}").alias("value")) for i in range(len(used))]
    long = rows.select("_id", "fold", F.explode(F.array(*spread)).alias("_c")).select("_id", "fold", "_c.*").where("value is not null")
    counted = sorted(all_)
    pre = prefix_sums(value_counts(long, ["i"], "value", {f"n{j}": (F.col("fold") == j).cast("int") for j in counted}), ["i"], "value", [f"n{j}" for j in counted])
    outside = lambda c, k: sum((F.col(f"{c}{j}") for j in counted if j != k), F.lit(0))
    ranks = pre.select("i", "value", *[(outside("before_n", k) + (outside("n", k) + 1) / F.lit(2.0)).alias(f"r{k}") for k in folds])
    cell = F.struct("i", "value", *[f"r{k}" for k in folds])
    vectors = long.join(ranks, ["i", "value"]).groupBy("_id", "fold").agg(F.collect_list(cell).alias("v")).select("fold", "v")
    of = {k: np.array([used.index(n) for n in names[k]]) for k in folds}

    def moved(x: np.ndarray, s: int) -> np.ndarray:
        """Cross products of ranks, centred on the mean rank."""
        x = x[:, of[folds[s]]] - (size[folds[s]] + 1) / 2
        return x.T @ x

    def partial(batches):
        total, seen = [np.zeros((len(of[k]), len(of[k]))) for k in folds], np.zeros(len(folds))
        for b in batches:
            own, lists = b.column(0).to_numpy(), b.column(1)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            i, value = (flat.field(c).to_numpy() for c in ("i", "value"))
            for s, k in enumerate(folds):
                x = np.tile(fill[s], (len(lists), 1))
                x[row, i] = flat.field(f"r{k}").to_numpy() + gaps[s][i] * ((value > at[s][i]) + (value == at[s][i]) / 2)
                total[s] += moved(x[own != k], s)
                seen[s] += (own != k).sum()
        for s, t in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size + 1, s, np.int32)), pa.array(np.arange(-1, t.size, dtype=np.int32)), pa.array(np.r_[seen[s], t.ravel()])], ["s", "at", "v"])

    sums = vectors.mapInArrow(partial, "s int, at int, v double").groupBy("s", "at").agg(F.sum("v").alias("v")).toPandas()
    out = dict(names)
    for s, k in enumerate(folds):
        mine = sums[sums["s"] == s].sort_values("at")["v"].to_numpy()
        n = len(of[k])
        mine = mine if len(mine) else np.zeros(n * n + 1)
        # a patient without any of the features has no vector
        xy = mine[1:].reshape(n, n) + (size[k] - mine[0]) * moved(fill[s][None], s)
        scale = np.sqrt(np.outer(np.diag(xy), np.diag(xy)))
        rho = np.abs(np.divide(xy, scale, out=np.zeros_like(xy), where=scale > 0))
        corr = [(a, b, float(rho[i, j])) for i, a in enumerate(names[k]) for j, b in enumerate(names[k]) if i < j]
        out[k] = _decorrelated(pools[k], corr, keep, cut, protected)
    return out


def protect(selected: Sequence[str], protected: Sequence[str]) -> list[str]:
    """Selection with the protected features always in it."""
    return list(dict.fromkeys([*protected, *selected]))
