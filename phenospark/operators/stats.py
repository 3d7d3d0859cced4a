"""Statistics over long facts: every feature at once, no feature in one task.

Rank-based measures start from the (group, value) count table of ``functions.prefix``; the per-feature results are tiny.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phenospark.functions.prefix import average_rank, exact_quantiles, prefix_sums, value_counts, with_blocks
from phenospark.session import checkpointed, spread
from phenospark.functions.special import chi2_tail_sql, normal_two_sided_sql, student_two_sided


def rank_sums(facts: DataFrame, keys: Sequence[str], y: str = "y", value: str = "value") -> DataFrame:
    """Per key: n, positives, rank sum of the positives, tie term, means."""
    vc = value_counts(facts.where(F.col(y).isNotNull()), keys, value, {"n": F.lit(1), "pos": (F.col(y) == 1).cast("int")})
    pre = prefix_sums(vc, keys, value, ["n"])
    n = F.col("n").cast("double")
    return pre.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * average_rank()).alias("rank_pos"),
        F.sum(n * n * n - n).alias("ties"))


def auc_of(r: str = "rank_pos", n: str = "n", p: str = "n_pos") -> Column:
    np_ = F.col(p).cast("double")
    return F.try_divide(F.col(r) - np_ * (np_ + 1) / 2, np_ * (F.col(n) - np_))


def rank_auc(facts: DataFrame, keys: Sequence[str] = ("feature",), y: str = "y", value: str = "value") -> DataFrame:
    """Exact AUC per key by average ranks; null when a class is empty."""
    return rank_sums(facts, list(keys), y, value).select(*keys, F.col("n"), "n_pos", auc_of().alias("auc"))


def mann_whitney(facts: DataFrame, keys: Sequence[str] = ("feature",), mode: str = "corrected", y: str = "y", value: str = "value") -> DataFrame:
    """AUC and two-sided normal p. ``plain``: no tie or continuity correction; ``corrected``: both."""
    return mann_whitney_of(rank_sums(facts, list(keys), y, value), keys, mode)


def rank_sums_left_out(facts: DataFrame, fold: str, folds: Sequence[int], y: str = "y", value: str = "value") -> DataFrame:
    """:func:`rank_sums` per (_fold, feature) over the rows outside each fold.

    One table of (feature, value) counts every fold beside the others; the counts outside a fold are sums of these. A copy of each
    row per fold that it trains in would go through two shuffles and a sort instead."""
    one = {f"_n{k}": F.col(fold) == k for k in folds}
    pos = {f"_p{k}": (F.col(fold) == k) & (F.col(y) == 1) for k in folds}
    vc = value_counts(facts.where(F.col(y).isNotNull()), ["feature"], value, {c: e.cast("int") for c, e in (one | pos).items()})
    pre = prefix_sums(vc, ["feature"], value, list(one))
    outside = lambda c, k: sum((F.col(f"{c}{j}") for j in folds if j != k), F.lit(0).cast("bigint"))
    aggs = []
    for k in folds:
        n, p = outside("_n", k), outside("_p", k)
        d = n.cast("double")
        rank = outside("before__n", k) + (n + 1) / F.lit(2.0)
        aggs.append(F.struct(F.lit(k).alias("_fold"), F.sum(n).alias("n"), F.sum(p).alias("n_pos"), F.sum(p * rank).alias("rank_pos"), F.sum(d * d * d - d).alias("ties")))
    return pre.groupBy("feature").agg(F.array(*aggs).alias("_a")).select("feature", F.explode("_a").alias("_a")).select("feature", "_a.*")


def mann_whitney_of(sums: DataFrame, keys: Sequence[str], mode: str = "corrected") -> DataFrame:
    """:func:`mann_whitney` from rank sums."""
    r = sums.withColumn("auc", auc_of())
    p, n = F.col("n_pos").cast("double"), F.col("n").cast("double")
    q = n - p
    u = F.col("auc") * p * q
    if mode == "plain":
        var, gap = p * q * (n + 1) / 12, F.abs(u - p * q / 2)
    else:
        var = p * q / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
        gap = F.greatest(F.abs(u - p * q / 2) - 0.5, F.lit(0.0))
    r = r.withColumn("_z", F.try_divide(gap, F.sqrt(F.when(var > 0, var))) / math.sqrt(2))
    return r.select(*keys, "n", "n_pos", "auc", F.least(F.expr(normal_two_sided_sql("_z")), F.lit(1.0)).alias("p"))


def cohens_d(facts: DataFrame, keys: Sequence[str] = ("feature",), sd: str = "pop", eps: float = 0.0) -> DataFrame:
    """(m1-m0)/sqrt((s1^2+s0^2)/2) with population or sample variance; ``eps`` is added to the denominator."""
    var = F.var_pop if sd == "pop" else F.var_samp
    one, zero = F.when(F.col("y") == 1, F.col("value")), F.when(F.col("y") == 0, F.col("value"))
    g = facts.groupBy(*keys).agg(F.avg(zero).alias("mean0"), F.avg(one).alias("mean1"), var(zero).alias("_v0"), var(one).alias("_v1"))
    return g.select(*keys, "mean0", "mean1", F.try_divide(
        F.col("mean1") - F.col("mean0"), F.sqrt((F.col("_v0") + F.col("_v1")) / 2) + eps).alias("d"))


def univariate_summary(facts: DataFrame, keys: Sequence[str] = ("feature",), min_class: int = 3) -> DataFrame:
    """Means, effect size, AUC (nulls take the feature median) and p, strongest |AUC-0.5| first."""
    keys = list(keys)
    seen = facts.where("value is not null")
    med = exact_quantiles(facts, keys, "value", {"_med": 0.5})
    filled = facts.join(med, keys, "left").withColumn("value", F.coalesce("value", "_med")).drop("_med")
    enough = seen.groupBy(*keys).agg(F.count_if(F.col("y") == 1).alias("_p"), F.count_if(F.col("y") == 0).alias("_q")).where(
        (F.col("_p") >= min_class) & (F.col("_q") >= min_class)).select(*keys)
    auc = rank_auc(filled, keys).select(*keys, "auc")
    out = cohens_d(seen, keys).join(auc, keys).join(mann_whitney(seen, keys).select(*keys, "p"), keys).join(enough, keys, "left_semi")
    return out.orderBy(F.desc(F.abs(F.col("auc") - 0.5)), *keys)


def univariate_auc_observed(facts: DataFrame, keys: Sequence[str] = ("feature",), min_rows: int = 10) -> DataFrame:
    """AUC, p and class means over observed rows only."""
    seen = facts.where("value is not null")
    return mann_whitney(seen, keys).where(F.col("n") >= min_rows).join(
        cohens_d(seen, keys).select(*keys, "mean0", "mean1"), list(keys))


def kruskal_wallis(facts: DataFrame, group: str, k: int, keys: Sequence[str] = ("feature",), min_rows: int = 3) -> DataFrame:
    """H with tie correction and its chi-square(k-1) p. Keys need ``k`` groups of ``min_rows`` rows that vary."""
    keys = list(keys)
    f = facts.where(F.col("value").isNotNull() & F.col(group).isNotNull())
    # ranks over the pooled rows, then rank sums per group: one row per (key, value) and per (key, value, group)
    pre = prefix_sums(value_counts(f, keys, "value"), keys, "value", ["n"])
    per = f.groupBy(*keys, "value", group).agg(F.count("*").alias("m"))
    n = F.col("n").cast("double")
    ties = pre.groupBy(*keys).agg(F.sum(n * n * n - n).alias("t"), F.max("total_n").cast("double").alias("N"))
    sums = per.join(pre.select(*keys, "value", average_rank().alias("r")), [*keys, "value"]).groupBy(*keys, group).agg(
        F.sum(F.col("m") * F.col("r")).alias("R"), F.sum("m").cast("double").alias("ng"), (F.max("value") > F.min("value")).alias("varies"))
    h = sums.where((F.col("ng") >= min_rows) & F.col("varies")).groupBy(*keys).agg(
        F.sum(F.col("R") * F.col("R") / F.col("ng")).alias("s"), F.count("*").alias("g")).where(F.col("g") == k).join(ties, keys)
    H = 12 / (F.col("N") * (F.col("N") + 1)) * F.col("s") - 3 * (F.col("N") + 1)
    h = h.withColumn("H", F.try_divide(H, 1 - F.col("t") / (F.pow("N", F.lit(3)) - F.col("N"))))
    h = h.withColumn("_c", F.greatest("H", F.lit(0.0))).withColumn("_z", F.sqrt(F.col("_c") / 2))
    return h.select(*keys, "H", F.expr(chi2_tail_sql("_c", "_z", k - 1)).alias("p"))


def class_pairs(facts: DataFrame, group: str, classes: Sequence) -> DataFrame:
    """Rows copied to each pair of classes they take part in (classes-1 copies); y=1 for the later class."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(classes) for b in list(classes)[i + 1:]])
    out = facts.withColumn("_p", F.explode(F.filter(pairs, lambda p: (p["a"] == F.col(group)) | (p["b"] == F.col(group)))))
    return out.withColumns({"pair": F.concat_ws("|", F.col("_p.a").cast("string"), F.col("_p.b").cast("string")),
                            "y": (F.col(group) == F.col("_p.b")).cast("int")}).drop("_p")


def pairwise_auc_macro(facts: DataFrame, group: str, classes: Sequence, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean over class pairs of max(AUC, 1-AUC)."""
    a = rank_auc(class_pairs(facts, group, classes), [*keys, "pair"])
    return a.groupBy(*keys).agg(F.avg(F.greatest(F.col("auc"), 1 - F.col("auc"))).alias("auc_macro"))


def stable_features(facts: DataFrame, group: str, classes: Sequence, keys: Sequence[str] = ("feature",), alpha: float = 0.05) -> DataFrame:
    """Features that differ between no pair of cohorts and not overall."""
    pair = mann_whitney(class_pairs(facts, group, classes), [*keys, "pair"]).groupBy(*keys).agg(F.min("p").alias("min_pair_p"))
    kw = kruskal_wallis(facts, group, len(classes), keys).select(*keys, F.col("p").alias("kw_p"))
    return pair.join(kw, list(keys)).withColumn("stable", (F.col("min_pair_p") > alpha) & (F.col("kw_p") > alpha))


def welch_t_test(facts: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Unequal-variance t, degrees of freedom and two-sided p."""
    one, zero = F.when(F.col("y") == 1, F.col("value")), F.when(F.col("y") == 0, F.col("value"))
    g = facts.groupBy(*keys).agg(*[f(c).alias(f"_{n}{i}") for i, c in ((0, zero), (1, one)) for n, f in
                                  (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    a, b = F.try_divide("_v0", "_n0"), F.try_divide("_v1", "_n1")
    t = F.try_divide(F.col("_m1") - F.col("_m0"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("_n0") - 1) + F.try_divide(b * b, F.col("_n1") - 1))
    return g.select(*keys, t.alias("t"), df.alias("df")).withColumn("p", student_two_sided("t", "df"))


def bh_fdr(results: DataFrame, p: str = "p", by: Sequence[str] = (), tie: str = "feature") -> DataFrame:
    """Benjamini-Hochberg over a result table (one row per feature and task); null p stays null."""
    by = list(by) or [F.lit(0)]
    asc = W.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), tie)
    rank, n = F.row_number().over(asc), F.count(p).over(W.partitionBy(*by))
    out = results.withColumn("_q", F.when(F.col(p).isNotNull(), F.col(p) * n / rank)).withColumn("_r", rank)
    back = W.partitionBy(*by).orderBy("_r").rowsBetween(W.currentRow, W.unboundedFollowing)
    return out.withColumn("fdr", F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(back), F.lit(1.0)))).drop("_q", "_r")


def to_ranks(facts: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Value -> its average rank within the key."""
    pre = prefix_sums(value_counts(facts, keys, "value"), keys, "value", ["n"])
    return facts.join(pre.select(*keys, "value", average_rank().alias("_r")), [*keys, "value"]).withColumn("value", F.col("_r")).drop("_r")


def correlation(facts: DataFrame, features: Sequence[str], method: str = "spearman") -> DataFrame:
    """Absolute pairwise correlations of a bounded feature list: (a, b, rho), each pair over the rows that hold both.

    Each row becomes one vector of values and one of presence; tasks add up partial cross-product matrices of both with numpy
    and only those (features squared per partition) are summed. No pair of features is emitted per patient. Ranks are taken
    over all present values of a feature. A pair without two common rows, or constant on them, has a null rho.
    """
    names = sorted(features)
    k = len(names)
    f = facts.where(F.col("feature").isin(*names) & F.col("value").isNotNull()).select("patient_id", "feature", "value")
    if method == "spearman":
        f = to_ranks(f)
    # centred on the feature mean, so that the sums of squares keep their digits
    mean = {r["feature"]: r["m"] for r in f.groupBy("feature").agg(F.avg("value").alias("m")).collect()}
    center = np.array([mean.get(n, 0.0) for n in names])
    at = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    rows = f.groupBy("patient_id").agg(F.collect_list(F.struct(at[F.col("feature")].alias("i"), "value")).alias("v"))

    def partial(batches):
        total = np.zeros((4, k, k))
        for b in batches:
            cells = b.column(0)
            row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
            col, val = (cells.flatten().field(n).to_numpy() for n in ("i", "value"))
            x, m = np.zeros((len(cells), k)), np.zeros((len(cells), k))
            x[row, col], m[row, col] = val - center[col], 1.0
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        i, j = np.triu_indices(k, 1)
        cells = {"i": i.astype("int32"), "j": j.astype("int32")} | {c: v for c, v in zip(
            ("n", "x", "y", "xx", "yy", "xy"), (total[0][i, j], total[1][i, j], total[1][j, i], total[2][i, j], total[2][j, i], total[3][i, j]))}
        yield pa.RecordBatch.from_pydict(cells)

    sums = ("n", "x", "y", "xx", "yy", "xy")
    g = rows.select("v").mapInArrow(partial, "i int, j int, " + ", ".join(f"{c} double" for c in sums)).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    nm = F.array(*[F.lit(n) for n in names])
    cov, vx, vy = F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("xx") - F.col("x") ** 2 / F.col("n"), F.col("yy") - F.col("y") ** 2 / F.col("n")
    # a constant column leaves rounding noise of its sum of squares
    varies = (vx > 1e-12 * F.col("xx")) & (vy > 1e-12 * F.col("yy"))
    return g.where("n > 0").select(nm[F.col("i")].alias("a"), nm[F.col("j")].alias("b"), F.when((F.col("n") > 1) & varies, F.abs(cov / F.sqrt(vx * vy))).alias("rho"))


def split_counts(rng: np.random.Generator, total: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Replicas x cells: each replica's ``total`` draws dealt to cells in proportion to ``sizes``, by conditional binomials cell after
    cell, so every row adds up to its total exactly."""
    out = np.zeros((len(total), len(sizes)), np.int64)
    rest, mass = total.astype(np.int64).copy(), float(sizes.sum())
    for j, size in enumerate(sizes):
        out[:, j] = rng.binomial(rest, min(1.0, size / mass)) if mass > 0 else 0
        rest -= out[:, j]
        mass -= float(size)
    return out


def stratified_replicas(scores: DataFrame, keys: Sequence[str], replicas: int = 200, seed: int = 42, y: str = "y", score: str = "score") -> DataFrame:
    """(keys, replica, pos, neg, auc) of a bootstrap within classes: each replica draws as many rows of a class, with replacement,
    as the class has.

    Draws go down a tree: a class total is split over the score blocks of a key (bounded in number), a block's share over its
    chunks and distinct scores, each time by conditional binomials. No row is copied per replica, a hot score is one row, and
    the class totals are exact. Draws are seeded by key and block, so a recomputed task repeats them.
    """
    keys = list(keys)
    vc = value_counts(scores.where(F.col(y).isNotNull()), keys, score, {"pos": (F.col(y) == 1).cast("bigint"), "neg": (F.col(y) == 0).cast("bigint")})
    b = checkpointed(with_blocks(vc, keys, score).select(*keys, F.col("_block").cast("bigint").alias("_block"), F.col(score).cast("double").alias("_s"), "pos", "neg"))
    types = dict(scores.dtypes)
    kind = "".join(f"{k} {types[k]}, " for k in keys)
    whole = b.groupBy(*keys, "_block").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("_seed", F.xxhash64(F.lit(seed), *keys))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        rng = np.random.default_rng(int(pdf["_seed"].iloc[0]) & (2**63 - 1))
        parts = [split_counts(rng, np.full(replicas, pdf[c].sum()), pdf[c].to_numpy()) for c in ("pos", "neg")]
        out = pd.DataFrame({"_block": pdf["_block"].to_numpy(), "p": list(parts[0].T), "q": list(parts[1].T)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_block", "p", "q"]]

    gk = keys or [F.lit(0)]
    shares = whole.groupBy(*gk).applyInPandas(deal, f"{kind}_block bigint, p array<bigint>, q array<bigint>")
    schema = f"{kind}_block bigint, replica int, pos bigint, neg bigint, u double"

    def draw(rows: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_s")
        rng = np.random.default_rng([seed, int(rows["_block"].iloc[0]) + 1, *(abs(hash_of(rows[k].iloc[0])) for k in keys)])
        p, q = rows["pos"].to_numpy(), rows["neg"].to_numpy()
        edges = np.arange(0, len(rows), 1024)
        mine = [split_counts(rng, np.asarray(share[c].iloc[0]), np.add.reduceat(v, edges)) for c, v in (("p", p), ("q", q))]
        before, u = np.zeros(replicas), np.zeros(replicas)
        for i, a in enumerate(edges):
            wp, wn = (split_counts(rng, m[:, i], v[a:a + 1024]) for m, v in zip(mine, (p, q)))
            run = np.cumsum(wn, axis=1)
            u += (wp * (before[:, None] + run - wn / 2)).sum(axis=1)
            before += wn.sum(axis=1)
        out = pd.DataFrame({"replica": np.arange(replicas, dtype="int32"), "pos": mine[0].sum(axis=1), "neg": mine[1].sum(axis=1), "u": u})
        for k in [*keys, "_block"]:
            out[k] = rows[k].iloc[0]
        return out[[*keys, "_block", "replica", "pos", "neg", "u"]]

    on = [*keys, "_block"]
    blk = spread(b, *on).groupBy(*on).cogroup(shares.groupBy(*on)).applyInPandas(draw, schema)
    earlier = W.partitionBy(*keys, "replica").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    blk = blk.withColumn("_e", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    return blk.groupBy(*keys, "replica").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("u") + F.col("pos") * F.col("_e")).alias("_u")).select(
        *keys, "replica", "pos", "neg", F.try_divide("_u", F.col("pos") * F.col("neg")).alias("auc"))


def hash_of(value) -> int:
    return int.from_bytes(hashlib.sha256(repr(value).encode()).digest()[:6], "big")


def bootstrap_replicas(scores: DataFrame, keys: Sequence[str], replicas: int = 200, seed: int = 42,
                       y: str = "y", score: str = "score") -> DataFrame:
    """(keys, replica, auc) of a Poisson bootstrap, the large-sample form of resampling with replacement.

    A row's Poisson(1) weights add up over equal scores to Poisson(count), so replicas are drawn from the count table: no
    row is copied per replica and a hot score is one row. Each score block (bounded, see ``functions.prefix``) returns one
    row per replica with its weights and the wins inside the block; wins between blocks follow from the negative weight
    of earlier blocks. Draws are seeded by key and block, so a recomputed task repeats them.
    """
    keys = list(keys)
    vc = value_counts(scores.where(F.col(y).isNotNull()), keys, score, {"pos": (F.col(y) == 1).cast("int"), "neg": (F.col(y) == 0).cast("int")})
    b = with_blocks(vc, keys, score).select(
        *keys, "_block", F.col(score).cast("double").alias("_s"), "pos", "neg", F.xxhash64(F.lit(seed), *keys, F.col("_block")).alias("_seed"))
    types = dict(scores.dtypes)
    schema = "".join(f"{k} {types[k]}, " for k in keys) + "_block bigint, replica int, pos double, neg double, u double"

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        rng = np.random.default_rng(int(pdf["_seed"].iloc[0]) & (2**63 - 1))
        pos, neg, u = np.zeros(replicas), np.zeros(replicas), np.zeros(replicas)
        p, q = pdf["pos"].to_numpy(float), pdf["neg"].to_numpy(float)
        for a in range(0, len(pdf), 8192):
            wp = rng.poisson(p[a:a + 8192, None], (len(p[a:a + 8192]), replicas)).astype(float)
            wn = rng.poisson(q[a:a + 8192, None], (len(q[a:a + 8192]), replicas)).astype(float)
            run = np.cumsum(wn, axis=0)
            u += (wp * (neg + run - wn / 2)).sum(axis=0)
            pos += wp.sum(axis=0)
            neg += run[-1]
        out = pd.DataFrame({"replica": np.arange(replicas, dtype="int32"), "pos": pos, "neg": neg, "u": u})
        for k in [*keys, "_block"]:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_block", "replica", "pos", "neg", "u"]]

    blk = spread(b, *keys, "_block").groupBy(*keys, "_block").applyInPandas(draw, schema)
    earlier = W.partitionBy(*keys, "replica").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blk = blk.withColumn("_e", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
    return blk.groupBy(*keys, "replica").agg(
        F.try_divide(F.sum(F.col("u") + F.col("pos") * F.col("_e")), F.sum("pos") * F.sum("neg")).alias("auc"))


def bootstrap_auc(scores: DataFrame, keys: Sequence[str], replicas: int = 200, seed: int = 42, stratified: bool = False, **cols) -> DataFrame:
    """Point AUC with the 2.5 and 97.5 percent points over replicas (one row per replica: small) and their number. ``stratified``
    keeps the class sizes of every replica."""
    keys = list(keys)
    reps = (stratified_replicas if stratified else bootstrap_replicas)(scores, keys, replicas, seed, **cols)
    ci = reps.groupBy(*keys).agg(F.percentile("auc", 0.025).alias("lo"), F.percentile("auc", 0.975).alias("hi"), F.count("auc").alias("used"))
    point = rank_auc(scores, keys, cols.get("y", "y"), cols.get("score", "score")).select(*keys, "auc")
    if keys:
        return point.join(ci, keys)
    return point.withColumn("_k", F.lit(0)).join(ci.withColumn("_k", F.lit(0)), "_k").drop("_k")


def direction_stability(replicas: DataFrame, point: DataFrame, keys: Sequence[str], min_replicas: int = 50) -> DataFrame:
    """Share of replicas on the point estimate's side of one half; null below ``min_replicas``."""
    j = replicas.where("auc is not null").join(point.select(*keys, F.col("auc").alias("_p")), list(keys))
    return j.groupBy(*keys).agg(F.when(F.count("*") >= min_replicas, F.avg(
        ((F.col("auc") > 0.5) == (F.col("_p") >= 0.5)).cast("double"))).alias("stability"))


def signal_count(aucs: DataFrame, delta: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    return aucs.groupBy(*by).agg(F.count_if(F.abs(F.col("auc") - 0.5) > delta).alias("with_signal"), F.count("auc").alias("features"))


def top_k(aucs: DataFrame, k: int, by: Sequence[str] = (), tie: str = "feature") -> DataFrame:
    """Strongest features per group by |AUC-0.5|; the rank filter is pushed into the window as a partial limit."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(F.abs(F.col("auc") - 0.5)), tie)
    return aucs.where("auc is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_task(aucs: DataFrame, task: str = "task") -> DataFrame:
    return aucs.where("auc is not null").groupBy(task).agg(
        F.min_by(F.struct("feature", "auc"), F.struct(-F.abs(F.col("auc") - 0.5), F.col("feature"))).alias("b")).select(task, "b.feature", "b.auc")


def five_number_by_class(facts: DataFrame, keys: Sequence[str] = ("feature", "y")) -> DataFrame:
    return exact_quantiles(facts, list(keys), "value", {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal bin; the upper edge belongs to the last bin."""
    b = F.least(F.width_bucket(F.col(col), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)), F.lit(bins)) - 1
    return df.groupBy(*by, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def mrmr(relevance: DataFrame, corr: DataFrame, k: int) -> list[str]:
    """Greedy maximum relevance, minimum redundancy with MI = -ln(1-rho^2)/2 on a bounded matrix (<= a few hundred
    features), which is all that reaches the driver."""
    mi = lambda r: -0.5 * math.log(max(1 - r * r, 1e-12))
    rel = {r["feature"]: mi(r["rho"]) for r in relevance.collect()}
    red = {}
    for r in corr.collect():
        red[r["a"], r["b"]] = red[r["b"], r["a"]] = mi(r["rho"])
    chosen: list[str] = []
    while len(chosen) < k and len(chosen) < len(rel):
        rest = [f for f in rel if f not in chosen]
        score = lambda f: rel[f] - (sum(red.get((f, c), 0.0) for c in chosen) / len(chosen) if chosen else 0.0)
        chosen.append(max(rest, key=lambda f: (round(score(f), 12), f)))
    return chosen


def label_relevance(facts: DataFrame) -> DataFrame:
    """|corr(value, y)| per feature."""
    return facts.where("value is not null").groupBy("feature").agg(F.abs(F.corr("value", F.col("y").cast("double"))).alias("rho"))
