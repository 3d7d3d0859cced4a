"""Survival analysis. Risk sets are running sums over time cut into blocks, so a group holding most patients is not one
task; Cox models of all features share each Newton round."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.functions.prefix import prefix_sums, value_counts
from phenospark.functions.special import chi2_tail_sql, normal_two_sided_sql
from phenospark.session import by_groups, checkpointed, take

TIE_CHUNK = 1024
PAIR_BLOCK = 1 << 16


def kaplan_meier(df: DataFrame, by: Sequence[str], time: str = "time", status: str = "status") -> DataFrame:
    """Product-limit curve per stratum with log-log limits, one row per distinct time."""
    by = list(by)
    vc = value_counts(df, by, time, {"n": F.lit(1), "d": F.col(status)})
    t = prefix_sums(vc, by, time, ["n"], descending=True).select(*by, time, "d", (F.col("before_n") + F.col("n")).alias("at_risk"))
    last = F.col("d") == F.col("at_risk")
    t = t.withColumns({"_l": F.when(~last, F.ln(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0),
                       "_v": F.when(~last, F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d")))).otherwise(0.0),
                       "_zero": last.cast("int")})
    t = prefix_sums(t, by, time, ["_l", "_v", "_zero"])
    s = F.when(F.col("before__zero") + F.col("_zero") > 0, F.lit(0.0)).otherwise(F.exp(F.col("before__l") + F.col("_l")))
    t = t.select(*by, time, "at_risk", "d", s.alias("survival"), F.sqrt(F.col("before__v") + F.col("_v")).alias("_se"))
    inner = (F.col("survival") > 0) & (F.col("survival") < 1)
    k = F.exp(1.96 * F.col("_se") / F.abs(F.ln(F.when(inner, F.col("survival")))))
    return t.select(*by, time, "at_risk", "d", "survival", F.when(inner, F.pow("survival", k)).alias("lo"), F.when(inner, F.pow("survival", 1 / k)).alias("hi"))


def log_rank(df: DataFrame, group: str, first: str, second: str, time: str = "time", status: str = "status") -> DataFrame:
    """Two-group log-rank chi-square, p and hazard ratio (second over first) with its interval."""
    df = df.where(F.col(group).isin(first, second))
    one = (F.col(group) == first).cast("int")
    vc = value_counts(df, [], time, {"n": F.lit(1), "n1": one, "d": F.col(status), "d1": F.col(status) * one})
    t = prefix_sums(vc, [], time, ["n", "n1"], descending=True)
    n, n1, d = F.col("before_n") + F.col("n"), F.col("before_n1") + F.col("n1"), F.col("d")
    g = t.agg(F.sum("d1").cast("double").alias("o1"), F.sum(F.col("d") - F.col("d1")).cast("double").alias("o2"), F.sum(d * n1 / n).alias("e1"), F.sum(d * (n - n1) / n).alias("e2"),
              F.sum(F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1))).alias("v"))
    g = g.withColumn("chi2", F.try_divide(F.pow(F.col("o1") - F.col("e1"), 2), "v")).withColumn("_z", F.sqrt(F.col("chi2") / 2))
    hr = (F.col("o2") / F.col("e2")) / (F.col("o1") / F.col("e1"))
    half = 1.96 * F.sqrt(1 / F.col("e1") + 1 / F.col("e2"))
    return g.select("o1", "o2", "e1", "e2", "chi2", F.expr(chi2_tail_sql("chi2", "_z", 1)).alias("p"), hr.alias("hr"),
                    F.exp(F.ln(hr) - half).alias("hr_lo"), F.exp(F.ln(hr) + half).alias("hr_hi"))


def _risk_sums(rows: DataFrame, keys: Sequence[str], covs: Sequence[str], time: str, status: str, start: str | None) -> DataFrame:
    """Per (keys, time): risk-set and event sums of w, w*x, w*x*x'. ``_w`` is exp(beta x). Delayed entry subtracts a
    row's weights at its start time."""
    p = range(len(covs))
    terms = {"r0": F.col("_w")}
    terms |= {f"r1_{i}": F.col("_w") * F.col(covs[i]) for i in p}
    terms |= {f"r2_{i}_{j}": F.col("_w") * F.col(covs[i]) * F.col(covs[j]) for i in p for j in p if i <= j}
    ev = F.col(status) == 1
    deaths = {f"d{k[1:]}": F.when(ev, c).otherwise(0.0) for k, c in terms.items()}
    deaths |= {f"sx_{i}": F.when(ev, F.col(covs[i])).otherwise(0.0) for i in p}
    deaths |= {"d": ev.cast("int"), "_eta": F.when(ev, F.col("_bx")).otherwise(0.0)}
    cols = [F.col(k) for k in keys]
    base = rows.select(*cols, F.col(time).alias("_t"), *[c.alias(k) for k, c in terms.items()], *[c.alias(k) for k, c in deaths.items()])
    if start:
        out = rows.select(*cols, F.col(start).alias("_t"), *[(-c).alias(k) for k, c in terms.items()],
                          *[F.lit(0).cast("int" if k == "d" else "double").alias(k) for k in deaths])
        base = base.unionByName(out)
    vc = value_counts(base, keys, "_t", {k: F.col(k) for k in [*terms, *deaths]})
    t = prefix_sums(vc, keys, "_t", list(terms), descending=True)
    return t.where("d > 0").select(*cols, "_t", *[(F.col(f"before_{k}") + F.col(k)).alias(k) for k in terms], *deaths)


def _newton_sums(t: DataFrame, keys: Sequence[str], n_cov: int, ties: str) -> DataFrame:
    """Gradient, information and log-likelihood per key. Tied deaths are spread over steps of at most TIE_CHUNK."""
    p = range(n_cov)
    pairs = [(i, j) for i in p for j in p if i <= j]
    if ties == "efron":
        t = t.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("d") - 1) / TIE_CHUNK))))
        t = t.withColumn("_first", F.col("_c") == 0)
        steps = F.sequence(F.col("_c") * TIE_CHUNK, F.least((F.col("_c") + 1) * TIE_CHUNK, F.col("d").cast("long")) - 1)
        spread = lambda f: F.aggregate(F.transform(steps, lambda l: f(l / F.col("d"))), F.lit(0.0), lambda a, x: a + x)
    else:
        t = t.withColumn("_first", F.lit(True))
        spread = lambda f: f(F.lit(0.0)) * F.col("d")
    den = lambda a: F.col("r0") - a * F.col("d0")
    m1 = lambda i, a: (F.col(f"r1_{i}") - a * F.col(f"d1_{i}")) / den(a)
    m2 = lambda i, j, a: (F.col(f"r2_{i}_{j}") - a * F.col(f"d2_{i}_{j}")) / den(a)
    once = lambda c: F.when(F.col("_first"), c).otherwise(0.0)
    return t.groupBy(*keys).agg(
        F.sum("d").alias("events"), F.sum(once(F.col("_eta")) - spread(lambda a: F.ln(den(a)))).alias("loglik"),
        *[F.sum(once(F.col(f"sx_{i}")) - spread(lambda a, i=i: m1(i, a))).alias(f"g_{i}") for i in p],
        *[F.sum(spread(lambda a, i=i, j=j: m2(i, j, a) - m1(i, a) * m1(j, a))).alias(f"h_{i}_{j}") for i, j in pairs])


def cox_univariate(facts: DataFrame, key: str = "feature", value: str = "value", time: str = "time", status: str = "status",
                   ties: str = "efron", rounds: int = 8, concordance: bool = False) -> DataFrame:
    """One Cox model per feature, all in the same Newton rounds: coefficient, se, hazard ratio with interval, p. The coefficients, one
    row per feature, are broadcast, so that no round shuffles the rows by feature."""
    x = facts.where(F.col(value).isNotNull())
    st = x.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")).where("_s > 0")
    x = x.join(F.broadcast(st), key).select(key, time, status, ((F.col(value) - F.col("_m")) / F.col("_s")).alias("_x"))
    x = x.persist()  # read once per round; given back below
    beta = st.select(key, "_s", F.lit(0.0).alias("b"))
    for i in range(rounds):
        rows = x.join(F.broadcast(beta.select(key, "b")), key).withColumn("_bx", F.col("b") * F.col("_x")).withColumn("_w", F.exp("_bx"))
        sums = _newton_sums(_risk_sums(rows, [key], ["_x"], time, status, None), [key], 1, ties)
        # one row per feature
        step = beta.select(key, "_s", "b").join(sums, key).select(key, "_s", (F.col("b") + F.try_divide("g_0", "h_0_0")).alias("b"), F.abs(F.try_divide("g_0", "h_0_0")).alias("_d"), "h_0_0", "loglik", "events")
        beta = checkpointed(step)
        if (beta.agg(F.max("_d")).first()[0] or 0.0) < 1e-9:
            break
    x.unpersist()
    se = 1 / F.sqrt("h_0_0")
    out = beta.select(key, "events", (F.col("b") / F.col("_s")).alias("coef"), (se / F.col("_s")).alias("se"), (F.abs(F.col("b")) / se / math.sqrt(2)).alias("_z"))
    out = out.select(key, "events", "coef", "se", F.exp("coef").alias("hr"), F.exp(F.col("coef") - 1.96 * F.col("se")).alias("hr_lo"),
                     F.exp(F.col("coef") + 1.96 * F.col("se")).alias("hr_hi"), F.expr(normal_two_sided_sql("_z")).alias("p"))
    if concordance:
        c = concordance_index(facts.where(F.col(value).isNotNull()), [key], value, time, status)
        out = out.join(c.select(key, "c_index"), key).withColumn("c_index", F.when(F.col("coef") < 0, 1 - F.col("c_index")).otherwise(F.col("c_index")))
    return out


def cox_multivariate(df: DataFrame, covs: Sequence[str], time: str = "time", status: str = "status", strata: str | None = None,
                     start: str | None = None, ties: str = "efron", rounds: int = 12, first: Sequence[float] | None = None) -> dict:
    """Several covariates; strata have their own risk sets, ``start`` gives delayed entry. Each round brings p*p sums to
    the driver, nothing else. Returns names, coefficients, covariance, log-likelihoods and the number of rounds. ``first`` is where the
    rounds begin instead of at zero; there is no log-likelihood of the empty model then."""
    covs, p = list(covs), len(covs)
    cent = df.agg(*[F.avg(c) for c in covs]).first()
    keys = [strata] if strata else []
    x = df.select(*keys, time, status, *([start] if start else []), *[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(covs, cent)])
    if not df.is_cached:
        x.persist()  # read once per round; given back below
    b, ll0 = np.zeros(p) if first is None else np.array(first, float), None
    for done in range(1, rounds + 1):
        bx = sum((F.lit(float(v)) * F.col(c) for v, c in zip(b[1:], covs[1:])), F.lit(float(b[0])) * F.col(covs[0]))
        rows = x.withColumn("_bx", bx).withColumn("_w", F.exp("_bx"))
        r = _newton_sums(_risk_sums(rows, keys, covs, time, status, start), [], p, ties).first()
        g = np.array([r[f"g_{i}"] for i in range(p)])
        h = np.array([[r[f"h_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        ll0 = r["loglik"] if ll0 is None and first is None else ll0
        step = np.linalg.solve(h, g)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    if not df.is_cached:
        x.unpersist()
    return {"names": covs, "coef": b, "cov": np.linalg.inv(h), "loglik": r["loglik"], "loglik0": ll0, "events": r["events"], "rounds": done}


def cox_table(spark, fit: dict) -> DataFrame:
    se = np.sqrt(np.diag(fit["cov"]))
    rows = [(n, float(c), float(s), float(math.exp(c)), float(math.exp(c - 1.96 * s)), float(math.exp(c + 1.96 * s)), float(math.erfc(abs(c / s) / math.sqrt(2))))
            for n, c, s in zip(fit["names"], fit["coef"], se)]
    return spark.createDataFrame(rows, "feature string, coef double, se double, hr double, hr_lo double, hr_hi double, p double")


def ph_check(df: DataFrame, fit: dict, time: str = "time", status: str = "status") -> DataFrame:
    """Correlation of Schoenfeld residuals with event time, per covariate."""
    covs = fit["names"]
    bx = sum((F.lit(float(v)) * F.col(c) for v, c in zip(fit["coef"], covs)), F.lit(0.0))
    rows = df.withColumn("_bx", bx).withColumn("_w", F.exp("_bx"))
    t = _risk_sums(rows, [], covs, time, status, None).select(F.col("_t").alias(time), *[(F.col(f"r1_{i}") / F.col("r0")).alias(f"_m{i}") for i in range(len(covs))])
    ev = df.where(F.col(status) == 1).join(t, time)
    one = ev.agg(*[F.corr(F.col(c) - F.col(f"_m{i}"), F.col(time).cast("double")).alias(c) for i, c in enumerate(covs)])
    return one.unpivot([], covs, "feature", "rho")


def _pairs_inside(table: pa.Table, starts: np.ndarray, score: str) -> dict:
    """Concordant, discordant and tied pairs inside each block; different scores by the highest bit in which their ranks differ."""
    ends = np.append(starts[1:], table.num_rows)
    value, t = table.column(score).to_numpy(), table.column("_t").to_numpy()
    e, c = (table.column(k).to_numpy().astype(np.int64) for k in ("e", "c"))
    out = np.zeros((3, len(starts)), np.int64)
    for k, (a, b) in enumerate(zip(starts, ends)):
        order = np.argsort(t[a:b], kind="stable")[::-1] + a  # latest first
        rank, own = np.unique(value[order], return_inverse=True)
        when = np.unique(t[order], return_inverse=True)[1]
        for lev in range(-1, (len(rank) - 1).bit_length()):
            group = own >> (lev + 1)
            by = np.argsort(group, kind="stable")
            g, w, ev, ce = group[by], when[by], e[order[by]], c[order[by]]
            bit = own[by] >> lev & 1 if lev >= 0 else np.zeros(len(by), np.int64)
            fresh = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1]))))  # one run per group and time
            e0, e1, c0, c1 = (np.add.reduceat(np.where(bit == side, x, 0), fresh) for x in (ev, ce) for side in (0, 1))
            g = g[fresh]
            head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            later = []
            for n, same in ((e0 + c0, c0), (e1 + c1, c1)):
                before = np.cumsum(n) - n
                later.append(before - np.repeat(before[head], np.diff(np.append(head, len(g)))) + same)
            if lev < 0:
                out[2, k] = (e0 * later[0]).sum()
            else:
                out[:2, k] += (e1 * later[0]).sum(), (e0 * later[1]).sum()
    return dict(zip(("concordant", "discordant", "tied"), out))


def concordance_index(df: DataFrame, keys: Sequence[str], score: str, time: str = "time", status: str = "status") -> DataFrame:
    """Harrell's c with ties and censoring, exactly and without pairs.

    The scores of a key are cut into blocks of about ``PAIR_BLOCK`` rows; a score with more rows is a block of its own. Pairs of
    scores in one block, ties among them, are counted there. Two blocks are told apart by the highest bit in which their numbers differ: per bit
    level the blocks that share the higher bits form a group, and the pairs split by this bit are counted with running sums
    over time, of at most one row per block, time and level. Ties of a score with a block of its own are counted by running sums.
    """
    keys = list(keys)
    ev = F.col(status) == 1
    rows = df.where(F.col(score).isNotNull()).groupBy(*keys, score, F.col(time).alias("_t")).agg(F.count_if(ev).alias("e"), F.count_if(~ev).alias("c"))
    vc = value_counts(rows, keys, score, {"n": F.lit(1)})
    at = prefix_sums(vc, keys, score, ["n"]).select(
        *keys, score, (2 * F.floor(F.col("before_n") / PAIR_BLOCK) + (F.col("n") >= PAIR_BLOCK).cast("int")).cast("bigint").alias("_r"))
    rows = checkpointed(rows.join(at, [*keys, score]).where(F.col("_t").isNotNull()))
    bits = max(1, int(rows.agg(F.max("_r")).first()[0] or 0).bit_length())
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "concordant bigint", "discordant bigint", "tied bigint"])
    inside = by_groups(rows.where("_r % 2 = 0"), [*keys, "_r"], lambda table, starts: {
        **{k: take(table, k, starts) for k in keys}, **_pairs_inside(table, starts, score)}, schema)
    # pairs of blocks, and ties of the scores with a block of their own
    side = lambda c, b: F.when(F.col("_b") == b, F.col(c)).otherwise(0)
    sums = {"e0": side("e", 0), "e1": side("e", 1), "n0": side("e", 0) + side("c", 0), "n1": side("e", 1) + side("c", 1)}
    blocks = rows.groupBy(*keys, "_r", "_t").agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
    lv = blocks.withColumn("_lev", F.explode(F.array(*[F.lit(i) for i in range(bits)]))).withColumns(
        {"_g": F.expr("shiftright(_r, _lev + 1)"), "_b": F.expr("shiftright(_r, _lev) % 2").cast("int")})

    def split(v: DataFrame, groups: Sequence[str]) -> DataFrame:
        t = prefix_sums(value_counts(v, groups, "_t", sums), groups, "_t", ["n0", "n1"], descending=True)
        return t.withColumns({"l0": F.col("before_n0") + F.col("n0") - F.col("e0"), "l1": F.col("before_n1") + F.col("n1") - F.col("e1")})

    none = F.lit(0).cast("bigint")
    between = split(lv, [*keys, "_lev", "_g"]).groupBy(*keys).agg(F.sum(F.col("e1") * F.col("l0")).alias("concordant"), F.sum(F.col("e0") * F.col("l1")).alias("discordant"))
    equal = split(rows.where("_r % 2 = 1").withColumn("_b", F.lit(0)), [*keys, score]).groupBy(*keys).agg(F.sum(F.col("e0") * F.col("l0")).alias("tied"))
    parts = inside.unionByName(between.withColumn("tied", none)).unionByName(
        equal.select(*keys, none.alias("concordant"), none.alias("discordant"), "tied"))
    g = parts.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in ("concordant", "discordant", "tied")])
    return g.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("concordant") + F.col("discordant") + F.col("tied")))


def risk_group(df: DataFrame, score: str, cut: float) -> DataFrame:
    return df.withColumn("risk_group", F.when(F.col(score) > cut, 1).otherwise(-1))


def backward_aic(df: DataFrame, covs: Sequence[str], time: str = "time", status: str = "status", strata: str | None = None,
                 start: str | None = None, **kw) -> list[dict]:
    """Stepwise removal by AIC (few covariates): the path of models, best last. The rows are read once and kept for all models; a
    smaller model begins at the coefficients of the larger one."""
    aic = lambda f: -2 * f["loglik"] + 2 * len(f["names"])
    df = df.select(*dict.fromkeys([*covs, time, status, *([strata] if strata else []), *([start] if start else [])])).persist()
    try:
        best = cox_multivariate(df, covs, time, status, strata, start, **kw)
        path = [{"names": list(best["names"]), "aic": aic(best), "rounds": best["rounds"]}]
        while len(path[-1]["names"]) > 1:
            now = dict(zip(best["names"], best["coef"]))
            tries = [cox_multivariate(df, [c for c in now if c != d], time, status, strata, start, first=[b for c, b in now.items() if c != d], **kw) for d in now]
            smaller = min(tries, key=aic)
            if aic(smaller) >= path[-1]["aic"]:
                break
            best = smaller
            path.append({"names": list(best["names"]), "aic": aic(best), "rounds": best["rounds"]})
    finally:
        df.unpersist()
    return path
