"""Distribution tails as plain SQL expressions (no UDF), plus a vectorised Student tail.

Each ``*_sql`` function returns an expression string over a *column name or literal*, so it stays inside
whole-stage codegen: ``F.expr(normal_two_sided_sql("z"))``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def erfc_sql(z: str, terms: int = 48, depth: int = 30) -> str:
    """erfc for z >= 0: the all-positive power series below 2.5, a continued fraction above."""
    series = "1e0"
    for n in range(terms, 0, -1):
        series = f"(1e0+2e0*{z}*{z}/{2 * n + 1}e0*{series})"
    small = f"(1e0-{2 / math.sqrt(math.pi)!r}*exp(-{z}*{z})*{z}*{series})"
    frac = z
    for k in range(depth, 0, -1):
        frac = f"({z}+{k / 2!r}e0/{frac})"
    large = f"(exp(-{z}*{z})/{math.sqrt(math.pi)!r}e0/{frac})"
    return f"(case when {z} is null then null when {z}<2.5e0 then {small} else {large} end)"


def normal_two_sided_sql(z_over_root2: str) -> str:
    """2*(1-Phi(|z|)) given a column holding |z|/sqrt(2)."""
    return erfc_sql(z_over_root2)


def chi2_tail_sql(x: str, root_half: str, df: int) -> str:
    """Upper tail of chi-square with integer ``df``; ``root_half`` is a column with sqrt(x/2)."""
    if df % 2 == 0:
        term, parts = "1e0", ["1e0"]
        for k in range(1, df // 2):
            term = f"({term}*{x}/2e0/{k}e0)"
            parts.append(term)
        return f"(exp(-{x}/2e0)*({'+'.join(parts)}))"
    out = erfc_sql(root_half)
    if df > 1:
        term = "1e0"
        parts = [term]
        for k in range(1, (df - 1) // 2):
            term = f"({term}*{x}/{2 * k + 1}e0)"
            parts.append(term)
        out = f"({out}+sqrt(2e0*{x}/{math.pi!r})*exp(-{x}/2e0)*({'+'.join(parts)}))"
    return out


def _beta_fraction(a, b, x, rounds: int = 200):
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds + 1):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def incomplete_beta(a, b, x):
    """Regularised incomplete beta, vectorised over numpy arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            lg(aa + bb) - lg(aa) - lg(bb) + aa * np.log(np.maximum(xx, 1e-300)) + bb * np.log1p(-np.minimum(xx, 1 - 1e-16))
        )
        val = np.where(xx <= 0, 0.0, front * _beta_fraction(aa, bb, xx) / aa)
    return np.where(flip, 1 - val, val)


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student tail. Meant for one row per feature, never for raw rows."""
    tv, dv = t.to_numpy(float), df.to_numpy(float)
    bad = ~(np.isfinite(tv) & np.isfinite(dv) & (dv > 0))
    dv = np.where(bad, 1.0, dv)
    tv = np.where(bad, 0.0, tv)
    p = incomplete_beta(dv / 2, np.full_like(dv, 0.5), dv / (dv + tv * tv))
    return pd.Series(p).where(~bad, other=None)
