"""Many logistic models in shared passes over the rows.

Resampling replicas, folds and penalties differ only in the weights of rows and in a few numbers, so they are a key of the model
table and no loop over Spark jobs: one pass computes, for every model that has not settled, the loss, the gradient and the Gram
matrix of the weighted rows; the driver takes a Newton step for each (a coordinate descent on the Gram matrix where there is an
L1 penalty). The number of passes is that of the slowest model, about ten, whatever the number of models.

A task holds one block of rows and models x columns^2 sums; the driver receives those sums added up. Rows are standardised inside
each model by the weighted moments of its own training rows.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phenospark.functions.prefix import value_counts, with_blocks
from phenospark.session import stored_for_passes

CHUNK = 4096
CELLS = 1 << 18  # sums over this many (row, model) cells at a time stay in the caches
# Poisson(1) distribution function in 32 bits: a draw is the number of steps at or under a hash.
STEPS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
_AT = np.array(STEPS, np.uint32)
_UPPER = np.searchsorted(_AT, np.arange(1 << 16, dtype=np.uint32) << np.uint32(16), side="right").astype(float)  # draws by the upper half of a hash
_SPLIT = np.isin(np.arange(1 << 16), _AT >> np.uint32(16))  # upper halves within which a step lies


# ---- resampling weights ---------------------------------------------------------------------------------------------------------------

def mix32(x: np.ndarray) -> np.ndarray:
    """A 32-bit mixing function on values below 2**32, kept in 64 bits."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor) & np.uint64(0xFFFFFFFF)
    return x ^ x >> np.uint64(16)


def draws(keys: np.ndarray, replicas: np.ndarray, seed: int) -> np.ndarray:
    """Rows x replicas of Poisson(1) counts that depend on key, replica and seed only."""
    k = keys.astype(np.int64).view(np.uint64)
    start = mix32(k & np.uint64(0xFFFFFFFF) ^ mix32((k >> np.uint64(32)) + np.uint64(seed) & np.uint64(0xFFFFFFFF)))
    h = start.astype(np.uint32)[:, None] + (replicas.astype(np.uint64) * np.uint64(0x9E3779B9)).astype(np.uint32)[None]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):  # mix32 in 32 bits, which wrap
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    upper = h >> np.uint32(16)
    out = _UPPER[upper]
    close = _SPLIT[upper]
    out[close] = np.searchsorted(_AT, h[close], side="right")
    return out


# ---- medians ----------------------------------------------------------------------------------------------------------------------------

class Medians(NamedTuple):
    """Sets x columns: values present, and of both middle values (one and the same if their number is odd) the value, the number of
    smaller values and of equal ones."""

    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    low_before: np.ndarray
    high_before: np.ndarray
    low_n: np.ndarray
    high_n: np.ndarray


def _ordered(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    u = (v + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def fold_medians(df: DataFrame, cols: Sequence[str], held: Sequence[int], folds: Sequence[str] | None = None, first: int = 12, more: int = 8, few: int = 256) -> Medians:
    """Exact middle values of columns over the rows outside each fold of ``held``, from a stored frame (fold, columns).

    ``folds`` names the fold column of each of ``cols``, among which a column may come again; rows without a fold take no part.

    A pass counts, per column and fold, the values by the leading bits of their ordered form, the next pass only those that share
    the bits of a middle value; when ``few`` are left, all bits at once. Three or four passes, whose counts alone leave the tasks:
    no value is shuffled or sorted."""
    m = len(cols)
    folds = list(folds or ["fold"] * m)
    names = list(dict.fromkeys([*folds, *cols]))
    place, by = [names.index(c) for c in cols], [names.index(c) for c in folds]
    known, todo = first, {(j, 0, 0) for j in range(m)}  # column, leading bits and their number
    state = {(s, j, h): [0, 0, 0, 0] for s in range(len(held)) for j in range(m) for h in (0, 1)}  # rank left, before, equal, bits
    n = np.zeros((len(held), m), np.int64)
    start = True
    while todo:
        cells = sorted(todo)

        def work(batches: Iterator[pa.RecordBatch], cells=cells, shift=np.uint64(64 - known)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys: dict[int, tuple] = {}
                for c, (j, bits, had) in enumerate(cells):
                    if j not in keys:
                        v, f = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (place[j], by[j]))
                        there = ~np.isnan(v) & ~np.isnan(f)
                        keys = {j: (_ordered(v[there]), *np.unique(f[there].astype(np.int32), return_inverse=True))}  # cells go by column
                    key, of, f = keys[j]
                    if not len(of):
                        continue
                    if had:
                        same = key >> np.uint64(64 - had) == np.uint64(bits)
                        key, f = key[same], f[same]
                    at, back = np.unique(key >> shift, return_inverse=True)
                    got = np.bincount(back * len(of) + f, minlength=len(at) * len(of))
                    some = np.flatnonzero(got)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c, np.int32)), pa.array(of[some % len(of)].astype(np.int32)),
                                                      pa.array(at[some // len(of)].view(np.int64)), pa.array(got[some])], ["c", "fold", "at", "n"])

        got = df.select(*names).mapInArrow(work, "c int, fold int, at bigint, n bigint").groupBy("c", "fold", "at").agg(F.sum("n").alias("n")).toPandas()
        cell, fold, at, num = got["c"].to_numpy(), got["fold"].to_numpy(), got["at"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy()
        order = np.lexsort((at, cell))
        cell, fold, at, num = cell[order], fold[order], at[order], num[order]
        most, moved = 0, {}
        for c, (j, bits, had) in enumerate(cells):
            mine = slice(*np.searchsorted(cell, [c, c + 1]))
            values, back = np.unique(at[mine], return_inverse=True)
            for s, h in enumerate(held):
                sums = np.cumsum(np.bincount(back, np.where(fold[mine] == h, 0, num[mine]), len(values)).astype(np.int64))
                if start:
                    n[s, j] = sums[-1] if len(sums) else 0
                if not n[s, j]:
                    continue
                for half in (0, 1):
                    x = state[s, j, half]
                    if start:
                        x[0] = (n[s, j] - 1) // 2 if half == 0 else n[s, j] // 2
                    elif x[3] != bits:
                        continue
                    i = int(np.searchsorted(sums, x[0], "right"))
                    below = int(sums[i - 1]) if i else 0
                    moved[s, j, half] = [x[0] - below, x[1] + below, int(sums[i]) - below, int(values[i])]
                    most = max(most, moved[s, j, half][2])
        state |= moved
        if known == 64:
            break
        start, todo = False, {(j, x[3], known) for (_, j, _), x in moved.items()}
        known = 64 if most <= few else min(64, known + more)

    def grid(i: int, half: int) -> np.ndarray:
        return np.array([[state[s, j, half][i] for j in range(m)] for s in range(len(held))], np.uint64).reshape(len(held), m)

    def value(half: int) -> np.ndarray:
        u = grid(3, half)
        return np.where(n > 0, np.where(u >> np.uint64(63), u & np.uint64((1 << 63) - 1), ~u).view(float), np.nan)

    return Medians(n, value(0), value(1), *(grid(i, half).astype(np.int64) for i in (1, 2) for half in (0, 1)))


# ---- rows -------------------------------------------------------------------------------------------------------------------------------

class SharedPasses:
    """Sums over one stored frame (key, y, ...) for several threads: when each of them waits for sums, one job computes them all.

    The frame is read once instead of once per thread, and the driver plans and keeps one job instead of one per thread. ``readers``
    are served by at most ``workers`` threads; each must call :meth:`leave` when it is done."""

    def __init__(self, df: DataFrame, readers: int, workers: int):
        self.df, self._left, self._workers = df, readers, workers
        self._waiting: list[dict] = []
        self._turn = threading.Condition()

    def tally(self, columns: Sequence[str], skip: tuple[str, int], work: Callable[..., np.ndarray], n: int, width: int) -> np.ndarray:
        """n x width sums of ``work(key, y, fold, x)`` over blocks of rows; ``columns`` are the fold and those of x, rows where ``skip``
        holds take no part."""
        ask = {"columns": list(columns), "skip": skip, "work": work, "n": n, "width": width}
        with self._turn:
            self._waiting.append(ask)
            self._run()
            self._turn.wait_for(lambda: "got" in ask or "error" in ask)
        if "error" in ask:
            raise ask["error"]
        return ask["got"]

    def leave(self) -> None:
        with self._turn:
            self._left -= 1
            self._run()

    def _run(self) -> None:
        if not self._waiting or len(self._waiting) < min(self._workers, self._left):
            return
        asked, self._waiting = self._waiting, []
        try:
            for ask, got in zip(asked, self._sums(asked)):
                ask["got"] = got
        except Exception as e:
            for ask in asked:
                ask["error"] = e
        self._turn.notify_all()

    def _sums(self, asked: list[dict]) -> list[np.ndarray]:
        names = list(dict.fromkeys(c for a in asked for c in (a["skip"][0], *a["columns"])))
        plan = [(names.index(a["skip"][0]), a["skip"][1], [names.index(c) for c in a["columns"]], a["work"], a["n"], a["width"]) for a in asked]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros((n, width)) for *_, n, width in plan]
            for b in batches:
                key, y, *cols = (b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns))
                for total, (held, out, (fold, *xs), step, _, _) in zip(totals, plan):
                    of = cols[held] != out
                    total += step(key[of], y[of], cols[fold][of], np.column_stack([cols[i][of] for i in xs]))
            yield _summed(totals)

        got = _added(self.df.select("key", "y", *names).mapInArrow(work, "model int, v array<double>"), [(a["n"], a["width"]) for a in asked])
        return got


def _summed(totals: Sequence[np.ndarray]) -> pa.RecordBatch:
    """Tables of sums as rows (model, v), without the rows that are zero; models are numbered through all tables."""
    some = [np.flatnonzero(t.any(axis=1)) for t in totals]
    first = np.cumsum([0, *(len(t) for t in totals)])
    ends = np.cumsum(np.concatenate([[0], *(np.full(len(k), t.shape[1]) for k, t in zip(some, totals))]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k + a for k, a in zip(some, first)]).astype(np.int32)), pa.ListArray.from_arrays(
        pa.array(ends.astype(np.int32)), pa.array(np.concatenate([t[k].ravel() for k, t in zip(some, totals)])))], ["model", "v"])


def _added(parts: DataFrame, shapes: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """The tables that the rows of all tasks add up to."""
    got = parts.select("model", F.posexplode("v").alias("at", "v")).groupBy("model", "at").agg(F.sum("v").alias("v")).toPandas()
    model, at, v = (got[c].to_numpy() for c in ("model", "at", "v"))
    out, first = [], 0
    for n, width in shapes:
        t, mine = np.zeros((n, width)), (model >= first) & (model < first + n)
        t[model[mine] - first, at[mine]] = v[mine]
        out.append(t)
        first += n
    return out


class View(NamedTuple):
    """How a training set reads a shared frame: the columns of its fold and of its features, the rows it does not see, its folds, a
    center and spread of its features, and their medians outside each fold and over all, in their own units."""

    passes: SharedPasses
    fold: str
    columns: Sequence[str]
    skip: tuple[str, int]
    folds: Sequence[int]
    center: np.ndarray
    spread: np.ndarray
    median: np.ndarray


class Rows:
    """A stored frame of (key, y, fold, f0, f1, ...) for shared passes, and the training sets that its folds define: one per
    fold, without its rows, and with ``whole`` one of all rows. A row without a label belongs to no set. With a ``view`` the frame is stored already and its
    sums are taken in the passes that it shares."""

    def __init__(self, frame: DataFrame, cols: Sequence[str], fold: str | None = "fold", whole: bool = False, id_: str = "patient_id", y: str = "y", view: View | None = None):
        key = F.col(id_) if dict(frame.dtypes)[id_] == "bigint" else F.xxhash64(id_)
        part = F.lit(-2) if fold is None else F.col(fold).cast("int")
        self.cols = list(cols)
        kept = frame.where(F.col(y).isNotNull()).select(key.alias("key"), F.col(y).cast("int").alias("y"), part.alias("fold"), *[F.col(c).cast("double").alias(c) for c in self.cols])
        self.view = view
        if view is not None:
            self.df, self.folds, self.center, self.spread = kept, list(view.folds), view.center, view.spread
            self.held = [*self.folds, *([-1] if whole else [])]
            self.median = (view.median[:len(self.held)] - self.center) / self.spread
            return
        self.df = stored_for_passes(kept, "key")
        stats = self.df.agg(F.collect_set("fold").alias("folds"), *[F.avg(c).alias(f"m_{c}") for c in self.cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in self.cols],
                            *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"g_{c}") for c in self.cols]).first()
        self.folds = sorted(f for f in stats["folds"] if f >= 0)
        self.held = [*self.folds, *([-1] if whole or not self.folds else [])]
        # a common scale for all models, for the sake of rounding only
        self.center = np.array([stats[f"m_{c}"] or 0.0 for c in self.cols])
        self.spread = np.array([stats[f"s_{c}"] or 1.0 for c in self.cols])
        self.median = self._medians([c for c in self.cols if stats[f"g_{c}"]])

    def _medians(self, gaps: Sequence[str]) -> np.ndarray:
        """Training medians per set and column on the common scale, of the columns with gaps."""
        out = np.zeros((len(self.held), len(self.cols)))
        if gaps:
            at = [self.cols.index(c) for c in gaps]
            med = fold_medians(self.df.select("fold", *gaps), gaps, self.held)
            out[:, at] = np.where(med.n > 0, ((med.low + med.high) / 2 - self.center[at]) / self.spread[at], 0.0)
        return out

    def tally(self, step: Callable[..., np.ndarray], n: int, width: int) -> np.ndarray:
        """The n x width sums of ``step(x, y, fold, key)`` over blocks of rows; x is on the common scale, missing cells are NaN."""
        center, spread, chunk = self.center, self.spread, min(CHUNK, max(256, CELLS // max(n, 1)))

        def block(key: np.ndarray, y: np.ndarray, fold: np.ndarray, raw: np.ndarray) -> np.ndarray:
            total, x = np.zeros((n, width)), (raw - center) / spread
            for a in range(0, len(y), chunk):
                s = slice(a, a + chunk)
                total += step(x[s], y[s], fold[s], key[s])
            return total

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, width))
            for b in batches:
                key, y, fold = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                total += block(key, y, fold, np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3, b.num_columns)]))
            yield _summed([total])

        if self.view is not None:
            return self.view.passes.tally([self.view.fold, *self.view.columns], self.view.skip, block, n, width)
        return _added(self.df.mapInArrow(work, "model int, v array<double>"), [(n, width)])[0]


# ---- models -----------------------------------------------------------------------------------------------------------------------------

class Models:
    """Penalised logistic models over the sets of ``rows``: one per (set, replica, c, l1_ratio), the arrays ``set``, ``replica`` (-1:
    every row once), ``c`` and ``l1_ratio``.

    Objective: sum of class weight x resampling count x log loss + ((1 - l1_ratio) / 2 |b|^2 + l1_ratio |b|_1) / c on columns
    standardised inside the model; the intercept goes free. ``balanced`` weighs the classes of a model's training rows equally.
    """

    def __init__(self, rows: Rows, replicas: int = 0, cs: Sequence[float] = (1.0,), l1_ratios: Sequence[float] = (0.0,), balanced: bool = True, seed: int = 42):
        grid = [(s, b, c, r) for s in range(len(rows.held)) for b in (range(replicas) if replicas else [-1]) for c in cs for r in l1_ratios]
        self.rows, self.replicas, self.balanced, self.seed = rows, replicas, balanced, seed
        self.set, self.replica = (np.array([g[i] for g in grid], np.int64) for i in (0, 1))
        self.c, self.l1_ratio = (np.array([g[i] for g in grid], float) for i in (2, 3))
        self.l2, self.l1 = (1 - self.l1_ratio) / self.c, self.l1_ratio / self.c
        self.p = len(rows.cols)
        self.beta = np.zeros((len(grid), self.p + 1))
        self.residual = np.full(len(grid), np.inf)
        self.passes = 0
        self._moments()

    def _weights(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        seed, replicated = self.seed, self.replicas > 0
        return lambda key, which: draws(key, which, seed) if replicated else np.ones((len(key), len(which)))

    def _moments(self) -> None:
        """Class sizes, means and scales of the training rows of every (set, replica), from sums per (replica, fold)."""
        rows, p, weights = self.rows, self.p, self._weights()
        folds = rows.folds or [-2]
        reps = np.arange(max(self.replicas, 1))

        def step(x, y, fold, key):
            hole = np.isnan(x)
            x0 = np.where(hole, 0.0, x)
            facts = np.column_stack([y == 0, y == 1, x0, x0 * x0, hole]).astype(float)
            w = weights(key, reps)
            return np.concatenate([w[fold == f].T @ facts[fold == f] for f in folds])

        per = rows.tally(step, len(folds) * len(reps), 2 + 3 * p).reshape(len(folds), len(reps), -1)
        self.class_n, self.mean, self.scale = np.zeros((len(self.set), 2)), np.zeros((len(self.set), p)), np.ones((len(self.set), p))
        for s, h in enumerate(rows.held):
            t = sum(per[i] for i, f in enumerate(folds) if f != h)
            n, med = np.maximum(t[:, :2].sum(axis=1, keepdims=True), 1e-300), rows.median[s]
            m = (t[:, 2:2 + p] + t[:, 2 + 2 * p:] * med) / n
            v = np.maximum((t[:, 2 + p:2 + 2 * p] + t[:, 2 + 2 * p:] * med * med) / n - m * m, 0.0)
            mine = np.flatnonzero(self.set == s)
            b = np.maximum(self.replica[mine], 0)
            self.class_n[mine], self.mean[mine] = t[b, :2], m[b]
            self.scale[mine] = np.where(v[b] > 1e-20, np.sqrt(v[b]), 1.0)
        n = self.class_n.sum(axis=1, keepdims=True)
        self.class_w = np.where(self.class_n > 0, n / (2 * np.maximum(self.class_n, 1e-300)), 0.0) if self.balanced else np.ones_like(self.class_n)

    def _affine(self, which: np.ndarray) -> np.ndarray:
        """Matrices T with [1, z] = [1, x] T from the common scale x to the model's own scale z."""
        t = np.zeros((len(which), self.p + 1, self.p + 1))
        t[:, 0, 0] = 1.0
        j = np.arange(1, self.p + 1)
        t[:, j, j] = 1 / self.scale[which]
        t[:, 0, 1:] = -self.mean[which] / self.scale[which]
        return t

    def _sums(self, which: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, gradient and Gram matrix of the models ``which`` at ``beta``, on their own scales: one pass over the rows."""
        p, t = self.p, self._affine(which)
        raw = np.einsum("mij,mj->mi", t, beta)
        sets, cw, held, median, weights = self.set[which], self.class_w[which], self.rows.held, self.rows.median, self._weights()
        iu, ju = np.triu_indices(p + 1)
        different, back = np.unique(np.maximum(self.replica[which], 0), return_inverse=True)

        def step(x, y, fold, key):
            out = np.zeros((len(raw), 1 + p + 1 + len(iu)))
            drawn = weights(key, different)
            for s in np.unique(sets):
                inside = np.flatnonzero(fold != held[s])
                if not len(inside):
                    continue
                xs, ys = x[inside], y[inside]
                a = np.column_stack([np.ones(len(xs)), np.where(np.isnan(xs), median[s], xs)])
                m = np.flatnonzero(sets == s)
                own = drawn[inside]
                w = (own if len(m) == len(different) and (back[m] == np.arange(len(m))).all() else own[:, back[m]]) * np.ascontiguousarray(cw[m].T)[ys]
                z = a @ raw[m].T
                e = np.exp(-np.abs(z))
                r = 1 / (1 + e)
                loss = np.maximum(z, 0.0) - np.log(r) - ys[:, None] * z
                out[m, 0] = np.einsum("ij,ij->j", w, loss)
                out[m, 1:p + 2] = (w * (np.where(z >= 0, r, e * r) - ys[:, None])).T @ a
                out[m, p + 2:] = (w * (e * r * r)).T @ (a[:, iu] * a[:, ju])
            return out

        got = self.rows.tally(step, len(raw), 1 + p + 1 + len(iu))
        self.passes += 1
        h = np.zeros((len(raw), p + 1, p + 1))
        h[:, iu, ju] = h[:, ju, iu] = got[:, p + 2:]
        return got[:, 0], np.einsum("mji,mj->mi", t, got[:, 1:p + 2]), np.einsum("mji,mjk,mkl->mil", t, h, t)

    def _stationarity(self, which: np.ndarray, beta: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Largest violation of the optimality conditions per model, relative to the weight of its rows."""
        l1, l2 = self.l1[which][:, None], self.l2[which][:, None]
        s, b = g[:, 1:] + l2 * beta[:, 1:], beta[:, 1:]
        off = np.where(b != 0, np.abs(s + l1 * np.sign(b)), np.maximum(np.abs(s) - l1, 0.0))
        weight = np.maximum((self.class_n[which] * self.class_w[which]).sum(axis=1), 1e-300)
        return np.maximum(np.abs(g[:, 0]), off.max(axis=1, initial=0.0)) / weight

    def _value(self, which: np.ndarray, beta: np.ndarray, loss: np.ndarray) -> np.ndarray:
        b = beta[:, 1:]
        return loss + self.l2[which] / 2 * (b * b).sum(axis=1) + self.l1[which] * np.abs(b).sum(axis=1)

    def _goal(self, which: np.ndarray, beta: np.ndarray, g: np.ndarray, h: np.ndarray, sweeps: int = 500) -> np.ndarray:
        """Minimum of the quadratic model of the objective: a linear system without an L1 penalty, else coordinate descent."""
        ridge = np.diag(np.r_[0.0, np.ones(self.p)])[None] * self.l2[which][:, None, None]
        h = h + 1e-12 * np.einsum("mii->m", h)[:, None, None] / (self.p + 1) * np.eye(self.p + 1)[None]
        out = beta.copy()
        smooth = self.l1[which] == 0
        if smooth.any():
            grad = g[smooth] + np.einsum("mij,mj->mi", ridge[smooth], beta[smooth])
            out[smooth] -= np.linalg.solve(h[smooth] + ridge[smooth], grad[:, :, None])[:, :, 0]
        m = np.flatnonzero(~smooth)
        if len(m):
            b, hm, l1, l2 = out[m], h[m], self.l1[which][m], self.l2[which][m]
            slope = g[m].copy()  # gradient of the quadratic at b, without penalties
            for _ in range(sweeps):
                moved = 0.0
                for j in range(self.p + 1):
                    curve = np.maximum(hm[:, j, j], 1e-300)
                    pull = curve * b[:, j] - slope[:, j]
                    new = pull / curve if j == 0 else np.sign(pull) * np.maximum(np.abs(pull) - l1, 0.0) / (curve + l2)
                    d = new - b[:, j]
                    slope += hm[:, :, j] * d[:, None]
                    b[:, j] = new
                    moved = max(moved, float(np.abs(d).max()))
                if moved < 1e-13:
                    break
            out[m] = b
        return out

    def fit(self, tol: float = 1e-9, max_passes: int = 60) -> Models:
        """Newton steps for all models at once until each is stationary to ``tol``; a step that does not lower a model's objective is
        halved. Replicas start where the model of all rows once ended, which takes few sums. A model without rows of both classes
        keeps coefficients of zero and a residual of infinity."""
        live = np.flatnonzero((self.class_n > 0).all(axis=1))
        base = np.zeros_like(self.beta)
        if self.replicas > 1:
            cs, ratios = list(dict.fromkeys(self.c)), list(dict.fromkeys(self.l1_ratio))
            plain = Models(self.rows, 0, cs, ratios, self.balanced, self.seed).fit(tol, max_passes)
            at = {k: i for i, k in enumerate(zip(plain.set, plain.c, plain.l1_ratio))}
            base[live] = plain.beta[[at[k] for k in zip(self.set[live], self.c[live], self.l1_ratio[live])]]
        value, aim = np.full(len(base), np.inf), base.copy()
        t = np.ones(len(base))
        while len(live) and self.passes < max_passes:
            trial = base[live] + t[live][:, None] * (aim[live] - base[live])
            loss, g, h = self._sums(live, trial)
            now = self._value(live, trial, loss)
            better = now <= value[live] + 1e-10 * np.abs(now)
            t[live[~better]] /= 2
            ok = live[better]
            base[ok], value[ok], t[ok] = trial[better], now[better], 1.0
            self.residual[ok] = self._stationarity(ok, base[ok], g[better])
            aim[ok] = self._goal(ok, base[ok], g[better], h[better])
            live = np.array([m for m in live if self.residual[m] > tol and t[m] > 1e-6], np.int64)
        self.beta = base
        return self

    def coefficients(self) -> np.ndarray:
        """Models x (1 + columns): intercept and slopes for columns in their own units."""
        raw = np.einsum("mij,mj->mi", self._affine(np.arange(len(self.beta))), self.beta)
        slope = raw[:, 1:] / self.rows.spread
        return np.column_stack([raw[:, 0] - slope @ self.rows.center, slope])

    def medians(self) -> np.ndarray:
        """Fills for missing cells of every model, in units of the columns."""
        return (self.rows.median * self.rows.spread + self.rows.center)[self.set]

    def margin(self, m: int) -> Column:
        """Margin of model ``m`` for a frame with its columns."""
        coef, fill = self.coefficients()[m], self.medians()[m]
        terms = [F.coalesce(F.col(c), F.lit(float(f))) * float(b) for c, f, b in zip(self.rows.cols, fill, coef[1:]) if b != 0]
        return sum(terms, F.lit(float(coef[0])))

    def held_out(self, only: Sequence[str] | None = None) -> DataFrame:
        """(replica, c, l1_ratio, fold, key, y, w, score), or ``only`` some of these: every row under the models that did not see its
        fold; w is its count in the replica, rows drawn zero times are left out. Linear in rows x replicas x penalties."""
        rows, p, weights = self.rows, self.p, self._weights()
        raw = np.einsum("mij,mj->mi", self._affine(np.arange(len(self.beta))), self.beta)
        sets, reps, cs, ratios, held, median = self.set, self.replica, self.c, self.l1_ratio, rows.held, rows.median
        center, spread = rows.center, rows.spread
        kinds = {"replica": "int", "c": "double", "l1_ratio": "double", "fold": "int", "key": "bigint", "y": "int", "w": "double", "score": "double"}
        names = list(only or kinds)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key, y, fold = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                x = (np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3, 3 + p)]) - center) / spread
                for s in np.unique(sets):
                    at = np.flatnonzero(fold == held[s]) if held[s] >= 0 else np.arange(0)
                    m = np.flatnonzero(sets == s)
                    for a in range(0, len(at), 512):
                        i = at[a:a + 512]
                        score = np.column_stack([np.ones(len(i)), np.where(np.isnan(x[i]), median[s], x[i])]) @ raw[m].T
                        w = weights(key[i], np.maximum(reps[m], 0))
                        r, k = np.nonzero(w)
                        cells = {"replica": lambda: reps[m].astype(np.int32)[k], "c": lambda: cs[m][k], "l1_ratio": lambda: ratios[m][k],
                                 "fold": lambda: fold[i].astype(np.int32)[r], "key": lambda: key[i].astype(np.int64)[r],
                                 "y": lambda: y[i].astype(np.int32)[r], "w": lambda: w[r, k], "score": lambda: score[r, k]}
                        yield pa.RecordBatch.from_arrays([pa.array(cells[n]()) for n in names], names)

        return rows.df.mapInArrow(work, ", ".join(f"{n} {kinds[n]}" for n in names))


def weighted_aucs(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact AUC per key of rows (y, w, score), all keys in one job.

    Sums run inside blocks of scores; a block leaves one row, and earlier blocks count as a whole. So the counts are read once: the
    scores behind them are costly, and a join of rows with totals would compute them again for each side."""
    keys = list(keys)
    pos, neg = (F.when(F.col("y") == k, F.col("w")).otherwise(0.0) for k in (1, 0))
    counts = value_counts(scored, keys, "score", {"pos": pos, "neg": neg}).drop("_h")
    b = with_blocks(counts, keys, "score", rows=scored)
    inside = W.partitionBy(*keys, "_block").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("_below", F.coalesce(F.sum("neg").over(inside), F.lit(0.0)))
    b = b.groupBy(*keys, "_block").agg(F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("_won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # at most MAX_BLOCKS rows per key
    b = b.withColumn("_won", F.col("_won") + F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
    return b.groupBy(*keys).agg(F.try_divide(F.sum("_won"), F.sum("pos") * F.sum("neg")).alias("auc"))


# ---- resampled models -------------------------------------------------------------------------------------------------------------------

def bootstrap_model_auc(frame: DataFrame, cols: Sequence[str], replicas: int = 200, c: float = 1.0, seed: int = 42, fold: str = "fold", id_: str = "patient_id") -> tuple[DataFrame, Models]:
    """((replica, auc), models): AUC of cross-validated ridge models under resampling.

    Folds go by patient and a resampled row is a count, so no copy of a patient is on both sides; imputation, scale and class weights
    are those of the training rows of each (replica, fold). A replica without both classes has a null AUC.
    """
    models = Models(Rows(frame, cols, fold, id_=id_), replicas, (c,), seed=seed).fit()
    return weighted_aucs(models.held_out(["replica", "y", "w", "score"]), ["replica"]), models


def bootstrap_interval(aucs: DataFrame) -> DataFrame:
    return aucs.agg(F.avg("auc").alias("mean"), F.percentile("auc", 0.025).alias("lo"), F.percentile("auc", 0.975).alias("hi"), F.count("auc").alias("used"))


def bootstrap_optimism(frame: DataFrame, cols: Sequence[str], replicas: int = 200, threshold: float = 0.3, c: float = 1.0, seed: int = 42, id_: str = "patient_id") -> tuple[DataFrame, Models]:
    """((replica, slope_apparent, nb_apparent, slope_test, nb_test, slope_optimism, nb_optimism), models): performance of models
    refitted on resampled counts, on their own rows and on all rows: discrimination slope and net benefit at ``threshold``."""
    rows = Rows(frame, cols, None, whole=True, id_=id_)
    models = Models(rows, replicas, (c,), balanced=False, seed=seed).fit()
    raw = np.einsum("mij,mj->mi", models._affine(np.arange(replicas)), models.beta)
    weights, median, reps = models._weights(), rows.median[0], np.arange(replicas)

    def step(x, y, fold, key):
        prob = 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), np.where(np.isnan(x), median, x)]) @ raw.T, -700, 700)))
        pos, hit = (y == 1)[:, None], prob >= threshold
        out = []
        for w in (weights(key, reps), np.ones(prob.shape)):
            out += [(w * v).sum(axis=0) for v in (pos * prob, pos, ~pos * prob, ~pos, pos & hit, ~pos & hit)]
        return np.stack(out, axis=1)

    t = rows.tally(step, replicas, 12).reshape(replicas, 2, 6)
    ratio = lambda a, b: np.divide(a, b, out=np.full(a.shape, np.nan), where=b > 0)
    slope = ratio(t[:, :, 0], t[:, :, 1]) - ratio(t[:, :, 2], t[:, :, 3])
    benefit = ratio(t[:, :, 4] - t[:, :, 5] * threshold / (1 - threshold), t[:, :, 1] + t[:, :, 3])
    none = lambda v: None if math.isnan(v) else float(v)
    data = [(b, *[none(v) for v in (slope[b, 0], benefit[b, 0], slope[b, 1], benefit[b, 1], slope[b, 0] - slope[b, 1], benefit[b, 0] - benefit[b, 1])]) for b in range(replicas)]
    return frame.sparkSession.createDataFrame(data, "replica int, " + ", ".join(f"{k} double" for k in (
        "slope_apparent", "nb_apparent", "slope_test", "nb_test", "slope_optimism", "nb_optimism"))), models


# ---- penalty paths ----------------------------------------------------------------------------------------------------------------------

class Path:
    """Result of :func:`penalty_path`: ``table`` rows (c, l1_ratio, mean score, sd over folds), ``best`` grid position, ``kept``
    columns, and the models, of which ``final`` are those of all rows in grid order."""

    def __init__(self, models: Models, final: np.ndarray, table: list[tuple], best: int, kept: list[str]):
        self.models, self.final, self.table, self.best, self.kept = models, final, table, best, kept

    def scored(self, df: DataFrame) -> DataFrame:
        """Add score, proba and pred of the chosen model to rows with its columns."""
        d = df.withColumn("score", self.models.margin(int(self.final[self.best])))
        return d.withColumns({"proba": 1 / (1 + F.exp(-F.col("score"))), "pred": (F.col("score") > 0).cast("int")})


def penalty_path(frame: DataFrame, cols: Sequence[str], cs: Sequence[float], l1_ratios: Sequence[float] = (1.0,), scoring: str = "log_loss", one_se: bool = False,
                 fold: str = "fold", id_: str = "patient_id", view: View | None = None) -> Path:
    """L1 or elastic-net logistic regression tuned over ``fold``: every fold, penalty and mixture is fitted in the same passes.

    ``scoring`` is log_loss (negated mean) or auc of the held-out rows, averaged over folds. ``one_se`` takes the strongest penalty
    whose mean is within one standard error of the best. Kept: |coefficient| > 1e-7, or the three largest. A frame with
    a ``view`` is read in shared passes.
    """
    models = Models(Rows(frame, cols, fold, whole=True, id_=id_, view=view), 0, cs, l1_ratios).fit(1e-8, 30)
    grid = [(c, r) for c in cs for r in l1_ratios]
    scored = models.held_out()
    by = ["fold", "c", "l1_ratio"]
    if scoring == "auc":
        got = weighted_aucs(scored, by).withColumnRenamed("auc", "s")
    else:
        loss = F.when(F.col("y") == 1, -F.col("score")).otherwise(F.col("score"))
        got = scored.groupBy(*by).agg((-F.avg(F.greatest(loss, F.lit(0.0)) + F.log1p(F.exp(-F.abs(loss))))).alias("s"))
    cells: dict[tuple, list[float]] = {}
    for r in got.collect():
        if r["s"] is not None:
            cells.setdefault((r["c"], r["l1_ratio"]), []).append(r["s"])
    avg = [float(np.mean(cells[g])) if g in cells else -math.inf for g in grid]
    sd = [float(np.std(cells[g], ddof=1)) if len(cells.get(g, ())) > 1 else 0.0 for g in grid]
    best = int(np.argmax(avg))
    if one_se:
        near = [i for i in range(len(grid)) if avg[i] >= avg[best] - sd[best] / math.sqrt(max(len(models.rows.folds), 1))]
        best = min(near, key=lambda i: (grid[i][0], -grid[i][1]))
    final = np.flatnonzero(models.set == models.rows.held.index(-1))
    coef = np.abs(models.beta[final[best], 1:])
    kept = [i for i, v in enumerate(coef) if v > 1e-7] or sorted(np.argsort(-coef, kind="stable")[:3].tolist())
    return Path(models, final, [(c, r, a, s) for (c, r), a, s in zip(grid, avg, sd)], best, [models.rows.cols[i] for i in kept])
