"""Document quality by nearest-neighbour voting in a latent-semantic space.

Terms of a document are its hashed words, hashed trigrams of character classes and a few binned style terms (share of
repeated words, of capitals, of marks, length of words and lines). Damped term counts times inverse document frequency
are projected on the leading singular directions of a bounded labelled sample. The labelled vectors are broadcast; every
document takes exact cosine products with all of them, block by block, and its nearest neighbours vote with weights that
grow with similarity and undo the sampling of the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import Roller, groups, labelled_sample, lower_bytes, runs_of

WORDS, SHAPES, BINS = 2048, 1024, 10
STYLES = 8
TERMS = WORDS + SHAPES + STYLES * BINS
STYLE_WEIGHT = 3.0
SCHEMA = "score double"

# classes of bytes: letters (small, capital), digits, blank, line end, any other mark by itself
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[range(65, 91)] = 2
_CLASS[range(48, 58)] = 3


def term_counts(group: list[tuple[int, int, bytes]], roll: Roller) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the hashed terms, (pieces, WORDS + SHAPES), and the sums behind the style terms, (pieces, 8)."""
    raw = b"\n".join(p for _, _, p in group) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    n = len(group)
    lens = np.array([len(p) + 1 for _, _, p in group])
    piece = np.repeat(np.arange(n), lens)
    low = lower_bytes(buf)
    s, e = runs_of((buf != 32) & ~((buf >= 9) & (buf <= 13)))
    h, of = roll(low, s, e), piece[s]
    counts = np.zeros((n, WORDS + SHAPES))
    counts[:, :WORDS] = np.bincount(of * WORDS + (h >> np.uint64(53)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    c = _CLASS[buf]
    if len(c) >= 3:
        tri = ((c[:-2] * np.uint64(65536) + c[1:-1] * np.uint64(256) + c[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
        counts[:, WORDS:] = np.bincount(piece[:-2] * SHAPES + tri, minlength=n * SHAPES).reshape(n, SHAPES)
    order = np.lexsort((h, of))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    letters, capital = c == 1, c == 2
    sums = np.stack([
        np.bincount(of, minlength=n), np.bincount(of[order], first, minlength=n), np.bincount(of, same, minlength=n),
        np.bincount(piece, letters, minlength=n), np.bincount(piece, capital, minlength=n),
        np.bincount(piece, c == 3, minlength=n), np.bincount(piece, (c > 3) & (c != 32) & (c != 10), minlength=n),
        np.bincount(piece, buf == 10, minlength=n)], axis=1).astype(float)
    return counts, sums


def weighted(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Damped counts, each family of terms at unit length, with the style terms appended."""
    x = np.zeros((len(counts), TERMS), np.float32)
    for a, b in ((0, WORDS), (WORDS, WORDS + SHAPES)):
        part = np.log1p(counts[:, a:b])
        x[:, a:b] = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    words, kinds, twins, small, capital, digit, mark, lines = sums.T
    some, chars = np.maximum(words, 1), np.maximum(small + capital + digit + mark, 1)
    style = np.stack([
        1 - kinds / some, twins / some, capital / chars, mark / chars, digit / chars, chars / some / 16,
        np.log2(1 + words) / 14, words / np.maximum(lines, 1) / 80], axis=1)
    place = np.clip(style, 0, 0.9999) * (BINS - 1)
    cell = place.astype(int)
    rows, off = np.arange(len(x))[:, None], WORDS + SHAPES + np.arange(STYLES)[None] * BINS
    scale = STYLE_WEIGHT / np.sqrt(STYLES)
    x[rows, off + cell] = scale * (1 - (place - cell))
    x[rows, off + cell + 1] = scale * (place - cell)
    return x


def documents_terms(texts: pd.Series, roll: Roller) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, term vectors) for bounded sets of rows. Pieces of a very long text are summed; repeats of words are counted
    within pieces."""
    carry: tuple[int, np.ndarray, np.ndarray] | None = None
    for g in groups(texts):
        counts, sums = term_counts(g, roll)
        rows, first = np.unique([i for i, _, _ in g], return_index=True)
        counts, sums = np.add.reduceat(counts, first), np.add.reduceat(sums, first)
        if carry is not None:
            if carry[0] == rows[0]:
                counts[0] += carry[1]
                sums[0] += carry[2]
            else:
                yield np.array([carry[0]]), weighted(carry[1][None], carry[2][None])
        carry = (int(rows[-1]), counts[-1].copy(), sums[-1].copy())
        if len(rows) > 1:
            yield rows[:-1], weighted(counts[:-1], sums[:-1])
    if carry is not None:
        yield np.array([carry[0]]), weighted(carry[1][None], carry[2][None])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000, rank: int = 64, id_col: str = "doc_id",
        text_col: str = "text") -> dict:
    """Projection and labelled vectors from at most ``2 * per_class`` labelled documents (the bound of the fit, about
    80 MB of half-precision term vectors on the driver). Without a labelled document the model has no vectors."""
    sample, sizes = labelled_sample(docs, labels, label, per_class, id_col, text_col)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Roller()
        for b in batches:
            for rows, x in documents_terms(b["text"], roll):
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[rows], "y": b["y"].to_numpy()[rows], "x": [v.astype("<f2").tobytes() for v in x]})

    got = sorted(sample.mapInPandas(extract, "doc_id bigint, y int, x binary").collect(), key=lambda r: (r["doc_id"], r["x"]))
    if not got:
        return {"prior": 0.5, "vectors": None}
    x = np.stack([np.frombuffer(r["x"], "<f2") for r in got]).astype(np.float32)
    y = np.array([r["y"] for r in got])
    del got
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32)
    idf[WORDS + SHAPES:] = 1
    x *= idf
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((TERMS, min(rank + 16, len(x)))).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    small = x @ q
    _, _, vt = np.linalg.svd(small.T @ small)
    proj = (idf[:, None] * (q @ vt.T[:, :rank])).astype(np.float32)
    z = x @ (q @ vt.T[:, :rank])
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    share = {k: sizes[k] / max(1, int((y == k).sum())) for k in sizes}
    total = sum(sizes.values())
    return {"prior": sizes.get(1, 0) / total, "proj": proj, "vectors": z.astype(np.float32), "y": y.astype(np.float32),
            "weight": np.array([share[int(k)] for k in y], np.float32)}


def vote(x: np.ndarray, model: dict, neighbours: int, power: float) -> np.ndarray:
    """Exact cosines with every labelled vector, the nearest ``neighbours`` vote with weight cosine ** power."""
    z = x @ model["proj"]
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    sim = (z / np.maximum(norm, 1e-9)) @ model["vectors"].T
    k = min(neighbours, sim.shape[1])
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(sim, near, 1), 0) ** power * model["weight"][near]
    total = w.sum(axis=1)
    return np.where(total > 0, (w * model["y"][near]).sum(axis=1) / np.maximum(total, 1e-12), model["prior"])


def scorer(spark, model: dict, text: Column | str = "text", neighbours: int = 15, power: float = 8.0) -> Column:
    """Column with the score of each text, 0 to 1. A null text is an empty one; an empty text is scored by its style
    terms like any other. Without labelled vectors the score is 0.5."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, roll = held.value, Roller()
        for texts in batches:
            out = np.full(len(texts), 0.5)
            if m["vectors"] is not None:
                for rows, x in documents_terms(texts, roll):
                    out[rows] = vote(x, m, neighbours, power)
            yield pd.Series(np.clip(out, 0, 1))

    return score(F.col(text) if isinstance(text, str) else text)
