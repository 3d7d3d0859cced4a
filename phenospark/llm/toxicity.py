"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has probability ``p = sigmoid(b + sum of the weights of its words and word
heads)``; the document's is the noisy-or ``1 - prod(1 - p)``. The weights are trained from document labels alone, so the
sentences that explain a positive label get the blame, and scoring returns where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import Roller, groups, labelled_sample, lower_bytes, runs_of

BITS = 20
HEADS = (4, 5)
CHUNK = 1 << 21
SCHEMA = "score double, n_offending bigint, offending array<struct<start:bigint,end:bigint,score:double>>"

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def sentence_terms(group: list[tuple[int, int, bytes]], roll: Roller):
    """Of a group of pieces: the joined bytes, sentence starts and ends, the piece of each sentence, and for each term
    its sentence and hashed feature. Only sentences with a word are kept."""
    raw = b"\n".join(p for _, _, p in group) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    low = lower_bytes(buf)
    word_s, word_e = runs_of(_WORD[low])
    stop = np.flatnonzero(_STOP[low])
    sent = np.searchsorted(stop, word_s)
    used, sent = np.unique(sent, return_inverse=True)
    ends = stop[used]
    first = np.searchsorted(sent, np.arange(len(used)))
    starts = word_s[first] if len(used) else ends
    lens = np.array([len(p) + 1 for _, _, p in group])
    piece = np.searchsorted(np.cumsum(lens), starts, side="right")
    shift = np.uint64(64 - BITS)
    whole = (roll(low, word_s, word_e) >> shift).astype(np.int64)
    of, feat = [sent], [whole]
    for k in HEADS:
        long = word_e - word_s > k
        of.append(sent[long])
        feat.append((roll(low, word_s[long], word_s[long] + k) * np.uint64(0x94D049BB133111EB + 2 * k) >> shift).astype(np.int64))
    return buf, starts, ends, piece, np.concatenate(of), np.concatenate(feat)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000, epochs: int = 60, l1: float = 2e-4,
          min_bags: int = 5, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Weights from at most ``2 * per_class`` labelled documents (the bound of the fit), by full-batch Adam on the
    noisy-or likelihood with an L1 penalty; documents of a class together count by its true share, and terms of fewer than
    ``min_bags`` sampled documents get no weight. Spark extracts the hashed terms; the driver only holds those of the
    bounded sample. Unless both labels occur every weight is zero."""
    sample, sizes = labelled_sample(docs, labels, label, per_class, id_col, text_col)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Roller()
        for b in batches:
            for g in groups(b["text"]):
                _, starts, _, piece, sent, feat = sentence_terms(g, roll)
                key = np.unique(sent.astype(np.int64) << BITS | feat)
                of, rows = piece[key >> BITS] if len(key) else np.zeros(0, int), []
                for j, (i, at, _) in enumerate(g):
                    mine = key[of == j]
                    s = (mine >> BITS) - (mine[0] >> BITS) if len(mine) else mine
                    rows.append((int(b["doc_id"].iloc[i]), at, int(b["y"].iloc[i]), s.astype("<i4").tobytes(), (mine & ((1 << BITS) - 1)).astype("<i4").tobytes()))
                yield pd.DataFrame(rows, columns=["doc_id", "at", "y", "sent", "feat"])

    rows = sorted(sample.mapInPandas(extract, "doc_id bigint, at bigint, y int, sent binary, feat binary").collect(), key=lambda r: (r["doc_id"], r["at"]))
    w, b = np.zeros(1 << BITS, np.float32), -8.0
    if not rows or len(sizes) < 2:
        return {"w": w, "b": float(b)}
    # documents that hold a term, then only the terms that are common enough, in 32 bits
    held = np.zeros(1 << BITS, np.int32)
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end]["doc_id"] == rows[at]["doc_id"]:
            end += 1
        held[np.unique(np.concatenate([np.frombuffer(r["feat"], "<i4") for r in rows[at:end]]))] += 1
        at = end
    known = held >= min_bags
    used = np.flatnonzero(known)
    place = (np.cumsum(known) - 1).astype(np.int32)
    sent, col, bag, y, n_sent, last = [], [], [], [], 0, None
    for i, r in enumerate(rows):
        if r["doc_id"] != last:
            last = r["doc_id"]
            y.append(r["y"])
        s, f = np.frombuffer(r["sent"], "<i4"), np.frombuffer(r["feat"], "<i4")
        rows[i] = None
        if len(s):
            ok = known[f]
            sent.append(s[ok] + np.int32(n_sent))
            col.append(place[f[ok]])
            bag.append(np.full(int(s.max()) + 1, len(y) - 1))
            n_sent += int(s.max()) + 1
    if not sent:
        return {"w": w, "b": float(b)}
    sent, col, bag, y = np.concatenate(sent), np.concatenate(col), np.concatenate(bag).astype(np.int64), np.array(y, float)
    cuts = range(0, len(sent), CHUNK)
    share = np.array([sizes[0], sizes[1]]) / np.maximum(np.bincount(y.astype(int), minlength=2), 1)
    weight = share[y.astype(int)] / share[y.astype(int)].sum()
    v, m, s2, mb, sb = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.full(n_sent, b)
        for c in cuts:
            z += np.bincount(sent[c: c + CHUNK], v[col[c: c + CHUNK]], minlength=n_sent)
        miss = np.bincount(bag, _softplus(z), minlength=len(y))
        # d loss / d miss: 1 for a negative bag, -exp(-miss) / (1 - exp(-miss)) for a positive one
        g_miss = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(miss, 700)), 1e-4), 1.0) * weight
        g_z = g_miss[bag] / (1 + np.exp(-z))
        g, gb = np.zeros(len(used)), g_z.sum()
        for c in cuts:
            g += np.bincount(col[c: c + CHUNK], g_z[sent[c: c + CHUNK]], minlength=len(used))
        g = np.where(v != 0, g + l1 * np.sign(v), np.sign(g) * np.maximum(np.abs(g) - l1, 0))
        m, s2, mb, sb = 0.9 * m + 0.1 * g, 0.98 * s2 + 0.02 * g * g, 0.9 * mb + 0.1 * gb, 0.98 * sb + 0.02 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.98**t
        step = v - 0.3 * (m / c1) / (np.sqrt(s2 / c2) + 1e-8)
        v = np.where((v != 0) & (step * v < 0), 0, step)  # a weight that crosses zero stops there
        b = b - 0.1 * (mb / c1) / (np.sqrt(sb / c2) + 1e-8)
    w[used] = v
    return {"w": w, "b": float(b)}


def scorer(spark, model: dict, text: Column | str = "text", offending: float = 0.3) -> Column:
    """Column with the document score, and start, end (code points, end exclusive) and score of each sentence that
    reaches ``offending``. Null and empty texts, and texts without a word, score 0 and have no sentence."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        roll, w, b = Roller(), held.value["w"], held.value["b"]
        for texts in batches:
            miss, found, chars = np.zeros(len(texts)), [[] for _ in range(len(texts))], {}
            for g in groups(texts):
                buf, starts, ends, piece, sent, feat = sentence_terms(g, roll)
                key = np.unique(sent.astype(np.int64) << BITS | feat)
                z = b + np.bincount(key >> BITS, w[key & ((1 << BITS) - 1)], minlength=len(starts))
                per = np.bincount(piece, _softplus(z), minlength=len(g))
                p = 1 / (1 + np.exp(-z))
                lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                at = np.concatenate(([0], np.cumsum([len(x) + 1 for _, _, x in g])))
                for s in np.flatnonzero(p >= offending):
                    i, base = g[piece[s]][0], lead[at[piece[s]]]
                    before = chars.get(i, 0) if g[piece[s]][1] else 0
                    found[i].append((int(before + lead[starts[s]] - base), int(before + lead[ends[s]] - base), float(p[s])))
                for j, (i, _, x) in enumerate(g):
                    miss[i] += per[j]
                    chars[i] = chars.get(i, 0) + int(lead[at[j] + len(x)] - lead[at[j]])
            yield pd.DataFrame({"score": -np.expm1(-miss), "n_offending": [len(x) for x in found], "offending": found})

    return score(F.col(text) if isinstance(text, str) else text)
