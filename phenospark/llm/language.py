"""Language identification by rank-order n-gram profiles.

Words are padded with a blank; n-grams of one to three characters are counted. A profile lists the most frequent n-grams
of a language by rank; a document gets the language whose ranks are least out of place against its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phenospark.llm.common import held_out

PROFILE = 300
STEP = 2 << 20
SCHEMA = "lang_pred string, score double"
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """True at the code points of letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a lower-cased text as integers (21 bits a character), ascending, and their counts. Very long
    texts are counted piece by piece, with two characters of overlap."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    cp = np.where(letters[cp], cp, np.uint32(32))
    if len(cp):
        keep = np.ones(len(cp), bool)
        keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
        cp = cp[keep]
    cp = np.concatenate(([32], cp if len(cp) and cp[0] != 32 else cp[1:], [32] if len(cp) and cp[-1] != 32 else [])).astype(np.uint64)
    grams, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, len(cp), STEP):
        c = cp[at: at + STEP + 2]
        n = min(STEP, len(c))
        two = (c[:-1] << np.uint64(21)) | c[1:]
        three = (two[:-1] << np.uint64(21)) | c[2:]
        own = np.concatenate([c[:n][c[:n] != 32], two[:n], three[:n][c[1:-1][:n] != 32]])
        own.sort()
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
        more = np.diff(np.append(first, len(own)))
        if len(grams):
            grams, back = np.unique(np.concatenate([grams, own[first]]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, more])).astype(np.int64)
        else:
            grams, counts = own[first], more
    return grams, counts


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties to the smaller n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def profiles(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of each language over all rows that are not held out and name a language.

    Tasks add up their own batches, Spark adds up the tasks, and a rank limit runs before the rows of a language meet, so
    the driver gets ``size`` rows per language.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for b in batches:
            for lang, rows in b.groupby("lang", sort=True):
                bag: list[tuple[np.ndarray, np.ndarray]] = []
                held = 0
                for t in rows["text"]:
                    bag.append(gram_counts(t, letters))
                    held += len(bag[-1][0])
                    if held > 1 << 20:
                        bag = [_merge(bag)]
                        held = 0
                g, n = _merge(bag)
                yield pd.DataFrame({"lang": lang, "gram": g.astype(np.int64), "n": n})

    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = known.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = total.withColumn("_r", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order))).where(F.col("_r") <= size)
    top = part.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("r") <= size)
    out: dict[str, list] = {}
    for r in top.select("lang", "gram", "r").collect():
        out.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {k: np.array([g for _, g in sorted(v)], np.uint64) for k, v in sorted(out.items())}


def _merge(bag: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not bag:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g, back = np.unique(np.concatenate([x for x, _ in bag]), return_inverse=True)
    return g, np.bincount(back, np.concatenate([n for _, n in bag]), minlength=len(g)).astype(np.int64)


def rank_matrix(model: dict[str, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the profiles, ascending, and the rank of each in each language (``size`` where absent), with one
    more column for n-grams of no profile."""
    grams = np.unique(np.concatenate(list(model.values())))
    place = np.full((len(model), len(grams) + 1), size, np.int64)
    for i, p in enumerate(model.values()):
        place[i, np.searchsorted(grams, p)] = np.arange(len(p))
    return grams, place


def scorer(spark, model: dict[str, np.ndarray], text: Column | str = "text", size: int = PROFILE) -> Column:
    """Column with the nearest language (ties to the smaller name) and a score, one minus its distance over the largest
    possible. Texts that are null or have no letter, and every text when no profile was learned, give ``und`` and 0."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, letters = held.value, letter_table()
        names = list(m)
        grams, place = rank_matrix(m, size) if m else (None, None)
        for texts in batches:
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, t in enumerate(texts):
                own, counts = gram_counts(t, letters)
                if not len(own) or not names:
                    continue
                top = ranked(own, counts, size)
                at = np.searchsorted(grams, top)
                at = np.where((at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == top), at, len(grams))
                far = place[:, at]
                dist = np.where(far == size, size, np.abs(far - np.arange(len(top)))).sum(axis=1)
                best = int(np.argmin(dist))
                lang[i], score[i] = names[best], 1 - dist[best] / (size * len(top))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predict(F.col(text) if isinstance(text, str) else text)
