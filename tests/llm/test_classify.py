"""Quality, toxicity and language: held-out accuracy, the vote against brute force, hard rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from phenospark.llm import language, quality, toxicity
from phenospark.llm.common import held_out, labelled_sample, pieces
from tests.llm.helpers import empty, hard, labels, words


def corpus(spark, n=240):
    rng, rows, lab = random.Random(3), [], []
    for i in range(n):
        bad, rude = i % 4 == 0, i % 3 == 0
        text = ". ".join(words(rng, 12) for _ in range(6))
        if rude:
            text += ". you " + rng.choice(["zzgrok", "zzgrum"]) + " " + words(rng, 4) + "."
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text))
        lab.append((i, 0 if bad else 1, int(rude)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), labels(spark, lab)


def test_held_out(spark):
    ids = [0, 1, 7, 123456789, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select(held_out()).collect()]
    assert got == [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


def test_sample_never_sees_held_out_labels(spark):
    docs, lab = corpus(spark)
    s, sizes = labelled_sample(docs, lab, "quality", 20)
    got = s.collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in got)
    assert len(got) == 40 and sum(sizes.values()) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(240))


def test_quality_on_held_out_documents(spark):
    docs, lab = corpus(spark)
    p = docs.join(lab, "doc_id").where(held_out()).select("quality", quality.scorer(spark, quality.fit(docs, lab)).alias("s")).toPandas()
    assert ((p.s >= 0.5).astype(int) == p.quality).mean() > 0.95


def test_vote_matches_brute_force():
    rng = np.random.default_rng(0)
    m = {"proj": rng.normal(size=(quality.TERMS, 5)).astype(np.float32), "prior": 0.3, "y": rng.integers(0, 2, 50).astype(np.float32), "weight": rng.random(50).astype(np.float32)}
    v = rng.normal(size=(50, 5))
    m["vectors"] = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    x = rng.random((9, quality.TERMS)).astype(np.float32)
    got = quality.vote(x, m, 7, 4.0)
    for i in range(9):
        z = x[i] @ m["proj"]
        sims = [float(z @ b / np.linalg.norm(z)) for b in m["vectors"]]
        near = sorted(range(50), key=lambda j: -sims[j])[:7]
        w = [max(sims[j], 0) ** 4 * m["weight"][j] for j in near]
        assert abs(got[i] - sum(a * m["y"][j] for a, j in zip(w, near)) / sum(w)) < 1e-4


def test_toxic_sentences_are_found(spark):
    docs, lab = corpus(spark)
    low = docs.withColumn("text", F.lower("text"))
    m = toxicity.train(low, lab, min_bags=3)
    p = low.join(lab, "doc_id").select("text", "toxic", toxicity.scorer(spark, m).alias("r"), held_out().alias("h")).toPandas()
    h = p[p.h]
    assert ((h.r.apply(lambda r: r["score"]) >= 0.3).astype(int) == h.toxic).mean() > 0.9
    hit = [(r.text[s["start"]:s["end"]], r.toxic) for r in p.itertuples() for s in r.r["offending"]]
    assert hit and np.mean(["zzgr" in t for t, _ in hit]) > 0.9


def test_spans_are_code_points_across_pieces(spark):
    m = {"w": np.zeros(1 << toxicity.BITS, np.float32), "b": -9.0}
    buf, starts, ends, piece, sent, feat = toxicity.sentence_terms([(0, 0, "zzgrok".encode())], toxicity.Roller())
    m["w"][feat] = 20
    long = "é é. " * 900_000 + "漢 zzgrok. b"
    r = spark.createDataFrame([(long,)], "text string").select(toxicity.scorer(spark, m).alias("r")).first().r
    assert r["n_offending"] == 1 and long[r["offending"][0]["start"]:r["offending"][0]["end"]] == "漢 zzgrok"


def test_pieces_lose_nothing():
    for t in ("é" * 1000, "ab c. d\n" * 200, "", "漢" * 333):
        raw = t.encode()
        got = list(pieces(raw, 64))
        assert b"".join(got) == raw and all(len(p) <= 64 for p in got)
        assert "".join(p.decode() for p in got) == t


def brute_language(text, prof):
    pad = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    n = {}
    for k in (1, 2, 3):
        for i in range(len(pad) - k + 1):
            g = pad[i:i + k]
            if g.strip() and not (k == 3 and g[1] == " "):
                n[g] = n.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * j for j, c in enumerate(reversed(g)))
    top = sorted(n, key=lambda g: (-n[g], code(g)))[:language.PROFILE]
    if not top:
        return "und", 0.0
    best = None
    for lang in sorted(prof):
        rank = {int(g): i for i, g in enumerate(prof[lang])}
        d = sum(abs(rank[code(g)] - i) if code(g) in rank else language.PROFILE for i, g in enumerate(top))
        if best is None or d < best[1]:
            best = lang, d
    return best[0], 1 - best[1] / (language.PROFILE * len(top))


def test_language_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, 40, "abcde" if i % 2 else "xyzäö"), "aa" if i % 2 else "zz") for i in range(60)]
    docs = spark.createDataFrame(rows + [(60, None, "aa"), (61, "123 !", "zz"), (62, "abc", None)], "doc_id bigint, text string, lang string")
    prof = language.profiles(docs)
    got = docs.select("text", "lang", language.scorer(spark, prof).alias("r")).collect()
    for r in got:
        want = brute_language(r.text or "", prof)
        assert r.r["lang_pred"] == want[0] and abs(r.r["score"] - want[1]) < 1e-12
    assert all(r.r["lang_pred"] == r.lang for r in got[:60])


def test_long_texts_count_the_same(monkeypatch):
    letters = language.letter_table()
    t = words(random.Random(1), 500)
    want = language.gram_counts(t, letters)
    monkeypatch.setattr(language, "STEP", 97)
    got = language.gram_counts(t, letters)
    assert all((a == b).all() for a, b in zip(want, got))


def test_hard_rows_and_empty_tables(spark):
    none = labels(spark, [])
    lab = labels(spark, [(i, i % 2, i % 2) for i in range(0, 30)] + [(3, 0, 1), (None, 1, 1), (5, None, None)])
    for docs in (hard(spark), empty(spark)):
        n = docs.count()
        for y in (none, lab):
            q = docs.select(quality.scorer(spark, quality.fit(docs, y)).alias("s")).toPandas()
            t = docs.select(toxicity.scorer(spark, toxicity.train(docs, y)).alias("s")).toPandas()
            assert len(q) == len(t) == n and q.s.between(0, 1).all() and all(0 <= r["score"] <= 1 for r in t.s)
        r = docs.select("text", language.scorer(spark, language.profiles(docs)).alias("r")).collect()
        assert len(r) == n and all(x.r["lang_pred"] == "und" for x in r if not any(c.isalpha() for c in x.text or ""))
