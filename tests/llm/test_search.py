"""SimHash and the multi-index against brute force."""

import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from phenospark.llm import multiindex, simhash
from tests.llm.helpers import empty, hard, hard_rows, words


def brute_fingerprint(text, width=4):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints(monkeypatch):
    texts = [r[1] for r in hard_rows()] + ["A b\tC\x0bd e", "a b c", "É a b c d", "a  b   c d"]
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint_of(t) for t in texts] == want
    from phenospark.llm import common
    monkeypatch.setattr(simhash, "pieces", lambda raw: common.pieces(raw, 50))
    assert [simhash.fingerprint_of(t) for t in texts[:30] + texts[-4:]] == want[:30] + want[-4:]


def fps(spark, values):
    return spark.createDataFrame([(int(np.array(v, np.uint64).astype(np.int64)),) for v in values], "fp bigint")


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    rng = random.Random(1)
    for slot, cut in ((simhash.SLOT, simhash.SLICE), (20, 3000)):
        monkeypatch.setattr(simhash, "SLOT", slot)
        monkeypatch.setattr(simhash, "SLICE", cut)
        base = [rng.getrandbits(64) for _ in range(12)]
        v = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(12)} | {0, 1, 2**64 - 1})
        want = roots(len(v), [(i, j) for i, j in itertools.combinations(range(len(v)), 2) if bin(v[i] ^ v[j]).count("1") <= 4])
        at = {x: i for i, x in enumerate(v)}
        got = simhash.links(fps(spark, v), 4).collect()
        pairs = [(at[r.u & 2**64 - 1], at[r.v & 2**64 - 1]) for r in got]
        assert all(bin(v[a] ^ v[b]).count("1") <= 4 for a, b in pairs)
        assert roots(len(v), pairs) == want


def test_components_on_hard_rows(spark):
    rows = hard_rows()
    got = simhash.components(hard(spark)).collect()
    assert len(got) == len(rows)
    fp = {r[0]: brute_fingerprint(r[1]) for r in rows if r[0] is not None}
    ids = sorted(fp)
    root = roots(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if bin(fp[ids[a]] ^ fp[ids[b]]).count("1") <= 4])
    want = {d: ids[root[i]] for i, d in enumerate(ids)}
    for r in got:
        if r.doc_id is not None:
            assert r.fp & 2**64 - 1 == fp[r.doc_id] and r.component_id == want[r.doc_id]
    assert simhash.components(empty(spark)).count() == 0


def test_one_of_each_group(spark):
    rng = random.Random(9)
    rows = hard_rows()
    near = rows[1][1].split()
    long = words(rng, 200).split()
    edited = list(long)
    edited[90] = "other"
    rows += [(100, " ".join(long), *[None] * 7), (101, " ".join(edited), *[None] * 7), (102, " ".join(near[: len(near) // 2]), *[None] * 7)]
    docs = spark.createDataFrame(rows, hard(spark).schema)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [shingles(r[1]) for r in rows]
    root = roots(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
                             if (rows[a][1] or "") == (rows[b][1] or "") or len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])])
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i][0])
    want = sorted(min((x for x in g if x is not None), default=-1) for g in groups.values())
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == want
    assert 101 not in want and 100 in want and 102 in want
    assert simhash.one_of_each(empty(spark)).count() == 0


def jaccard(a, b):
    s, t = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(s & t) / len(s | t)


def test_near_copies_over_a_closed_vocabulary(spark):
    """All texts have the same word set, so they share one star whose head is no near copy of most."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(10)]
    texts = []
    for _ in range(6):
        t = vocabulary * 8
        rng.shuffle(t)
        near = list(t)
        near[40], near[41] = near[41], near[40]
        far = near[:70] + rng.sample(near[70:], 10)
        texts += [" ".join(t), " ".join(near), " ".join(far)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    root = roots(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8])
    assert 6 <= len(set(root)) < 15
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(root))


def test_near_links_on_given_documents(spark):
    """By brute force over shared shingles: no text goes without a near copy, and each pair at 0.9 or more is one group. Between 0.8
    and 0.9 the word fingerprints miss some pairs (README)."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets, at = {}, {}
    for r in rows:
        w = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in sets[r.doc_id]:
            at.setdefault(x, []).append(r.doc_id)
    met = {p for ds in at.values() if len(ds) > 1 for p in itertools.combinations(ds, 2)}
    ids = [r.doc_id for r in rows]
    spot = {d: i for i, d in enumerate(ids)}
    blank = [d for d in ids if not sets[d]]

    def left(similarity):
        pairs = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
        return {ids[i] for i in roots(len(ids), [(spot[a], spot[b]) for a, b in [*pairs, *zip(blank, blank[1:])]])}

    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert left(0.8) <= got <= left(0.9) and len(left(0.9)) < len(ids)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id bigint, embedding array<float>")


def brute(x, ids, q, top):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:top]


def test_search_over_all_cells_is_exact(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 40)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:200] = x[50]  # one very common vector
    ids = np.arange(400)
    u = multiindex.usable(vectors(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)]))
    got = {}
    for r in multiindex.search(u, u.where("id % 50 = 0"), top=10, share=1.0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 400, 50):
        assert [(i, s) for _, i, s in sorted(got[q])] == brute(x.astype(float), ids, q, 10)


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = multiindex.usable(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    got = {}
    for r in multiindex.search(u, u.where("id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = [len(got[q] & {i for i, _ in brute(x.astype(float), np.arange(3000), q, 10)}) for q in range(0, 3000, 100)]
    assert np.mean(hit) / 10 >= 0.9


def test_cells_are_walked_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b, n = rng.random(6), rng.random(7), rng.integers(0, 3, 42)
    order = [c for c in sorted(range(42), key=lambda c: a[c // 7] + b[c % 7]) if n[c]]
    assert multiindex.walk(a, b, n, 10**9) == order
    some = multiindex.walk(a, b, n, 9)
    assert some == order[: len(some)] and n[some].sum() >= 9 > n[some[:-1]].sum()


def test_vectors_that_take_no_part(spark):
    bad = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (None, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0])]
    u = multiindex.usable(vectors(spark, bad))
    assert sorted(r.id for r in u.collect()) == [0, 1, 100, 100]
    got = multiindex.search(u, u.where("id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 100), (0, 2, 100), (0, 3, 1), (100, 1, 0), (100, 2, 1)]
    none = multiindex.usable(vectors(spark, []))
    assert multiindex.search(none, none).count() == 0
    assert u.where(F.lit(False)).count() == 0


def brute_groups(rows, similarity=0.8):
    """Smallest ids by all pairs of texts that share a shingle."""
    sets, at = {}, {}
    for d, text in rows:
        w = (text or "").lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in sets[d]:
            at.setdefault(x, []).append(d)
    pairs = {p for ds in at.values() if len(ds) > 1 for p in itertools.combinations(ds, 2)}
    pairs = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    blank = [d for d in sets if not sets[d]]
    ids = [d for d, _ in rows]
    spot = {d: i for i, d in enumerate(ids)}
    return {ids[i] for i in roots(len(ids), [(spot[a], spot[b]) for a, b in [*pairs, *zip(blank, blank[1:])]])}


def test_every_link_at_the_threshold(spark):
    """Two pairs of these documents between 0.8 and 0.84 have fingerprints too far apart; they are links all the same."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_groups(rows)


def test_every_link_under_common_shingles(spark, monkeypatch):
    """Texts of a shared passage and own words: most prefixes hold shingles of all texts, chains link ends that are dissimilar."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(60):
        own = [f"t{i}_{j}" for j in range(rng.choice((3, 8, 12, 30)))]
        rows.append((len(rows), " ".join(passage + own)))
        for _ in range(rng.randrange(3)):
            own = own[:-1] + [f"c{len(rows)}"]
            rows.append((len(rows), " ".join(passage[: rng.choice((36, 40))] + own)))
    rows += [(len(rows) + k, t) for k, t in enumerate(("", " ", "\n ", None, "one", "One", "two"))]
    want = brute_groups(rows)
    assert 10 < len(want) < len(rows) - 20
    for common in (32, 3):
        monkeypatch.setattr(simhash, "COMMON", common)
        got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got == want


def test_sketches_bound_the_difference(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n, new in ((0, 0), (3, 1), (50, 5), (500, 60), (500, 400), (90000, 4000)):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        b = np.concatenate([a[new:], np.unique(rng.integers(-(2**63), 2**63 - 1, new))])
        rows.append((a.tolist(), b.tolist(), len(set(a.tolist()) ^ set(b.tolist()))))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, n int")
    got = df.select("n", simhash.sketch_distance(simhash.sketch(F.col("a")), simhash.sketch(F.col("b"))).alias("d")).collect()
    assert all(r.d <= r.n for r in got) and got[2].d > 0 and got[4].d > 200


def test_near_duplicates_store_less_than_their_texts(spark, tmp_path):
    """Candidates that share a few shingles are told apart by sketches; their whole sets are not stored."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    try:
        simhash.one_of_each(docs).count()
    finally:
        if before:
            sc.setCheckpointDir(before)
    assert sum(p.stat().st_size for p in tmp_path.rglob("part-*")) < size
