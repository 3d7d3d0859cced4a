import math

import numpy as np
from pyspark.sql import functions as F

from phenospark.functions import special as X
from phenospark.functions.prefix import exact_quantiles, prefix_sums, value_counts, with_blocks
from phenospark.functions.text import normalize_id, parse_amount, parse_number


def test_erfc_and_tails(spark):
    zs = [0.0, 0.3, 1.0, 2.49, 2.51, 4.0, 6.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", F.expr(X.erfc_sql("z")).alias("e"))
    for r in df.collect():
        assert math.isclose(r.e, math.erfc(r.z), rel_tol=1e-9)
    c = spark.createDataFrame([(7.2, math.sqrt(3.6))], "x double, z double")
    assert math.isclose(c.select(F.expr(X.chi2_tail_sql("x", "z", 2))).first()[0], math.exp(-3.6), rel_tol=1e-12)
    p1 = c.select(F.expr(X.chi2_tail_sql("x", "z", 1))).first()[0]
    assert math.isclose(p1, math.erfc(math.sqrt(3.6)), rel_tol=1e-9)
    p3 = c.select(F.expr(X.chi2_tail_sql("x", "z", 3))).first()[0]
    assert math.isclose(p3, p1 + math.sqrt(2 * 7.2 / math.pi) * math.exp(-3.6), rel_tol=1e-9)


def test_student_tail():
    # one degree of freedom is a Cauchy variable
    for t in (0.1, 1.0, 5.0):
        p = X.incomplete_beta([0.5], [0.5], [1 / (1 + t * t)])[0]
        assert math.isclose(p, 1 - 2 / math.pi * math.atan(t), rel_tol=1e-9)


def test_text(spark):
    df = spark.createDataFrame([("00123", "<0.01", "1包/天"), ("123.0", "1,200", "2.5两/日"), (" 123 ", "/", "/"), ("0000", "无", None), ("", None, "3/日"), (None, "≥5", "x")],
                               "i string, n string, a string")
    r = df.select(normalize_id("i"), parse_number("n"), parse_amount("a")).collect()
    assert [x[0] for x in r] == ["123", "123", "123", "0", None, None]
    assert [x[1] for x in r] == [0.01, 1200.0, None, None, None, 5.0]
    assert [x[2] for x in r] == [1.0, 2.5, None, None, 3.0, None]


def test_prefix_blocks_match_brute_force(spark):
    # one key holds most rows and one value holds a third of them; the sample rate is raised so that keys split
    df = spark.range(60000).selectExpr("if(id % 10 = 0, 1, 0) AS k", "if(id % 3 = 0, 7.0D, cast(pmod(xxhash64(id), 9000) AS double)) AS v")
    opts = {"sample_one_in": 4, "sample_per_block": 8}
    vc = value_counts(df, ["k"], "v")
    got = prefix_sums(vc, ["k"], "v", ["n"], **opts).toPandas()
    raw = df.toPandas()
    for k, g in raw.groupby("k"):
        s = np.sort(g.v.to_numpy())
        x = got[got.k == k]
        assert (x.before_n.to_numpy() == np.searchsorted(s, x.v.to_numpy())).all() and (x.total_n == len(s)).all()
    down = prefix_sums(vc, ["k"], "v", ["n"], descending=True, **opts).toPandas()
    big = np.sort(raw[raw.k == 0].v.to_numpy())
    x = down[down.k == 0]
    assert (x.before_n.to_numpy() == len(big) - np.searchsorted(big, x.v.to_numpy(), side="right")).all()
    blocks = with_blocks(vc, ["k"], "v", **opts).groupBy("k", "_block").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).toPandas()
    assert blocks.groupby("k").size().min() > 5 and blocks.n.max() < 1500
    for _, g in blocks.groupby("k"):
        g = g.sort_values("_block")
        assert (g.lo.to_numpy()[1:] > g.hi.to_numpy()[:-1]).all()


def test_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 9)], "k string, v double")
    assert math.isclose(exact_quantiles(df, ["k"], "v", {"q": 0.15}).first()["q"], 1.45)


def test_same_result_for_any_partition_count(spark):
    from phenospark.operators.stats import rank_auc

    df = spark.range(2000).selectExpr("'f' AS feature", "cast(id % 2 AS int) AS y", "cast(pmod(xxhash64(id), 50) AS double) AS value")
    old, out = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in (1, 4, 37):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.add(rank_auc(df).first()["auc"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(out) == 1
