"""Exact ranks, prefix sums and quantiles that never put one key into one task.

A plain ``Window.partitionBy(feature).orderBy(value)`` sorts a whole feature in one task. Here:

1. rows are first collapsed to one row per (keys, value) with a map-side combined aggregate, so a hot value
   costs one row;
2. each key's value range is cut into blocks of roughly a million distinct values. The cut points come
   from a hash sample of the distinct values, so they are the same on every recomputation (lost executors
   included);
3. a window runs inside (keys, block), and the totals of earlier blocks, a table of at most
   ``MAX_BLOCKS`` rows per key, are added by a join that reuses the (keys, block) partitioning.

Small keys get no cut point and stay in one block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE_ONE_IN = 16384
SAMPLE_PER_BLOCK = 64
MAX_BLOCKS = 4096
SAMPLE_SLOTS = 16384
FAN = 64


def value_counts(df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (keys, value) with summed measures; ``n`` counts rows."""
    measures = dict(measures or {"n": F.lit(1)})
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(c).alias(m) for m, c in measures.items()], F.max(F.xxhash64(*keys, F.col(value))).alias("_h"))
    )


def with_blocks(vc: DataFrame, keys: Sequence[str], order: str, sample_one_in: int = SAMPLE_ONE_IN,
                sample_per_block: int = SAMPLE_PER_BLOCK, rows: DataFrame | None = None) -> DataFrame:
    """Add ``_block``: monotone in ``order`` within each key, bounded in size for any key.

    Where ``vc`` counts ``rows`` and few of them are equal, the sample of distinct values is better taken from ``rows``: the
    branch of the cut points then shuffles the sample instead of a second, narrower copy of the counts."""
    keys = list(keys)
    # ``_h`` is an aggregate output, so the sample filter stays above the aggregation and every branch below reads
    # the same shuffle instead of computing the input again
    if "_h" not in vc.columns:
        vc = vc.withColumn("_h", F.xxhash64(*keys, F.col(order)))
    vc = vc.where(F.col("_h").isNotNull())
    sample = (vc if rows is None else rows.where(F.col(order).isNotNull()).withColumn("_h", F.xxhash64(*keys, F.col(order)))).select(
        *keys, F.col(order).alias("_v"), "_h").where(F.pmod(F.col("_h"), F.lit(sample_one_in)) == 0)
    if rows is not None:
        sample = sample.distinct()
    if not keys:
        sample = sample.withColumn("_k", F.lit(0))
        vc = vc.withColumn("_k", F.lit(0))
    gk = keys or ["_k"]
    # at most SAMPLE_SLOTS sampled values per key: the one with the smallest hash in each slot
    slots = sample.groupBy(*gk, F.pmod(F.shiftright("_h", 24), F.lit(SAMPLE_SLOTS)).alias("_slot")).agg(
        F.min_by("_v", "_h").alias("_v"), F.count("*").alias("_c"))
    cuts = slots.groupBy(*gk).agg(F.array_sort(F.collect_set("_v")).alias("_s"), F.sum("_c").alias("_c"))
    blocks = F.least(F.floor(F.col("_c") / sample_per_block), F.lit(MAX_BLOCKS))
    cuts = cuts.where(blocks > 1).select(*gk, "_s", F.ceil(F.size("_s") / blocks).cast("int").alias("_step")).select(
        *gk, F.expr("filter(_s, (v, i) -> (i + 1) % _step = 0)").alias("_cuts"))
    cuts = cuts.where(F.size("_cuts") > 0).select(
        *gk, "_cuts", F.expr(f"filter(_cuts, (v, i) -> (i + 1) % {FAN} = 0)").alias("_coarse")
    )
    # The broadcast is bounded: one cut point (8 bytes) per SAMPLE_ONE_IN * SAMPLE_PER_BLOCK = 1M distinct values and
    # never more than MAX_BLOCKS per key, so 100 TB of 16-byte (key, value) pairs give about 50 MB.
    cuts = F.broadcast(cuts)
    o = F.col(order)
    coarse = F.size(F.filter("_coarse", lambda c: c < o))
    fine = F.size(F.filter(F.slice("_cuts", F.col("_cb") * FAN + 1, F.lit(FAN)), lambda c: c < o))
    return (
        vc.join(cuts, gk, "left")
        .withColumn("_cb", F.when(F.col("_cuts").isNotNull(), coarse).otherwise(0))
        .withColumn("_block", F.when(F.col("_cuts").isNotNull(), F.col("_cb") * FAN + fine).otherwise(0))
        .drop("_cuts", "_coarse", "_cb", "_h", *([] if keys else ["_k"]))
    )


def prefix_sums(vc: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str], descending: bool = False,
                **block_options) -> DataFrame:
    """Add ``before_<m>`` (sum over strictly smaller ``order``; larger if descending) and ``total_<m>``.

    ``vc`` has one row per (keys, order), as ``value_counts`` makes it.
    """
    keys = list(keys)
    b = with_blocks(vc, keys, order, **block_options)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy(*keys, "_block").orderBy(direction).rowsBetween(W.unboundedPreceding, -1)
    bdir = F.col("_block").desc() if descending else F.col("_block").asc()
    # at most MAX_BLOCKS rows per key from here on
    earlier = W.partitionBy(*keys).orderBy(bdir).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    totals = b.groupBy(*keys, "_block").agg(*[F.sum(m).alias(f"_b_{m}") for m in measures])
    totals = totals.select(
        *keys, "_block",
        *[F.coalesce(F.sum(f"_b_{m}").over(earlier), F.lit(0)).alias(f"_e_{m}") for m in measures],
        *[F.sum(f"_b_{m}").over(whole).alias(f"total_{m}") for m in measures],
    )
    local = b.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_i_{m}") for m in measures])
    joined = local.join(totals, [*keys, "_block"])
    return joined.select(
        *[c for c in vc.columns if c != "_h"],
        *[(F.col(f"_e_{m}") + F.col(f"_i_{m}")).alias(f"before_{m}") for m in measures],
        *[F.col(f"total_{m}") for m in measures],
    )


def average_rank(before: str = "before_n", n: str = "n") -> Column:
    """Average rank (1-based) of a tie group."""
    return F.col(before) + (F.col(n) + 1) / F.lit(2.0)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key, exact, from the prefix table (no per-key value map in one task)."""
    pre = prefix_sums(value_counts(df, keys, value), keys, value, ["n"])
    aggs = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("total_n") - 1)
        for tag, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("before_n") <= pos) & (pos < F.col("before_n") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{name}"))
    out = pre.groupBy(*keys).agg(F.max("total_n").alias("_n"), *aggs)
    cols = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return out.select(*keys, *cols)
