"""Joins and set operations over cohort tables.

No side is broadcast by hint: which side is small depends on the cohort, so the size check is left to Spark's
statistics and adaptive execution. Literal rule tables are folded into expressions instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.operators.keys import dedup_first


def left_features(features: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keep every row of ``features``."""
    return features.join(other, key, "left")


def with_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows of one task: inner join with its labels."""
    return features.join(labels, key, "inner")


def having(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def merge_keys(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Full outer join whose key is the coalesced one."""
    return left.join(right, key, "full")


def lookup(df: DataFrame, ref: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """First reference value per key, joined left."""
    first = dedup_first(ref.select(key, value, *[o for o in order if o not in (key, value)]), [key], order)
    return df.join(first.select(key, value), key, "left")


def fuzzy_key_join(names: DataFrame, ids: DataFrame, name: str = "name", id_: str = "id", min_len: int = 1) -> DataFrame:
    """Resolve folder names to known ids: exact, without a ``.<digits>`` suffix, longest prefix, else the name itself.

    The prefix step is an equi-join on the name's own prefixes (at most its length many), not a nested loop.
    """
    n = names.select(name).distinct()
    known = ids.select(F.col(id_).alias("_id")).distinct()
    bare = F.regexp_replace(F.col(name), r"\.\d+$", "")
    cand = n.select(
        name,
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(0).alias("rank"), F.col(name).alias("_id"))),
                F.array(F.struct(F.lit(1).alias("rank"), bare.alias("_id"))),
                F.transform(
                    F.sequence(F.lit(min_len), F.greatest(F.length(name), F.lit(min_len))),
                    lambda k: F.struct(F.lit(2).alias("rank"), F.substring(F.col(name), F.lit(1), k).alias("_id")),
                ),
            )
        ).alias("c"),
    ).select(name, "c.rank", "c._id")
    best = (
        cand.join(known, "_id")
        .groupBy(name)
        .agg(F.min_by(F.struct("_id", "rank"), F.struct("rank", -F.length("_id"), "_id")).alias("b"))
    )
    out = n.join(best, name, "left")
    return out.select(
        name, F.coalesce(F.col("b._id"), F.col(name)).alias("resolved"), F.coalesce(F.col("b.rank"), F.lit(3)).alias("rank")
    )


def fallback_key_join(df: DataFrame, ref: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Value by the first key, else by the second."""
    a = ref.select(F.col(first).alias("_k1"), F.col(value).alias("_v1")).where(F.col("_k1").isNotNull())
    b = ref.select(F.col(second).alias("_k2"), F.col(value).alias("_v2")).where(F.col("_k2").isNotNull())
    a, b = dedup_first(a, ["_k1"], ["_v1"]), dedup_first(b, ["_k2"], ["_v2"])
    out = df.join(a, df[first] == F.col("_k1"), "left").join(b, df[second] == F.col("_k2"), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_v1", "_k2", "_v2")


def add_new_columns(target: DataFrame, source: DataFrame, key: str, prefix: str = "", skip: Sequence[str] = ()):
    """Bring only columns the target lacks. Returns (joined, collisions)."""
    names = {c: f"{prefix}{c}" for c in source.columns if c != key and c not in skip}
    clash = [c for c, n in names.items() if n in target.columns]
    fresh = {c: n for c, n in names.items() if n not in target.columns}
    return target.join(source.select(key, *[F.col(c).alias(n) for c, n in fresh.items()]), key, "left"), clash


def fill_null_cells(target: DataFrame, source: DataFrame, keys=("patient_id", "feature")) -> DataFrame:
    """Long cells: a null in the target takes the source value. ``filled`` marks the changed cells."""
    t = target.select(*keys, F.col("value").alias("_t"), F.lit(True).alias("_in"))
    s = source.select(*keys, F.col("value").alias("_s"))
    out = t.join(s, list(keys), "left")
    return out.select(
        *keys, F.coalesce("_t", "_s").alias("value"), (F.col("_t").isNull() & F.col("_s").isNotNull()).alias("filled")
    )


def threshold(col: Column, steps: Sequence[tuple[float, float]], default: float) -> Column:
    """Value of the first step whose upper bound is not below ``col``; a literal table folded into one expression."""
    out = F.lit(default)
    for hi, v in reversed(list(steps)):
        out = F.when(col <= hi, F.lit(v)).otherwise(out)
    return F.when(col.isNull(), F.lit(default)).otherwise(out)


def add_labels(df: DataFrame, labels: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Label columns after alignment; repeated label ids do not multiply rows."""
    return df.join(dedup_first(labels.select(key, *cols), [key], list(cols)), key, "left")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the intersection and of both differences of two key sets: one full join."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1))
    y = b.select(key).distinct().withColumn("_b", F.lit(1))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return x.join(y, key, "full").agg(
        F.count_if(both).alias("both"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
    )


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union of result sets with a tag column."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def ordered_distinct_union(lists: Sequence[DataFrame], item: str, position: str) -> DataFrame:
    """Items of several ordered lists, each once, at the place of its first appearance."""
    out = None
    for i, df in enumerate(lists):
        part = df.select(item, F.struct(F.lit(i).alias("list_no"), F.col(position).alias("pos")).alias("_p"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(item).agg(F.min("_p").alias("_p")).select(item, "_p.list_no", "_p.pos")


def shared_features(facts: DataFrame, cohorts: int) -> DataFrame:
    """Features present in all cohorts."""
    return (
        facts.where(F.col("value").isNotNull())
        .groupBy("feature")
        .agg(F.count_distinct("cohort").alias("n_cohorts"))
        .where(F.col("n_cohorts") == cohorts)
    )
