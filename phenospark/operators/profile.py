"""Profiling, missingness, imputation and scaling over long facts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions.prefix import exact_quantiles

# Name prefixes that never are model features (compared without regard to case).
NON_FEATURE_PREFIXES = ("patient", "label", "rule", "hit", "ct_", "series", "patientid", "patient_id", "tni_", "bnp_",
                        "age", "aq_pi10")
# The order in which profile roles are listed.
ROLE_ORDER = ("主键", "连续自变量", "有序/分类自变量", "二分类变量", "分类自变量", "文本变量", "谨慎使用", "待定", "排除")


def profile_columns(texts: DataFrame, total: DataFrame | None = None, id_column: str | None = None) -> DataFrame:
    """Long (column, text) -> non-null, total, missing rate, distinct, numeric?, role. Texts are combined per distinct
    value first, so a column that is mostly one value moves as few rows."""
    per_value = texts.groupBy("column", "text").agg(F.count("*").alias("_n"))
    num = F.col("text").try_cast("double")
    out = per_value.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("_n"))), F.lit(0)).alias("non_null"),
        F.sum("_n").alias("total"), F.count("text").alias("n_distinct"),
        F.coalesce(F.bool_and(F.when(F.col("text").isNotNull(), num.isNotNull())), F.lit(False)).alias("is_numeric"),
    )
    miss = 1 - F.col("non_null") / F.col("total")
    nd = F.col("n_distinct")
    role = (
        F.when(F.col("missing_rate") > 0.5, "排除").when(F.col("missing_rate") > 0.2, "谨慎使用")
        .when(F.col("column") == F.lit(id_column), "主键").when(nd == 1, "排除")
        .when(F.col("is_numeric") & (nd >= 5), "连续自变量").when(F.col("is_numeric"), "有序/分类自变量")
        .when(nd == 2, "二分类变量").when(nd <= 10, "分类自变量").otherwise("文本变量")
    )
    return out.withColumn("missing_rate", miss).withColumn("role", role)


def order_by_role(profile: DataFrame) -> DataFrame:
    rank = F.create_map(*[x for i, r in enumerate(ROLE_ORDER) for x in (F.lit(r), F.lit(i))])
    return profile.orderBy(rank[F.col("role")], "column")


def missing_band(rate: Column) -> Column:
    return (
        F.when(rate >= 1, "all").when(rate > 0.5, "over_50").when(rate >= 0.1, "10_to_50").otherwise("under_10")
    )


def column_missing_bands(facts: DataFrame, block: Column) -> DataFrame:
    """Features per (block, missing band)."""
    rate = facts.groupBy("feature").agg((F.count_if(F.col("value").isNull()) / F.count("*")).alias("rate"))
    return rate.select(block.alias("block"), missing_band(F.col("rate")).alias("band")).groupBy("block", "band").agg(
        F.count("*").alias("features"))


def row_missing(facts: DataFrame) -> DataFrame:
    """Per-patient missing rates summed up: median, max, all-null rows, rows over one half."""
    rate = facts.groupBy("patient_id").agg((F.count_if(F.col("value").isNull()) / F.count("*")).alias("rate"))
    rate = rate.withColumn("_all", F.lit(0))
    med = exact_quantiles(rate, ["_all"], "rate", {"median_rate": 0.5})
    rest = rate.groupBy("_all").agg(
        F.max("rate").alias("max_rate"), F.count_if(F.col("rate") == 1).alias("all_null"),
        F.count_if(F.col("rate") > 0.5).alias("over_half"))
    return med.join(rest, "_all").drop("_all")


def block_missing(facts: DataFrame, block: Column) -> DataFrame:
    """Patients whose missing rate within a block is over one half."""
    per = facts.groupBy(block.alias("block"), "patient_id").agg(
        (F.count_if(F.col("value").isNull()) / F.count("*")).alias("rate"))
    return per.groupBy("block").agg(F.count_if(F.col("rate") > 0.5).alias("patients"))


def rerun_list(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of (cohort, patient_id) lists with their reasons."""
    return reduce(lambda a, b: a.unionByName(b),
                  [df.select("cohort", "patient_id", F.lit(r).alias("reason")) for r, df in parts.items()])


def missing_parts(patients: DataFrame, parts: DataFrame, required: Sequence[str], jobs: dict[str, str]) -> DataFrame:
    """Absent required parts per patient and the jobs that supply them. The collected set holds at most the
    required parts."""
    have = parts.where(F.col("roi").isin(*required)).groupBy("patient_id").agg(F.collect_set("roi").alias("_have"))
    need = F.array(*[F.lit(r) for r in required])
    job = F.create_map(*[F.lit(x) for kv in jobs.items() for x in kv])
    out = patients.select("patient_id").distinct().join(have, "patient_id", "left")
    miss = F.array_sort(F.array_except(need, F.coalesce("_have", F.array().cast("array<string>"))))
    return out.select(
        "patient_id", F.array_join(miss, ",").alias("missing"), F.size(miss).alias("n_missing"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(miss, lambda r: job[r]))), ",").alias("jobs"),
    ).where("n_missing > 0")


def drop_features(facts: DataFrame, max_missing: float = 0.30, min_sd: float = 1e-6,
                  exclude: Sequence[str] = ()) -> DataFrame:
    """One row per feature with ``reason``: excluded, missing, const, or null when kept."""
    low = F.lower("feature")
    named = reduce(lambda a, b: a | b, [low.startswith(p) for p in NON_FEATURE_PREFIXES])
    if exclude:
        named = named | low.isin(*[e.lower() for e in exclude])
    st = facts.groupBy("feature").agg(
        (F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing"), F.stddev_samp("value").alias("sd"))
    return st.withColumn("reason", F.when(named, "excluded").when(F.col("missing") > max_missing, "missing")
                         .when(F.coalesce(F.col("sd"), F.lit(0.0)) < min_sd, "const"))


def usable_features(facts: DataFrame, min_rows: int = 20, share: float = 0.5) -> DataFrame:
    """Features observed in at least max(min_rows, share of the rows) with more than one distinct value."""
    st = facts.groupBy("feature").agg(
        F.count("value").alias("n_obs"), F.count("*").alias("n"),
        (F.max("value") > F.min("value")).alias("varies"))
    return st.where((F.col("n_obs") >= F.greatest(F.lit(min_rows), F.col("n") * share)) & F.col("varies")).select("feature", "n_obs")


def fit_medians(train: DataFrame) -> DataFrame:
    """Exact training medians, one row per feature."""
    return exact_quantiles(train, ["feature"], "value", {"median": 0.5})


def median_impute(facts: DataFrame, medians: DataFrame) -> DataFrame:
    """Null -> the fitted median, then 0."""
    return facts.join(medians, "feature", "left").withColumn(
        "value", F.coalesce("value", "median", F.lit(0.0))).drop("median")


def missing_indicator(facts: DataFrame) -> DataFrame:
    """0/1 indicator facts for features that have nulls."""
    holes = facts.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("_h")).where("_h > 0").select("feature")
    ind = facts.join(holes, "feature", "left_semi")
    return ind.withColumns({"feature": F.concat(F.lit("missing::"), "feature"), "value": F.col("value").isNull().cast("double")})


def fit_scaler(train: DataFrame, kind: str = "standard") -> DataFrame:
    """(feature, center, scale): mean / population sd, or median / interquartile range. A zero scale becomes 1."""
    if kind == "standard":
        st = train.groupBy("feature").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"))
    else:
        q = exact_quantiles(train, ["feature"], "value", {"q1": 0.25, "center": 0.5, "q3": 0.75})
        st = q.select("feature", "center", (F.col("q3") - F.col("q1")).alias("scale"))
    return st.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))


def standardize(facts: DataFrame, scaler: DataFrame) -> DataFrame:
    return facts.join(scaler, "feature").withColumn("value", (F.col("value") - F.col("center")) / F.col("scale")).drop("center", "scale")


def outlier_slices(ct: DataFrame, floor: float) -> DataFrame:
    """Per slice: voxels below ``floor`` and their share; per-patient extremes come from ``outlier_volume``."""
    return ct.groupBy("patient_id", "z").agg(
        F.count_if(F.col("hu") < floor).alias("below"), F.count("*").alias("n"),
        F.min("hu").alias("min_hu"), F.max("hu").alias("max_hu")).withColumn("share", F.col("below") / F.col("n"))


def outlier_volume(slices: DataFrame) -> DataFrame:
    return slices.groupBy("patient_id").agg(
        F.sum("below").alias("below"), F.max_by("z", F.struct(F.col("below"), -F.col("z"))).alias("worst_slice"),
        F.min("min_hu").alias("min_hu"), F.max("max_hu").alias("max_hu"))


def label_set_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Non-zero labels of a mask before and after regridding; ``lost`` marks a mask that became empty.
    The sets hold label codes only, at most one per structure."""
    def sets(df, name):
        return df.where("label > 0").groupBy("patient_id").agg(
            F.array_sort(F.collect_set("label")).alias(name), F.count("*").alias(f"n_{name}"))

    j = sets(before, "src").join(sets(after, "dst"), "patient_id", "full")
    return j.select(
        "patient_id", F.coalesce(F.col("src") == F.col("dst"), F.lit(False)).alias("same"),
        (F.col("n_src").isNotNull() & F.col("n_dst").isNull()).alias("lost"))
