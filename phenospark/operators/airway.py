"""Operators over branch tables and airway voxels. All per-patient summaries are one map-side combined aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phenospark.session import checkpointed

# Branch columns that are averaged, generation bins, and the columns averaged per bin.
SUMMARY_COLUMNS = ("stats_arclength", "stats_change_deg", "stats_euclength", "stats_tortuosity", "LumenArea_mm2",
                   "WallArea_mm2", "WA_pct", "Inner_Diameter_mm", "Outer_Diameter_mm", "Wall_Thickness_mm",
                   "Pi_Perimeter_mm", "Sqrt_WallArea")
GENERATION_BINS = (("GenLe2", 0, 2), ("Gen3", 3, 3), ("Gen4", 4, 4), ("GenGe5", 5, 99))
LAYER_COLUMNS = ("WA_pct", "Wall_Thickness_mm", "Inner_Diameter_mm", "stats_tortuosity")



def _gen(lo: int, hi: int) -> Column:
    return F.col("generation").between(lo, hi)


def branch_summary(b: DataFrame) -> DataFrame:
    aggs = [F.count("*").alias("n_branches")]
    for c in SUMMARY_COLUMNS:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return b.groupBy("patient_id").agg(*aggs)


def generation_layers(b: DataFrame) -> DataFrame:
    aggs = []
    for tag, lo, hi in GENERATION_BINS:
        aggs.append(F.count_if(_gen(lo, hi)).alias(f"{tag}_count"))
        aggs += [F.avg(F.when(_gen(lo, hi), F.col(c))).alias(f"{tag}_{c}_mean") for c in LAYER_COLUMNS]
    return b.groupBy("patient_id").agg(*aggs)


def _td() -> Column:
    return F.try_divide("Wall_Thickness_mm", "Outer_Diameter_mm")


def morphology(b: DataFrame) -> DataFrame:
    def at(c, lo=None, hi=None):
        c = F.col(c) if isinstance(c, str) else c
        return F.avg(c if lo is None else F.when(_gen(lo, hi or lo), c))

    out = {"n_branches": F.count("*"), "Din_mean_all": at("Inner_Diameter_mm"), "Dout_mean_all": at("Outer_Diameter_mm"),
           "WA_pct_all": at("WA_pct"), "WA_pct_gen3to6": at("WA_pct", 3, 6), "TD_ratio_all": at(_td()),
           "LA_mean_all": at("LumenArea_mm2"), "WA_mean_all": at("WallArea_mm2"), "Pi_mean_all": at("Pi_Perimeter_mm")}
    for g in (3, 4, 5):
        out[f"Din_mean_gen{g}"] = at("Inner_Diameter_mm", g)
        out[f"WA_pct_gen{g}"] = at("WA_pct", g)
        out[f"TD_ratio_gen{g}"] = at(_td(), g)
    return b.groupBy("patient_id").agg(*[e.alias(n) for n, e in out.items()])


def topology(b: DataFrame) -> DataFrame:
    return b.groupBy("patient_id").agg(
        F.max("generation").alias("max_generation"), F.avg("stats_tortuosity").alias("mean_tortuosity"),
        F.stddev_pop("stats_tortuosity").alias("std_tortuosity"), F.avg("stats_parent_deg").alias("mean_parent_angle"),
        F.avg("stats_sibling_deg").alias("mean_sibling_angle"),
        *[F.avg(F.when(_gen(g, g), F.col("stats_parent_deg"))).alias(f"mean_parent_angle_gen{g}") for g in (3, 4)])


def terminal_pruning(b: DataFrame) -> DataFrame:
    t = F.col("children_1").isNull() & F.col("children_2").isNull()
    g5, g6 = F.count_if(t & (F.col("generation") >= 5)), F.count_if(t & (F.col("generation") >= 6))
    n = F.greatest(F.lit(1), F.count("*"))
    return b.groupBy("patient_id").agg(
        F.count_if(t).alias("n_terminal_total"), g5.alias("n_terminal_gen5plus"), g6.alias("n_terminal_gen6plus"),
        (g5 / n).alias("pruning_ratio_gen5"), (g6 / n).alias("pruning_ratio_gen6"),
        F.avg(F.when(t, F.col("WA_pct"))).alias("mean_WA_pct_terminal"))


def td_change_markers(b: DataFrame) -> DataFrame:
    """Spread and trend of the wall-to-diameter ratio along the tree."""
    td = b.select("patient_id", "generation", _td().alias("td")).where("td is not null")
    far, near = F.col("generation") >= 5, F.col("generation") <= 2
    st = td.groupBy("patient_id").agg(
        F.avg("td").alias("_m"), F.stddev_samp("td").alias("TD_sd"),
        F.stddev_samp(F.when(far, F.col("td"))).alias("TD_sd_gen5plus"),
        F.regr_slope("td", "generation").alias("TD_slope_generation"),
        (F.avg(F.when(far, F.col("td"))) - F.avg(F.when(near, F.col("td")))).alias("TD_distal_minus_proximal"))
    out = td.join(st.select("patient_id", "_m", F.col("TD_sd").alias("_s")), "patient_id").groupBy("patient_id").agg(
        F.avg((F.abs(F.try_divide(F.col("td") - F.col("_m"), F.col("_s"))) > 2).cast("double")).alias("TD_outlier_share"))
    return st.withColumn("TD_cv", F.try_divide("TD_sd", "_m")).drop("_m").join(out, "patient_id")


def pi10(b: DataFrame) -> DataFrame:
    """Root wall area of a 10-mm-perimeter airway from a per-patient line; null with five branches or fewer."""
    x, y = F.when(F.col("Pi_Perimeter_mm") > 0, F.col("Pi_Perimeter_mm")), F.col("Sqrt_WallArea")
    return b.groupBy("patient_id").agg(
        F.when(F.regr_count(y, x) > 5, F.regr_intercept(y, x) + 10 * F.regr_slope(y, x)).alias("Pi10"))


def branch_geometry(df: DataFrame, lumen_voxels: str, voxel_volume: str, length: str, wall: str) -> DataFrame:
    la = F.try_divide(F.col(lumen_voxels) * F.col(voxel_volume), F.col(length))
    out = df.withColumn("LumenArea_mm2", la)
    out = out.withColumn("Inner_Diameter_mm", 2 * F.sqrt(F.col("LumenArea_mm2") / math.pi))
    out = out.withColumns({"Pi_Perimeter_mm": math.pi * F.col("Inner_Diameter_mm"),
                           "Outer_Diameter_mm": F.col("Inner_Diameter_mm") + 2 * F.col(wall)})
    out = out.withColumn("WallArea_mm2", math.pi * (F.pow(F.col("Outer_Diameter_mm") / 2, 2) - F.pow(F.col("Inner_Diameter_mm") / 2, 2)))
    return out.withColumns({"Sqrt_WallArea": F.sqrt("WallArea_mm2"),
                            "WA_pct": F.try_divide(100 * F.col("WallArea_mm2"), F.col("WallArea_mm2") + F.col("LumenArea_mm2"))})


def wall_profile(wall: DataFrame, keys: Sequence[str], distance: str = "d", hu: str = "hu", width: float = 0.2,
                 reach: float = 5.0) -> DataFrame:
    """Mean HU per distance bin and branch on the complete bin axis (reach/width rows per branch), gaps filled linearly."""
    keys = list(keys)
    bins = int(round(reach / width))
    at = F.least(F.floor(F.col(distance) / width + 1e-9), F.lit(bins - 1))
    seen = wall.where(F.col(distance).between(0, reach)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.avg(hu).alias("mean_hu"))
    pts = F.array_sort(F.collect_list(F.when(F.col("mean_hu").isNotNull(), F.struct("bin", F.col("mean_hu").alias("seen")))))
    n = F.size("_p")

    def part(j):
        """Bins from seen bin ``j - 1`` up to before seen bin ``j``, on the line through both; beyond the outermost seen bins the
        line through the two nearest seen bins goes on."""
        at = F.greatest(F.lit(0), F.least(j - 1, n - 2))
        a, b, own = F.get("_p", at), F.get("_p", at + 1), F.get("_p", j - 1)
        lo, hi = F.coalesce(own["bin"], F.lit(0)), F.coalesce(F.get("_p", j)["bin"] - 1, F.lit(bins - 1))
        line = lambda i: a["seen"] + (b["seen"] - a["seen"]) * F.try_divide((i - a["bin"]).cast("double"), b["bin"] - a["bin"])
        filled = F.transform(F.sequence(lo, hi), lambda i: F.struct(i.alias("bin"), F.when(own["bin"] == i, own["seen"]).otherwise(line(i)).alias("hu")))
        return F.when(lo <= hi, filled).otherwise(F.slice(filled, 1, 0))

    whole = F.flatten(F.transform(F.sequence(F.lit(0), n), part))
    return seen.groupBy(*keys).agg(pts.alias("_p")).select(*keys, F.inline(whole))


def fwhm_wall_thickness(profile: DataFrame, keys: Sequence[str], width: float = 0.2, lung_default: float = -850.0) -> DataFrame:
    """Peak, lung level after the peak and distance of the first bin below half-maximum."""
    keys = list(keys)
    whole = W.partitionBy(*keys)
    rank = F.struct(F.col("hu"), -F.col("bin"))
    p = profile.where("hu is not null")
    p = p.withColumn("peak_bin", F.max_by("bin", rank).over(whole)).withColumn("peak_hu", F.max("hu").over(whole))
    after = F.col("bin") >= F.col("peak_bin")
    p = p.withColumn("lung_hu", F.coalesce(F.min(F.when(after, F.col("hu"))).over(whole), F.lit(lung_default)))
    half = (F.col("peak_hu") + F.col("lung_hu")) / 2
    g = p.groupBy(*keys).agg(
        F.first("peak_hu").alias("peak_hu"), F.first("lung_hu").alias("lung_hu"), F.first("peak_bin").alias("peak_bin"),
        F.min(F.when(after & (F.col("hu") < half), F.col("bin"))).alias("_drop"),
        F.min(F.when(after & (F.col("hu") < F.col("lung_hu") + 0.1 * (F.col("peak_hu") - F.col("lung_hu"))), F.col("bin"))).alias("_end"))
    return g.select(
        *keys, "peak_hu", "lung_hu", ((F.col("_drop") * width) + width / 2).alias("wall_thickness"),
        (F.col("peak_hu") - F.col("lung_hu")).alias("contrast"),
        ((F.col("_end") - F.col("peak_bin")) * width).alias("transition_width"))


def blur_features(fwhm: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Edge blur per patient: level, contrast, transition width and sharpness; mean, sd and distal mean."""
    f = fwhm.withColumn("sharpness", F.try_divide("contrast", "transition_width"))
    aggs = []
    for c in ("peak_hu", "lung_hu", "contrast", "transition_width", "sharpness"):
        aggs += [F.avg(c).alias(f"blur_{c}_mean"), F.stddev_samp(c).alias(f"blur_{c}_sd"),
                 F.avg(F.when(F.col("generation") >= 5, F.col(c))).alias(f"blur_{c}_gen5plus")]
    return f.groupBy(patient).agg(*aggs)


def wall_density(wall: DataFrame) -> DataFrame:
    """Wall HU moments per patient, and means per generation 3-5."""
    return wall.groupBy("patient_id").agg(
        F.avg("hu").alias("wall_hu_mean"), F.stddev_samp("hu").alias("wall_hu_std"), F.skewness("hu").alias("wall_hu_skew"),
        F.kurtosis("hu").alias("wall_hu_kurt"),
        *[F.avg(F.when(F.col("generation") == g, F.col("hu"))).alias(f"wall_hu_mean_gen{g}") for g in (3, 4, 5)])


def profile_pca(profile: DataFrame, keys: Sequence[str], bins: int = 25, k: int = 3) -> DataFrame:
    """Explained shares of the first ``k`` components of branch profiles over a cohort, and the sd of the first score."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    wide = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "hu"))).alias("_p"))
    wide = wide.where((F.size("_p") == bins) & ~F.exists("_p", lambda s: s["hu"].isNull()))
    vec = checkpointed(wide.select(array_to_vector(F.transform("_p", lambda s: s["hu"])).alias("v")))  # the fit reads it several times
    model = PCA(k=k, inputCol="v", outputCol="s").fit(vec)
    sd = model.transform(vec).agg(F.stddev_samp(vector_to_array("s")[0]).alias("pca_first_pc_std"))
    shares = [float(x) for x in model.explainedVariance]
    return sd.select(*[F.lit(s).alias(f"pca_explained_{i + 1}") for i, s in enumerate(shares)], "pca_first_pc_std")


def voxel_to_branch(voxels: DataFrame, line: DataFrame, reach: float = 6.0) -> DataFrame:
    """Nearest centre-line point within ``reach`` for every voxel: (patient, coordinates, branch, d).

    Space is cut into cells of edge ``reach``; each centre-line point visits its 27 cells (the small side moves),
    so a voxel meets only points of its own and adjacent cells. Points grow 27-fold behind the planner's back, so the join
    is told to sort and merge: it spills, whereas a broadcast of them is held by every executor.
    """
    def cell(c):
        return F.floor(F.col(c) / reach).cast("int")

    v = voxels.withColumns({"cz": cell("z"), "cy": cell("y"), "cx": cell("x")})
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = line.select("patient_id", "branch", F.col("z").alias("pz"), F.col("y").alias("py"), F.col("x").alias("px"))
    for c, q in (("cz", "pz"), ("cy", "py"), ("cx", "px")):
        p = p.withColumn("_s", F.explode(steps)).withColumn(c, F.floor(F.col(q) / reach).cast("int") + F.col("_s")).drop("_s")
    d2 = sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in (("z", "pz"), ("y", "py"), ("x", "px")))
    near = v.join(p.hint("merge"), ["patient_id", "cz", "cy", "cx"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    best = near.groupBy("patient_id", "z", "y", "x").agg(F.min(F.struct("d2", "branch")).alias("b"))
    return best.select("patient_id", "z", "y", "x", "b.branch", F.sqrt("b.d2").alias("d"))


def bronchus_artery_ratio(airway: DataFrame, artery: DataFrame, bronchus: str, diameter: str) -> DataFrame:
    """Mean inner diameter over artery diameter; null unless finite and positive."""
    r = F.try_divide(F.col(bronchus), F.col(diameter))
    return airway.join(artery, "patient_id").select("patient_id", F.when(r > 0, r).alias("BronchoArtery_Ratio"))


def _doubled(edges: DataFrame) -> DataFrame:
    """(patient_id, id, dist, n): steps up to the root and branches below and including each branch.

    Pointer doubling: after round k a branch knows its ancestor 2**k steps up and has counted all branches less than 2**k
    steps below, so a tree of any depth d takes log2(d) rounds of equi-joins on (patient, id). A cycle never reaches a root
    and raises as soon as the steps exceed the number of branches.
    """
    keys = ["patient_id"]
    cur = checkpointed(edges.select(*keys, "id", F.col("parent").alias("anc"), F.col("parent").isNotNull().cast("bigint").alias("dist"), F.lit(1).cast("bigint").alias("n")))
    total, reach = cur.count(), 1
    while not cur.where("anc is not null").isEmpty():
        if reach > total:
            raise ValueError("parent links form a cycle")
        below = cur.where("anc is not null").groupBy(*keys, F.col("anc").alias("id")).agg(F.sum("n").alias("_more"))
        above = cur.select(*keys, F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("dist").alias("_dist"))
        cur = checkpointed(cur.join(below, [*keys, "id"], "left").join(above, [*keys, "anc"], "left").select(
            *keys, "id", F.col("_anc").alias("anc"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
            (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n")))
        reach *= 2
    return cur


def tree_walk(edges: DataFrame) -> DataFrame:
    """(id, parent) -> steps from the root, per patient, for trees of any depth."""
    return _doubled(edges).select("patient_id", "id", F.col("dist").alias("generation"))


def subtree_sizes(edges: DataFrame) -> DataFrame:
    """Branches below and including each branch."""
    return _doubled(edges).select("patient_id", "id", F.col("n").alias("subtree"))


def tree_measures(edges: DataFrame) -> DataFrame:
    """Generation and subtree size in one walk."""
    return _doubled(edges).select("patient_id", "id", F.col("dist").alias("generation"), F.col("n").alias("subtree"))
