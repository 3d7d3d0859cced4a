"""Feature catalogue: naming rules, families, alignment to a standard cohort, composite scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names that are not features.
META = ("cohort", "PatientID", "info_match", "label", "label_name", "label_reason", "main_diagnosis", "main_icd",
        "other_diagnosis", "other_icd", "feature_source", "source_Patient_ID", "source_PatientID_raw",
        "source_CT_Series", "source_ICD", "source_AECOPD", "source_COPD_BCOS")
# Name prefixes of features without a structure part.
FEATURE_PREFIXES = ("TD_", "blur_", "wall_", "WA_", "Din_", "Dout_", "mean_", "Pi10", "Vessel_", "Lobe_", "Lung_",
                    "Airway_", "PA_", "Diaphragm_", "pca_", "RV_", "LV_", "CAC_", "BronchoArtery_", "EpiFat_", "FAI_",
                    "Aorta_", "CardioThoracic_", "tortuosity", "n_branches", "pruning", "max_generation", "terminal",
                    "generation", "branch", "junction")
# Prefixes of airway-family features, and of radiomics features without '::'.
AIRWAY_PREFIXES = ("TD_", "blur_", "wall_", "WA_", "Din_", "Dout_", "mean_", "Pi10", "Vessel_", "Lobe_", "Lung_",
                   "Airway_", "PA_", "Diaphragm_", "pca_", "RV_", "LV_", "CAC_")
RADIOMICS_EXTRA = ("Lobe_", "Lung_", "Airway_", "PA_", "Diaphragm_", "heart", "aorta", "trachea", "pulmonary_artery")
# Keywords of clinical imaging features, and of chest structures.
CLINICAL_KEYWORDS = ("LAA950", "Perc15", "Pi10", "WA_pct", "TD_", "wall_", "blur_", "Vessel_", "Lobe_", "Lung_",
                     "Din_", "Dout_", "tortuosity", "n_branches", "pruning", "max_generation")
CHEST_KEYWORDS = ("lung", "heart", "aorta", "pulmonary", "trachea", "airway", "bronchus", "diaphragm", "mediastinum",
                  "thymus", "esophagus", "aortic", "coronary", "rib_", "spine", "vertebra", "sternum", "clavicle",
                  "scapula", "humerus", "lobe", "vessel")
# Structures that keep their full name in a family label.
WHOLE_ROI = ("lung_vessels", "heart_myocardium", "pulmonary_artery", "aorta", "trachea")
# Raw features of each composite score.
COMPOSITES = {
    "PAH_vascular": ("Vessel_CSA_mean_mm2", "PA_Equivalent_Diameter_mm"),
    "CAC_score": ("CAC_Agatston",),
    "FatInflam_score": ("EpiFat_Volume_mm3", "FAI_pericoronary_HU", "EpiFat_Mean_HU"),
    "CTR_score": ("CardioThoracic_Ratio",),
    "BAR_score": ("BronchoArtery_Ratio",),
}
# Clinical category and direction by feature pattern; the first match counts.
MEANINGS = (
    ("^Pi10$", "气道重塑", "Pi10 ↑ 风险↑"),
    ("Vessel_BV5_pct|Vessel_BV10_pct", "肺血管", "BV ↓ 风险↑(反向)"),
    ("Vessel_Fractal_Dim", "肺血管", "双向"),
    ("Vessel_CSA_mean_mm2", "肺血管", "异常即风险"),
    ("Vessel_Volume_mm3", "肺血管", "↓ 风险↑(反向)"),
    ("Vessel_Tortuosity", "肺血管", "↑ 风险↑"),
    ("Vessel_", "肺血管", "—"),
    ("^CAC_Agatston$", "钙化", "CAC ↑ 风险↑"),
    ("^CAC_Mass_mg$", "钙化", "↑ 风险↑"),
    ("^CAC_Volume_mm3$", "钙化", "↑ 风险↑"),
    ("^EpiFat_Volume_mm3$", "心包脂肪", "↑ 风险↑"),
    ("^EpiFat_Mean_HU$", "心包脂肪", "↑(更致密) 风险↑"),
    ("^FAI_pericoronary_HU$", "心包脂肪", "FAI ↑ 风险↑"),
    ("^CardioThoracic_Ratio$", "心脏", "↑ 风险↑"),
    ("^BronchoArtery_Ratio$", "气道", "↑ 风险↑"),
    ("^PA_Equivalent_Diameter_mm$", "肺动脉", "↑ 风险↑"),
    ("PA_Ao_", "肺动脉", "↑ 风险↑"),
    ("^Aorta_", "主动脉", "↑ 风险↑"),
    ("^RV_", "心脏", "↑ 风险↑"),
    ("^LV_", "心脏", "—"),
    ("TD_", "气道", "TD 异质/扩张 风险↑"),
    ("blur_", "气道", "↑ 风险↑"),
    ("wall_|WA_", "气道", "↑ 风险↑"),
    ("Din_|Dout_", "气道", "口径异常 风险↑"),
    ("^mean_", "气道", "—"),
    ("Pi10|Pi_", "气道", "Pi10 ↑ 风险↑"),
    ("Lobe_.*LAA|Lung_.*LAA", "肺气肿", "↑ 风险↑"),
    ("Perc15", "肺气肿", "↓ 风险↑(反向)"),
    ("Lobe_|Lung_", "肺叶", "—"),
    ("Airway_", "气道", "—"),
    ("Diaphragm_", "膈肌", "↓填充比 风险↑"),
    ("tortuosity|branch|junction|pruning|generation", "气道结构", "—"),
    ("firstorder_(Energy|TotalEnergy)", "强度(混杂)", "混杂"),
    ("firstorder_", "firstorder", "—"),
    ("shape_", "形态学", "—"),
    ("_(glcm|glrlm|glszm|gldm|ngtdm)_", "纹理", "—"),
)

# Filters, feature classes and keywords of families; the first that a name holds counts.
FAMILY_FILTERS = ("original", "wavelet", "log-sigma")
FAMILY_CLASSES = ("glcm", "glrlm", "glszm", "ngtdm", "firstorder")
FAMILY_WORDS = ("vessel", "fractal", "bv", "pi10", "tortuosity", "td", "blur", "wall", "wa_", "lobe")


def _starts(c: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def _has(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def is_feature(c: Column) -> Column:
    return ~c.isin(*META) & ~c.startswith("info_") & (c.contains("::") | _starts(c, FEATURE_PREFIXES))


def feature_block(c: Column) -> Column:
    return (
        F.when(c.startswith("Vessel_"), "vessel")
        .when(c.startswith("Lobe_") | c.startswith("Lung_"), "lobe/lung")
        .when(_starts(c, AIRWAY_PREFIXES) & ~c.contains("::"), "airway")
        .when(c.contains("::"), "radiomics")
        .otherwise("other")
    )


def split_family(c: Column, rule: str = "airway_first") -> Column:
    """Radiomics or airway. ``rule`` says which prefix list is asked first for names without '::'."""
    out = F.when(c.contains("::"), "rad")
    if rule == "airway_first":
        return out.when(_starts(c, AIRWAY_PREFIXES), "aq").when(_starts(c, RADIOMICS_EXTRA), "rad")
    return out.when(_starts(c, RADIOMICS_EXTRA), "rad").otherwise("aq")


def _first_held(c: Column, words: Sequence[str], default: str) -> Column:
    return F.coalesce(*[F.when(c.contains(w), w) for w in words], F.lit(default))


def feature_family(c: Column) -> Column:
    """structure :: filter :: class for structured names, a keyword otherwise."""
    roi, rest = F.substring_index(c, "::", 1), F.substring_index(c, "::", -1)
    short = F.when(roi.isin(*WHOLE_ROI), roi).otherwise(F.substring_index(roi, "_", 1))
    structured = F.concat_ws("::", short, _first_held(rest, FAMILY_FILTERS, "other"), _first_held(F.lower(c), FAMILY_CLASSES, "shape"))
    return F.when(c.contains("::"), structured).otherwise(_first_held(F.lower(c), FAMILY_WORDS, "other"))


def composition_group(c: Column) -> Column:
    return (
        F.when(c.rlike("firstorder_(TotalEnergy|Energy)(_|$)"), "intensity")
        .when(c.contains("shape_"), "shape")
        .when(c.rlike("_(glcm|glrlm|glszm|gldm|ngtdm)_"), "texture")
        .when(c.contains("firstorder_"), "firstorder_other")
        .otherwise("structural")
    )


def feature_composition(selected: DataFrame) -> DataFrame:
    g = composition_group(F.col("feature"))
    names = ("intensity", "shape", "texture", "firstorder_other", "structural")
    return selected.agg(*[F.count_if(g == n).alias(n) for n in names])


def clinical_meaning(c: Column) -> tuple[Column, Column]:
    """(category, direction) of the first pattern that matches: a fixed literal table folded into the plan."""
    cat = reduce(lambda acc, m: acc.when(c.rlike(m[0]), m[1]), MEANINGS[1:], F.when(c.rlike(MEANINGS[0][0]), MEANINGS[0][1]))
    way = reduce(lambda acc, m: acc.when(c.rlike(m[0]), m[2]), MEANINGS[1:], F.when(c.rlike(MEANINGS[0][0]), MEANINGS[0][2]))
    return cat.otherwise("其它"), way.otherwise("—")


def align_to_standard(facts: DataFrame, standard: DataFrame) -> DataFrame:
    """Only the features of the standard cohort."""
    return facts.join(standard.select("feature").distinct(), "feature", "left_semi")


def alignment_drops(facts: DataFrame, standard: DataFrame) -> DataFrame:
    """Dropped features of every structure, largest first; ``non_chest`` counts those with no chest keyword."""
    dropped = facts.select("feature").distinct().join(standard.select("feature").distinct(), "feature", "left_anti")
    f = F.col("feature")
    return (
        dropped.groupBy(F.substring_index(f, "::", 1).alias("block"))
        .agg(F.count("*").alias("dropped"), F.count_if(~_has(f, CHEST_KEYWORDS)).alias("non_chest"))
        .orderBy(F.desc("dropped"), "block")
    )


def clinical_group(c: Column) -> Column:
    return (
        F.when(c.contains("LAA"), "LAA").when(c.contains("Perc15"), "Perc15")
        .when(_starts(c, ("Pi10", "WA_", "TD_", "wall_", "blur_", "Din_", "Dout_")), "airway")
        .when(c.startswith("Vessel_"), "vessel").when(c.startswith("Lobe_"), "lobe")
        .when(c.startswith("Lung_"), "lung").otherwise("other")
    )


def clinical_features(features: DataFrame) -> DataFrame:
    f = F.col("feature")
    return features.where(_has(f, CLINICAL_KEYWORDS)).select("feature", clinical_group(f).alias("grp"))


def rename_cohort(c: Column, names: Mapping[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(m[c], c)


def composite_scores(facts: DataFrame, spec: Mapping[str, Sequence[str]] = COMPOSITES) -> DataFrame:
    """z-score each raw feature over the whole cohort and sum the available z's per score; the raws are dropped."""
    to_score = {f: s for s, fs in spec.items() for f in fs}
    m = F.create_map(*[F.lit(x) for kv in to_score.items() for x in kv])
    raw = facts.where(F.col("feature").isin(*to_score))
    stats = raw.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = raw.join(stats, "feature").select(
        "patient_id", m[F.col("feature")].alias("feature"),
        F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).alias("z"),
    )
    scores = z.groupBy("patient_id", "feature").agg(F.sum("z").alias("value"))
    rest = facts.where(~F.col("feature").isin(*to_score)).select("patient_id", "feature", "value")
    return rest.unionByName(scores)
