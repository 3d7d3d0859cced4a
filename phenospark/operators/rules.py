"""Outcome labels from codes, text and laboratory values; cohorts as data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions.text import parse_number
from phenospark.operators.joins import threshold

# Acute terms (one hit is enough), chronic terms (need a modifier nearby), modifiers.
ACUTE_TERMS = ("急性心力衰竭", "急性心衰", "心源性休克", "急性心肌梗死", "急性心梗", "急性冠脉", "急性冠脉综合征",
               "恶性心律失常", "心肺复苏", "室颤", "心室颤动", "急性肺水肿", "心搏骤停", "心脏骤停")
CHRONIC_TERMS = ("心力衰竭", "心衰", "心肌梗死", "心梗", "心功能不全", "房颤", "心房颤动", "心肌缺血", "冠心病", "心绞痛")
MODIFIERS = ("急性", "加重", "急性发作", "衰竭", "发作", "新发", "突发")
# Further terms that count as a cardiovascular comorbidity.
COMORBIDITY_TERMS = ("心律失常", "肺源性心脏病", "肺心病", "心包积液", "心肌病", "瓣膜病", "心脏瓣膜", "心内膜炎",
                     "主动脉夹层", "心肌炎", "心包炎", "二尖瓣", "主动脉瓣", "心脏扩大", "心影增大")
# Terms of the frequency scan.
SCAN_TERMS = ("心力衰竭", "心衰", "心功能不全", "心肌梗死", "心梗", "急性冠脉", "冠心病", "心绞痛", "心肌缺血", "房颤",
              "心房颤动", "心律失常", "心源性休克", "肺源性心脏病", "肺心病", "心包积液", "高血压", "高血压病", "瓣膜",
              "心肌病", "心室颤动", "室颤", "心脏骤停", "心肺复苏")
# Troponin limit in ng/mL, unit factors, and age-banded NT-proBNP limits in pg/mL.
TNI_LIMIT = 0.047
TNI_UNITS = {"ng/mL": 1.0, "ng/L": 0.001, "μg/L": 1.0, "ug/L": 1.0}
BNP_STEPS = ((50.0, 450.0), (75.0, 900.0), (200.0, 1800.0))
BNP_DEFAULT = 450.0
# Terms and diagnoses of the cohort definitions.
BRONCH_PREFIXES = ("支气管扩张", "支气管扩张症", "细支气管扩张症")
NSFC_TERMS = ("急性加重", "急性发作", "合并感染", "肺部感染", "下呼吸道感染", "咯血")
BCOS_AE_TERMS = ("急性加重", "急性发作", "伴急性下呼吸道感染", "合并感染")
INFECTION_TERMS = ("下呼吸道感染", "肺部感染", "合并感染")
STABLE_DIAGNOSIS = "慢性阻塞性肺疾病"
ACUTE_COPD_DIAGNOSES = ("慢性阻塞性肺病伴有急性加重", "慢性阻塞性肺疾病急性加重", "慢性阻塞性肺疾病伴急性下呼吸道感染",
                        "慢性阻塞性肺病伴急性下呼吸道感染", "慢性支气管炎合并肺部感染")
PLAIN_BRONCH_DIAGNOSES = ("支气管扩张", "支气管扩张症")
HEMOPTYSIS = "伴咯血"


def any_of(c: Column, terms: Sequence[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(t) for t in terms]), F.lit(False))


def starts_any(c: Column, prefixes: Sequence[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes]), F.lit(False))


def icd_label(icd: Column) -> Column:
    """Exacerbation-coded -> 1, unspecified or other -> 0, anything else null."""
    return F.when(icd.startswith("J44.1") | icd.startswith("J44.0"), 1).when(
        icd.startswith("J44.9") | icd.startswith("J44.8"), 0
    )


def icd_contrast(icd: Column, pos: str = "J44.0", neg: str = "J44.9") -> Column:
    return F.when(icd.startswith(pos), 1).when(icd.startswith(neg), 0)


def flag_label(flag: Column) -> Column:
    """Doctor's flag equal to 1; a missing flag counts as 0."""
    return F.coalesce((flag == 1).cast("int"), F.lit(0))


def keyword_label(text: Column, terms: Sequence[str] = NSFC_TERMS) -> Column:
    return any_of(text, terms).cast("int")


def _words(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def acute_rule(text: Column, reach: int = 6, exclude_term_from_window: bool = False, all_occurrences: bool = False) -> Column:
    """Note of the first acute hit in a text column, null without one.

    An acute term hits by itself; a chronic term needs a modifier within ``reach`` characters of its first occurrence.
    By default the window includes the term itself, as the labels in use do. With ``all_occurrences`` a modifier near any
    occurrence of the chronic term counts.
    """
    acute = F.get(F.filter(_words(ACUTE_TERMS), lambda t: text.contains(t)), F.lit(0))

    def near(t, at):
        start = F.greatest(at - reach, F.lit(1))
        middle = F.lit("\u0001") if exclude_term_from_window else t
        return F.concat(F.substring(text, start, at - start), middle, F.substring(text, at + F.length(t), F.lit(reach)))

    # the window of a term is cut out once, then searched for every modifier
    def places(t):
        if all_occurrences:
            return F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.length(t)) == t)
        return F.array(F.instr(text, t))

    windows = F.flatten(F.transform(F.filter(_words(CHRONIC_TERMS), lambda t: text.contains(t)), lambda t: F.transform(
        places(t), lambda at: F.struct(t.alias("t"), near(t, at).alias("w")))))
    pairs = F.transform(windows, lambda s: F.struct(s["t"].alias("t"), F.get(F.filter(_words(MODIFIERS), lambda m: s["w"].contains(m)), F.lit(0)).alias("m")))
    first = F.get(F.filter(pairs, lambda p: p["m"].isNotNull()), F.lit(0))
    return F.coalesce(F.concat(F.lit("急性关键词: "), acute), F.concat(F.lit("慢性词+修饰: "), first["t"], F.lit("+"), first["m"]))


def comorbidity_rule(*cols: Column) -> Column:
    """Longest matching cardiovascular term over all diagnosis columns, null without one."""
    text = F.concat_ws(" ", *cols)
    terms = sorted(set(ACUTE_TERMS + CHRONIC_TERMS + COMORBIDITY_TERMS), key=lambda t: (-len(t), t))
    hit = F.get(F.filter(_words(terms), lambda t: text.contains(t)), F.lit(0))
    return F.concat(F.lit("合并症: "), hit)


def troponin_ng_ml(value: Column, unit: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in TNI_UNITS.items() for x in kv])
    return parse_number(value) * F.coalesce(m[F.trim(unit)], F.lit(1.0))


def troponin_rule(value: Column, unit: Column) -> Column:
    return F.coalesce(troponin_ng_ml(value, unit) > TNI_LIMIT, F.lit(False))


def troponin_note(value: Column, unit: Column) -> Column:
    """Note with the value in ng/mL, null without a hit."""
    v = troponin_ng_ml(value, unit)
    return F.when(v > TNI_LIMIT, F.format_string("肌钙蛋白升高(%.3fng/mL)", F.bround(v, 3)))


def bnp_limit(age: Column) -> Column:
    return threshold(parse_number(age), BNP_STEPS, BNP_DEFAULT)


def bnp_rule(value: Column, age: Column) -> Column:
    return F.coalesce(parse_number(value) > bnp_limit(age), F.lit(False))


def bnp_note(value: Column, age: Column) -> Column:
    """Note with the value and the limit of the age, null without a hit."""
    v, limit = parse_number(value), bnp_limit(age)
    return F.when(v > limit, F.format_string("NT-ProBNP升高(%.0f>%.0fpg/mL)", F.bround(v, 0), limit.cast("double")))


def combine_rules(df: DataFrame, note: Column, tni: Column, bnp: Column) -> DataFrame:
    """OR of the text, troponin and NT-proBNP rules, given by their notes (null without a hit), with the notes joined."""
    df = df.withColumns({"_note": note, "_tni": tni, "_bnp": bnp})
    df = df.withColumns({"hit_text": F.col("_note").isNotNull(), "hit_tni": F.col("_tni").isNotNull(), "hit_bnp": F.col("_bnp").isNotNull()})
    label = (F.col("hit_text") | F.col("hit_tni") | F.col("hit_bnp")).cast("int")
    return df.withColumns({"label": label, "note": F.concat_ws(" | ", "_note", "_tni", "_bnp")}).drop("_note", "_tni", "_bnp")


def rule_counts(df: DataFrame) -> DataFrame:
    hits = sum(F.col(c).cast("int") for c in ("hit_text", "hit_tni", "hit_bnp"))
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positive"),
        *[F.count_if(F.col(c)).alias(c) for c in ("hit_text", "hit_tni", "hit_bnp")],
        F.count_if(hits > 1).alias("multi_rule"),
    )


def cohort_rules(diagnosis: Column, flag: Column) -> dict[str, tuple[Column, Column]]:
    """Task -> (membership, label); a null label means "in the cohort, not in the task"."""
    d = F.coalesce(diagnosis, F.lit(""))
    bronch, bcos = starts_any(d, BRONCH_PREFIXES), F.coalesce(flag == 1, F.lit(False))
    everyone = F.lit(True)
    return {
        "NSFC": (everyone, any_of(d, NSFC_TERMS).cast("int")),
        "BCOS_AE": (~(bronch & ~bcos), any_of(d, BCOS_AE_TERMS).cast("int")),
        "PHENO": (~bronch | bcos, bcos.cast("int")),
        "COPD_AE": (~bronch, F.when(d == STABLE_DIAGNOSIS, 0).when(d.contains("急性加重"), 1)),
        "HEMO": (bronch, F.when(d.isin(*PLAIN_BRONCH_DIAGNOSES) | d.contains("合并感染"), 0)
                 .when(d.contains(HEMOPTYSIS), 1)),
        "AE_CAUSE": (d.isin(*ACUTE_COPD_DIAGNOSES), any_of(d, INFECTION_TERMS).cast("int")),
    }


def task_registry(diagnosis: Column, icd: Column, flag: Column, acute: Column, comorbid: Column):
    """All ten tasks as (membership, label) expressions."""
    tasks = {
        "AECOPD": (F.lit(True), icd_label(icd)),
        "COPD_BCOS": (F.lit(True), flag_label(flag)),
        "J440_VS_J449": (F.lit(True), icd_contrast(icd)),
        **cohort_rules(diagnosis, flag),
        "CVD_ACUTE": (F.lit(True), acute.isNotNull().cast("int")),
        "CVD_COMORBID": (F.lit(True), comorbid.isNotNull().cast("int")),
    }
    return tasks


def label_table(df: DataFrame, ids: Sequence[str], tasks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One pass over the sheet -> (ids, task, y) for members of every task."""
    items = F.array(*[F.struct(F.lit(t).alias("task"), m.alias("member"), y.cast("int").alias("y"))
                      for t, (m, y) in tasks.items()])
    return df.select(*ids, F.explode(items).alias("_t")).where("_t.member").select(*ids, "_t.task", "_t.y")


def cohort_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("task").agg(
        F.count("*").alias("members"), F.count_if(F.col("y") == 1).alias("positive"),
        F.count_if(F.col("y") == 0).alias("negative"), F.count_if(F.col("y").isNull()).alias("unlabelled"),
    )


def term_frequency(df: DataFrame, patient: str, cols: Sequence[str], terms: Sequence[str] = SCAN_TERMS) -> DataFrame:
    """Hits per term over all text columns and patients with the term. Terms are matched in one pass per text."""
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.col("_text").contains(t))
    texts = df.select(patient, F.explode(F.array(*[F.col(c) for c in cols])).alias("_text")).where("_text is not null")
    found = texts.select(patient, F.explode(hits).alias("term"))
    # one row per (term, patient) first: a term or a patient with most hits is combined before it moves
    return (
        found.groupBy("term", patient).agg(F.count("*").alias("_n"))
        .groupBy("term").agg(F.sum("_n").alias("hits"), F.count("*").alias("patients"))
    )


def diagnosis_distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def label_summary(labels: DataFrame, icd: str = "icd") -> DataFrame:
    """Counts per (cohort, task) with subtotals."""
    c = F.col(icd)
    return labels.rollup("cohort", "task").agg(
        F.count("*").alias("n"), F.count_if(c.startswith("J44")).alias("j44"), F.count_if(c.startswith("J47")).alias("j47"),
        F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative"),
        F.avg(F.col("y").cast("double")).alias("rate"),
    )


def select_series(series: DataFrame, patient: str, description: str, slices: str, name: str, mark: str = "+C") -> DataFrame:
    """Series per patient: contrast first, then most slices, then name."""
    order = F.struct(
        (~F.coalesce(F.col(description).contains(mark), F.lit(False))).alias("a"), (-F.col(slices)).alias("b"), F.col(name).alias("c")
    )
    return series.groupBy(patient).agg(
        F.min_by(F.struct(F.col(name).alias("series"), F.col(slices).alias("slices"), F.col(description).alias("description")), order)
        .alias("s")
    ).select(patient, "s.series", "s.slices", "s.description")


def example_patients(df: DataFrame, cls: str, patient: str, preferred: Column, n: int) -> DataFrame:
    """First ``n`` patients per class, preferred ones first (a rank filter Spark turns into a partial top-n)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(cls).orderBy(preferred.cast("int").desc(), F.col(patient))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
