"""Queries over the feature catalogue and the label rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.operators import catalog as G
from phenospark.operators import rules as C
from phenospark.plans import standin as S
from phenospark.plans.q_tables import NUM_SQL
from phenospark.plans.registry import query


def _starts(prefixes, c="feature"):
    return "(" + " OR ".join(f"starts_with({c}, '{p}')" for p in prefixes) + ")"


def _has(words, c="feature"):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _features(spark, sf):
    return S.fact(spark, sf).select("feature").distinct()


FS = "+, fs AS (SELECT DISTINCT feature FROM fact) "


@query("G-01", S.cte("fact", f"SELECT feature, count(value) AS n FROM fact WHERE NOT starts_with(feature, 'info_') AND "
                            f"(contains(feature, '::') OR {_starts(G.FEATURE_PREFIXES)}) GROUP BY 1"))
def g_features(spark, sf):
    return S.fact(spark, sf).where(G.is_feature(F.col("feature"))).groupBy("feature").agg(F.count("value").alias("n"))


BLOCK_SQL = ("CASE WHEN starts_with(feature, 'Vessel_') THEN 'vessel' WHEN starts_with(feature, 'Lobe_') OR starts_with(feature, 'Lung_') "
             f"THEN 'lobe/lung' WHEN {_starts(G.AIRWAY_PREFIXES)} AND NOT contains(feature, '::') THEN 'airway' "
             "WHEN contains(feature, '::') THEN 'radiomics' ELSE 'other' END")


@query("G-02", S.cte("fact", f"SELECT {BLOCK_SQL} AS block, count(DISTINCT feature) AS features, count(value) AS n_values FROM fact GROUP BY 1"))
def g_blocks(spark, sf):
    return S.fact(spark, sf).groupBy(G.feature_block(F.col("feature")).alias("block")).agg(
        F.count_distinct("feature").alias("features"), F.count("value").alias("n_values"))


@query("G-03", S.cte("fact", FS + f"""SELECT feature, CASE WHEN contains(feature, '::') THEN 'rad' WHEN {_starts(G.AIRWAY_PREFIXES)} THEN 'aq'
 WHEN {_starts(G.RADIOMICS_EXTRA)} THEN 'rad' END AS airway_first,
 CASE WHEN contains(feature, '::') OR {_starts(G.RADIOMICS_EXTRA)} THEN 'rad' ELSE 'aq' END AS extra_first FROM fs"""))
def g_split(spark, sf):
    f = F.col("feature")
    return _features(spark, sf).select("feature", G.split_family(f).alias("airway_first"), G.split_family(f, "extra_first").alias("extra_first"))


FAMILY_SQL = """CASE WHEN contains(feature, '::') THEN
 (CASE WHEN split_part(feature, '::', 1) IN ('lung_vessels','heart_myocardium','pulmonary_artery','aorta','trachea') THEN split_part(feature, '::', 1)
       ELSE split_part(split_part(feature, '::', 1), '_', 1) END) || '::' ||
 (CASE WHEN contains(split_part(feature, '::', 2), 'original') THEN 'original' WHEN contains(split_part(feature, '::', 2), 'wavelet') THEN 'wavelet'
       WHEN contains(split_part(feature, '::', 2), 'log-sigma') THEN 'log-sigma' ELSE 'other' END) || '::' ||
 (CASE WHEN contains(lower(feature), 'glcm') THEN 'glcm' WHEN contains(lower(feature), 'glrlm') THEN 'glrlm' WHEN contains(lower(feature), 'glszm') THEN 'glszm'
       WHEN contains(lower(feature), 'ngtdm') THEN 'ngtdm' WHEN contains(lower(feature), 'firstorder') THEN 'firstorder' ELSE 'shape' END)
 ELSE (CASE """ + " ".join(f"WHEN contains(lower(feature), '{k}') THEN '{k}'" for k in
                           ("vessel", "fractal", "bv", "pi10", "tortuosity", "td", "blur", "wall", "wa_", "lobe")) + " ELSE 'other' END) END"


@query("G-04", S.cte("fact", FS + f"SELECT {FAMILY_SQL} AS family, count(*) AS n FROM fs GROUP BY 1"))
def g_family(spark, sf):
    return _features(spark, sf).groupBy(G.feature_family(F.col("feature")).alias("family")).agg(F.count("*").alias("n"))


@query("G-05", S.cte("fact", FS + """, g AS (SELECT CASE WHEN regexp_matches(feature, 'firstorder_(TotalEnergy|Energy)(_|$)') THEN 'i'
 WHEN contains(feature, 'shape_') THEN 's' WHEN regexp_matches(feature, '_(glcm|glrlm|glszm|gldm|ngtdm)_') THEN 't'
 WHEN contains(feature, 'firstorder_') THEN 'f' ELSE 'x' END AS g FROM fs)
 SELECT count(*) FILTER (g = 'i') AS intensity, count(*) FILTER (g = 's') AS shape, count(*) FILTER (g = 't') AS texture,
 count(*) FILTER (g = 'f') AS firstorder_other, count(*) FILTER (g = 'x') AS structural FROM g"""))
def g_composition(spark, sf):
    return G.feature_composition(_features(spark, sf))


def _meaning(i, other):
    return "CASE " + " ".join(f"WHEN regexp_matches(feature, '{m[0]}') THEN '{m[i]}'" for m in G.MEANINGS) + f" ELSE '{other}' END"


@query("G-06", S.cte("fact", FS + f"SELECT feature, {_meaning(1, '其它')} AS category, {_meaning(2, '—')} AS direction FROM fs"))
def g_meaning(spark, sf):
    cat, way = G.clinical_meaning(F.col("feature"))
    return _features(spark, sf).select("feature", cat.alias("category"), way.alias("direction"))


STANDARD = "SELECT feature FROM obs WHERE cohort = 'ASIA' AND feature NOT LIKE 'liver%' AND feature NOT LIKE 'info%' AND feature NOT LIKE 'heart%'"


@query("G-07", S.cte("obs", f"+, std AS ({STANDARD}) SELECT cohort, feature, count(*) AS n FROM obs WHERE feature IN (SELECT feature FROM std) GROUP BY 1, 2"))
def g_align(spark, sf):
    o = S.obs(spark, sf)
    std = o.where("cohort = 'ASIA' AND feature NOT LIKE 'liver%' AND feature NOT LIKE 'info%' AND feature NOT LIKE 'heart%'")
    return G.align_to_standard(o, std).groupBy("cohort", "feature").agg(F.count("*").alias("n"))


@query("G-07b", S.cte("obs", f"""+, std AS ({STANDARD}) SELECT split_part(feature, '::', 1) AS block, count(DISTINCT feature) AS dropped,
 count(DISTINCT CASE WHEN NOT {_has(G.CHEST_KEYWORDS)} THEN feature END) AS non_chest
 FROM obs WHERE feature NOT IN (SELECT feature FROM std) GROUP BY 1"""))
def g_drops(spark, sf):
    o = S.obs(spark, sf)
    std = o.where("cohort = 'ASIA' AND feature NOT LIKE 'liver%' AND feature NOT LIKE 'info%' AND feature NOT LIKE 'heart%'")
    return G.alignment_drops(o, std)


@query("G-08", S.cte("fact", FS + f"""SELECT feature, CASE WHEN contains(feature, 'LAA') THEN 'LAA' WHEN contains(feature, 'Perc15') THEN 'Perc15'
 WHEN {_starts(('Pi10', 'WA_', 'TD_', 'wall_', 'blur_', 'Din_', 'Dout_'))} THEN 'airway' WHEN starts_with(feature, 'Vessel_') THEN 'vessel'
 WHEN starts_with(feature, 'Lobe_') THEN 'lobe' WHEN starts_with(feature, 'Lung_') THEN 'lung' ELSE 'other' END AS grp
 FROM fs WHERE {_has(G.CLINICAL_KEYWORDS)}"""))
def g_clinical(spark, sf):
    return G.clinical_features(_features(spark, sf))


@query("G-09", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '2026-01' WHEN 'MACHINERY' THEN '2026-02' ELSE c_mktsegment END AS cohort FROM customer")
def g_rename(spark, sf):
    return S.table(spark, sf, "customer").select(
        "c_custkey", G.rename_cohort(F.col("c_mktsegment"), {"BUILDING": "2026-01", "MACHINERY": "2026-02"}).alias("cohort"))


RAWS = "('" + "','".join(f for fs in G.COMPOSITES.values() for f in fs) + "')"
SCORE_OF = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{s}'" for s, fs in G.COMPOSITES.items() for f in fs) + " END"


@query("G-10", S.cte("fact", f"""+, st AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM fact GROUP BY 1)
 SELECT patient_id, feature, value FROM (
 SELECT patient_id, feature, value FROM fact WHERE feature NOT IN {RAWS}
 UNION ALL SELECT patient_id, {SCORE_OF} AS f, round(sum((value - m) / s), 5) FROM fact JOIN st USING (feature) WHERE feature IN {RAWS} GROUP BY 1, 2)"""))
def g_composites(spark, sf):
    f = S.fact(spark, sf).select("patient_id", "feature", "value")
    return G.composite_scores(f).withColumn(
        "value", F.when(F.col("feature").isin(*G.COMPOSITES), F.round("value", 5)).otherwise(F.col("value")))


# ---- labels ------------------------------------------------------------------------------------------------------------

def _any(c, terms):
    return f"coalesce({_has(terms, c)}, FALSE)"


ICD_SQL = "CASE WHEN icd LIKE 'J44.1%' OR icd LIKE 'J44.0%' THEN 1 WHEN icd LIKE 'J44.9%' OR icd LIKE 'J44.8%' THEN 0 END"


@query("C-01", S.cte("clinical", f"SELECT icd, {ICD_SQL} AS label, count(*) AS n FROM clinical GROUP BY 1, 2"))
def c_icd(spark, sf):
    return S.clinical(spark, sf).groupBy("icd", C.icd_label(F.col("icd")).alias("label")).agg(F.count("*").alias("n"))


@query("C-02", S.cte("clinical", "SELECT k, CASE WHEN icd LIKE 'J44.0%' THEN 1 WHEN icd LIKE 'J44.9%' THEN 0 END AS label FROM clinical WHERE icd LIKE 'J44.0%' OR icd LIKE 'J44.9%'"))
def c_contrast(spark, sf):
    return S.clinical(spark, sf).select("k", C.icd_contrast(F.col("icd")).alias("label")).where("label is not null")


@query("C-03", S.cte("clinical", "SELECT k, CASE WHEN flag = 1 THEN 1 ELSE 0 END AS label FROM clinical"))
def c_flag(spark, sf):
    return S.clinical(spark, sf).select("k", C.flag_label(F.col("flag")).alias("label"))


DOC_TERMS = ("heth", "tion", "eaux", "ung", "ción")


@query("C-04", f"SELECT doc_id, CASE WHEN {_has(DOC_TERMS, 'text')} THEN 1 ELSE 0 END AS label FROM documents")
def c_keyword(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", C.keyword_label(F.col("text"), DOC_TERMS).alias("label"))


TEXT_SQL = "coalesce(main_diagnosis, '') || ' ' || coalesce(other_diagnosis, '') || ' ' || coalesce(complaint, '')"


def _acute_sql(t):
    out = ["CASE"] + [f"WHEN contains({t}, '{w}') THEN '急性关键词: {w}'" for w in C.ACUTE_TERMS]
    for w in C.CHRONIC_TERMS:
        win = f"substr({t}, greatest(strpos({t}, '{w}') - 6, 1), strpos({t}, '{w}') + {len(w)} + 6 - greatest(strpos({t}, '{w}') - 6, 1))"
        out += [f"WHEN strpos({t}, '{w}') > 0 AND contains({win}, '{m}') THEN '慢性词+修饰: {w}+{m}'" for m in C.MODIFIERS]
    return " ".join(out) + " END"


def _text(df):
    return df.withColumn("t", F.concat_ws(" ", F.coalesce("main_diagnosis", F.lit("")), F.coalesce("other_diagnosis", F.lit("")),
                                          F.coalesce("complaint", F.lit(""))))


@query("C-05", S.cte("clinical", f"+, x AS (SELECT k, {TEXT_SQL} AS t FROM clinical) SELECT k, {_acute_sql('t')} AS note FROM x"))
def c_acute(spark, sf):
    return _text(S.clinical(spark, sf)).select("k", C.acute_rule(F.col("t")).alias("note"))


COMORB = sorted(set(C.ACUTE_TERMS + C.CHRONIC_TERMS + C.COMORBIDITY_TERMS), key=lambda t: (-len(t), t))
COMORB_SQL = "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '合并症: {w}'" for w in COMORB) + " END"


def _near_sql(t: str) -> str:
    """First modifier near any occurrence of a chronic term."""
    at = f"list_filter(range(1, length(t) + 1), lambda i: substring(t, i, {len(t)}) = '{t}')"
    win = f"list_transform({at}, lambda i: substring(t, greatest(i - 6, 1), i - greatest(i - 6, 1) + {len(t) + 6}))"
    mods = "[" + ", ".join(f"'{m}'" for m in C.MODIFIERS) + "]"
    return f"list_filter(list_transform({win}, lambda w: list_filter({mods}, lambda m: contains(w, m))[1]), lambda m: m IS NOT NULL)[1]"


NEAR_SQL = "CASE " + " ".join(f"WHEN contains(t, '{a}') THEN '急性关键词: {a}'" for a in C.ACUTE_TERMS) + " ELSE coalesce(" + ", ".join(
    f"'慢性词+修饰: {c}+' || {_near_sql(c)}" for c in C.CHRONIC_TERMS) + ") END"


@query("C-05b", S.cte("clinical", f"+, x AS (SELECT k, {TEXT_SQL} AS t FROM clinical) SELECT k, {NEAR_SQL} AS note FROM x"))
def c_acute_all(spark, sf):
    return _text(S.clinical(spark, sf)).select("k", C.acute_rule(F.col("t"), all_occurrences=True).alias("note"))


@query("C-06", S.cte("clinical", f"+, x AS (SELECT k, main_diagnosis || ' ' || other_diagnosis AS t FROM clinical) SELECT k, {COMORB_SQL} AS note FROM x"))
def c_comorbid(spark, sf):
    return S.clinical(spark, sf).select("k", C.comorbidity_rule(F.col("main_diagnosis"), F.col("other_diagnosis")).alias("note"))


TNI_SQL = f"{NUM_SQL.format('tni')} * CASE tni_unit WHEN 'ng/L' THEN 0.001e0 ELSE 1e0 END"
BNP_LIMIT_SQL = "CASE WHEN CAST(age AS DOUBLE) <= 50 THEN 450e0 WHEN CAST(age AS DOUBLE) <= 75 THEN 900e0 WHEN CAST(age AS DOUBLE) <= 200 THEN 1800e0 ELSE 450e0 END"
BNP_SQL = f"{NUM_SQL.format('bnp')} > {BNP_LIMIT_SQL}"
TNI_NOTE_SQL = f"CASE WHEN {TNI_SQL} > 0.047e0 THEN '肌钙蛋白升高(' || format('{{:.3f}}', {TNI_SQL}) || 'ng/mL)' END"
BNP_NOTE_SQL = f"CASE WHEN {BNP_SQL} THEN 'NT-ProBNP升高(' || format('{{:.0f}}', {NUM_SQL.format('bnp')}) || '>' || format('{{:.0f}}', {BNP_LIMIT_SQL}) || 'pg/mL)' END"


@query("C-07", S.cte("clinical", f"SELECT k, round({TNI_SQL}, 9) AS ng_ml, coalesce({TNI_SQL} > 0.047e0, FALSE) AS hit, {TNI_NOTE_SQL} AS note FROM clinical"))
def c_troponin(spark, sf):
    return S.clinical(spark, sf).select("k", F.round(C.troponin_ng_ml(F.col("tni"), F.col("tni_unit")), 9).alias("ng_ml"),
                                        C.troponin_rule(F.col("tni"), F.col("tni_unit")).alias("hit"), C.troponin_note(F.col("tni"), F.col("tni_unit")).alias("note"))


@query("C-08", S.cte("clinical", f"SELECT k, coalesce({BNP_SQL}, FALSE) AS hit, {BNP_NOTE_SQL} AS note FROM clinical"))
def c_bnp(spark, sf):
    return S.clinical(spark, sf).select("k", C.bnp_rule(F.col("bnp"), F.col("age")).alias("hit"), C.bnp_note(F.col("bnp"), F.col("age")).alias("note"))


RULES_CTE = f"""+, x AS (SELECT *, {TEXT_SQL} AS t FROM clinical),
 h AS (SELECT k, {_acute_sql('t')} AS note, coalesce({TNI_SQL} > 0.047e0, FALSE) AS hit_tni, coalesce({BNP_SQL}, FALSE) AS hit_bnp, {TNI_NOTE_SQL} AS note_tni, {BNP_NOTE_SQL} AS note_bnp FROM x)"""


def _combined(spark, sf):
    return C.combine_rules(_text(S.clinical(spark, sf)), C.acute_rule(F.col("t")),
                           C.troponin_note(F.col("tni"), F.col("tni_unit")), C.bnp_note(F.col("bnp"), F.col("age")))


@query("C-09", S.cte("clinical", RULES_CTE + """ SELECT k, CASE WHEN note IS NOT NULL OR hit_tni OR hit_bnp THEN 1 ELSE 0 END AS label,
 concat_ws(' | ', note, note_tni, note_bnp) AS note FROM h"""))
def c_combined(spark, sf):
    return _combined(spark, sf).select("k", "label", "note")


@query("C-09b", S.cte("clinical", RULES_CTE + """ SELECT count(*) AS n, count(*) FILTER (note IS NOT NULL OR hit_tni OR hit_bnp) AS positive,
 count(*) FILTER (note IS NOT NULL) AS hit_text, count(*) FILTER (hit_tni) AS hit_tni, count(*) FILTER (hit_bnp) AS hit_bnp,
 count(*) FILTER ((note IS NOT NULL)::INT + hit_tni::INT + hit_bnp::INT > 1) AS multi_rule FROM h"""))
def c_rule_counts(spark, sf):
    return C.rule_counts(_combined(spark, sf))


def _cohort_sql():
    d = "coalesce(main_diagnosis, '')"
    bronch, bcos = _starts(C.BRONCH_PREFIXES, d), "coalesce(flag = 1, FALSE)"
    lst = lambda v: "('" + "','".join(v) + "')"
    return {
        "NSFC": ("TRUE", f"CASE WHEN {_any(d, C.NSFC_TERMS)} THEN 1 ELSE 0 END"),
        "BCOS_AE": (f"NOT ({bronch} AND NOT {bcos})", f"CASE WHEN {_any(d, C.BCOS_AE_TERMS)} THEN 1 ELSE 0 END"),
        "PHENO": (f"NOT {bronch} OR {bcos}", f"CASE WHEN {bcos} THEN 1 ELSE 0 END"),
        "COPD_AE": (f"NOT {bronch}", f"CASE WHEN {d} = '{C.STABLE_DIAGNOSIS}' THEN 0 WHEN contains({d}, '急性加重') THEN 1 END"),
        "HEMO": (bronch, f"CASE WHEN {d} IN {lst(C.PLAIN_BRONCH_DIAGNOSES)} OR contains({d}, '合并感染') THEN 0 WHEN contains({d}, '伴咯血') THEN 1 END"),
        "AE_CAUSE": (f"{d} IN {lst(C.ACUTE_COPD_DIAGNOSES)}", f"CASE WHEN {_any(d, C.INFECTION_TERMS)} THEN 1 ELSE 0 END"),
    }


def _labels_sql(tasks, source="clinical"):
    return " UNION ALL ".join(f"SELECT k, cohort, icd, '{t}' AS task, {y} AS y FROM {source} WHERE {m}" for t, (m, y) in tasks.items())


COUNTS_SQL = ("SELECT task, count(*) AS members, count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS negative, "
              "count(*) FILTER (y IS NULL) AS unlabelled FROM l GROUP BY 1")


@query("C-10", S.cte("clinical", f"+, l AS ({_labels_sql(_cohort_sql())}) {COUNTS_SQL}"))
def c_cohorts(spark, sf):
    tasks = C.cohort_rules(F.col("main_diagnosis"), F.col("flag"))
    return C.cohort_counts(C.label_table(S.clinical(spark, sf), ["k", "cohort", "icd"], tasks))


ALL_TASKS = {"AECOPD": ("TRUE", ICD_SQL), "COPD_BCOS": ("TRUE", "CASE WHEN flag = 1 THEN 1 ELSE 0 END"),
             "J440_VS_J449": ("TRUE", "CASE WHEN icd LIKE 'J44.0%' THEN 1 WHEN icd LIKE 'J44.9%' THEN 0 END"), **_cohort_sql(),
             "CVD_ACUTE": ("TRUE", "CASE WHEN acute IS NOT NULL THEN 1 ELSE 0 END"),
             "CVD_COMORBID": ("TRUE", "CASE WHEN comorbid IS NOT NULL THEN 1 ELSE 0 END")}
TASKS_CTE = f"""+, t0 AS (SELECT *, {TEXT_SQL} AS t FROM clinical), t1 AS (SELECT *, {_acute_sql('t')} AS acute FROM t0),
 t2 AS (SELECT * EXCLUDE (t), main_diagnosis || ' ' || other_diagnosis AS t FROM t1), c2 AS (SELECT *, {COMORB_SQL} AS comorbid FROM t2),
 l AS ({_labels_sql(ALL_TASKS, 'c2')}) """


def _task_labels(spark, sf):
    c = _text(S.clinical(spark, sf))
    tasks = C.task_registry(F.col("main_diagnosis"), F.col("icd"), F.col("flag"), C.acute_rule(F.col("t")),
                            C.comorbidity_rule(F.col("main_diagnosis"), F.col("other_diagnosis")))
    return C.label_table(c, ["k", "cohort", "icd"], tasks)


@query("C-11", S.cte("clinical", TASKS_CTE + "SELECT k, task, y FROM l"))
def c_tasks(spark, sf):
    return _task_labels(spark, sf).select("k", "task", "y")


@query("C-12", S.cte("clinical", "+, d AS (SELECT person, main_diagnosis AS t FROM clinical UNION ALL SELECT person, other_diagnosis FROM clinical "
                    "UNION ALL SELECT person, complaint FROM clinical), w AS (SELECT unnest(['" + "','".join(C.SCAN_TERMS) + "']) AS term) "
                    "SELECT term, count(*) AS hits, count(DISTINCT person) AS patients FROM d JOIN w ON contains(t, term) GROUP BY 1"))
def c_terms(spark, sf):
    return C.term_frequency(S.clinical(spark, sf), "person", ["main_diagnosis", "other_diagnosis", "complaint"])


@query("C-13", S.cte("clinical", "SELECT main_diagnosis, count(*) AS n FROM clinical WHERE icd LIKE 'J44%' GROUP BY 1"))
def c_distribution(spark, sf):
    return C.diagnosis_distribution(S.clinical(spark, sf).where(F.col("icd").startswith("J44")), "main_diagnosis")


@query("C-14", S.cte("clinical", TASKS_CTE + """SELECT cohort, task, count(*) AS n, count(*) FILTER (icd LIKE 'J44%') AS j44,
 count(*) FILTER (icd LIKE 'J47%') AS j47, count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS negative, round(avg(y), 6) AS rate
 FROM l GROUP BY ROLLUP (cohort, task)"""))
def c_summary(spark, sf):
    return C.label_summary(_task_labels(spark, sf)).withColumn("rate", F.round("rate", 6))


@query("C-15", """SELECT patient_id, series, slices, description FROM (SELECT l_suppkey AS patient_id, 's' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS series,
 CAST(l_quantity AS INTEGER) AS slices, CASE WHEN l_discount > 0.095 THEN 'chest +C' ELSE 'plain' END AS description,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_discount > 0.095 THEN 0 ELSE 1 END, l_quantity DESC,
   's' || l_orderkey || '_' || l_linenumber || '_' || l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def c_series(spark, sf):
    li = S.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("patient_id"), F.expr("concat('s', l_orderkey, '_', l_linenumber, '_', l_partkey)").alias("name"),
        F.col("l_quantity").cast("int").alias("n"), F.when(F.col("l_discount") > 0.095, "chest +C").otherwise("plain").alias("d"))
    return C.select_series(li, "patient_id", "d", "n", "name")


@query("C-16", S.cte("wide", """SELECT y, patient_id, CAST(rank AS INTEGER) AS rank FROM (SELECT y, patient_id, row_number() OVER (PARTITION BY y
 ORDER BY CASE WHEN CAC_Agatston IS NOT NULL THEN 1 ELSE 0 END DESC, patient_id) AS rank FROM wide WHERE Pi10 IS NOT NULL) WHERE rank <= 5"""))
def c_examples(spark, sf):
    w = S.wide(spark, sf).where("Pi10 is not null")
    return C.example_patients(w, "y", "patient_id", F.col("CAC_Agatston").isNotNull(), 5).select("y", "patient_id", "rank")
