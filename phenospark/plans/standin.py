"""Cohort tables derived from the given star-schema tables.

The tables at hand hold orders and documents, not scans. Each stand-in reshapes whole given tables into one of the
layers the operators work on (facts, branches, voxels, clinical sheets, survival, predictions), so the work of every
query grows with its input. The shaping SQL is plain enough to run on both engines; ``cte`` gives it to the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from phenospark.operators.keys import to_long
from phenospark.sources.sinks import scratch_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# Feature names of the stand-in catalogue, written the way feature records name them.
FEATURES = {
    "lung_vessels::original_firstorder_Energy": "o.s_tp / 1e2",
    "lung_vessels::original_firstorder_Mean": "o.s_tp / (1e2 * o.n_o)",
    "aorta::wavelet-LLH_glcm_Contrast": "l.s_qty / (1e0 * l.n_l)",
    "heart::log-sigma-1-0-mm-3D_glrlm_ShortRunEmphasis": "l.s_disc / (1e2 * l.n_l)",
    "heart::original_shape_Sphericity": "l.s_tax / (1e2 * l.n_l)",
    "liver::original_firstorder_Median": "l.m_qty / 1e0",
    "Lobe_LLL_LAA950_pct": "l.s_ext / (1e2 * l.n_l)",
    "Lung_Perc15_HU": "o.m_tp / 1e2",
    "Pi10": "o.x_tp / 1e2",
    "TD_ratio_all": "o.n_o / 1e0",
    "Vessel_BV5_pct": "l.n_l / 1e0",
    "CAC_Agatston": "CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal END",
    "EpiFat_Mean_HU": "c.c_acctbal / 1e0",
    "BronchoArtery_Ratio": "l.s_ext / (1e0 * o.s_tp)",
    "info_returned": "l.n_r / 1e0",
}

WIDE = """
SELECT c.c_custkey AS patient_id, r.r_name AS cohort,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 2 WHEN c.c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS label3,
       %s
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_o, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS s_tp,
                  min(CAST(round(o_totalprice * 100) AS BIGINT)) AS m_tp,
                  max(CAST(round(o_totalprice * 100) AS BIGINT)) AS x_tp
           FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_l, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s_qty,
                  max(CAST(l_quantity AS BIGINT)) AS m_qty,
                  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS s_disc,
                  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS s_tax,
                  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s_ext,
                  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_r
           FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey) l ON l.o_custkey = c.c_custkey
"""


def _wide(quote: str) -> str:
    return WIDE % ",\n       ".join(f"{e} AS {quote}{f}{quote}" for f, e in FEATURES.items())


# Diagnosis texts of the stand-in clinical sheet.
DIAGNOSES = ("慢性阻塞性肺疾病急性加重", "慢性阻塞性肺疾病", "支气管扩张伴咯血", "支气管扩张症", "急性心肌梗死",
             "支气管扩张合并感染", "慢性阻塞性肺病伴有急性加重", "慢性支气管炎合并肺部感染",
             "慢性阻塞性肺疾病伴急性下呼吸道感染", "心力衰竭", "细支气管扩张症", "冠心病 房颤加重", "高血压病")
OTHERS = ("无", "心衰病史多年，后因外伤住院治疗现感冒急性起病", "冠心病", "肺源性心脏病 心律失常", "急性冠脉综合征",
          "心房颤动", "心绞痛发作")
ICDS = ("J44.000", "J44.100", "J44.900", "J44.801", "J47.x00", "J45.901")


def _pick(expr: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {whens} ELSE '{values[-1]}' END"


CLINICAL = f"""
SELECT o_orderkey AS k,
       CASE o_orderkey % 4 WHEN 0 THEN lpad(CAST(o_orderkey AS STRING), 10, '0')
            WHEN 1 THEN CAST(o_orderkey AS STRING) || '.0'
            WHEN 2 THEN ' ' || CAST(o_orderkey AS STRING) || ' ' ELSE CAST(o_orderkey AS STRING) END AS raw_id,
       {_pick('o_orderkey % 13', DIAGNOSES)} AS main_diagnosis,
       {_pick('o_custkey % 7', OTHERS)} AS other_diagnosis,
       CASE WHEN o_orderpriority = '1-URGENT' THEN '突发胸痛伴心绞痛' WHEN o_orderpriority = '5-LOW' THEN NULL
            ELSE '咳嗽咳痰' END AS complaint,
       {_pick('o_custkey % 6', ICDS)} AS icd,
       CASE o_orderkey % 6 WHEN 0 THEN '<0.01' WHEN 1 THEN '/' WHEN 2 THEN '无'
            WHEN 3 THEN '1,' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0')
            ELSE CAST((o_custkey % 97) / 1e3 AS STRING) END AS tni,
       CASE o_custkey % 4 WHEN 0 THEN 'ng/mL' WHEN 1 THEN 'ng/L' WHEN 2 THEN 'μg/L' ELSE 'x' END AS tni_unit,
       CASE WHEN o_orderkey % 5 = 0 THEN '/' ELSE CAST(o_custkey % 2500 AS STRING) END AS bnp,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(20 + o_orderkey % 70 AS STRING) END AS age,
       CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 5 AS STRING) || '.5包/天' WHEN 1 THEN '/'
            WHEN 2 THEN CAST(o_custkey % 4 AS STRING) || '两/日' ELSE NULL END AS smoking,
       CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS flag,
       o_custkey AS person, o_orderpriority AS cohort, o_orderdate AS admitted
FROM {{orders}}
"""

BRANCH = """
SELECT l_suppkey AS patient_id, l_linenumber AS generation,
       l_orderkey * 8 + l_linenumber AS id,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_orderkey END AS children_1,
       CASE WHEN l_returnflag IN ('R', 'A') THEN NULL ELSE l_partkey END AS children_2,
       CAST(l_partkey % 40 + 1 AS DOUBLE) AS stats_arclength, CAST(l_partkey % 30 + 1 AS DOUBLE) AS stats_euclength,
       l_discount * 2e2 AS stats_change_deg, l_discount * 3e2 AS stats_parent_deg, l_tax * 5e2 AS stats_sibling_deg,
       1e0 + l_tax AS stats_tortuosity,
       l_extendedprice / 1e3 AS LumenArea_mm2, l_extendedprice / 2e3 AS WallArea_mm2,
       l_discount * 5e2 + 4e1 AS WA_pct, l_quantity / 1e1 AS Inner_Diameter_mm,
       CASE WHEN l_quantity = 1 THEN 0e0 ELSE l_quantity / 1e1 + 1e0 + l_tax * 2e1 END AS Outer_Diameter_mm,
       l_tax * 1e1 + 5e-1 AS Wall_Thickness_mm,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / 2e0 END AS Pi_Perimeter_mm,
       sqrt(l_extendedprice / 2e3) AS Sqrt_WallArea
FROM {lineitem}
"""

# The 16 structures every patient should have.
ROIS = ("lung_upper_lobe_left", "lung_lower_lobe_left", "lung_upper_lobe_right", "lung_middle_lobe_right",
        "lung_lower_lobe_right", "lung_vessels", "lung_trachea_bronchia", "heart", "heart_myocardium",
        "heart_atrium_left", "heart_atrium_right", "heart_ventricle_left", "heart_ventricle_right", "aorta",
        "pulmonary_artery", "trachea")

# One scanned volume per supplier. hu is the largest of the lines that fall on a voxel.
CT = """
SELECT l_suppkey AS patient_id, CAST(l_quantity AS INT) % 12 AS z, CAST(l_orderkey % 16 AS INT) AS y,
       CAST(l_partkey % 16 AS INT) AS x,
       CAST(max(CAST(floor(l_extendedprice) AS INT) % 1500 - 1024) AS INT) AS hu
FROM {lineitem} GROUP BY 1, 2, 3, 4
"""
MASK = f"""
SELECT DISTINCT l_suppkey AS patient_id,
       {_pick("(l_linenumber * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) % 16", ROIS)} AS roi,
       CAST(l_quantity AS INT) % 12 AS z, CAST(l_orderkey % 16 AS INT) AS y, CAST(l_partkey % 16 AS INT) AS x
FROM {{lineitem}}
"""
META = """
SELECT s_suppkey AS patient_id, 0.5e0 + (s_suppkey % 3) / 4e0 AS dx, 0.5e0 + (s_suppkey % 3) / 4e0 AS dy,
       1e0 + (s_suppkey % 2) AS dz, 16 AS nx, 16 AS ny, 16 AS nz
FROM {supplier}
"""
# A sparser one: centre-line voxels, one 24^3 grid per supplier.
SKELETON = """
SELECT DISTINCT l_suppkey AS patient_id, CAST((CAST(l_quantity AS BIGINT) * 3 + l_linenumber) % 24 AS INT) AS z,
       CAST(l_orderkey % 24 AS INT) AS y, CAST(l_partkey % 24 AS INT) AS x
FROM {lineitem}
"""
OOF = """
SELECT o_orderkey AS patient_id, o_orderpriority AS cohort, CAST(o_custkey % 5 AS INT) AS fold,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
       CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS label3,
       round(o_totalprice / (o_totalprice + 2.5e5), 3) AS proba,
       CASE WHEN o_totalprice / (o_totalprice + 2.5e5) >= 0.5e0 THEN 1 ELSE 0 END AS pred
FROM {orders}
"""
SURV = """
SELECT o_orderkey AS patient_id, o_orderpriority AS grp, CAST(%s AS BIGINT) AS time,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS status,
       o_totalprice / 1e5 AS x1, (o_custkey %% 10) / 1e1 AS x2, (o_orderkey %% 7) / 1e1 AS x3
FROM {orders}
"""

_SQL = {
    "wide": _wide('"'),
    "fact": "SELECT patient_id, cohort, y, label3, feature, value FROM (SELECT * FROM wide) "
            "UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(f'"{f}"' for f in FEATURES) + "))",
    "obs": "SELECT * FROM fact WHERE value IS NOT NULL",
    "clinical": CLINICAL, "branch": BRANCH, "ct": CT, "mask": MASK, "meta": META, "skeleton": SKELETON, "oof": OOF,
    "surv": SURV % "date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02')",
}
_NEEDS = {"fact": ["wide"], "obs": ["wide", "fact"]}


def cte(names: str, body: str) -> str:
    """``WITH`` prefix for the oracle from stand-in names, followed by ``body``."""
    order: list[str] = []
    for n in names.split():
        order += [d for d in _NEEDS.get(n, []) if d not in order] + ([n] if n not in order else [])
    parts = [f"{n} AS ({_SQL[n].format(**{t: t for t in TABLES})})" for n in order]
    body = body.lstrip().lstrip("+")  # "+, more AS (...)" continues the WITH list
    head = "WITH RECURSIVE " if "RECURSE" in body else "WITH "
    return head + ", ".join(parts) + " " + body.replace("/*RECURSE*/", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark, sf_dir, sql: str) -> DataFrame:
    used = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def wide(spark, sf_dir):
    return _run(spark, sf_dir, _wide("`"))


_FACTS: dict[tuple[str, str], str] = {}


def fact(spark, sf_dir):
    """The long fact layer. It is the one layer that is stored: written once per session as Parquet in the shared folder,
    as a cohort keeps its facts, and read back by every query (with column pruning and a pushed filter on ``feature``)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        path = scratch_dir(spark, "fact")
        to_long(wide(spark, sf_dir), ["patient_id", "cohort", "y", "label3"], list(FEATURES)).write.parquet(path)
        _FACTS[key] = path
    return spark.read.schema("patient_id BIGINT, cohort STRING, y INT, label3 INT, feature STRING, value DOUBLE").parquet(_FACTS[key])


def obs(spark, sf_dir):
    return fact(spark, sf_dir).where("value IS NOT NULL")


def clinical(spark, sf_dir):
    return _run(spark, sf_dir, CLINICAL)


def branch(spark, sf_dir):
    return _run(spark, sf_dir, BRANCH)


def ct(spark, sf_dir):
    return _run(spark, sf_dir, CT)


def mask(spark, sf_dir):
    return _run(spark, sf_dir, MASK)


def meta(spark, sf_dir):
    return _run(spark, sf_dir, META)


def skeleton(spark, sf_dir):
    return _run(spark, sf_dir, SKELETON)


def oof(spark, sf_dir):
    return _run(spark, sf_dir, OOF)


def surv(spark, sf_dir):
    return _run(spark, sf_dir, SURV % "datediff(DATE '2001-08-02', CAST(o_orderdate AS DATE))")
