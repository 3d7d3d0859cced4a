"""Queries over sources, projections, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenospark.functions.text import normalize_id, parse_amount, parse_number
from phenospark.operators import joins as J
from phenospark.operators import keys as K
from phenospark.plans import standin as S
from phenospark.plans.registry import query
from phenospark.sources import sinks, tables

NORM_ID = ("regexp_replace(regexp_replace(trim({0}), '\\.0+$', ''), '^0+(?=.)', '')")
# RE2 has no lookahead: strip zeros, then give back the single zero of an all-zero id
ID_SQL = ("CASE WHEN regexp_replace(trim({0}), '\\.0+$', '') IN ('', 'nan', 'None') THEN NULL "
          "WHEN regexp_matches(regexp_replace(trim({0}), '\\.0+$', ''), '^0+$') THEN '0' "
          "ELSE ltrim(regexp_replace(trim({0}), '\\.0+$', ''), '0') END")
NUM_SQL = ("CASE WHEN replace(trim({0}), ',', '') IN ('', '/', '无', 'nan', 'None', '<', '>') THEN NULL ELSE "
           "TRY_CAST(regexp_replace(replace(trim({0}), ',', ''), '[<>≤≥]', '', 'g') AS DOUBLE) END")
AMT_SQL = "TRY_CAST(nullif(regexp_extract({0}, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)"


# ---- sources and sinks -------------------------------------------------------------------------------------------

@query("IO-01", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_acctbal FROM customer")
def io_csv(spark, sf):
    path = sinks.scratch_dir(spark, "csv")
    S.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True)
    return tables.read_table_csv(spark, path, "c_custkey STRING, c_name STRING, c_acctbal DOUBLE")


@query("IO-02", "SELECT event_id AS patient_id, 'k' AS feature, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value "
                "FROM events WHERE json_valid(props)")
def io_records(spark, sf):
    parsed = tables.parse_records(S.table(spark, sf, "events"), "props")
    return tables.record_facts(parsed, "event_id").withColumnRenamed("event_id", "patient_id")


INFO_JSON = """to_json(named_struct(
  'Series', array(named_struct('SeriesFolder', '1', 'Instances', 10, 'Patient', named_struct('PatientID', concat(' 00', user_id, ' '))),
                  named_struct('SeriesFolder', cast(user_id % 7 as string), 'Instances', cast(user_id as int), 'Patient', named_struct('PatientID', 'x'))),
  'series_info', named_struct('candidates', array(named_struct('series_info', named_struct('Patient',
      named_struct('PatientID', if(event_type = 'click', '', cast(event_id as string)))))))))"""


@query("IO-03", "SELECT event_id, CASE WHEN event_type = 'click' THEN '00' || user_id ELSE CAST(event_id AS VARCHAR) END AS patient_no, "
                "CAST(CASE WHEN event_type = 'click' THEN user_id ELSE event_id END AS BIGINT) AS patient_num FROM events")
def io_patient_number(spark, sf):
    ev = S.table(spark, sf, "events").select("event_id", F.expr(INFO_JSON).alias("js"))
    info = ev.select("event_id", F.from_json("js", tables.INFO_SCHEMA).alias("info"))
    no = tables.patient_number(F.col("info"))
    return info.select("event_id", no.alias("patient_no"), normalize_id(no).try_cast("bigint").alias("patient_num"))


@query("IO-04", S.cte("branch", "SELECT CAST(patient_id AS VARCHAR) AS patient, count(*) AS n, round(max(WA_pct), 6) AS max_wa, "
                               "max(patient_id * 2) AS num_measured FROM branch GROUP BY 1"))
def io_branches(spark, sf):
    root = sinks.scratch_dir(spark, "branches")
    b = S.branch(spark, sf).withColumn("folder", F.concat(F.col("patient_id"), F.lit("_branches")))
    sinks.write_folders_csv(b.select("folder", "generation", "WA_pct"), root, "folder")
    side = S.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("patient"), (F.col("s_suppkey") * 2).alias("num_measured"))
    df = tables.read_branch_metrics(spark, root, "generation INT, WA_pct DOUBLE", side)
    return df.groupBy("patient").agg(F.count("*").alias("n"), F.round(F.max("WA_pct"), 6).alias("max_wa"),
                                     F.max("num_measured").alias("num_measured"))


@query("IO-05", "SELECT s_suppkey AS patient_folder, min(s_acctbal) AS Pi10 FROM supplier GROUP BY 1")
def io_airway_features(spark, sf):
    root = sinks.scratch_dir(spark, "airway")
    s = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("patient_folder"), F.col("s_acctbal").alias("Pi10"))
    twice = s.unionByName(s.withColumn("Pi10", F.col("Pi10") + 1))
    twice.write.csv(root + "/parts", header=True)
    return tables.read_airway_features(spark, root, "patient_folder BIGINT, Pi10 DOUBLE", "patient_folder", ["Pi10"])


@query("IO-09", "SELECT c_mktsegment, count(*) AS n, CAST(2 AS INTEGER) AS version FROM customer GROUP BY 1")
def io_versions(spark, sf):
    root = sinks.scratch_dir(spark, "versions")
    c = S.table(spark, sf, "customer")
    for v in (1, 2):
        sinks.write_table(c.select("c_mktsegment", F.lit(v).alias("version")), root, f"v{v}")
    return sinks.read_current(spark, root).groupBy("c_mktsegment", "version").agg(F.count("*").alias("n"))


@query("IO-11", "SELECT event_id, user_id % 7 = 1 AS first_flag, TRUE AS second_flag, 'done' AS note FROM events")
def io_annotate(spark, sf):
    ev = S.table(spark, sf, "events").select("event_id", "user_id", F.expr(INFO_JSON).alias("js"))
    rec = tables.annotate_record(F.from_json("js", tables.INFO_SCHEMA), (F.col("user_id") % 7).cast("string"),
                                 F.struct(F.lit("done").alias("note")))
    out = ev.select("event_id", rec.alias("r"))
    return out.select("event_id", F.col("r.Series")[0]["Normalized"].alias("first_flag"),
                      F.col("r.Series")[1]["Normalized"].alias("second_flag"), F.col("r.Normalization.note").alias("note"))


LOG_LINES = """SELECT o_custkey AS file, o_orderkey AS line_no,
 CASE o_orderkey % 4 WHEN 0 THEN '=== task ' || o_orderpriority || ' ===' WHEN 1 THEN 'noise'
      ELSE 'CV AUC = 0.' || CAST(500 + o_orderkey % 400 AS STRING) || ' ± 0.0' || CAST(10 + o_orderkey % 80 AS STRING) END AS text
 FROM {orders}"""


@query("IO-12", f"""WITH l AS ({LOG_LINES.format(orders='orders')}),
 s AS (SELECT *, last_value(nullif(regexp_extract(text, '^=+\\s*(.+?)\\s*=+$', 1), '') IGNORE NULLS)
       OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l)
 SELECT file, line_no, section, CAST(regexp_extract(text, 'AUC = ([0-9.]+)', 1) AS DOUBLE) AS auc,
        CAST(regexp_extract(text, '± ([0-9.]+)', 1) AS DOUBLE) AS sd FROM s WHERE text LIKE 'CV AUC%'""")
def io_logs(spark, sf):
    return tables.mine_run_logs(S._run(spark, sf, LOG_LINES))


@query("IO-13", "SELECT o_custkey AS patient_id, CAST(to_json(list({'feature': 'order' || o_orderkey, 'value': o_orderkey} "
                "ORDER BY 'order' || o_orderkey)) AS VARCHAR) AS record FROM orders GROUP BY 1")
def io_record_json(spark, sf):
    o = S.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("patient_id"), F.concat(F.lit("order"), "o_orderkey").alias("feature"), F.col("o_orderkey").alias("value"))
    return sinks.records_json(o, ["patient_id"], "feature", "value")


@query("IO-14", "SELECT CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'skip' ELSE 'fail' END AS status, count(*) AS n FROM orders GROUP BY 1")
def io_manifest(spark, sf):
    path = sinks.scratch_dir(spark, "manifest")
    st = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "skip").otherwise("fail")
    run = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), st.alias("status"), F.lit(None).cast("string").alias("reason"))
    sinks.append_manifest(run, path)
    return sinks.status_counts(spark.read.schema("item BIGINT, status STRING, reason STRING").parquet(path))


# ---- projections, filters, keys ------------------------------------------------------------------------------------

@query("T-01", S.cte("clinical", f"SELECT k, {ID_SQL.format('raw_id')} AS id FROM clinical"))
def t_ids(spark, sf):
    return S.clinical(spark, sf).select("k", normalize_id("raw_id").alias("id"))


@query("T-04", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey "
               "ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def t_dedup(spark, sf):
    o = S.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return K.dedup_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("T-05", S.cte("clinical", f"""SELECT DISTINCT person, CASE WHEN person % 3 = 0 THEN '00' || person ELSE trim(raw_id) END AS raw,
  TRY_CAST(CASE WHEN person % 3 = 0 THEN CAST(person AS VARCHAR) ELSE {ID_SQL.format('raw_id')} END AS BIGINT) AS num FROM clinical"""))
def t_numeric_id(spark, sf):
    c = S.clinical(spark, sf).select("person", "raw_id")
    meta = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" 00"), "c_custkey")).otherwise("").alias("PatientID"))
    out = K.numeric_id(c, meta, "person", "raw_id")
    return K.id_map(out.select("person", F.col("PatientID_raw").alias("raw"), F.col("PatientID_num").alias("num")), "person", "raw", "num")


@query("T-06", S.cte("clinical", f"SELECT k, {NUM_SQL.format('tni')} AS tni, {NUM_SQL.format('bnp')} AS bnp FROM clinical"))
def t_numbers(spark, sf):
    return S.clinical(spark, sf).select("k", parse_number("tni").alias("tni"), parse_number("bnp").alias("bnp"))


@query("T-07", S.cte("clinical", f"SELECT k, {AMT_SQL.format('smoking')} AS amount FROM clinical"))
def t_amounts(spark, sf):
    return S.clinical(spark, sf).select("k", parse_amount("smoking").alias("amount"))


@query("T-08", S.cte("clinical", f"SELECT k, {AMT_SQL.format('smoking')} AS smoking_num, {NUM_SQL.format('tni')} AS tni, "
                                f"TRY_CAST(age AS DOUBLE) AS age FROM clinical"))
def t_clean(spark, sf):
    c = K.clean_clinical(S.clinical(spark, sf), {"smoking": "smoking_num"}, ["tni", "bnp"], ["age"])
    return c.select("k", "smoking_num", "tni", "age")


CLIN_LONG = ("SELECT k, 'tni' AS feature, tni AS text FROM clinical UNION ALL SELECT k, 'bnp', bnp FROM clinical "
             "UNION ALL SELECT k, 'age', age FROM clinical UNION ALL SELECT k, 'icd', icd FROM clinical")


@query("T-09", S.cte("clinical", f"""+, x AS ({CLIN_LONG}),
 r AS (SELECT feature, count(TRY_CAST(text AS DOUBLE)) / count(text) AS rate FROM x GROUP BY 1)
 SELECT feature, rate >= 0.8 AS is_numeric, count(CASE WHEN rate >= 0.8 THEN TRY_CAST(text AS DOUBLE) END) AS n_value,
        count(CASE WHEN rate < 0.8 THEN text END) AS n_text,
        CAST(sum(CASE WHEN rate >= 0.8 THEN TRY_CAST(text AS DOUBLE) END) AS DOUBLE) AS total
 FROM x JOIN r USING (feature) GROUP BY 1, 2"""))
def t_coerce(spark, sf):
    texts = S.clinical(spark, sf).unpivot(["k"], ["tni", "bnp", "age", "icd"], "feature", "text")
    out = K.coerce_mostly_numeric(texts)
    return out.groupBy("feature", "is_numeric").agg(F.count("value").alias("n_value"), F.count("text").alias("n_text"),
                                                   F.sum("value").alias("total"))


PIVOTED = ["Pi10", "TD_ratio_all", "CAC_Agatston"]


@query("T-10", S.cte("wide", "SELECT patient_id, Pi10, TD_ratio_all, CAC_Agatston FROM wide"))
def t_layout(spark, sf):
    return K.to_wide(S.fact(spark, sf), ["patient_id"], PIVOTED)


@query("T-12", S.cte("obs", "SELECT cohort, feature, count(*) AS n FROM obs GROUP BY 1, 2 ORDER BY 1 ASC, n DESC, feature"))
def t_sort(spark, sf):
    return S.obs(spark, sf).groupBy("cohort", "feature").agg(F.count("*").alias("n")).orderBy(
        F.asc("cohort"), F.desc("n"), "feature")


@query("T-13", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') "
               "AND NOT starts_with(CAST(o_custkey AS VARCHAR), '10') AND NOT starts_with(CAST(o_custkey AS VARCHAR), '7')")
def t_worklist(spark, sf):
    items = S.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_custkey", "o_orderkey")
    wanted = S.table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").cast("string").alias("id"))
    return K.filter_work_items(items, wanted, "id", ["10", "7"]).drop("id")


EXTRA = ("SELECT patient_id, CASE WHEN feature = 'Pi10' THEN 'Pi15' ELSE feature END AS feature, value + 1e0 AS value FROM obs "
         "WHERE feature IN ('Pi10', 'CAC_Agatston', 'EpiFat_Mean_HU')")


def _extra(o):
    f = F.col("feature")
    return o.where(f.isin("Pi10", "CAC_Agatston", "EpiFat_Mean_HU")).select(
        "patient_id", F.when(f == "Pi10", "Pi15").otherwise(f).alias("feature"), (F.col("value") + 1).alias("value"))


@query("T-14", S.cte("obs", f"+, extra AS ({EXTRA}) SELECT patient_id, feature, value FROM obs UNION ALL SELECT * FROM extra e "
                           "WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.patient_id = e.patient_id AND o.feature = e.feature)"))
def t_union(spark, sf):
    o = S.obs(spark, sf).select("patient_id", "feature", "value")
    return K.with_record_union(o, _extra(o))


@query("T-15", "SELECT page_id, 'p' || (page_id % 50) AS folder, CAST(page_id % 9 AS INTEGER) AS series_number FROM pages")
def t_paths(spark, sf):
    p = S.table(spark, sf, "pages").select("page_id", F.expr("concat('/data/p', page_id % 50, '_', page_id % 9, '.nii.gz')").alias("path"))
    return K.path_parts(p, "path").drop("path")


# ---- joins and sets --------------------------------------------------------------------------------------------------

def _patients(spark, sf):
    return S.table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id"), "c_mktsegment", "c_acctbal")


@query("J-01", "SELECT c_custkey AS patient_id, c_mktsegment, c_acctbal, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def j_left(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"), "o_orderkey")
    return J.left_features(_patients(spark, sf), o, "patient_id")


@query("J-02", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def j_inner(spark, sf):
    return J.with_labels(S.table(spark, sf, "documents").select("doc_id", "n_chars"),
                         S.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("J-03", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j_semi(spark, sf):
    return J.having(S.table(spark, sf, "documents").select("doc_id", "n_chars"), S.table(spark, sf, "labels"), "doc_id")


@query("J-04", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j_anti(spark, sf):
    return J.without(S.table(spark, sf, "documents").select("doc_id", "n_chars"), S.table(spark, sf, "labels"), "doc_id")


@query("J-05", "SELECT id, a, b FROM (SELECT c_custkey AS id, c_acctbal AS a FROM customer) FULL JOIN "
               "(SELECT p_partkey AS id, p_retailprice AS b FROM part) USING (id)")
def j_full(spark, sf):
    return J.merge_keys(S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a")),
                        S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("b")), "id")


@query("J-06", "SELECT c_custkey AS person, min(o_orderkey) AS folder FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j_lookup(spark, sf):
    ref = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("folder"))
    return J.lookup(S.table(spark, sf, "customer").select(F.col("c_custkey").alias("person")), ref, "person", "folder", ["folder"])


NAMES = """SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN CAST(o_custkey AS STRING) || '.1'
 WHEN 2 THEN CAST(o_custkey AS STRING) || 'x' || CAST(o_orderkey % 10 AS STRING) ELSE 'q' || CAST(o_custkey AS STRING) END AS name FROM {orders}"""


@query("J-07", f"""WITH n AS ({NAMES.format(orders='orders')}), i AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer),
 c AS (SELECT name, id, 0 AS rank FROM n JOIN i ON id = name
       UNION ALL SELECT name, id, 1 FROM n JOIN i ON id = regexp_replace(name, '\\.\\d+$', '')
       UNION ALL SELECT name, id, 2 FROM (SELECT name, unnest(range(1, length(name) + 1)) AS k FROM n) JOIN i ON id = substr(name, 1, k)),
 b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, length(id) DESC, id) AS rn FROM c)
 SELECT n.name, coalesce(b.id, n.name) AS resolved, CAST(coalesce(b.rank, 3) AS INTEGER) AS rank FROM n LEFT JOIN b ON b.name = n.name AND rn = 1""")
def j_fuzzy(spark, sf):
    ids = S.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return J.fuzzy_key_join(S._run(spark, sf, NAMES), ids)


@query("J-08", """WITH ref AS (SELECT p_partkey AS k1, CASE WHEN p_size > 25 THEN p_partkey + 100000 END AS k2, p_retailprice AS v FROM part)
 SELECT e.event_id, coalesce(a.v, b.v) AS v FROM (SELECT event_id, event_id % 5000 AS f, event_id % 3000 + 100000 AS s FROM events) e
 LEFT JOIN ref a ON a.k1 = e.f LEFT JOIN ref b ON b.k2 = e.s""")
def j_fallback(spark, sf):
    ref = S.table(spark, sf, "part").select(
        F.col("p_partkey").alias("k1"), F.when(F.col("p_size") > 25, F.col("p_partkey") + 100000).alias("k2"), F.col("p_retailprice").alias("v"))
    ev = S.table(spark, sf, "events").select("event_id", (F.col("event_id") % 5000).alias("k1_"), (F.col("event_id") % 3000 + 100000).alias("k2_"))
    ev = ev.withColumnRenamed("k1_", "k1").withColumnRenamed("k2_", "k2")
    return J.fallback_key_join(ev, ref, "k1", "k2", "v").select("event_id", "v")


@query("J-09", "SELECT c_custkey AS patient_id, c_acctbal, n AS aq_n, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS matched FROM customer "
               "LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j_add_columns(spark, sf):
    target = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id"), "c_acctbal")
    src = S.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("skipped"))
    out, _ = J.add_new_columns(target, src, "patient_id", "aq_", ["skipped"])
    return out.withColumn("matched", F.when(F.col("aq_n").isNull(), 0).otherwise(1))


@query("J-10", S.cte("fact", """SELECT t.feature, count(*) AS n, count(CASE WHEN t.value IS NULL AND s.value IS NOT NULL THEN 1 END) AS filled,
  count(coalesce(t.value, s.value)) AS present FROM fact t
  LEFT JOIN (SELECT c_custkey AS patient_id, 'CAC_Agatston' AS feature, -c_acctbal AS value FROM customer) s
  ON s.patient_id = t.patient_id AND s.feature = t.feature GROUP BY 1"""))
def j_fill(spark, sf):
    src = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("patient_id"), F.lit("CAC_Agatston").alias("feature"), (-F.col("c_acctbal")).alias("value"))
    return J.fill_null_cells(S.fact(spark, sf), src).groupBy("feature").agg(
        F.count("*").alias("n"), F.count_if("filled").alias("filled"), F.count("value").alias("present"))


@query("J-11", S.cte("clinical", "SELECT k, CASE WHEN CAST(age AS DOUBLE) <= 50 THEN 450e0 WHEN CAST(age AS DOUBLE) <= 75 THEN 900e0 "
                                "WHEN CAST(age AS DOUBLE) <= 200 THEN 1800e0 ELSE 450e0 END AS lim FROM clinical"))
def j_threshold(spark, sf):
    from phenospark.operators.rules import bnp_limit
    return S.clinical(spark, sf).select("k", bnp_limit(F.col("age")).alias("lim"))


@query("J-12", "SELECT c_custkey AS patient_id, st AS label FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS st FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j_labels(spark, sf):
    lab = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("label"))
    return J.add_labels(S.table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id")), lab, "patient_id", ["label"])


@query("J-13", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS \"both\", "
               "(SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_a, "
               "(SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_b")
def j_overlap(spark, sf):
    return J.overlap(S.table(spark, sf, "documents"), S.table(spark, sf, "labels"), "doc_id")


@query("J-14", "SELECT 'c' AS src, c_custkey AS id, c_acctbal AS bal, NULL::VARCHAR AS name FROM customer UNION ALL "
               "SELECT 's', s_suppkey, s_acctbal, s_name FROM supplier")
def j_union(spark, sf):
    return J.union_tagged({
        "c": S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")),
        "s": S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name")),
    }, "src")


@query("J-15", "SELECT item, list_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY list_no, pos) AS rn FROM "
               "(SELECT l_partkey AS item, 0 AS list_no, l_orderkey AS pos FROM lineitem WHERE l_returnflag = 'R' "
               "UNION ALL SELECT p_partkey, 1, p_partkey FROM part)) WHERE rn = 1")
def j_ordered(spark, sf):
    a = S.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("pos"))
    b = S.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_partkey").alias("pos"))
    return J.ordered_distinct_union([a, b], "item", "pos")


@query("J-16", S.cte("obs", "SELECT feature, count(DISTINCT cohort) AS n_cohorts FROM obs GROUP BY 1 HAVING count(DISTINCT cohort) = 5"))
def j_shared(spark, sf):
    return J.shared_features(S.obs(spark, sf), 5)
