"""Readers for cohort files. Every reader takes an explicit schema; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.functions.text import clean_double
from phenospark.operators.keys import dedup_first

PATIENT_TAGS = "STRUCT<PatientID: STRING, PatientName: STRING, PatientBirthDate: STRING, PatientSex: STRING>"
SERIES = (
    f"STRUCT<SeriesFolder: STRING, Instances: INT, Patient: {PATIENT_TAGS}, Study: STRUCT<StudyDate: STRING>, "
    "Series: STRUCT<SeriesDescription: STRING, Modality: STRING, SliceThickness: STRING>>"
)
INFO_SCHEMA = (
    f"STRUCT<Series: ARRAY<{SERIES}>, series_info: STRUCT<candidates: ARRAY<STRUCT<series_info: "
    f"STRUCT<Patient: {PATIENT_TAGS}>>>>>"
)


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header; ids are strings because the schema says so. The reader drops a UTF-8 BOM."""
    return spark.read.schema(schema).csv(path, header=True, encoding="UTF-8")


def parse_records(df: DataFrame, json_col: str) -> DataFrame:
    """Rows with a JSON text -> ``record MAP<STRING,STRING>``; null for anything that is not an object."""
    return df.withColumn("record", F.from_json(F.col(json_col), "map<string,string>"))


def record_facts(parsed: DataFrame, *ids: str) -> DataFrame:
    """Long facts of good records; null and text values become null. Of a repeated key the last value counts."""
    keys = F.map_keys("record")
    entries = F.map_entries("record")
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    once = F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(last)
    return (
        parsed.where(F.col("record").isNotNull())
        .select(*ids, F.explode(once).alias("e"))
        .select(*ids, F.col("e.key").alias("feature"), F.col("e.value").alias("text"))
        .select(*ids, "feature", clean_double(F.col("text").try_cast("double")).alias("value"))
    )


def record_rejects(parsed: DataFrame, *cols: str) -> DataFrame:
    """Broken or non-object records."""
    return parsed.where(F.col("record").isNull()).select(*cols)


def read_feature_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object per patient file -> (facts, rejects); the patient comes from the file name."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"(_radiomics)?\.json$", "").alias("patient_id"), "value"
    )
    parsed = parse_records(raw, "value")
    return record_facts(parsed, "patient_id"), record_rejects(parsed, "patient_id", "value")


def patient_number(info: Column) -> Column:
    """First non-empty candidate id, else the first series id, of a parsed info struct (``INFO_SCHEMA``)."""
    def first(arr, get):
        ids = F.filter(F.transform(arr, lambda s: F.trim(get(s))), lambda v: v.isNotNull() & (v != ""))
        return F.get(ids, F.lit(0))

    return F.coalesce(
        first(info["series_info"]["candidates"], lambda s: s["series_info"]["Patient"]["PatientID"]),
        first(info["Series"], lambda s: s["Patient"]["PatientID"]),
    )


def read_branch_metrics(spark: SparkSession, root: str, schema: str, sidecars: DataFrame | None = None,
                        glob: str = "*.csv", pattern: str = r"([^/=]+?)(?:_[a-z]+)?/[^/]*$") -> DataFrame:
    """Per-patient branch tables below ``root``; the patient comes from the path, side information joins left.

    ``pattern`` sees the last folder and the file name only: a search over the whole path costs more per row than its parsing.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .csv(root)
        .withColumn("patient", F.regexp_extract(F.substring_index(F.col("_metadata.file_path"), "/", -2), pattern, 1))
    )
    return df if sidecars is None else df.join(sidecars, "patient", "left")


def read_airway_features(spark: SparkSession, root: str, schema: str, key: str, order: list[str]) -> DataFrame:
    """Per-patient feature files without the roll-up file, first row per folder."""
    df = (
        spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(root)
        .withColumn("_file", F.col("_metadata.file_path"))
        .where(~F.col("_file").endswith("all.csv"))
    )
    return dedup_first(df.drop("_file"), [key], order)


def annotate_record(info: Column, folder: Column, note: Column) -> Column:
    """Flag the chosen series and attach the normalisation note to the record struct."""
    return info.withField(
        "Series",
        F.transform(info["Series"], lambda s: s.withField("Normalized", s["SeriesFolder"] == folder)),
    ).withField("Normalization", note)


def mine_run_logs(lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """Metrics from run logs: CV mean and sd per line, the last section header carried forward within the file."""
    from pyspark.sql import Window as W

    section = F.nullif(F.regexp_extract(text, r"^=+\s*(.+?)\s*=+$", 1), F.lit(""))
    metric = r"AUC\s*[:=]?\s*([0-9.]+)\s*(?:±|\+/-)\s*([0-9.]+)"
    w = W.partitionBy(file).orderBy(line_no).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        lines.withColumn("section", F.last(section, ignorenulls=True).over(w))
        .withColumns({
            "auc": F.nullif(F.regexp_extract(text, metric, 1), F.lit("")).try_cast("double"),
            "sd": F.nullif(F.regexp_extract(text, metric, 2), F.lit("")).try_cast("double"),
        })
        .where(F.col("auc").isNotNull())
        .select(file, line_no, "section", "auc", "sd")
    )
