"""Row-level reshaping: ids, first-per-key, wide/long, work lists, record unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions.text import normalize_id, parse_amount, parse_number


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key under an explicit total order.

    An aggregate rather than ``row_number``: it combines map-side, so a key holding most rows costs nothing extra.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def numeric_id(df: DataFrame, lookup: DataFrame, folder: str, own_id: str, lookup_id: str = "PatientID") -> DataFrame:
    """Number id = metadata id, else the table's own; keeps the raw text with its zeros."""
    out = df.join(lookup.select(folder, F.col(lookup_id).alias("_meta")), folder, "left")
    raw = F.coalesce(F.nullif(F.trim("_meta"), F.lit("")), F.trim(F.col(own_id)))
    return out.withColumn("PatientID_raw", raw).withColumn(
        "PatientID_num", normalize_id(raw).try_cast("bigint")
    ).drop("_meta")


def id_map(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct id correspondences."""
    return df.select(*cols).distinct()


def clean_clinical(df: DataFrame, amounts: dict[str, str], quantities: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Parse amount texts into new columns, laboratory results and number columns in place: one projection."""
    new = {n: parse_amount(c) for c, n in amounts.items()}
    new.update({c: parse_number(c) for c in quantities})
    new.update({c: F.col(c).try_cast("double") for c in numbers})
    return df.withColumns(new)


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide to long; nulls kept as rows."""
    return df.unpivot(
        [F.col(i) for i in ids], [F.col(f"`{f}`").cast("double").alias(f) for f in features], "feature", "value"
    )


def to_wide(facts: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long to wide for an explicit feature list; only its rows are read, ids without any of them come back as nulls."""
    rows = facts.where(F.col("feature").isin(*features))
    wide = rows.groupBy(*ids).pivot("feature", list(features)).agg(F.first("value"))
    known = facts.select(*ids).distinct().alias("_i")
    same = [F.col(f"_i.`{c}`").eqNullSafe(F.col(f"_w.`{c}`")) for c in ids]
    return known.join(wide.alias("_w"), same, "left").select(*[F.col(f"_i.`{c}`") for c in ids], *[F.col(f"_w.`{c}`") for c in features])


def coerce_mostly_numeric(texts: DataFrame, share: float = 0.8) -> DataFrame:
    """Long text facts (feature, text): a feature turns numeric when enough of its non-null texts parse."""
    num = F.col("text").try_cast("double")
    rate = texts.groupBy("feature").agg((F.try_divide(F.count(num), F.count("text"))).alias("parse_rate"))
    out = texts.join(rate, "feature")
    ok = F.col("parse_rate") >= share
    return out.withColumn("is_numeric", ok).withColumn("value", F.when(ok, num)).withColumn(
        "text", F.when(~ok, F.col("text"))
    )


def filter_work_items(items: DataFrame, wanted: DataFrame | None, key: str, skip_prefixes: Sequence[str] = ()) -> DataFrame:
    """Keep listed ids, drop ids equal to or starting with a skip entry."""
    out = items if wanted is None else items.join(wanted.select(key), key, "left_semi")
    if skip_prefixes:
        out = out.where(~reduce(lambda a, b: a | b, [F.col(key).startswith(p) for p in skip_prefixes]))
    return out


def with_record_union(facts: DataFrame, extra: DataFrame, keys=("patient_id", "feature")) -> DataFrame:
    """Add only those (patient, feature) facts that the record does not have yet."""
    return facts.unionByName(extra.join(facts.select(*keys), list(keys), "left_anti"))


def path_parts(df: DataFrame, path: str) -> DataFrame:
    """Folder stem and series number of a volume file name."""
    name = F.substring_index(F.col(path), "/", -1)
    num = F.nullif(F.regexp_extract(name, r"_(\d+)\.nii\.gz$", 1), F.lit("")).try_cast("int")
    stem = F.regexp_replace(name, r"(_\d+)?\.nii\.gz$", "")
    return df.withColumns({"folder": stem, "series_number": num})
