"""Cleaning expressions for ids, laboratory text and path names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no number" in the clinical sheets.
NULL_TOKENS = ("", "/", "无", "nan", "None", "<", ">")


def normalize_id(col: Column | str) -> Column:
    """Trim, drop a trailing ``.0``, strip leading zeros; all-zero stays ``0``; empty or null gives null."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "")
    stripped = F.regexp_replace(bare, r"^0+(?=.)", "")
    return F.when(stripped.isin("", "nan", "None"), F.lit(None)).otherwise(stripped)


def parse_number(col: Column | str) -> Column:
    """Laboratory text to double: null tokens, comparison signs and thousands commas handled."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.regexp_replace(F.trim(c), ",", "")
    return F.when(t.isin(*NULL_TOKENS), F.lit(None)).otherwise(
        F.regexp_replace(t, "[<>≤≥]", "").try_cast("double")
    )


def parse_amount(col: Column | str) -> Column:
    """First number in a free-text amount such as '1包/天'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def clean_double(col: Column | str) -> Column:
    """NaN to null, so that counts and orderings treat missing values as missing."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def folder_of(path: Column | str) -> Column:
    """File name without its directories."""
    c = F.col(path) if isinstance(path, str) else path
    return F.substring_index(c, "/", -1)


def series_number(path: Column | str) -> Column:
    """Series number at the end of a volume file name, ``<patient>_<n>.nii.gz``."""
    c = F.col(path) if isinstance(path, str) else path
    return F.nullif(F.regexp_extract(c, r"_(\d+)\.nii\.gz$", 1), F.lit("")).try_cast("int")
