"""Writers: versioned tables with a pointer, record JSON, run manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.session import local_folder, spread


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder of the cluster; a local one only where the session names none (tests)."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{local_folder(spark)}/{name}"


def write_table(df: DataFrame, root: str, version: str) -> str:
    """Write a new version folder, then append a pointer row. The version being read is never touched."""
    path = f"{root}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    pointer = df.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    pointer.write.mode("append").parquet(f"{root}/_current")
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version that the newest pointer names."""
    row = spark.read.parquet(f"{root}/_current").agg(F.max_by("version", "at").alias("v")).first()
    return spark.read.parquet(f"{root}/v={row['v']}")


def records_json(df: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """One JSON text per key with its sorted items. Items per key are bounded by the feature catalogue."""
    return df.groupBy(*keys).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(F.col(item), F.col(value))))).alias("record")
    )


def write_folders_csv(df: DataFrame, root: str, folder: str) -> None:
    """One CSV file per value of ``folder``, in a folder of its own below the fresh folder ``root``.

    Tasks move their own files into place: with the default committer the driver moves every folder, one after the other. The
    partition count is fixed, because files cost time by number and adaptive merging goes by bytes.
    """
    spread(df, folder).write.partitionBy(folder).option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(root, header=True)


def write_records_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_manifest(df: DataFrame, path: str) -> None:
    df.select("item", "status", "reason").write.mode("append").parquet(path)


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"))
