"""Incremental ingest of patient records with Structured Streaming.

Facts are kept as an append-only log of versions in Parquet: each micro-batch appends only what is new, so nothing that is
being read is rewritten, and a batch that is replayed after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from phenospark.sources.sinks import write_table
from phenospark.sources.tables import record_facts

FACT_SCHEMA = "patient_id STRING, feature STRING, value DOUBLE, bucket INT"
MANIFEST_SCHEMA = "item STRING, status STRING, reason STRING, batch INT"
BUCKETS = 256
KEYS = ("patient_id", "feature")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one if nothing was written yet; any other error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_manifest(rows: DataFrame, path: str, batch_id: int) -> None:
    """Entries (item, status, reason) of one micro-batch, in a partition of its own that a replay of the batch replaces."""
    rows.select("item", "status", "reason").write.mode("overwrite").parquet(f"{path}/batch={int(batch_id)}")


def compact_facts(spark: SparkSession, log: str, root: str, version: str) -> str:
    """Write the current facts of a log as a new table version, a few large files per bucket; the log stays as it is."""
    cur = current_facts(spark.read.schema(FACT_SCHEMA).parquet(log), ("bucket", *KEYS))
    return write_table(cur.repartition("bucket").sortWithinPartitions("patient_id", "feature"), root, version)


def new_facts(current: DataFrame, batch: DataFrame, mode: str = "add", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of a batch to append: ``add`` takes unknown keys only, ``fill`` also keys whose stored value is null.

    Within a batch one row per key is kept, observed values before nulls (an aggregate, so a hot key combines map-side)."""
    once = batch.groupBy(*keys).agg(F.min("value").alias("value"))
    known = current if mode == "add" else current.where("value is not null")
    out = once.join(known.select(*keys), list(keys), "left_anti")
    return out if mode == "add" else out.join(current.select(*keys, F.lit(1).alias("_old")).distinct(), list(keys), "left").where(
        "_old is null or value is not null").drop("_old")


def current_facts(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The log read as a table: the observed value if any version has one."""
    return log.groupBy(*keys).agg(F.min("value").alias("value"))


def upsert_features(batch: DataFrame, path: str, mode: str = "add", manifest: str | None = None, batch_id: int = 0) -> None:
    """Append the new facts of a batch. The log is partitioned by a hash bucket of the patient and the bucket is a join key,
    so a batch reads only the buckets of its own patients (dynamic partition pruning)."""
    spark = batch.sparkSession
    batch = batch.withColumn("bucket", F.pmod(F.xxhash64("patient_id"), F.lit(BUCKETS)).cast("int"))
    rows = new_facts(_read(spark, path, FACT_SCHEMA), batch.select("bucket", *KEYS, "value"), mode, ("bucket", *KEYS))
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)  # one file per bucket and batch
    if manifest:
        write_manifest(batch.select("patient_id").distinct().select(
            F.col("patient_id").alias("item"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason")), manifest, batch_id)


def ingest_new_patients(spark: SparkSession, source: str, facts: str, checkpoint: str, manifest: str, mode: str = "add", schema: str = "patient_id STRING, record STRING",
                        fmt: str = "parquet", files_per_batch: int = 100):
    """Process files that have not been seen, then stop: a file stream with ``availableNow`` and its own checkpoint.

    ``source`` holds (patient_id, record JSON). Patients whose manifest status is terminal (``no_mask``) are not retried; broken
    records go to the manifest as failures and are retried when their file comes again."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(source)

    def step(batch: DataFrame, batch_id: int) -> None:
        done = _read(spark, manifest, MANIFEST_SCHEMA).where((F.col("status") == "no_mask") & (F.col("batch") != batch_id)).select(F.col("item").alias("patient_id")).distinct()
        batch = batch.join(done, "patient_id", "left_anti")
        parsed = batch.withColumn("parsed", F.from_json("record", "map<string,string>")).drop("record")
        good = parsed.where("parsed is not null")
        upsert_features(record_facts(good.withColumnRenamed("parsed", "record"), "patient_id"), facts, mode)
        empty = F.size("parsed") == 0
        write_manifest(parsed.select(
            F.col("patient_id").alias("item"), F.when(F.col("parsed").isNull(), "fail").when(empty, "no_mask").otherwise("ok").alias("status"),
            F.when(F.col("parsed").isNull(), "broken record").when(empty, "no structures").alias("reason")), manifest, batch_id)

    return raw.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_events(stream: DataFrame, time: str, delay: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop repeats of a key within the watermark, for sources that carry an event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
