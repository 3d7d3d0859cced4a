"""Session helpers: configuration for local runs and fault-tolerant lineage cuts."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches. Clusters bring their own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("phenospark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job through the reliable checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session without
    one (tests) gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or local_folder(df.sparkSession))
    return df.checkpoint()


def local_folder(spark: SparkSession) -> str:
    """A temporary folder of this machine, for local sessions only: executors elsewhere could not share it."""
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder under master {master}")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by the grouping columns of a following ``applyInPandas`` with the full partition count.

    Adaptive execution merges partitions by bytes; numpy work per byte is high, so merged partitions would run block after
    block in one task. The grouping reuses this partitioning, so it is still one shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def stored_for_passes(df: DataFrame, key: str) -> DataFrame:
    """Checkpoint of rows that costly passes read again and again, in at least one partition per core.

    Adaptive execution merges small rows into few partitions by bytes, and every pass would run in as few tasks. More partitions
    than that are kept as they are: each costs a start of a task and its partial sums in every pass.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    got = checkpointed(df)
    return got if got.rdd.getNumPartitions() >= n else checkpointed(got.repartition(n, key))


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First row of each group of a table that is sorted by ``keys``; nulls are one group."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        a = table.column(k).to_numpy()
        new[1:] |= (a[1:] != a[:-1]) & ~((a[1:] != a[1:]) & (a[:-1] != a[:-1]))
    return np.flatnonzero(new)


def by_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table, np.ndarray], Mapping], schema: str, rows: int = 1 << 16) -> DataFrame:
    """``fn(table, starts)`` over Arrow tables of whole groups, sorted by ``keys``; it returns columns by name.

    One shuffle, as for ``applyInPandas``, but a call gets as many small groups as make up ``rows`` rows, so that a group of a
    few rows does not cost a call. A task holds one call's rows or its largest group.
    """
    keys = list(keys)
    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def call(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        got = fn(table, starts)
        columns = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in (got[f.name] for f in target)]
        yield from pa.table([c.cast(f.type) for c, f in zip(columns, target)], schema=target).to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, rows
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = group_starts(table, keys)
            if len(starts) > 1:
                yield from call(table.slice(0, starts[-1]), starts[:-1])
                table = table.slice(starts[-1])
            held, size = table.to_batches(), table.num_rows
            most = max(rows, 2 * size)
        if size:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from call(table, group_starts(table, keys))

    return spread(df, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def take(table: pa.Table, column: str, at: np.ndarray) -> pa.ChunkedArray:
    """Values of a column at row numbers, of any type."""
    return table.column(column).take(pa.array(at))
