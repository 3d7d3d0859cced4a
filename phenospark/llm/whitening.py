"""Whitening of embeddings with distributed block matrices.

Rows become integers on a grid. The distinct ones, centred, are indexed into the blocks of an MLlib ``BlockMatrix``; its
transpose times itself is the scatter matrix, whose eigenvectors the driver finds (components x components numbers). A second
block matrix, of all rows, times the whitening matrix projects them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenospark.llm.bisector import finite
from phenospark.llm.common import rows_of
from phenospark.session import checkpointed

# Rows of a block at most, and bytes of blocks that one task of the transpose product takes in.
BLOCK_ROWS = 4096
TASK_BYTES = 64 << 20
# Eigenvalues below this share of the trace are rounding noise of a rank-deficient table.
RANK = 1e-12
BLOCK = T.StructType([
    T.StructField("at", T.StructType([T.StructField("row", T.LongType()), T.StructField("column", T.LongType())])),
    T.StructField("block", MatrixUDT())])


def grid(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x array<bigint>): the integers floor(scale * component) of finite vectors.

    Of vectors of different lengths those of the commonest take part (ties: the longer); empty ones and such as leave 64 bits on
    the grid do not. Repeated rows and null ids stay; further columns are ignored.
    """
    v = F.col(vec_col)
    inside = F.array_max(F.transform(v, lambda c: F.abs(c.cast("double") * scale))) < float(1 << 52)
    d = vectors.where(finite(v) & (F.size(v) > 0)).where(inside).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale) + F.lit(0)).alias("x"))
    width = d.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return d.where(F.size("x") == (width["n"] if width else 0))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``part`` and ``pos``, stored, so that a lost task finds the same numbers again."""
    spot = F.monotonically_increasing_id()
    return checkpointed(rows.withColumn("spot", spot)).select("*", F.shiftrightunsigned("spot", 33).alias("part"), F.col("spot").bitwiseAND((1 << 33) - 1).alias("pos")).drop("spot")


class Layout:
    """Where the rows of an indexed table stand: every partition fills whole blocks, the last one up with zero rows, which add
    nothing to a product of centred rows. The driver holds one number per partition."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> None:
        counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
        self.rows = max(1, min(block_rows, max(counts.values(), default=1)))
        self.first, self.blocks = {}, 0
        for part in sorted(counts):
            self.first[part] = self.blocks
            self.blocks += math.ceil(counts[part] / self.rows)


def block_matrix(rows: DataFrame, layout: Layout, mean: np.ndarray) -> BlockMatrix:
    """Block matrix of the rows ``x - mean``, from an indexed table."""
    size, first, dims = layout.rows, layout.first, len(mean)

    def block(number: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.zeros((size, dims))
        have = np.concatenate(parts)
        x[: len(have)] = have - mean
        one = lambda v, t: pa.array([v], t)
        ints = pa.list_(pa.int32())
        m = pa.StructArray.from_arrays(
            [one(1, pa.int8()), one(size, pa.int32()), one(dims, pa.int32()), one(None, ints), one(None, ints),
             pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel())), one(True, pa.bool_())],
            ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])
        return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([one(number, pa.int64()), one(0, pa.int64())], ["row", "column"]), m], ["at", "block"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = None, []
        for batch in batches:
            x = rows_of(batch.column(2), dims)
            number = np.array([first[p] for p in batch.column(0).to_pylist()], np.int64) + batch.column(1).to_numpy() // size
            cuts = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(x)]):
                if a == b:
                    continue
                if kept and number[a] != current:
                    yield block(current, kept)
                    kept = []
                current = int(number[a])
                kept.append(x[a:b].astype(np.float64))
        if kept:
            yield block(current, kept)

    frame = rows.select("part", "pos", "x").mapInArrow(build, BLOCK)
    java = callMLlibFunc("createBlockMatrix", frame, size, dims, layout.blocks * size, dims)
    return BlockMatrix(java, size, dims)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, as an array. The long inner dimension is cut into as many tasks as keep each at ``TASK_BYTES`` of
    blocks; their small products are added up."""
    per_block = 8 * matrix.rowsPerBlock * matrix.colsPerBlock
    splits = max(1, math.ceil(matrix.numRowBlocks * per_block / TASK_BYTES))
    java = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(rows: DataFrame, matrix: BlockMatrix, layout: Layout, weights: np.ndarray) -> DataFrame:
    """(part, pos, w array<double>): the rows of ``matrix`` times ``weights``."""
    dims, k = weights.shape
    sc = rows.sparkSession.sparkContext
    right = BlockMatrix(sc.parallelize([((0, 0), DenseMatrix(dims, k, weights.ravel(order="F")))], 1), dims, k, dims, k)
    out = callMLlibFunc("getMatrixBlocks", matrix.multiply(right)._java_matrix_wrapper._java_model).toDF("at", "block")
    starts = sorted((b, p) for p, b in layout.first.items())
    heads, parts, size = np.array([b for b, _ in starts]), np.array([p for _, p in starts]), layout.rows

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, cells = batch.column(0).field(0).to_numpy(), batch.column(1)
            for i, number in enumerate(numbers):
                w = cells.field("values")[i].values.to_numpy().reshape((size, k), order="C" if cells.field("isTransposed")[i].as_py() else "F")
                at = np.searchsorted(heads, number, side="right") - 1
                pos = (number - heads[at]) * size + np.arange(size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, parts[at], np.int64)), pa.array(pos.astype(np.int64)), pa.ListArray.from_arrays(
                    pa.array(np.arange(0, size * k + 1, k, dtype=np.int32)), pa.array(w.ravel()))], ["part", "pos", "w"])

    return out.mapInArrow(unpack, "part bigint, pos bigint, w array<double>")


def exact_deviation(x: Column, n: int, sums: list[int], largest: int) -> Column:
    """Sum over dimensions of (n * x - S)**2: in 64 bits where the largest entry shows that they hold it, else in decimals, null
    if the result itself is beyond 64 bits."""
    small = (n * largest + max(map(abs, sums))) ** 2 * len(sums) < 1 << 63
    kind = "bigint" if small else "decimal(38,0)"
    gap = lambda c, s: c.cast(kind) * F.lit(n).cast(kind) - s
    if small:
        means = F.array(*[F.lit(s).cast("bigint") for s in sums])
        return F.aggregate(F.zip_with(x, means, gap), F.lit(0).cast("bigint"), lambda a, d: a + d * d)

    @F.pandas_udf("bigint")
    def far(rows):
        import pandas as pd
        out = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in rows]
        return pd.Series([d if d < 1 << 63 else None for d in out], dtype="Int64")

    return far(x)


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, dict]:
    """((id, deviation, w array<double>), facts) of every usable row: whitened coordinates of the leading components, and
    n, sums, eigenvalues and the identity error of the distinct rows that were fitted.

    Components whose eigenvalue is below rounding noise (fewer distinct rows or dimensions than ``components``) are left out.
    Copies of a vector are combined before the shuffle that finds the distinct rows and are never joined by value: rows meet
    their projection by position.
    """
    rows = indexed(grid(vectors, scale, id_col, vec_col))
    fit = indexed(rows.groupBy("x").agg(F.min(F.struct("part", "pos")).alias("first")).select("first", "x"))
    cells = fit.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.max(F.abs("v")).alias("m"), F.count("*").alias("n")).collect()
    if not cells:
        return rows.select("id", F.lit(0).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("w")), {"n": 0, "sums": [], "values": [], "trace": 0.0, "error": 0.0}
    sums = [int(r["s"]) for r in sorted(cells, key=lambda r: r["dim"])]
    n, largest, mean = cells[0]["n"], max(r["m"] for r in cells), np.array([s / cells[0]["n"] for s in sums])
    layout = Layout(fit)
    matrix = block_matrix(fit, layout, mean)
    matrix.persist(StorageLevel.DISK_ONLY)
    v = scatter(matrix) / n
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)
    values, vectors_ = np.linalg.eigh((v + v.T) / 2)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    trace = float(np.trace(v))
    k = int(np.sum(values[:components] > RANK * trace)) if trace > 0 else 0
    facts = {"n": n, "sums": sums, "values": values[:k].tolist(), "trace": trace, "error": 0.0}
    if not k:
        return rows.select("id", F.lit(0).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("w")), facts
    where = Layout(rows)
    w = projected(rows, block_matrix(rows, where, mean), where, vectors_[:, :k] / np.sqrt(values[:k]))
    known = rows.select("part", "pos", "id", exact_deviation(F.col("x"), n, sums, largest).alias("deviation"))
    fitted = fit.select("first.part", "first.pos", F.lit(True).alias("fitted"))
    out = checkpointed(known.join(w, ["part", "pos"]).join(fitted, ["part", "pos"], "left").select("id", "deviation", "w", "fitted"))
    facts["error"] = identity_error(out.where("fitted"), k)
    return out.drop("fitted"), facts


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = rows.select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)]).agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def report(vectors: DataFrame, **options) -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error. Empty without
    a usable row, or if all usable rows are equal."""
    rows, facts = whiten(vectors, **options)
    shares = F.array(*[F.lit(float(e / facts["trace"])) for e in facts["values"]]).cast("array<double>")
    each = rows.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(facts["n"]).cast("bigint").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(float(facts["error"])).alias("identity_error"))
