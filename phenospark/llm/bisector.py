"""Centroid clustering by a tournament of bisectors.

A vector is nearer to centroid j than to i if it lies beyond the plane halfway between them. For every pair of centroids the
driver computes the plane's integer normal and threshold once per round; a vector then meets k - 1 of these planes: the
winner so far plays the next centroid, a positive sign is a win of the larger number, zero favours the smaller. Only the
last distance, to the winner, is computed as such. All arithmetic is in 64-bit integers, hence exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenospark.llm.common import rows_of
from phenospark.session import checkpointed

# Grid values up to this size keep every product and squared distance of 64 components below 2**63.
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def grid(vectors: DataFrame, scale: int = 1024, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x array<int>): the integers floor(scale * component) of finite vectors with exactly ``dims`` components.

    Any other vector takes no part, nor does one with a grid value beyond ``LARGEST``, whose squared distance no 64-bit
    integer holds. Repeated rows and null ids stay as rows of their own; further columns are ignored.
    """
    v = F.col(vec_col)
    top = F.transform(v, lambda c: F.abs(c.cast("double") * scale))
    d = vectors.where((F.size(v) == dims) & finite(v)).where(F.array_max(top) < LARGEST)
    return d.select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("x"))


def seeds(points: DataFrame, k: int, salt: int) -> np.ndarray:
    """The ``k`` points with the smallest sha256 of ``salt:id``, ties by the point itself, null ids last; fewer if there are fewer."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = points.select(h.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


class Bisectors:
    """Normals and thresholds of all pairs: x beats i with j, i < j, if x . normal[i, j] > threshold[i, j]."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        square = (centroids * centroids).sum(axis=1)
        self.normal = 2 * (centroids[None] - centroids[:, None])
        self.threshold = square[None] - square[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of every row, ties to the smaller number."""
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("rd,rd->r", x, self.normal[best, j]) - self.threshold[best, j]
            best[side > 0] = j
        return best

    def distances(self, x: np.ndarray, winner: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[winner]
        return np.einsum("rd,rd->r", gap, gap)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the vectors of each centroid; one without vectors stays.

    A task sends one row of sums per centroid that it met, whatever the sizes of the clusters; the totals are exact decimals.
    """
    plane = Bisectors(centroids)
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = rows_of(batch.column(0), dims).astype(np.int64)
            winner = plane.winners(x)
            n += np.bincount(winner, minlength=k)
            for c in np.unique(winner):
                total[c] += x[winner == c].sum(axis=0)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": met.astype(np.int32), "n": n[met], "total": total[met].tolist()},
                                         pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    parts = points.select("x").mapInArrow(sums, "cluster int, n bigint, total array<bigint>").select("cluster", "n", F.posexplode("total").alias("dim", "v"))
    whole = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = centroids.copy()
    for r in whole:
        out[r["cluster"], r["dim"]] = int(r["v"]) // r["n"]
    return out


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every point."""
    plane = Bisectors(centroids)
    dims = centroids.shape[1]
    schema = T.StructType([points.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), dims).astype(np.int64)
            winner = plane.winners(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(winner.astype(np.int32)), pa.array(plane.distances(x, winner))], ["id", "cluster", "distance"])

    return points.select("id", "x").mapInArrow(place, schema)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: int = 3, scale: int = 1024, dims: int = 64, id_col: str = "vec_id",
            vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centroids) after ``rounds`` rounds of assignment and exact floored means and a last assignment.

    The grid is stored once; a round reads it and brings k x dims sums to the driver. There is no shuffle by vector, so
    copies of one vector are no hot key. Without a usable vector the table is empty and there is no centroid.
    """
    points = checkpointed(grid(vectors, scale, dims, id_col, vec_col))
    centroids = seeds(points, k, salt).reshape(-1, dims)
    if not len(centroids):
        return points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(points, centroids)
    return checkpointed(assigned(points, centroids)), centroids


def report(vectors: DataFrame, **options) -> DataFrame:
    """Per vector: vec_id, cluster, squared distance, its sum over the cluster and over all (null beyond 64 bits), and the
    digest of the final centroid."""
    rows, centroids = cluster(vectors, **options)
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(wide.alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    spark = rows.sparkSession
    facts = spark.createDataFrame([(c, ",".join(map(str, x.tolist())), fits(sums.get(c, 0)), fits(sum(sums.values()))) for c, x in enumerate(centroids)],
                                  "cluster int, centroid string, cluster_inertia bigint, inertia bigint")
    return rows.join(F.broadcast(facts), "cluster").select(  # one row per centroid
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
