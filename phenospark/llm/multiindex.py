"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own codebook, so ``k`` centroids per half make ``k * k``
cells. A query walks the cells in order of summed half distances with a heap until the cells hold its share of all vectors;
the entries of those cells are reranked by their exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phenospark.session import checkpointed

BLOCK = 2048


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part: an id, no null or non-finite component, not all zero, not empty."""
    v = F.col("v")
    limit = F.lit(1.7976931348623157e308)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of a bounded sample, seeded by evenly spaced distinct rows."""
    x = np.unique(x, axis=0)
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def train(vectors: DataFrame, k: int = 16, sample: int = 8192) -> dict | None:
    """Two codebooks from the ``sample`` vectors with the smallest id hashes (the bound of the fit). Vectors of another length
    than the commonest, ties to the longer, take no part in an index; ``None`` if there is no vector at all."""
    size = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return None
    d = size["d"]
    ids = vectors.where(F.size("v") == d).select("id", F.xxhash64("id").alias("_h")).orderBy("_h", "id").limit(sample).select("id").distinct()
    x = np.array([r["v"] for r in vectors.where(F.size("v") == d).join(F.broadcast(ids), "id").orderBy("id", "v").limit(2 * sample).collect()])
    half = max(1, d // 2)
    return {"d": d, "half": half, "a": codebook(x[:, :half], k), "b": codebook(x[:, half:], k) if d > 1 else np.zeros((1, 0))}


def half_distances(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of each half to the centroids of its codebook."""
    h = model["half"]
    return tuple(np.maximum((p * p).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * p @ c.T, 0) for p, c in ((x[:, :h], model["a"]), (x[:, h:], model["b"])))


def index(vectors: DataFrame, model: dict) -> DataFrame:
    """(id, v, cell) for every vector of the model's length."""
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            if len(b):
                da, db = half_distances(np.stack(b["v"].to_numpy()), m)
                b["cell"] = (np.argmin(da, 1) * len(m["b"]) + np.argmin(db, 1)).astype(np.int32)
                yield b[["id", "v", "cell"]]

    return vectors.where(F.size("v") == model["d"]).select("id", "v").mapInPandas(assign, "id bigint, v array<double>, cell int")


def walk(da: np.ndarray, db: np.ndarray, sizes: np.ndarray, want: int) -> list[int]:
    """Cells by rising summed distance until they hold ``want`` vectors (all cells if they never do)."""
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    heap, seen, out, got = [(da[oa[0]] + db[ob[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        cell = int(oa[i]) * len(ob) + int(ob[j])
        if sizes[cell]:
            out.append(cell)
            got += int(sizes[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(oa) and q < len(ob) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (da[oa[p]] + db[ob[q]], p, q))
    return out


def search(vectors: DataFrame, queries: DataFrame, top: int = 10, share: float = 0.65, k: int = 16, sample: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found among the other rows, by exact Euclidean distance in double
    precision, ties to the smaller id. ``vectors`` and ``queries`` have ``id`` and ``v`` as from :func:`usable`.

    A query visits cells that together hold at least ``share`` of all vectors, and ``10 * top`` at least. Cells are cut into
    blocks of about ``BLOCK`` vectors and the visiting queries into blocks as large, so no task holds more than two blocks,
    whatever a cell holds. An id that occurs on several rows takes part with each; only rows of another id than the query's
    are its candidates. Rows with a length other than the index's take no part.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    model = train(vectors, k, sample)
    if model is None:
        return spark.createDataFrame([], schema)
    cells = checkpointed(index(vectors, model))
    count = np.zeros(len(model["a"]) * len(model["b"]), np.int64)
    for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row per cell
        count[r["cell"]] = r["n"]
    want = max(int(np.ceil(share * count.sum())), 10 * top)
    held = spark.sparkContext.broadcast((model, count))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, n = held.value
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at: at + 256]
                if len(part):
                    da, db = half_distances(np.stack(part["v"].to_numpy()), m)
                    hit = [walk(x, y, n, want) for x, y in zip(da, db)]
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "v": part["v"].to_numpy(), "cell": hit})

    q = queries.where(F.size("v") == model["d"]).dropDuplicates(["id", "v"]).select("id", "v")
    n_q = q.count()
    q_blocks = max(1, -(-n_q // BLOCK))
    v_blocks = F.element_at(F.array(*[F.lit(int(max(1, -(-c // BLOCK)))) for c in count]), F.col("cell") + 1)
    asked = q.mapInPandas(visits, "id bigint, v array<double>, cell array<int>").withColumn("cell", F.explode("cell")).withColumn(
        "vb", F.explode(F.sequence(F.lit(0), v_blocks - 1))).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"))
    given = cells.withColumn("vb", F.pmod(F.xxhash64("id", "v"), v_blocks).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def rerank(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids = np.stack(theirs["v"].to_numpy()), theirs["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        out = []
        for i, y in zip(mine["id"], mine["v"]):
            other = ids != i
            d, own = np.sqrt(((x[other] - y) ** 2).sum(axis=1)), ids[other]
            # ids ascend, so a stable order breaks ties by id; everything at the last distance kept is a tie to weigh
            if len(d) > top:
                near = np.flatnonzero(d <= np.partition(d, top - 1)[top - 1])
                near = near[np.argsort(d[near], kind="stable")[:top]]
            else:
                near = np.argsort(d, kind="stable")
            out.append(pd.DataFrame({"query_id": i, "vec_id": own[near], "score": d[near]}))
        return pd.concat(out)

    found = asked.groupBy("cell", "vb", "qb").cogroup(given.groupBy("cell", "vb", "qb")).applyInPandas(rerank, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
