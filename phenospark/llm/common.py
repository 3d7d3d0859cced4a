"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.session import checkpointed

PIECE = 4 << 20
GROUP = 256
BOUND = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it in a lambda function."""
    return F.element_at(F.transform(F.array(value), use), 1)


def held_out(id_col: Column | str = "doc_id") -> Column:
    """The quarter of ids whose labels no model may see; a null id counts as not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


def checked(df: DataFrame, bound: int = BOUND) -> DataFrame:
    """A stored table, marked for broadcast if its counted rows (a few numbers each) are within ``bound``; beyond it the join
    is left to shuffle."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= bound else df


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most ``per_class`` labelled, not held-out documents of either class, and the class sizes.

    A document labelled twice counts once, with the larger label. The sample holds the documents with the smallest id
    hashes, so a recomputed task draws the same rows; the id list is at most ``2 * per_class`` rows and is broadcast.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label).cast("int").alias("y")).withColumn("_h", F.xxhash64("_id"))
    sizes = {int(r["y"]): int(r["n"]) for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for k in (0, 1):
        part = y.where(F.col("y") == k).orderBy("_h", "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return d.join(F.broadcast(picked.drop("_h")), "_id").select(F.col("_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "y"), sizes


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of ``width`` numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Cut a very long text after the last line end, full stop or blank before ``size`` bytes, never inside a character."""
    at = 0
    while len(raw) - at > size:
        cut = -1
        for mark in (b"\n", b". ", b" "):
            cut = raw.rfind(mark, at + size // 2, at + size)
            if cut >= 0:
                cut += len(mark)
                break
        if cut < 0:
            cut = at + size
            while cut > at and (raw[cut] & 0xC0) == 0x80:
                cut -= 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def groups(texts: Iterable[str | None]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, byte offset in its text, piece) of about ``PIECE`` bytes and ``GROUP`` pieces; memory stays bounded
    for any text length. A null text is an empty one."""
    out, size = [], 0
    for i, t in enumerate(texts):
        at = 0
        for p in pieces((t or "").encode("utf-8", "replace")):
            if out and (size + len(p) > PIECE or len(out) >= GROUP):
                yield out
                out, size = [], 0
            out.append((i, at, p))
            size += len(p)
            at += len(p)
    if out:
        yield out


def lower_bytes(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of two-byte Latin-1 letters in UTF-8; lengths and offsets stay."""
    out = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    if len(buf) > 1:
        second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:] += second.astype(np.uint8) * np.uint8(32)
    return out


class Roller:
    """Hashes of byte ranges by prefix sums of a polynomial modulo 2**64."""

    P = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.n = 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 20)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(self.n, self.P, np.uint64))
                self.down = np.cumprod(np.full(self.n, pow(self.P, -1, 1 << 64), np.uint64))

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        with np.errstate(over="ignore"):
            s = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[: len(buf)], out=s[1:])
            h = (s[ends] - s[starts]) * self.down[starts]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return h


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true runs."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
