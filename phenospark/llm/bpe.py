"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one token that can end its encoding: the one that is a valid neighbour of the last
token of the prefix before it. Storing that token per prefix encodes in one pass, appends exactly by looking at the new
bytes only, and after an edit recomputes no further than where the stored tokens agree again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

CACHE = 60_000
ROWS = 500
CACHED_BYTES = 64
SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens with their ranks."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ... without a gap")
    return [t for _, t in pairs]


class Vocabulary:
    """Ranks, the two tokens that each token is merged from, and which pairs may stand side by side."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        self.parts: list[tuple[int, int] | None] = [None] * len(tokens)
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}
        self.usable = [len(t) == 1 for t in tokens]
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None and a < i and b < i and self.usable[a] and self.usable[b] and self._fit(a, b):
                    self.parts[i], self.merged[a, b], self.usable[i] = (a, b), i, True
                    break
        self.usable_rank = {t: i for i, t in enumerate(tokens) if self.usable[i]}
        #: the token of each byte string that is one, -1 for other ends of tokens
        self.suffix = {t[k:]: -1 for t in self.usable_rank for k in range(len(t))} | self.usable_rank
        self.pairs.clear()

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging by rank would leave the boundary between ``a`` and ``b`` alone: undo the later of the merges next to
        the boundary step by step; no pair that meets there may have a merge that would have come first."""
        limit = len(self.tokens)
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            pa, pb = self.parts[a], self.parts[b]
            if pa is None and pb is None:
                return True
            # equal tokens on both sides: the left one is formed first, so the right one is undone first
            if pb is None or (pa is not None and a > b):
                limit, a = a, pa[1]
            else:
                limit, b = b + 1, pb[0]

    def fit(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= 2 * CACHE:
                self.pairs.clear()
            ok = self.pairs[key] = self._fit(a, b)
        return ok


class PrefixTable:
    """The last token of every prefix of a byte string; grows by appending and follows edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def _token(self, end: int) -> int:
        suffix, fit, data, last = self.v.suffix, self.v.fit, self.data, self.last
        for start in range(end - 1, -1, -1):
            t = suffix.get(bytes(data[start:end]))
            if t is None:
                break
            if t >= 0 and (start == 0 or fit(last[start - 1], t)):
                return t
        raise ValueError("a byte has no token")

    def append(self, data: bytes) -> None:
        """Exact: tokens of earlier prefixes do not change."""
        n = len(self.data)
        self.data += data
        for end in range(n + 1, len(self.data) + 1):
            self.last.append(self._token(end))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start`` to ``end``; returns how many prefixes were recomputed."""
        tail, old = self.last[end:], self.data[end:]
        self.data = self.data[:start] + new + old
        self.last = self.last[:start]
        agree, done = 0, 0
        while len(self.last) < len(self.data):
            k = len(self.last) - start - len(new)  # position in the unchanged tail
            if k >= 0 and agree >= self.v.longest:
                self.last += tail[k:]
                break
            t = self._token(len(self.last) + 1)
            done += 1
            agree = agree + 1 if k >= 0 and tail[k] == t else 0
            self.last.append(t)
        return done

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            t = self.last[at - 1]
            out.append(t)
            at -= len(self.v.tokens[t])
        return out[::-1]


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of the first 256 code points, with the classes written out, for the faster standard
    engine; None if it has escapes other than these classes."""
    sets = {k: "".join(f"\\x{c:02x}" for c in range(256) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out, at, inside = "", 0, False
    while at < len(pattern):
        known = next((k for k in sets if pattern.startswith(k, at)), None)
        if known:
            out += sets[known] if inside else f"[{sets[known]}]"
            at += len(known)
        elif pattern.startswith(r"\S", at) and not inside:
            out += f"[^{sets[chr(92) + 's']}]"
            at += 2
        elif pattern[at] == "\\":
            return None
        else:
            inside = (inside or pattern[at] == "[") and pattern[at] != "]"
            out += pattern[at]
            at += 1
    return re.compile(out)


class Encoder:
    """Pieces of the splitting pattern to ids, with bounded tables of encoded pieces and of last tokens by byte prefix."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.v, self.wide, self.cache, self.last = vocabulary, regex.compile(pattern), {}, {}
        self.latin = latin_pattern(pattern)

    def piece(self, data: bytes) -> list[int]:
        """A piece that is a token is that token; any other extends the longest prefix whose last token is known."""
        whole = self.v.rank.get(data)
        if whole is not None:
            return [whole]
        if len(data) > CACHED_BYTES:
            return PrefixTable(self.v, data).ids()
        last, suffix, pairs, n = self.last, self.v.suffix, self.v.pairs, len(data)
        if len(last) >= 2 * CACHE:
            last.clear()
        known = n
        while known and data[:known] not in last:
            known -= 1
        for end in range(known + 1, n + 1):
            start = end - 1
            while True:
                t = suffix[data[start:end]]
                if t >= 0:
                    if start == 0:
                        break
                    left = last[data[:start]]
                    ok = pairs.get(left << 32 | t)
                    if ok if ok is not None else self.v.fit(left, t):
                        break
                start -= 1
            last[data[:end]] = t
        out, tokens = [], self.v.tokens
        while n:
            t = last[data[:n]]
            out.append(t)
            n -= len(tokens[t])
        return out[::-1]

    def split(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin.findall(text)
            except UnicodeEncodeError:
                pass
        return self.wide.findall(text)

    def encode(self, text: str) -> np.ndarray:
        cache, out = self.cache, []
        for p in self.split(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "replace"))
                if len(p) <= CACHED_BYTES:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return np.array(out, "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, ids))


def _encoder(model: dict) -> Encoder:
    """The encoder of a worker; it stays with the broadcast value, so that a worker's later tasks find its tables filled."""
    if "encoder" not in model:
        model["encoder"] = Encoder(Vocabulary(model["tokens"]), model["pattern"])
    return model["encoder"]


def encoded(spark, tokens: list[bytes], pattern: str, text: Column | str = "text") -> Column:
    """Column with the ids of each text and the digests of :func:`digests`; a null or empty text has no ids."""
    return _column(spark, tokens, pattern, text, True)


def digests(spark, tokens: list[bytes], pattern: str, text: Column | str = "text") -> Column:
    """Column with the number of ids, the SHA-256 of the ids as little-endian 32-bit integers, and the SHA-256 of the bytes that
    decoding the ids gives back. A null text is an empty one."""
    return _column(spark, tokens, pattern, text, False)


def _column(spark, tokens: list[bytes], pattern: str, text: Column | str, with_ids: bool) -> Column:
    held = spark.sparkContext.broadcast({"tokens": tokens, "pattern": pattern})

    @F.arrow_udf(("ids array<int>, " if with_ids else "") + SCHEMA)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _in_slices(_encoder(held.value), batches, with_ids)

    return encode(F.col(text) if isinstance(text, str) else text)


def _in_slices(e: Encoder, batches: Iterator[pa.Array], with_ids: bool) -> Iterator[pa.Array]:
    """Results of ``ROWS`` rows at a time; a batch is let go before the next one is read."""
    for texts in batches:
        for at in range(0, len(texts), ROWS):
            yield _digested(e, texts.slice(at, ROWS), with_ids)
        texts = None


def _digested(e: Encoder, texts: pa.Array, with_ids: bool) -> pa.StructArray:
    """The result of a few rows; only their texts are Python strings at a time."""
    ids, sums, decoded = [], [], []
    for t in texts:
        got = e.encode(t.as_py() or "")
        ids.append(got)
        sums.append(hashlib.sha256(got).hexdigest())
        decoded.append(hashlib.sha256(e.decode(got.tolist())).hexdigest())
    sizes = np.array([len(x) for x in ids])
    out = {"n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
    if with_ids:
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        out = {"ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))} | out
    return pa.StructArray.from_arrays(list(out.values()), list(out))
