"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at up to ``2 r`` differing bits have a common variant at up to ``r`` flipped bits of either. Every distinct
fingerprint therefore emits its ball of radius ``r``. The shuffle is on the leading bits of the variants: a fingerprint is
sent once to each prefix that its ball reaches, and the task of a prefix spells out the variants below it, sorts them and
links the fingerprints that share one. Links are deduplicated, verified by counting differing bits, and closed to
components with checkpointed star steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phenospark.llm.common import checked, let, pieces
from phenospark.operators.components import spread_labels
from phenospark.session import checkpointed

SLOT = 4096
SLICE = 1 << 21
COMMON = 32
SPELLED = 8


def fingerprint_of(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit majority of the XXH64 hashes of all ``width``-word shingles; A-Z in lower case, words cut at ASCII blanks. A
    text of fewer words is one shingle; a null text or one without a word has fingerprint 0."""
    total, bits = 0, np.zeros(64, np.int64)
    carry: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    head = b""
    for raw in pieces((text or "").encode("utf-8", "replace").lower()):
        raw = head + raw
        head = b""
        words = raw.split()
        if words and not raw[-1:].isspace():
            head = words.pop()  # the next piece may go on with it
        words = carry + words
        if len(words) >= width:
            total += _add(words, width, seed, digest, bits)
            carry = words[-(width - 1):] if width > 1 else []
        else:
            carry = words
    if head:
        carry = [*carry, head]
        if len(carry) >= width:
            total += _add(carry, width, seed, digest, bits)
    if not total and carry:
        total += _add(carry, len(carry), seed, digest, bits)
    return int(sum(1 << k for k in np.flatnonzero(2 * bits > total).tolist()))


def _add(words: list[bytes], width: int, seed: int, digest, bits: np.ndarray) -> int:
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    h = np.array([digest(line[a:b - 1], seed) for a, b in zip(starts, ends[width - 1:])], np.uint64)
    for at in range(0, len(h), 65536):
        bits += np.unpackbits(h[at: at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return len(h)


def fingerprint(text: Column | str = "text", width: int = 4) -> Column:
    """Column with the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("bigint")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t, width) for t in texts], np.uint64).astype(np.int64))

    return fp(F.col(text) if isinstance(text, str) else text)


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of up to ``radius`` set bits among the lowest ``bits``, fewest bits first."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.uint64)


def links(fps: DataFrame, distance: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """(by, u, v) with u > v: links between distinct fingerprints ``fp`` at up to ``distance`` differing bits, enough to connect
    every pair in reach: of the fingerprints that share a variant, each is linked to the smallest. ``by`` names columns that
    keep several sets of fingerprints apart.

    The number of prefix bits follows the number of fingerprints, so that a prefix gets about ``SLOT`` of them; a task spells
    out variants in slices of bounded size.
    """
    radius = (distance + 1) // 2
    by = list(by)
    n = fps.count() if not by else fps.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    high = 0
    while high < 40 and n * len(ball(high, min(radius, high))) > SLOT << high:
        high += 1
    low = 64 - high
    reach = [int(x) for x in ball(high, min(radius, high))]
    # prefix bits that differ and, for each count of them, the flips that are left for the low bits
    sent = fps.select(*by, "fp", F.explode(F.transform(
        F.array(*[F.lit(x) for x in reach]), lambda m: F.shiftrightunsigned("fp", low).bitwiseXOR(m) if high else F.lit(0).cast("bigint"))).alias("slot"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(group["fp"].to_numpy().astype(np.uint64))
        slot = np.uint64(group["slot"].iloc[0])
        tail = np.uint64((1 << low) - 1) if low < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
        spent = np.bitwise_count((fp >> np.uint64(low)) ^ slot) if high else np.zeros(len(fp), np.uint8)
        u, v = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        total = sum(int((spent == k).sum()) * len(ball(low, radius - k)) for k in range(radius + 1))
        cut = 0
        while total >> cut > SLICE:
            cut += 1
        for part in range(1 << cut):
            keys, owners = [], []
            for k in range(radius + 1):
                mine = np.flatnonzero(spent == k)
                if not len(mine):
                    continue
                masks = ball(low, radius - k)
                step = max(1, SLICE // len(masks))
                for at in range(0, len(mine), step):
                    own = mine[at: at + step]
                    var = (fp[own] & tail)[:, None] ^ masks[None]
                    if cut:  # slices by a mix of the variant's bits
                        take = (var * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - cut) == np.uint64(part)
                        keys.append(var[take])
                        owners.append(np.broadcast_to(own[:, None], var.shape)[take].astype(np.int32))
                    else:
                        keys.append(var.ravel())
                        owners.append(np.repeat(own.astype(np.int32), len(masks)))
            key, own = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key)
            key, own = key[order], own[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.flatnonzero(new)
            small = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(key))))
            pair = np.unique(own[own != small].astype(np.int64) << 32 | small[own != small])
            u.append(fp[pair >> 32])
            v.append(fp[pair & 0xFFFFFFFF])
        return pd.DataFrame({**{b: group[b].iloc[0] for b in by}, "u": np.concatenate(u).astype(np.int64), "v": np.concatenate(v).astype(np.int64)})

    kinds = dict(fps.dtypes)
    found = sent.groupBy(*by, "slot").applyInPandas(meet, "".join(f"{b} {kinds[b]}, " for b in by) + "u bigint, v bigint").distinct()
    return found.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)


def components(docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): fingerprint and smallest document id reachable over links, per row of ``docs``.

    Rows with equal fingerprints are one node, so a group of copies of any size is one row of the search. Rows without an id
    keep a null id and take the component of their fingerprint, whose id is null if no row of it has one.
    """
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_col, width).alias("fp")))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = spread_labels(links(nodes.select("fp"), distance), [])
    group = F.coalesce("component", "fp")
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", group)
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def word_fingerprints(text: Column | str = "text", tables: int = 4) -> Column:
    """Column with ``tables`` independent 64-bit SimHashes of the set of words of a text. One changed word in fifty moves few
    of their bits, whereas each word changes five shingles of five words."""

    @F.pandas_udf("array<bigint>")
    def fps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        odd = [np.uint64(0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1E * k & 0xFFFFFFFFFFFFFFFF | 1) for k in range(tables)]
        for texts in batches:
            out = []
            for t in texts:
                words: set[bytes] = set((t or "").encode("utf-8", "replace").lower().split())
                h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
                row = []
                for m in odd:
                    x = h * m
                    x ^= x >> np.uint64(31)
                    x *= np.uint64(0xD6E8FEB86659FD93)
                    x ^= x >> np.uint64(32)
                    ones = np.zeros(64, np.int64)
                    for at in range(0, len(x), 65536):
                        ones += np.unpackbits(x[at: at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    row.append(int(np.packbits(2 * ones > len(x), bitorder="little").view("<i8")[0]))
                out.append(np.array(row, np.int64))
            yield pd.Series(out)

    return fps(F.col(text) if isinstance(text, str) else text)


def shingle_set(text: Column, width: int) -> Column:
    """Distinct hashes of the word shingles; a text of fewer words is one shingle, one without a word has none."""
    def hashes(words: Column) -> Column:
        n = F.size(words)
        own = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, width)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(own))

    return let(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]++"), lambda w: w != ""), hashes)


def near_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, tables: int = 1, distance: int = 4, text_col: str = "text", rounds: int = 2) -> DataFrame:
    """(key, part): text hashes that have a near-duplicate, and the smallest text hash that they are linked to.

    Texts are linked if their sets of ``width``-word shingles have a Jaccard similarity of at least ``similarity``: all such links
    count. First candidates are the ball-hashing links of ``tables`` word fingerprints, where texts with equal fingerprints meet the
    one with the smallest hash. Then texts meet by prefix shingles (:func:`prefix_index`): in ``rounds`` each shingle's texts meet one
    of them, which spares pairs where many texts share a shingle, and at last all texts of a shingle that are not linked yet meet each
    other, which misses none. Candidates whose sketches differ too much go; each other one is verified on whole texts."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = checkpointed(texts.select("key", word_fingerprints("text", tables).alias("fps")).groupBy("key").agg(F.first("fps").alias("fps")))
    of = rows.select("key", F.posexplode("fps").alias("k", "fp"))
    heads = checkpointed(of.groupBy("k", "fp").agg(F.min("key").alias("head")))
    same = of.join(heads, ["k", "fp"]).where("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v"))
    near = links(heads.select("k", "fp"), distance, ["k"]).join(heads.select("k", F.col("fp").alias("u"), F.col("head").alias("a")), ["k", "u"]).join(
        heads.select("k", F.col("fp").alias("v"), F.col("head").alias("b")), ["k", "v"]).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    own = checkpointed(prefixes(texts, width, similarity))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(alike(checkpointed(pairs.distinct()), own, similarity))
        return checkpointed(verified(pairs, checkpointed(shingles_of(texts, ends(pairs), width)), similarity))

    good = linked(same.unionByName(near))
    index = checkpointed(prefix_index(texts, own, width, similarity))
    meet = index.agg(F.avg((F.col("c") - 1) / 2)).first()[0] or 0.0  # pairs an entry, all with all
    for turn in [*(range(rounds) if meet > COMMON / 4 else ()), None]:
        labels = checkpointed(spread_labels(good, []).select(F.col("node").alias("key"), F.col("component").alias("part")))
        entries = checkpointed(unlinked(index, labels))
        if entries.isEmpty():
            return labels
        good = good.unionByName(linked(meetings(entries, similarity, turn)))
    return spread_labels(good, []).select(F.col("node").alias("key"), F.col("component").alias("part"))


def ends(pairs: DataFrame) -> DataFrame:
    """(key): the texts of the pairs."""
    return pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()


def sketch(s: Column) -> Column:
    """Column with the counts of a set's hashes by their lowest byte, 255 at most, as 256 bytes."""

    @F.pandas_udf("binary")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sets in batches:
            yield pd.Series([np.minimum(np.bincount(np.asarray(h, np.int64) & 255, minlength=256), 255).astype(np.uint8).tobytes() for h in sets], dtype=object)

    return counts(s)


def sketch_distance(a: Column, b: Column) -> Column:
    """Column with a lower bound of the number of hashes that are in one of two sets only, from their sketches."""

    @F.pandas_udf("int")
    def differ(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), 256).astype(np.int32) for v in (a, b))
        return pd.Series(np.abs(x - y).sum(axis=1).astype(np.int32))

    return differ(a, b)


def alike(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The pairs that may be similar by their sketches; similar sets of n and m hashes differ in (1 - similarity) / (1 + similarity)
    of n + m at most."""
    sk = own.join(checked(ends(pairs)), "key", "left_semi").select("key", "n", "sk")
    j = pairs.join(sk.toDF("u", "nu", "su"), "u").join(sk.toDF("v", "nv", "sv"), "v")
    most = (1 - similarity) / (1 + similarity) * (F.col("nu") + F.col("nv")) + 1e-6
    return j.where(sketch_distance(F.col("su"), F.col("sv")) <= most).select("u", "v")


def shingles_of(texts: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(key, s): the shingle sets of the texts whose key is ``asked`` for."""
    return texts.join(checked(asked.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"]).select("key", shingle_set(F.col("text"), width).alias("s"))


def reach(n: Column | str, similarity: float) -> Column:
    """Shingles of a set of ``n``, in any order common to all sets, among which every similar set has one of its own first ones."""
    n = F.col(n) if isinstance(n, str) else n
    return (n - F.ceil(similarity * n - 1e-9) + 1).cast("int")


def prefixes(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(key, n, s, sk): size of each text's shingle set, the first hashes by which similar texts must meet, and its sketch.
    Texts without a word share one entry."""
    sets = texts.select("key", shingle_set(F.col("text"), width).alias("s")).select("key", F.size("s").alias("n"), F.sort_array("s").alias("s"))
    first = F.when(F.col("n") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.slice("s", 1, reach("n", similarity)))
    return sets.select("key", "n", first.alias("s"), sketch(F.col("s")).alias("sk")).groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "s", "sk")])


def prefix_index(texts: DataFrame, own: DataFrame, width: int, similarity: float) -> DataFrame:
    """(h, key, n, at, c): the shingles by which similar texts must meet, of those that two texts have; ``at`` counts from 1, ``c`` is
    the number of texts.

    The common order is that of the hashes, so a text's prefix needs no counts. Where that brings more than ``COMMON`` texts
    under a shingle, this shingle and those that are as frequent among its texts go to the end of the order, frequent ones last, and
    the texts with such a shingle in their prefix are ranked anew; the prefix of any other text is the same in both orders. Any order
    finds all links, so one text in ``SPELLED`` is enough to see what is frequent among them.
    """
    met = own.select("key", "n", F.posexplode("s").alias("at", "h")).withColumn("at", F.col("at") + 1)
    c = F.count("*").over(W.partitionBy("h"))
    index = checkpointed(met.withColumn("c", c).where("c > 1"))
    many = index.where((F.col("c") > COMMON) & (F.col("n") > 0))
    if many.isEmpty():
        return index
    some = many.where(F.pmod(F.xxhash64("key"), F.lit(SPELLED)) == 0).select("key").distinct()
    spelled = shingles_of(texts, some, width).select("key", F.explode("s").alias("h")).groupBy("h").agg((F.count("*") * SPELLED).alias("f")).where(F.col("f") > COMMON)
    frequent = checked(spelled.unionByName(many.groupBy("h").agg(F.max("c").alias("f"))).groupBy("h").agg(F.max("f").alias("f")))
    moved = checkpointed(own.where("n > 0").select("key", F.explode("s").alias("h")).join(frequent, "h", "left_semi").select("key").distinct())
    whole = shingles_of(texts, moved, width).select("key", F.size("s").alias("n"), F.explode("s").alias("h")).join(frequent, "h", "left")
    # one text a window
    ranked = whole.withColumn("at", F.row_number().over(W.partitionBy("key").orderBy(F.coalesce("f", F.lit(0)), "h"))).where(F.col("at") <= reach("n", similarity))
    stay = met.join(checked(moved), "key", "left_anti")
    columns = ["h", "key", "n", "at"]
    return stay.select(*columns).unionByName(ranked.select(*columns)).withColumn("c", c).where("c > 1")


def unlinked(index: DataFrame, labels: DataFrame) -> DataFrame:
    """``index`` with each text's ``part``, of the shingles whose texts are not all of one part."""
    e = index.drop("c").join(checked(labels), "key", "left").withColumn("part", F.coalesce("part", "key"))
    open_ = e.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("h")
    return e.join(open_, "h", "left_semi")


def meetings(entries: DataFrame, similarity: float, turn: int | None) -> DataFrame:
    """(u, v): texts of different parts under a shingle that may be similar by their sizes and by what can follow the shingle. With
    ``turn`` a shingle's texts meet one of them, another one at each turn; without, each other."""
    a = entries.select("h", F.col("key").alias("u"), F.col("part").alias("pu"), F.col("n").alias("nu"), F.col("at").alias("iu"))
    b = entries.select("h", F.col("key").alias("v"), F.col("part").alias("pv"), F.col("n").alias("nv"), F.col("at").alias("iv"))
    if turn is not None:
        b = b.groupBy("h").agg(F.min_by(F.struct("v", "pv", "nv", "iv"), F.xxhash64(F.lit(turn), "v")).alias("b")).select("h", "b.*")
    need = similarity / (1 + similarity) * (F.col("nu") + F.col("nv")) - 1e-9
    may = (F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - 1e-9) & (1 + F.least(F.col("nu") - F.col("iu"), F.col("nv") - F.col("iv")) >= need)
    order = F.col("u") > F.col("v") if turn is None else F.lit(True)
    return a.join(b, "h").where(order & (F.col("pu") != F.col("pv")) & may).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of at least ``similarity``."""
    j = pairs.join(sets.select(F.col("key").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("s").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    return j.where(both >= similarity * (F.size("a") + F.size("b") - both)).select("u", "v")


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, columns as they are: the smallest id (a null one only if there is
    no other), then the smallest text hash. Null and empty texts are one group; of rows with equal id and text one stays."""
    names = docs.columns
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    labels = near_groups(docs, similarity, width, text_col=text_col)
    # one row per id and text first, so that copies of a text do not meet in one task
    ids = checkpointed(docs.select(F.col(id_col).alias("id"), key.alias("key")).groupBy("key", "id").agg(F.count("*").alias("n")))
    low = ids.groupBy("key").agg(F.min("id").alias("id"))
    groups = low.join(labels, "key", "left").withColumn("group", F.coalesce("part", "key"))
    stays = groups.groupBy("group").agg(F.min_by(F.struct("id", "key"), F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))).alias("s")).select("s.id", "s.key")
    # the rows that go are few, so that the texts need no shuffle
    goes = checked(ids.join(stays, ids["key"].eqNullSafe(stays["key"]) & ids["id"].eqNullSafe(stays["id"]), "left_anti").select("id", "key"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), key.alias("key"))
    kept = d.join(goes, d["key"].eqNullSafe(goes["key"]) & d["id"].eqNullSafe(goes["id"]), "left_anti")
    if not ids.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["key", "id"])
    return kept.select("row.*")
