"""Line deduplication with a log-template tree.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens. At the leaf the rest of the
line is cut into a few fields. A field whose value recurs over the texts of the leaf is constant, any other is variable;
tokens with a digit are variable in lines that mostly consist of other tokens. The leaf and the constant fields are the line's template. A template that
recurs over the documents is boilerplate: only the first document that holds it keeps its lines.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import let
from phenospark.session import checkpointed

FIELDS = 4
VARIABLE = "<*>"
# Share of the tokens of a line that may be generalised because they hold a digit.
MASKED = 1 / 3
# Scripts written without blanks; so many of their characters count as one more token in the length of a line.
SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
SPACED = f"[^{SCRIPTS}]++"
# Ranges that hold all of these scripts: a quick test before the slow one.
MAYBE = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u19E0-\u19FF\u2E80-\uD7FF\uF900-\uFAFF\uFF66-\uFF9F\x{10000}-\x{3FFFF}]"
PER_TOKEN = 3


def text_key(text: Column) -> Column:
    """Identity of a text; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def wide_tokens(line: Column) -> Column:
    """Tokens that a line counts besides its blank-separated ones: one for every ``PER_TOKEN`` characters of a script without
    blanks."""
    return F.floor(F.length(F.regexp_replace(line, SPACED, "")) / PER_TOKEN).cast("int")


def generalised(t: Column, line: Column) -> Column:
    """Tokens with a digit become ``VARIABLE``, unless they are more than ``MASKED`` of a line: one of which numbers are the content
    is compared as it stands, so only its exact repeats recur."""
    few = lambda m: F.when(F.size(F.filter(m, lambda x: x == VARIABLE)) <= MASKED * F.size(m), m).otherwise(t)
    return F.when(line.rlike("[0-9]"), let(F.transform(t, lambda x: F.when(x.rlike("[0-9]"), VARIABLE).otherwise(x)), few)).otherwise(t)


def parsed(docs: DataFrame, depth: int, min_tokens: int, long_tokens: int | None, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, pos, n, leaf, f0..f3, raw): one row per line of ``min_tokens`` tokens or more in length, everything but
    the id as hashes. raw is the line as it stands, for lines of ``long_tokens`` or more (none without it).

    Blanks are evened out once per text; a line is tokenised once, inside the array that is exploded, because a filter on a
    column would be pushed below its computation and repeat it.
    """
    given = F.coalesce(F.col(text_col), F.lit(""))
    # per text and not per line: its hash, and whether it holds a script without blanks (three bytes a character or more)
    wide = (F.octet_length(given) - F.length(given) >= 2 * PER_TOKEN) & given.rlike(MAYBE)
    keyed = docs.select(text_key(F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"), given.alias("text"), wide.alias("wide"))
    odd = reduce(or_, [F.contains("text", F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")])
    text = F.when(odd, F.regexp_replace("text", r"[ \t\x0B\f\r]++", " ")).otherwise(F.col("text"))
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("pos"), line.alias("line"), F.split(F.trim(line), " ").alias("t")))
    sized = F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), x["t"].alias("t"), (F.size(x["t"]) + F.when(F.col("wide"), wide_tokens(x["line"])).otherwise(0)).alias("length")))
    kept = F.filter(sized, lambda x: (x["t"][0] != "") & (x["length"] >= min_tokens))

    def row(x: Column) -> Column:
        n = F.size(x["t"])
        raw = F.lit(None).cast("bigint") if long_tokens is None else F.when(x["length"] >= long_tokens, F.xxhash64(x["t"]))
        rest = F.greatest(n - depth, F.lit(0))

        def hashed(t: Column) -> Column:
            fields = []
            for k in range(FIELDS):
                a, b = F.floor(rest * k / FIELDS).cast("int"), F.floor(rest * (k + 1) / FIELDS).cast("int")
                fields.append(F.when(b > a, F.xxhash64(F.slice(t, depth + 1 + a, b - a))).alias(f"f{k}"))
            return F.struct(x["pos"].alias("pos"), n.alias("n"), F.xxhash64(n, F.slice(t, 1, depth)).alias("leaf"), *fields, raw.alias("raw"))

        return let(generalised(x["t"], x["line"]), hashed)

    return keyed.select("key", "doc_id", F.explode(F.transform(kept, row)).alias("x")).select("key", "doc_id", "x.*")


def recurring(docs: DataFrame, depth: int = 3, min_docs: int = 3, min_tokens: int = 3, min_constant: int = 8, long_docs: int | None = 2, long_tokens: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, pos): lines to drop, by the hash of the text they stand in.

    Documents are counted by text, so exact copies are one document. Lines under ``min_tokens`` tokens stay; a script without
    blanks is measured by its characters. Lines of ``long_tokens`` or more go from ``long_docs`` texts on if they are the same
    token for token; no template is generalised for them, since two texts are too few to tell what varies. A line may have
    one variable field if at least ``min_constant`` of its tokens are constant. All shuffles carry hashes only; every count
    combines before it shuffles, so that a line that a third of all documents hold costs one row per task.
    """
    lines = checkpointed(parsed(docs, depth, min_tokens, None if long_docs is None else long_tokens, id_col, text_col))
    fs = [f"f{k}" for k in range(FIELDS)]
    hot = lines.groupBy("leaf").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("leaf")
    # distinct lines of the leaves that several texts share, with the number of their texts
    shared = lines.join(hot, "leaf", "left_semi")
    kinds = shared.groupBy("leaf", "n", *fs, "key").agg(F.lit(1).alias("c")).groupBy("leaf", "n", *fs).agg(F.sum("c").alias("texts"))
    kinds = checkpointed(kinds.withColumn("line", F.xxhash64("leaf", *fs)))
    field = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f).alias("v")) for k, f in enumerate(fs)]))
    values = kinds.select("leaf", "line", "n", "texts", field.alias("s")).select("leaf", "line", "n", "texts", "s.*").where("v is not null")
    often = values.groupBy("leaf", "k", "v").agg(F.sum("texts").alias("c")).where(F.col("c") >= min_docs).select("leaf", "k", "v", F.lit(1).alias("constant"))
    marked = values.join(often, ["leaf", "k", "v"], "left").groupBy("leaf", "line", "n", "texts").agg(
        F.sum(F.when(F.col("constant").isNull(), 1).otherwise(0)).alias("open"),
        F.max(F.when(F.col("constant").isNull(), F.col("k"))).alias("at"))
    # a line of its leaf alone (no field) or without a variable field stands for itself; one variable field is generalised
    whole = kinds.select("leaf", "line", "n", "texts", *fs).join(marked.select("leaf", "line", "open", "at"), ["leaf", "line"], "left")
    rest = F.greatest(F.col("n") - depth, F.lit(0))
    width = F.floor(rest * (F.col("at") + 1) / FIELDS) - F.floor(rest * F.col("at") / FIELDS)
    loose = (F.col("open") == 1) & (F.col("n") - width >= min_constant)
    template = F.xxhash64("leaf", *[F.when(loose & (F.col("at") == k), F.lit(k).cast("bigint")).otherwise(F.coalesce(f, F.lit(-1))) for k, f in enumerate(fs)])
    named = whole.select("line", template.alias("template"))
    placed = checkpointed(shared.select("key", "doc_id", "pos", F.xxhash64("leaf", *fs).alias("line")).join(named, "line").select("key", "doc_id", "pos", "template"))
    gone = repeats(placed, "template", min_docs)
    if long_docs is not None:
        gone = gone.unionByName(repeats(lines.where("raw is not null"), "raw", long_docs))
    return gone.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def repeats(lines: DataFrame, name: str, min_docs: int) -> DataFrame:
    """(key, pos) of lines whose ``name`` stands in at least ``min_docs`` texts, without those of the first text."""
    count = lines.groupBy(name, "key").agg(F.min("doc_id").alias("low")).groupBy(name).agg(
        F.count("*").alias("texts"), F.min_by("key", F.struct("low", "key")).alias("first")).where(F.col("texts") >= min_docs).select(name, "first")
    return lines.join(count, name).where("key <> first").select("key", "pos")


def dedup(docs: DataFrame, drop_empty: bool = False, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its own columns, the text without the dropped lines. A text without any dropped line is unchanged, null
    included; a text that loses every line but blank ones goes with ``drop_empty``, else it stays as it is left. Ids may be
    null or repeated, further columns may have any name."""
    drops = recurring(docs, id_col=id_col, text_col=text_col, **options)
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_key(F.col(text_col)).alias("key"))
    j = d.join(drops, "key", "left").withColumn("kept", cleaned(F.col(f"row.`{text_col}`"), F.col("drop")))
    if drop_empty:
        j = j.where(F.col("drop").isNull() | F.col("kept").rlike(r"\S"))
    return j.select(*[(F.col("kept") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names])


def cleaned(text: Column, drop: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(drop, i))  # the list of a text is short or the text is mostly gone
    return F.when(drop.isNull(), text).otherwise(F.array_join(kept, "\n"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, number of lines, number of dropped lines, and the text that is left. A null text is one empty line; copies
    of a text lose the same lines; null ids and repeated rows keep their own row."""
    drops = recurring(docs, id_col=id_col, text_col=text_col, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text_key(F.col(text_col)).alias("key"))
    return d.join(drops, "key", "left").select(
        "doc_id", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("bigint").alias("n_dropped"),
        cleaned(F.col("text"), F.col("drop")).alias("text"))
