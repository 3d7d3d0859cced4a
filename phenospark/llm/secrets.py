"""Secrets: base patterns, then corpus-wide ownership of every candidate.

Each candidate value is hashed; Spark counts the distinct repositories and owners that hold it. Values that many owners
hold are copied examples; values of one owner look live. Besides the base kinds, mixed tokens of 20 and more characters are
candidates: those that one owner alone holds are added as spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.llm.spans import listed, matches
from phenospark.session import checkpointed

KINDS = ["assign", "access", "hex", "mixed"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end,value>> of the base kinds; the value of an assignment is what is assigned."""
    keyed = F.filter(F.transform(matches(text, ASSIGN, 0, text.rlike("[:=]")), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.regexp_extract(s["value"], ASSIGN, 1).alias("value"))), lambda s: F.length(s["value"]) >= 6)
    digit = text.rlike("[0-9]")
    return F.concat(keyed, matches(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))), matches(text, HEX, 2, text.rlike(r"[0-9a-f]{24}")),
                    F.filter(matches(text, MIXED, 3, digit), lambda s: mixed(s["value"])))


def mixed(value: Column) -> Column:
    """Small and capital letters and digits, and at least 12 different characters."""
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 12)


def ownership(held: DataFrame) -> DataFrame:
    """(h, n_repos, n_owners) from (h, repo, owner). Each step combines before it shuffles, so a value that everyone holds
    costs one row per task. Null repositories and owners count as one of their own."""
    once = held.select("h", F.xxhash64(F.coalesce(F.col("repo").cast("string"), F.lit("\u0000"))).alias("repo"), F.xxhash64(F.coalesce(F.col("owner").cast("string"), F.lit("\u0000"))).alias("owner")).distinct()
    by_owner = once.groupBy("h", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("h").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def find(docs: DataFrame, example_owners: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(doc_id, base, found): base spans, and all spans with n_repos, n_owners and class of their values.

    A value of ``example_owners`` owners or more is an ``example``, of one owner ``live``, else ``shared``. Mixed tokens that touch
    no base span are added if live. Null texts are empty; null ids and repeated rows each keep their own row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), text.alias("text"))
    rows = rows.withColumn("all", base_spans(F.col("text")))
    rows = rows.withColumn("base", F.filter("all", lambda s: s["kind"] < 3)).withColumn(
        "all", F.filter("all", lambda c: (c["kind"] < 3) | ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    rows = rows.select("doc_id", "owner", "repo", F.xxhash64("text").alias("key"), "base", F.transform("all", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("h"))).alias("all"))
    rows = checkpointed(rows)
    some, none = rows.where(F.size("all") > 0), rows.where(F.size("all") == 0)
    spot = some.select("key", "repo", "owner", F.explode("all").alias("s"))
    owned = ownership(spot.select(F.col("s.h").alias("h"), "repo", "owner"))
    label = F.when(F.col("n_owners") >= example_owners, "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    # spans are a matter of the text, so copies of a text are judged once
    per_text = spot.select("key", "s.*").distinct().join(owned.withColumn("class", label), "h").where((F.col("kind") < 3) | (F.col("class") == "live")).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_repos", "n_owners", "class"))).alias("found"))
    shape = "array<struct<start:bigint,kind:int,end:bigint,n_repos:bigint,n_owners:bigint,class:string>>"
    return some.join(per_text, "key", "left").select("doc_id", "base", F.coalesce("found", F.array().cast(shape)).alias("found")).unionByName(
        none.select("doc_id", "base", F.array().cast(shape).alias("found")))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, number of base spans of each kind, digest of the base spans, the list of all spans, and how many
    of them look live or are copied examples. Null texts are empty; null ids and repeated rows keep their own row."""
    r = find(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    is_class = lambda c: F.size(F.filter("found", lambda s: s["class"] == c)).cast("bigint")
    return r.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
                    listed(F.col("found"), KINDS).alias("spans"), is_class("live").alias("n_live"), is_class("example").alias("n_example"))
