"""Personal data: base patterns, then bootstrapped contextual extraction.

Matches of the base patterns are the seeds. The words around them are lexical patterns. All identifier-like tokens of the
corpus, seeds or not, are instances of the patterns around them. Spark scores this bipartite graph in rounds: a pattern is
as sure of a kind as the share of its instances that have it, an instance as sure as the noisy-or of its patterns. Unseen
tokens that reach the threshold are added as spans of the kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.llm.spans import SPAN, digits, listed, luhn, matches
from phenospark.session import checkpointed

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "[A-Za-z0-9._%+-]"
# The base patterns; possessive and started at the left end of a run of local characters or digits, which finds the same matches in linear time.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CONTEXT = 80


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end,value>>: kinds are positions in ``KINDS``."""
    digit = text.rlike("[0-9]")
    ip = F.filter(matches(text, IP, 1, digit & F.contains(text, F.lit("."))), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))))
    card = F.filter(matches(text, CARD, 2, digit), lambda s: F.length(digits(s["value"])).between(14, 19) & luhn(digits(s["value"])))
    phone = F.filter(matches(text, PHONE, 3, F.contains(text, F.lit("+"))), lambda s: F.length(digits(s["value"])).between(10, 15))
    return F.concat(matches(text, EMAIL, 0, F.contains(text, F.lit("@"))), ip, card, phone)


def candidate_spans(text: Column) -> Column:
    """Blank-free tokens with four digits or more, or an ``@``; marks at the ends are not part of them. Kind is -1."""
    raw = matches(text, r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", -1, text.rlike("[0-9@]"))
    cut = F.transform(raw, lambda s: F.struct(
        s["kind"].alias("kind"),
        (s["start"] + F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^[^\p{L}\p{N}+]++", ""))).alias("start"),
        (s["start"] + F.length(_right_cut(s["value"]))).alias("end"),
        F.regexp_replace(_right_cut(s["value"]), r"^[^\p{L}\p{N}+]++", "").alias("value")))
    return F.filter(cut, lambda s: ((F.length(digits(s["value"])) >= 4) | F.contains(s["value"], F.lit("@"))) & (s["end"] > s["start"]))


def _right_cut(value: Column) -> Column:
    """Without the marks at the right end; by reversal, so that long runs of marks cost linear time."""
    return F.reverse(F.regexp_replace(F.reverse(value), r"^[^\p{L}\p{N}]++", ""))


def find(docs: DataFrame, rounds: int = 3, min_support: int = 3, confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): per row of ``docs`` the base spans and the spans that contexts add, both
    array<struct<kind,start,end,value>>.

    A pattern needs ``min_support`` different sure values (seeds, and what earlier rounds found) and ``confidence`` to add spans; copies of a text add no support,
    as instances are counted by value. Null texts are empty; null ids and repeated rows each keep their own row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("other", F.when(F.col("text").rlike("[0-9@]"), candidate_spans(F.col("text"))).otherwise(F.array().cast(SPAN)))
    # a candidate that touches a base span is that entity already
    rows = rows.withColumn("other", F.filter("other", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    near = lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.substring(F.col("text"), F.greatest(s["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT)).cast("int")).alias("left"),
        F.substring(F.col("text"), (s["end"] + 1).cast("int"), F.lit(CONTEXT)).alias("right"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), "base", F.transform(F.concat("base", "other"), near).alias("seen"))
    rows = checkpointed(rows)
    added = discover(rows.where(F.size("seen") > 0).select("key", F.explode("seen").alias("s")).select("key", "s.*"), rounds, min_support, confidence)
    per_text = added.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end", "value"))).alias("added"))
    some, none = rows.where(F.size("seen") > F.size("base")), rows.where(F.size("seen") <= F.size("base"))
    empty = F.array().cast(SPAN)
    joined = some.join(per_text, "key", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))
    return joined.unionByName(none.select("doc_id", "base", empty.alias("added")))


def patterns_of(left: Column, right: Column) -> Column:
    """Lexical patterns around a span: two words before, one on each side, two words after; words in lower case."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}=:]+"), lambda w: w != "")
    lw, rw = words(left), words(right)
    l1, l2, r1, r2 = F.try_element_at(lw, F.lit(-1)), F.try_element_at(lw, F.lit(-2)), F.try_element_at(rw, F.lit(1)), F.try_element_at(rw, F.lit(2))
    return F.filter(F.array(
        F.concat(F.lit("L "), l2, F.lit(" "), l1), F.concat(F.lit("B "), l1, F.lit(" _ "), r1), F.concat(F.lit("R "), r1, F.lit(" "), r2)), lambda p: p.isNotNull())


def discover(seen: DataFrame, rounds: int, min_support: int, confidence: float) -> DataFrame:
    """(key, kind, start, end, value) of unseen tokens, from occurrences (key, kind or -1, start, end, value, left, right).

    Base entities are sure from the start; a value found with ``confidence`` in one round is sure in the next, so its other contexts
    become patterns in their turn."""
    spot = seen.select("key", "kind", "start", "end", "value", F.xxhash64("value").alias("inst"), F.transform(patterns_of(F.col("left"), F.col("right")), lambda p: F.xxhash64(p)).alias("pats"))
    edges = checkpointed(spot.select("inst", "kind", F.explode("pats").alias("pat")).groupBy("inst", "pat").agg(F.max("kind").alias("kind")))
    # a pattern of too few values can never score; any other may come to do so in a later round
    size = checkpointed(edges.groupBy("pat").agg(F.count("*").alias("size")).where(F.col("size") >= min_support))
    live = checkpointed(edges.join(size, "pat", "left_semi"))
    score = live.where("kind >= 0").select("inst", "kind").distinct().withColumn("p", F.lit(1.0))
    for _ in range(rounds):
        hit = live.select("inst", "pat").join(score, "inst")
        pat = hit.groupBy("pat", "kind").agg(F.sum("p").alias("mass"), F.count_if(F.col("p") >= confidence).alias("support")).join(size, "pat")
        pat = pat.select("pat", "kind", F.least(F.col("mass") / F.col("size"), F.lit(1.0)).alias("conf"), "support").where((F.col("support") >= min_support) & (F.col("conf") >= 0.5 * confidence))
        new = live.where("kind < 0").select("inst", "pat").join(pat, "pat").groupBy("inst", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))).alias("p"))
        # an unseen value takes its surest kind, and stays a little less sure than a seed
        best = new.groupBy("inst").agg(F.max_by(F.struct("kind", "p"), F.struct(F.col("p"), -F.col("kind"))).alias("b")).select("inst", "b.kind", F.least("b.p", F.lit(0.999999)).alias("p"))
        score = checkpointed(score.where("p = 1").unionByName(best))
    found = score.where((F.col("p") < 1) & (F.col("p") >= confidence)).select("inst", F.col("kind").alias("as_kind"))
    return spot.where("kind < 0").join(found, "inst").select("key", F.col("as_kind").alias("kind"), "start", "end", "value")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, number of base spans of each kind, digest of the base spans, and the list of all spans. Null texts are empty;
    null ids and repeated rows keep their own row; an empty table gives none."""
    r = find(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return r.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
                    listed(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
