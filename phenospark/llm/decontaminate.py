"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units give way to typed placeholders. Hashed windows of template words of the
benchmark meet those of the corpus in a join. For documents that hold most windows of an item, what fills the
placeholders is compared: the same filler of the item must always stand for the same filler of the document and the other
way round, so that a question with other parameters is caught and a chance match of two templates is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import checked, let
from phenospark.session import checkpointed

# Units after a number, in lower case.
UNITS = ("%", "cm", "eur", "euro", "euros", "dollars", "feet", "ft", "g", "gb", "hours", "hrs", "inches", "kb", "kg", "km", "kmh", "l", "lb", "lbs", "m", "mb",
         "meters", "mg", "mi", "miles", "min", "minutes", "ml", "mm", "mph", "oz", "pounds", "seconds", "usd", "years")
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
NUMBER = r"(?<!\S)[^\s0-9\p{L}]*+[0-9][0-9.,:/$€£%+-]*+(?!\S)"
NAMED = r"(?<=[^\s.!?:] )\p{Lu}[\p{Ll}\p{M}'’-]++(?=[\s.,;:!?)]|$)"

def template_words(text: Column) -> Column:
    """Template of a text: lower-case words without marks at their ends, typed placeholders for numbers, names and units.
    A capitalised word that does not start a sentence is a name. Words and template words correspond one to one."""
    units = "|".join(UNITS)
    t = F.regexp_replace(F.regexp_replace(text, r"\s++", " "), NAMED, NAME)
    t = F.when(text.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(t, NUMBER, NUM), f"(?i)(?<=(?:^| ){NUM} )(?:{units})(?=[.,;:!?)]* |[.,;:!?)]*$)", UNIT)).otherwise(t)
    return F.split(bare(F.lower(F.trim(t))), " ")


def bare(text: Column) -> Column:
    """Marks next to a blank or an end become nothing, so that words compare without punctuation."""
    return F.regexp_replace(text, r"(?<![^ ])[.,;:!?\"'()\[\]]++|[.,;:!?\"'()\[\]]++(?![^ ])", "")


def plain_words(text: Column) -> Column:
    return F.split(bare(F.lower(F.trim(F.regexp_replace(text, r"\s++", " ")))), " ")


def windows(words: Column, width: int) -> Column:
    """Hashes of all windows, in order; none for fewer words."""
    def hashes(w: Column) -> Column:
        last = F.size(w) - width
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, width)))).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)


def slots(template: Column, raw: Column, at: Column, width: int) -> Column:
    """(position, filler) of the placeholders among the words of a window."""
    both = F.slice(F.arrays_zip(template.alias("t"), raw.alias("r")), at + 1, width)
    return F.filter(F.transform(both, lambda z, i: F.struct((i + at).alias("i"), z["t"].alias("t"), z["r"].alias("r"))), lambda z: z["t"].isin(NUM, NAME, UNIT))


def benchmark_windows(bench: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(item, q, h, total, fills): windows of each item with at least two literal words; fills are placeholder fillers. Items
    under ``width`` words have no window and cannot be found."""
    b = bench.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item is not null").select(
        "item", template_words(F.col("text")).alias("t"), plain_words(F.col("text")).alias("r"))
    # the first word of an item may stand within a sentence of a document and then is a name there
    other = b.where(F.substring(F.ltrim("text"), 1, 1).rlike(r"\p{Lu}") & (F.col("t")[0] != NAME)).select(
        "item", F.concat(F.array(F.lit(NAME)), F.slice("t", 2, F.size("t"))).alias("t"), "r")
    spelled = lambda x: x.select("item", "t", "r", F.posexplode(windows(F.col("t"), width)).alias("q", "h"))
    w = spelled(b).unionByName(spelled(other).where("q = 0"))
    w = w.where(F.size(F.filter(F.slice("t", F.col("q") + 1, width), lambda x: ~x.isin(NUM, NAME, UNIT, ""))) >= 2)
    w = w.select("item", "q", "h", slots(F.col("t"), F.col("r"), F.col("q"), width).alias("fills"))
    return w.join(w.groupBy("item").agg(F.count_distinct("q").alias("total")), "item")


def contaminated(docs: DataFrame, bench: DataFrame, width: int = 5, share: float = 0.8, edits: int = 1, consistent: float = 0.9, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, item, n_windows, share, n_slots, n_changed) for texts that hold enough of an item's template windows with consistent
    placeholders; key is the hash of the text, so copies of a text are one.

    Enough is ``share`` of them or, for items so short that a few changed words break more, all but the ``width`` windows that
    each of ``edits`` changes may break, if that is at least half of them and three.

    ``n_changed`` counts placeholders with another filler than the item's. Where the two sides of a placeholder do not map
    one to one in at least ``consistent`` of the aligned windows, the match is dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text).alias("key")
    bw = checkpointed(benchmark_windows(bench, width, item_col, "text"))
    known = checked(bw.select("h").distinct())
    hits = docs.select(key, F.posexplode(windows(template_words(text), width)).alias("p", "h")).join(known, "h", "left_semi").distinct()
    hits = checkpointed(hits)
    met = hits.join(bw, "h")
    n = F.col("total")
    enough = F.least(share * n, F.greatest(n - edits * width, 0.5 * n, F.least(n, F.lit(3))))
    whole = met.groupBy("key", "item", "total").agg(F.count_distinct("q").alias("n_windows")).where(F.col("n_windows") >= enough)
    whole = checkpointed(whole)
    # fillers of the document, only for texts in question and only where an item has a placeholder
    filled = met.where(F.size("fills") > 0).join(whole.select("key", "item"), ["key", "item"], "left_semi").select("key", "item", "p", "q", "fills")
    asked = checked(filled.select("key").distinct())
    words = docs.select(text.alias("text"), key).join(asked, "key", "left_semi").dropDuplicates(["key"]).select("key", plain_words(F.col("text")).alias("r"))
    pairs = filled.join(words, "key").select("key", "item", "r", F.col("p"), F.col("q"), F.explode("fills").alias("f")).select(
        "key", "item", F.col("f.t").alias("t"), F.col("f.i").alias("i"), F.col("f.r").alias("theirs"), F.element_at("r", (F.col("p") - F.col("q") + F.col("f.i") + 1).cast("int")).alias("ours")).distinct()
    # a filler agrees with the one that it is most often aligned with; every other alignment is a contradiction
    votes = pairs.groupBy("key", "item", "t", "theirs", "ours").agg(F.count("*").alias("n"))
    best = lambda side: votes.groupBy("key", "item", "t", side).agg(F.max("n").alias("n")).groupBy("key", "item").agg(F.sum("n").alias(f"ok_{side}"))
    judged = votes.groupBy("key", "item").agg(F.sum("n").alias("n_slots"), F.sum(F.when(F.col("theirs") != F.col("ours"), F.col("n")).otherwise(0)).alias("n_changed")).join(
        best("theirs"), ["key", "item"]).join(best("ours"), ["key", "item"])
    out = whole.join(judged, ["key", "item"], "left").where(F.col("n_slots").isNull() | (F.least("ok_theirs", "ok_ours") >= consistent * F.col("n_slots")))
    return out.select("key", "item", "n_windows", (F.col("n_windows") / F.col("total")).alias("share"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"))


def report(docs: DataFrame, bench: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, n_windows, share, n_slots, n_changed): one row per contaminated row of ``docs`` and item. Null texts hold
    nothing; null ids and repeated rows have rows of their own; items without an id are not looked for."""
    found = checked(contaminated(docs, bench, item_col=item_col, id_col=id_col, text_col=text_col, **options))
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    return d.join(found, "key").select("doc_id", F.col("item").alias("item_id"), F.col("n_windows"), "share", "n_slots", "n_changed")


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated rows, columns as they are. Null texts, null ids and repeated rows stay unless contaminated."""
    found = checked(contaminated(docs, bench, text_col=text_col, **options).select(F.col("key").alias("_found")).distinct())
    return docs.join(found, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == found["_found"], "left_anti")
