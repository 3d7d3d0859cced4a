"""Spans of regular-expression matches as native columns: code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, OTHER = "\u0001", "\u0002"
SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"


def running_starts(lens: Column) -> Column:
    """Start of each piece from the lengths of all pieces. Pieces are summed in chunks of about the square root of their
    number, so that a text with very many matches stays cheap."""
    size = F.ceil(F.sqrt(F.size(lens))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / size).cast("int")), lambda j: F.slice(lens, j * size + 1, size))
    grow = lambda first, xs: F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    heads = grow(F.lit(0).cast("bigint"), F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)))
    return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), F.slice(heads, 1, F.size(chunks)).alias("h")), lambda z: F.slice(grow(z["h"], z["c"]), 1, F.size(z["c"]))))


def matches(text: Column, pattern: str, kind: int, guard: Column) -> Column:
    """All leftmost non-overlapping matches in order. The pattern must not be able to match ``MARK`` or ``OTHER``; texts
    that fail ``guard`` cannot match and are skipped."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    parts = F.split(marked, MARK, -1)

    def build(wrapped: Column) -> Column:
        return F.flatten(F.transform(wrapped, lambda p: F.when(F.size(p) < 3, F.array().cast(SPAN)).otherwise(spans_of(p))))

    def spans_of(p: Column) -> Column:
        lens = F.transform(p, lambda x: F.length(x).cast("bigint"))
        both = F.arrays_zip(p.alias("p"), running_starts(lens).alias("s"))
        odd = F.filter(both, lambda z, i: i % 2 == 1)
        return F.transform(odd, lambda z: F.struct(F.lit(kind).alias("kind"), z["s"].alias("start"), (z["s"] + F.length(z["p"])).alias("end"), z["p"].alias("value")))

    return F.when(guard, build(F.array(parts))).otherwise(F.array().cast(SPAN))


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas. Needs fields kind, start, end."""
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(plain, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Check sum of a string of digits: every second digit from the right doubled."""
    d = F.transform(F.split(F.reverse(number), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0
