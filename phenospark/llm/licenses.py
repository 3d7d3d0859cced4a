"""License scans by ordered signature rules.

A text becomes its lower-case words. Hundreds of hand-written expressions (``license_rules``) are gated by keywords: a rule runs
only on texts that hold all words it needs. Detections are word intervals; they are taken by priority, longer ones first,
and one that lies within an interval already taken is suppressed. The phrases of ``BASE`` are found on their own and stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import pieces
from phenospark.llm.license_rules import RULES

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# How sure a label is, by the priority of the rule that found it; 0 is a base phrase.
SURE = {0: 1.0, 1: 1.0, 2: 0.95, 3: 0.9, 4: 0.75, 5: 0.6, 6: 0.3}
# Words that a match may span at most: so many are scanned again with the next piece of a very long text.
REACH = 64
WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
SPAN = "array<struct<start:bigint,end:bigint,label:string,rule:int,text:string>>"
RESULT = f"n_words bigint, base {SPAN}, found {SPAN}, score double"


class Rule:
    def __init__(self, number: int, line: str) -> None:
        priority, self.label, keys, pattern = line.split(" ", 3)
        self.number, self.priority = number, int(priority)
        self.keys = frozenset(keys.encode().split(b","))
        self.find = re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])").finditer


def parse(rules: str = RULES) -> list[Rule]:
    """Rules by number, from 1; the base phrases come first, at priority 0, numbered from 0 downwards."""
    base = [Rule(-i, f"0 {label} {phrase.replace(' ', ',')} {phrase}") for i, (phrase, label) in enumerate(BASE.items())]
    return base + [Rule(i + 1, line) for i, line in enumerate(rules.strip().splitlines())]


def resolve(found: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The (start, end, priority, rule) that no interval taken earlier contains, by start. Order: priority, length (longest first),
    start, rule number."""
    taken: list[tuple[int, int]] = []
    kept = []
    for s in sorted(found, key=lambda s: (s[2], s[0] - s[1], s[0], s[3])):
        a, b = s[0], s[1]
        near = taken[bisect_left(taken, (b - REACH, 0)):bisect_left(taken, (a + 1, 0))]
        if not any(e >= b for _, e in near):
            insort(taken, (a, b))
            kept.append(s)
    return sorted(kept)


class Scanner:
    def __init__(self, rules: list[Rule]) -> None:
        self.rules = {r.number: r for r in rules}
        self.keys = frozenset(k for r in rules for k in r.keys)
        self.gate: dict[bytes, list[Rule]] = {}
        uses: dict[bytes, int] = {}
        for r in rules:
            for k in r.keys:
                uses[k] = uses.get(k, 0) + 1
        for r in rules:  # filed under its rarest keyword
            self.gate.setdefault(min(r.keys, key=lambda k: (uses[k], k)), []).append(r)

    def detect(self, words: list[bytes], limit: int, offset: int) -> Iterator[tuple[int, int, int, int, str]]:
        """Matches that start before word ``limit``: start, end, priority, rule, matched words."""
        present = self.keys.intersection(words)
        rules = [r for k in present for r in self.gate.get(k, ()) if r.keys <= present]
        if not rules:
            return
        text = b" ".join(words)
        starts = None
        for r in rules:
            for m in r.find(text):
                if starts is None:
                    starts = np.cumsum([0, *[len(w) + 1 for w in words]])
                a, b = np.searchsorted(starts, (m.start(), m.end() + 1)).tolist()
                if a < limit:
                    yield offset + a, offset + b, r.priority, r.number, m.group().decode("utf-8", "replace")

    def __call__(self, text: str | None) -> tuple[int, list, list, float]:
        """n_words, base spans, surviving spans of the rules, score of a text; a null text is an empty one."""
        found: list[tuple[int, int, int, int, str]] = []
        offset, carry, head = 0, [], b""
        raw = (text or "").encode("utf-8", "replace")
        for piece in pieces(raw):
            piece = head + piece.translate(WORDS)
            words, head = piece.split(), b""
            if words and not piece.endswith(b" "):
                head = words.pop()  # the next piece may go on with it
            words = carry + words
            limit = max(len(words) - REACH, 0)
            if limit:
                found += self.detect(words, limit, offset)
            carry, offset = words[limit:], offset + limit
        words = carry + [head] * bool(head)
        found += self.detect(words, len(words), offset)
        spelled = {s[:4]: s[4] for s in found}
        out = lambda spans: [{"start": s[0], "end": s[1], "label": self.rules[s[3]].label, "rule": s[3], "text": spelled[s]} for s in spans]
        base = sorted(s[:4] for s in found if s[2] == 0)
        kept = resolve(s[:4] for s in found if s[2] > 0)
        return offset + len(words), out(base), out(kept), max((SURE[s[2]] for s in [*base, *kept]), default=0.0)


def scanner(text: Column | str = "text", rules: str = RULES) -> Column:
    """Column of struct<n_words, base, found, score> for whole texts; a very long one is scanned piece by piece."""
    scan = Scanner(parse(rules))

    @F.pandas_udf(RESULT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([scan(t) for t in texts], columns=["n_words", "base", "found", "score"])

    return scanned(F.col(text) if isinstance(text, str) else text)


def report(docs: DataFrame, rules: str = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word and last_word (smallest and largest start of a base phrase, else null), base_labels,
    labels (of base phrases and rules, distinct, sorted, joined by commas), score, and the spans of the rules.

    Null and empty texts have no words, no labels and score 0. Repeated rows and null ids each keep their own row; further
    columns are ignored, whatever their names. The work is per text, so there is no key and no shuffle.
    """
    r = docs.select(F.col(id_col).alias("doc_id"), scanner(text_col, rules).alias("r")).select("doc_id", "r.*")
    names = lambda *spans: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(f"{s}.label") for s in spans]))), ",")
    return r.select("doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
                    names("base").alias("base_labels"), names("base", "found").alias("labels"), "score", F.col("found").alias("spans"))
