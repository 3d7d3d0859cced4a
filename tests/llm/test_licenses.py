"""License rules against a plain scan of whole texts."""

import re

from phenospark.llm import common, licenses
from tests.llm.helpers import empty, hard, hard_rows, words

CASES = {
    "Released under the MIT License.": ("mit", "mit"),
    "Licensed under the Apache License, Version 2.0 (the \"License\")": ("apache-2", "apache-2"),
    "Image: CC BY-NC-SA 4.0": ("cc-by-nc", "cc-by-nc,cc-by-nc-sa-4.0"),
    "This work is licensed under the GNU General Public License, version 3.": ("", "gpl-3.0"),
    "# SPDX-License-Identifier: LGPL-2.1-or-later": ("", "lgpl-2.1-or-later"),
    "GPLv2 or MIT license": ("", "gpl-2.0,mit"),
    "see https://creativecommons.org/licenses/by-sa/4.0/": ("", "cc-by-sa-4.0"),
    "Redistribution and use in source and binary forms, with or without modification, are permitted": ("", "bsd"),
    "the permit and the license of mitred apache trails": ("", ""),
    "GNU Lesser General Public License v3.0": ("", "lgpl-3.0"),
    "dual: MPL 2.0, EPL-2.0 text: Eclipse Public License v 2.0": ("", "epl-2.0,mpl-2.0"),
}


def brute(text):
    """Every rule over the whole text, every interval against every kept one."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    line = " ".join(w)
    at = {}
    spot = 0
    for i, x in enumerate(w):
        at[spot] = i
        spot += len(x) + 1
    found = []
    for i, rule in enumerate(licenses.RULES.strip().splitlines()):
        priority, label, _, pattern = rule.split(" ", 3)
        for m in re.finditer(f"(?<![^ ])(?:{pattern})(?![^ ])", line):
            a = at[m.start()]
            found.append((int(priority), -(m.group().count(" ") + 1), a, i + 1, label))
    kept = []
    for p, minus, a, i, label in sorted(found):
        if not any(b <= a and a - minus <= b - n for _, n, b, _, _ in kept):
            kept.append((p, minus, a, i, label))
    base = sorted((m, label) for phrase, label in licenses.BASE.items() for m in range(len(w)) if w[m:m + phrase.count(" ") + 1] == phrase.split(" "))
    return len(w), base, sorted((a, a - minus, label) for _, minus, a, _, label in kept)


def demanded(pattern):
    """Words that every match of an expression holds."""
    p = pattern.replace(r"(\S+ )", "")
    optional = r"\([^()]*\)(\?|\{0,\d+\})"
    while "(" in p:
        p = re.sub(optional, "", p, count=1) if re.search(optional, p) else re.sub(
            r"\(([^()]*)\)", lambda m: " ".join(set.intersection(*[set(x.split()) for x in m[1].split("|")])), p, count=1)
    return set(re.sub(r"\{\d+,\d+\}", " ", p).split())


def test_rules_are_well_formed():
    lines = licenses.RULES.strip().splitlines()
    assert len(lines) > 200
    for line in lines:  # a keyword that the expression does not demand would lose matches
        priority, _, keys, pattern = line.split(" ", 3)
        assert 1 <= int(priority) <= 6 and set(keys.split(",")) <= demanded(pattern), line


def test_cases(spark):
    scan = licenses.Scanner(licenses.parse())
    for text, (base, labels) in CASES.items():
        _, b, found, score = scan(text)
        assert ",".join(sorted({s["label"] for s in b})) == base, text
        assert ",".join(sorted({s["label"] for s in b} | {s["label"] for s in found})) == labels, text
        assert (score > 0) == bool(labels)


def mixed_text(n=400, seed=1):
    import random
    rng = random.Random(seed)
    parts = list(CASES) * 3 + [words(rng, 25) for _ in range(n)] + ["ÉÇ license mit", "under the mit-license", "\x7f\x00cc_by~nc x"]
    rng.shuffle(parts)
    return "\n".join(parts)


def test_pieces_find_what_the_whole_text_holds(monkeypatch):
    scan = licenses.Scanner(licenses.parse())
    for text in [mixed_text(), *[r[1] for r in hard_rows()], *CASES]:
        n, base, found = brute(text)
        for size in (common.PIECE, 500, 37):
            monkeypatch.setattr(licenses, "pieces", lambda raw, size=size: common.pieces(raw, size))
            got = scan(text)
            assert got[0] == n and [(s["start"], s["label"]) for s in got[1]] == base
            assert sorted((s["start"], s["end"], s["label"]) for s in got[2]) == found


def test_report_on_hard_rows(spark):
    got = licenses.report(hard(spark)).collect()
    want = sorted((r[0] if r[0] is not None else -1, brute(r[1])[0], 0) for r in hard_rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_base) for r in got) == want
    assert all(r.first_word is None and r.last_word is None and r.base_labels == "" and r.score == 0.0 for r in got)
    assert licenses.report(empty(spark)).count() == 0


def test_query_columns(spark):
    texts = [mixed_text(), "cc by nc cc-by-nc, CC BY NC", None]
    got = licenses.report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        n, base, found = brute(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), base[0][0] if base else None, base[-1][0] if base else None)
        assert r.base_labels == ",".join(sorted({x for _, x in base})) and r.labels == ",".join(sorted({x for _, x in base} | {x for _, _, x in found}))
