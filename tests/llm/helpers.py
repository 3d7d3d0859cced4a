"""A small corpus with the hard rows: nulls, empty and long texts, copies, repeated rows and clashing column names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score double, _id string, row int"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(n))


def hard_rows(seed=0, n=30):
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(5, 120)) for _ in range(n)]
    texts += [None, "", "   \n\t ", "a", texts[0], texts[0], words(rng, 30_000), "x" * 50_000, "ΩЖ漢字 😀 é"]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", len(t or ""), "k", 0.5, "i", 1) for i, t in enumerate(texts)]
    return rows + [rows[1], (None, texts[2], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def hard(spark, seed=0):
    return spark.createDataFrame(hard_rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
