"""Byte-level BPE against the tiktoken library, appends, edits and the exact round trip."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from phenospark.llm import bpe
from tests.llm.helpers import hard, hard_rows

TOKENS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
V = bpe.Vocabulary(TOKENS)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
BITS = ["a", "b", " ", "\n", "é", "ß", "1", "23", "'s", "'ll", "!!", "\x1c", "\x85", "　", "😀", "你", "́", "the", "ing", "  ", "퟿"]


def test_random_texts():
    e, rng = bpe.Encoder(V, P.PATTERN), random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 40)))
        ids = e.encode(t)
        assert ids.tolist() == REF.encode_ordinary(t)
        assert e.decode(ids.tolist()) == t.encode()


def test_random_pieces():
    e, rng = bpe.Encoder(V, P.PATTERN), random.Random(2)
    for _ in range(4000):
        b = bytes(rng.choice(b"abetnhi rs") for _ in range(rng.randint(1, 90)))
        assert e.piece(b) == REF._encode_single_piece(b)


def test_appends_and_edits():
    rng = random.Random(3)
    for _ in range(150):
        b = bytes(rng.choice(b"thean i") for _ in range(500))
        t = bpe.PrefixTable(V, b[:200])
        t.append(b[200:])
        assert t.ids() == bpe.PrefixTable(V, b).ids() == REF._encode_single_piece(b)
        s = rng.randint(0, 400)
        done = t.edit(s, s + 7, b"qua")
        assert t.ids() == bpe.PrefixTable(V, b[:s] + b"qua" + b[s + 7:]).ids()
        assert done <= 500 - s


def test_latin_pattern_is_the_same():
    p = bpe.latin_pattern(P.PATTERN)
    w, rng = bpe.regex.compile(P.PATTERN), random.Random(4)
    for _ in range(3000):
        t = "".join(chr(rng.randrange(256)) for _ in range(30))
        assert p.findall(t) == w.findall(t)


def test_bounded_tables(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    test_random_pieces()


def test_gaps_in_ranks_are_an_error(tmp_path):
    (tmp_path / "r").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "r"))


def test_hard_rows(spark):
    got = hard(spark).select("doc_id", bpe.encoded(spark, TOKENS, P.PATTERN, "text").alias("r")).collect()
    assert len(got) == len(hard_rows())
    text = {r[0]: r[1] or "" for r in hard_rows() if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            ids = REF.encode_ordinary(text[r.doc_id])
            assert r.r["ids"] == ids and r.r["n_tokens"] == len(ids)
            assert r.r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.r["decoded_sha256"] == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_batches_are_not_held():
    """Neither a batch that is done nor all texts of a batch as Python strings."""
    e, size = bpe.Encoder(V, P.PATTERN), 4_000
    base = pa.total_allocated_bytes()

    def batches():
        for k in range(3):
            assert pa.total_allocated_bytes() - base < 2_000_000
            yield pa.array([f"{'the ' * 1000}{k} {i}" for i in range(size)])

    e.encode("the " * 1000)
    tracemalloc.start()
    rows = 0
    for out in bpe._in_slices(e, batches(), False):
        rows += len(out)
        out = None
        if rows % size == bpe.ROWS:  # the texts of a batch have just been made
            tracemalloc.reset_peak()
        elif rows % size:
            assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()
    assert rows == 3 * size
