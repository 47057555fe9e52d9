import zlib

import numpy as np
import pytest

from emberframe.llm import packing
from emberframe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, sequence_id string"


@pytest.fixture(scope="module")
def docs():
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgé漢") for _ in range(r.randint(1, 8)))
    rows = [(i, " ".join(word() for _ in range(r.choice((1, 5, 60, 400, 900)))), "clash") for i in range(120)]
    return [*rows, (500, None, "c"), (501, "", "c"), (502, "x" * 5000, "c"), (502, "x" * 5000, "c"), (None, "no id", "c"), (503, "a <|endoftext|> b", "c"), (504, "wörd " * 9000, "c")]


def test_encoder_matches_tokenizers(docs):
    from tokenizers import Tokenizer

    t, fast = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    extra = ["\n\n  a\t b\r\n", "don't WON'T", "１２３ ⅷ x²", "a b　c", "👩‍🚀 ok", " " * 300, "<|endoftext|>"]
    for text in [d[1] or "" for d in docs] + extra:
        assert list(fast(text)) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("parts", [1, 3])
def test_exact_round_trip(spark, docs, parts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA).repartition(parts), tokenizer_path()).collect()
    pieces, sequences = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text, _ in docs:
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[doc, len(want)])
        copies = docs.count((doc, text, "clash")) + docs.count((doc, text, "c"))
        assert sum(p[1] for p in own) == copies * len(want)
        assert all(p[2] == want[p[0] : p[0] + p[1]].tobytes() for p in own)
        if copies == 1:
            assert [p[0] for p in own] == np.cumsum([0, *[p[1] for p in own[:-1]]]).tolist()
    filled = padded = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        filled += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= 0.02 * filled


def test_cuts_are_harmonic():
    for n in range(1, 5000):
        c = packing.cuts(n, 2048, 64)
        assert sum(c) == n
        assert all(x == 2048 or 2048 - (2048 // x) * x <= 33 or x <= 64 for x in c)


def test_bins_take_a_fixed_count():
    p = packing.Packer(0, 2048, 64)
    for i in range(6):
        p.add(i, np.arange(682, dtype=np.uint32))
    assert [r[5] for r in p.rows] == [0, 0, 0, 1, 1, 1]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_crc(spark):
    from pyspark.sql import functions as F

    df = packing.pack(spark.createDataFrame([(1, "a b", "c")], SCHEMA), tokenizer_path()).select("ids", F.crc32("ids").alias("c"))
    row = df.first()
    assert row.c == zlib.crc32(bytes(row.ids))
