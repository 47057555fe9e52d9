"""Token alignment against brute force over byte ranges and plain counts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from emberframe.llm import crosstok
from emberframe.llm.queries import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
ODD = [
    "a <|endoftext|> b </s> <s> <unk> <0x41>", "▁ under", " lead", "  two  spaces ", "tab\tnew\nline\r\n", "ﬁ ligature ｆｕｌｌ", "é combining", "漢字 かな 한국어", "👩‍🚀 ok", "\x00nul\x01",
    "﻿bom", "​zero wide", "x" * 3000, "é" * 700, " ", "\n", "1234567890 " * 50, "ÀÖØöø ßẞ ǅ", "a▁b",
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("etaoinshrdlu éß漢🚀") for _ in range(r.randint(1, 9)))
    return [*(" ".join(word() for _ in range(r.choice((1, 3, 20, 200, 1000)))) for _ in range(60)), *ODD, None, "", "same words same words", "same words same words", ODD[0]]


def brute(texts):
    """Row values of each text by ranges of bytes, with the libraries' own encoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    value = crosstok.byte_values()
    rows, links = [], []
    for text in texts:
        x = y = []
        if text:
            x = [(i, bytes(value[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(text) for p in [two.id_to_piece(i)]]
            if any(b"".join(p for _, p in v) != (" " + text).encode() for v in (x, y)):
                x = y = []
        xe, ye = np.cumsum([0, *(len(p) for _, p in x)]), np.cumsum([0, *(len(p) for _, p in y)])
        own = [(x[i][0], y[j][0]) for i in range(len(x)) for j in range(np.searchsorted(ye, xe[i], "right") - 1, np.searchsorted(ye, xe[i + 1]))]
        links.append(own)
        parts = []
        for lo, hi in zip(c := sorted({*xe.tolist()} & {*ye.tolist()}), c[1:], strict=False):
            parts.append("|".join(",".join(str(v[k][0]) for k in range(np.searchsorted(e, lo), np.searchsorted(e, hi))) for v, e in ((x, xe), (y, ye))))
        rows.append([len(x), len(y), len(parts), len(own), ";".join(parts)])
    count = Counter(p for own in links for p in own)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(*r, sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own)) for r, own in zip(rows, links, strict=True)]


def test_encoders_match_the_libraries(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    for text in texts:
        if text:
            assert crosstok.byte_level(A).encode(text).tolist() == t.encode(" " + text, add_special_tokens=False).ids


def test_gallop_finds_ranks():
    r = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 500), (40, 60), (500, 3000), (3000, 3000)):
        long = np.unique(r.integers(0, 9000, m))
        short = np.unique(np.append(r.integers(0, long[-1] + 1, n), long[-1]))
        for guess in (np.zeros(len(short), int), np.full(len(short), len(long) - 1), r.integers(0, len(long), len(short))):
            assert (crosstok.gallop(short, long, guess) == np.searchsorted(long, short)).all()


@pytest.mark.parametrize(("parts", "block", "chunk"), [(1, 16 << 20, 1 << 20), (3, 500, 200), (5, 1, 1)])
def test_against_byte_ranges(spark, texts, monkeypatch, parts, block, chunk):
    monkeypatch.setattr(crosstok, "CHUNK_BYTES", chunk)
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, groups string, block int").repartition(parts)
    got = crosstok.align(df, lambda: crosstok.byte_level(A), lambda: crosstok.sentence_pieces(B), block_bytes=block).collect()
    want = brute(texts)
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in got) == [(i, *w) for i, w in enumerate(want)]
    assert sum(w[0] > 0 for w in want) > 60 and any(t and not w[0] for t, w in zip(texts, want, strict=True))


def test_ids_and_digests(spark):
    rows = [(None, "one two"), (3, "one two"), (3, "one two"), (3, "other"), (None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (lambda: crosstok.byte_level(A)), (lambda: crosstok.sentence_pieces(B))
    plain = crosstok.align(df, a, b).collect()
    digest = crosstok.align(df, a, b, digest=True).collect()
    assert len(plain) == len(digest) == 6
    hashed = sorted((r.doc_id or -1, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "", r.count_sum) for r in plain)
    assert hashed == sorted((r.doc_id or -1, r.groups, r.count_sum) for r in digest)
    assert [r.count_sum for r in plain if r.groups and r.doc_id is None] == [r.count_sum for r in plain if r.doc_id == 3 and r.n_links == 2][:1]
    assert crosstok.align(df.limit(0), a, b).count() == 0
