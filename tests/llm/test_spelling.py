"""Spelling variants against brute force over all pairs of words."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from emberframe.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(count):
    forms, out = {}, []
    links = {w: [x for x in count if near(w, x)] for w in count}
    for w, n in count.items():
        best = min(links[w], key=lambda x: (-count[x], x), default=None)
        if best is not None and count[best] >= 2 * n:
            forms[w] = best
    for w, n in count.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(links[w]), count[forms[w]] if w in forms else None))
    return sorted(out)


def made_words(seed, letters, n):
    r = random.Random(seed)
    count = {}
    base = ["".join(r.choice(letters) for _ in range(r.choice((5, 5, 6, 6, 7, 9, 10, 17)))) for _ in range(n // 4)]
    while len(count) < n:
        w = r.choice(base)
        for _ in range(r.choice((0, 1, 1, 2))):
            i, c = r.randrange(len(w)), r.choice(letters)
            w = r.choice((w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]))
        if len(w) >= 5:
            count[w] = r.choice((3, 3, 4, 6, 12, 40, 90, 400))
    return count


@pytest.mark.parametrize(("cell", "leaf", "pairs"), [(32_768, 24, 1 << 21), (64, 4, 50), (20, 1, 7)])
def test_against_brute_force(spark, monkeypatch, cell, leaf, pairs):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    count = made_words(1, "abcéÿ×", 900) | {"listen": 9, "silent": 30, "enlist": 70, "tinsel": 4, "x" * 300: 5, "x" * 301: 50, "x" * 299 + "y": 3, "aaaaa": 3, "aaaaaa": 7, "aaaaaaa": 15}
    words = spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)
    got = [tuple(r) for r in spelling.variants(words, cell).collect()]
    assert sorted(got) == brute(count)
    assert sum(f is not None for _, f, *_ in got) > 100 and sum(f is not None and f != root for _, f, root, *_ in got) > 20


def test_upper_trees_deal_all_words(spark):
    count = made_words(2, "abcdefgh", 3000)
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    trees = spelling.upper_trees(words, 64)
    assert trees and all(t.leaves > 1 for t in trees.values()) and spelling.upper_trees(words, 3000) == {}


def test_search_finds_every_leaf_within_the_box():
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abcd"), 6)) for _ in range(500)]
    vectors = spelling.counts(spelling.codes(words, 6))
    tree, at = spelling.grow(vectors, 3)
    assert (np.bincount(at, minlength=tree.leaves) > 0).all()
    step = vectors.astype(int)[:, None] - vectors.astype(int)[None]
    for up, down in ((0, 0), (1, 1)):
        q, leaf = spelling.search(tree, vectors, up, down)
        pairs = set(zip(q.tolist(), leaf.tolist(), strict=True))
        inside = (np.maximum(-step, 0).sum(axis=2) <= up) & (np.maximum(step, 0).sum(axis=2) <= down)
        assert {(i, int(at[j])) for i, j in np.argwhere(inside)} <= pairs
        assert len(pairs) < 0.5 * 500 * tree.leaves
    longer = spelling.counts(spelling.codes([w + r.choice(list("abcd")) for w in words], 7))
    tree, at = spelling.grow(longer, 3)
    q, leaf = spelling.search(tree, vectors, 1, 0)
    assert {(i, int(at[i])) for i in range(500)} <= set(zip(q.tolist(), leaf.tolist(), strict=True))


def plain_counts(rows):
    import re

    total = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}


def test_words_and_odd_rows(spark, monkeypatch):
    r = random.Random(8)
    words = [*made_words(3, "abcÉé", 150)]
    rows = [(i, " ".join(r.choice(words).capitalize() for _ in range(300)) + "-DÉJÀ÷vu_漢x") for i in range(40)]
    rows += [(None, None), (None, ""), (7, "12 3"), (None, "repeated words repeated words repeated"), *[(5, "twice the same row")] * 3, (9, "long" * 20_000), (9, "ab " * 20_000)]
    df = spark.createDataFrame([(d, t, "clash", "clash", 1) for d, t in rows], "doc_id long, text string, word string, form string, n int").repartition(4)
    want = plain_counts(rows)
    for flush in (300_000, 10):
        monkeypatch.setattr(spelling, "FLUSH", flush)
        assert {r.word: r.n for r in spelling.word_counts(df).collect()} == want
    assert sorted(tuple(r) for r in spelling.groups(df).collect()) == brute(want)
    assert spelling.groups(df.limit(0)).count() == 0


def test_a_run_loses_one_letter_only():
    """What is left of a run may be a run of the same document that loses a letter too; it stays as it is."""
    for doc_id in range(20_000):
        start = zlib.crc32(f"{doc_id}:".encode())
        hits = [a for a in ("a" * n for n in range(6, 40)) if zlib.crc32(a.encode(), start) % 97 == 0]
        pair = next((a for a in hits if a[1:] in hits), None)
        if pair:
            break
    for text in (f"{pair} {pair[1:]}", f"{pair[1:]} {pair}"):
        assert spelling.thinned(doc_id, text, 97) == {pair[1:]: 1, pair[2:]: 1}
