import collections
import hashlib
import random

import pytest

from emberframe.llm import repeats

SCHEMA = "doc_id long, text string, k long, flags string"


def brute(docs, length):
    """Counter of (doc_id, n_bytes, spans, sha256) by looking at every string."""
    texts = [(d[0], (d[1] or "").encode()) for d in docs]
    seen = collections.Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = collections.Counter()
    for doc, b in texts:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(c for c, v in zip(b, cover, strict=True) if not v)
        out[doc, len(b), sum(1 for run in bytes(cover).split(b"\0") if run), hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df, length):
    out = collections.Counter()
    for r in repeats.repeated(df, length).collect():
        assert all(a.end <= b.start - 1 for a, b in zip(r.spans, r.spans[1:], strict=False))
        assert r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)
        out[r.doc_id, r.n_bytes, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_against_brute_force(spark, sf_dir, parts):
    r = random.Random(parts)
    base = [(x[0], x[1]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    docs = [*base, (1000, None), (1001, ""), (1002, "a" * 1000), (1003, "a" * 399), (1004, "ab" * 450), (1005, base[3][1]), (1005, base[3][1]), (None, base[8][1][100:900]), (1007, base[8][1][300:705]), (1008, "é" * 200), (1009, "é" * 300)]
    for i in range(50):
        text = r.choice(base)[1]
        at = r.randrange(max(1, len(text) - 500))
        piece = text[at : at + r.randrange(350, 900)]
        docs.append((2000 + i, f"zz{i} {piece} qq{i}"))
    hot = base[20][1][:700]
    docs += [(3000 + i, f"{i} {hot} {i * 7}") for i in range(40)]
    docs += [(4000 + i, base[21][1][:k] + "#" + base[21][1][k:]) for i, k in enumerate(range(5, 600, 40))]
    df = spark.createDataFrame([(*d, i, "x") for i, d in enumerate(docs)], SCHEMA).repartition(parts)
    assert got(df, 400) == brute(docs, 400)


def test_other_length_and_empty(spark):
    docs = [(1, "0123456789" * 20), (2, "x" + "0123456789" * 9), (3, "unlike")]
    df = spark.createDataFrame([(*d, 0, "") for d in docs], SCHEMA)
    assert got(df, 150) == brute(docs, 150)
    assert repeats.repeated(df.limit(0)).count() == 0


def test_stretches_of_long_texts(monkeypatch):
    """A text parsed in stretches has the triggers, keys and strings of the whole."""
    import numpy as np

    r = random.Random(8)
    data = bytes(r.choice(b"abcd ") for _ in range(9000)) + b"x" * 1500 + bytes(r.choice(b"ab") for _ in range(2500))
    whole = repeats.parse(data, 400)
    want = list(zip(whole.triggers.tolist(), whole.inner_keys().tolist(), *(c.tolist() for c in repeats._class_digests(whole, data)), strict=True))
    got, known, loose = [], [], []
    for begin, low, high, p in repeats.parses(data, 400, core=1000):
        own = (p.triggers >= low) & (p.triggers < high)
        digests = [c[own].tolist() for c in repeats._class_digests(p, data[begin : begin + p.n])]
        got += zip((p.triggers[own] + begin).tolist(), p.inner_keys()[own].tolist(), *digests, strict=True)
        a, b = repeats._settled(p, low, high, repeats._flags(p, begin, whole.triggers * 8 + 3))
        known += (a + begin).tolist()
        loose += (b + begin).tolist()
    assert got == want
    a, b = repeats._settled(whole, 0, len(data), np.full(len(whole.triggers), 3))
    assert known == a.tolist() and loose == b.tolist() and len(known) + len(loose) == len(data) - 399


def test_suffix_orders_against_brute_force():
    """Random representatives over two letters: every string of every group, counted plainly."""
    import numpy as np

    for seed in range(12):
        r = random.Random(seed)
        n, length, inner = r.randint(1, 40), 12, 5
        bit = lambda k: bytes(r.choice(b"ab") for _ in range(k))
        group = np.sort([r.randrange(3) for _ in range(n)])
        core = [bit(inner) for _ in range(3)]
        back, ahead = [bit(r.choice((7, 7, 7, 2, 0))) for _ in range(n)], [core[g] + bit(r.choice((7, 7, 3))) for g in group]
        weight = np.array([r.choice((1, 1, 2)) for _ in range(n)])
        strings = {(i, a): back[i][len(back[i]) - a :] + ahead[i][: length - a] for i in range(n) for a in range(8) if len(back[i]) >= a and len(ahead[i]) >= length - a}
        count = collections.Counter()
        for (i, a), x in strings.items():
            count[group[i], a, x] += weight[i]
        again, alone = repeats.repeated_starts(group, back, ahead, weight, length, inner)
        assert {tuple(t) for t in again.T.tolist()} == {(i, a) for (i, a), x in strings.items() if count[group[i], a, x] > 1}
        assert {tuple(t) for t in alone.T.tolist()} == {(i, a) for (i, a), x in strings.items() if count[group[i], a, x] == 1}


def test_inner_keys_with_many_classes_are_dealt_out(spark, monkeypatch):
    """A passage shorter than a string with other text on both sides in every document, in parts of three."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(330)
    docs = [(i, f"{word(300)}{passage}{word(300)}") for i in range(25)]
    docs += [(100 + i, docs[i][1][:60] + "!" + docs[i][1][150:800]) for i in range(8)]
    df = spark.createDataFrame([(*d, 0, "") for d in docs], SCHEMA)
    for part in (4096, 3):
        monkeypatch.setattr(repeats, "PART", part)
        assert got(df, 400) == brute(docs, 400)


def test_strings_repeated_in_one_part_reach_the_others(spark, monkeypatch):
    """Strings of three and more places, of which one part may hold several and another only one."""
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(330)
    docs = []
    for i in range(8):
        front, back = word(150), word(150)
        docs += [(10 * i + j, f"{word(60 + j)}{front[-40 - 9 * j:]}{passage}{back[: 60 + 11 * j]}{word(90)}") for j in range(5)]
        docs += [(10 * i + 9, docs[-1][1])]
    df = spark.createDataFrame([(*d, 0, "") for d in docs], SCHEMA)
    for part in (4096, 3):
        monkeypatch.setattr(repeats, "PART", part)
        assert got(df, 400) == brute(docs, 400)


def test_triggers_are_local():
    import numpy as np

    r = random.Random(5)
    piece = bytes(r.randrange(97, 123) for _ in range(3000))
    a, b = repeats.parse(b"q" * 517 + piece, 400), repeats.parse(b"zz" + piece + b"tail" * 9, 400)
    inner = lambda p, at: [t - at for t in p.triggers if at <= t <= at + 3000 - 200]
    assert inner(a, 517) == inner(b, 2) and len(inner(a, 517)) > 20
    ka, kb = a.inner_keys(), b.inner_keys()
    assert set(ka[np.isin(a.triggers, [t + 517 for t in inner(a, 517)])]) <= set(kb)
