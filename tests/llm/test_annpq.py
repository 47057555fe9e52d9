import collections
import math
import random

import numpy as np
import pytest

from emberframe.llm import annpq

SCHEMA = "vec_id long, embedding array<float>, label int, v string, node string"


def brute(rows, threshold=0.98):
    ok = [i for i, (v, e, l) in enumerate(rows) if None not in (v, e, l) and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links, root = collections.Counter(), {i: i for i in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ok):
        for j in ok[a + 1 :]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        c = low.get(find(i)) if r[0] is not None else None
        out.append((r[0], links[i], c, r[0] == c))  # a row without an id is kept
    return collections.Counter(out)


def rows(seed, n=400, d=16):
    r = random.Random(seed)
    out = [(i, [r.gauss(0, 1) for _ in range(d)], r.randrange(3)) for i in range(n)]
    hot = out[0][1]
    out += [(1000 + i, hot, 0) for i in range(30)]  # copies
    out += [(2000 + i, [x + r.gauss(0, 0.08) for x in hot], 0) for i in range(150)]  # a tight group
    out += [(3000 + i, [x + 0.06 * i * (k == 3) for k, x in enumerate(out[5][1])], out[5][2]) for i in range(60)]  # a chain
    out += [(4000, None, 0), (4001, [0.0] * d, 0), (4002, [math.nan] * d, 0), (4003, [None] * d, 0), (4004, hot, None), (None, hot, 0), (4005, hot[:8], 0), (4005, hot[:8], 0), (4006, [2 * x for x in hot], 0), (4007, [math.inf] + hot[1:], 0), (4008, [], 0)]
    return out


@pytest.mark.parametrize(("seed", "block", "coarse"), [(1, 4096, 1024), (2, 25, 1024), (3, 25, 3)])
def test_against_brute_force(spark, seed, block, coarse):
    data = rows(seed)
    df = spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA).repartition(3)
    got = collections.Counter(tuple(r) for r in annpq.near_duplicates(df, block=block, coarse=coarse).collect())
    assert got == brute(data)
    assert annpq.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("second", [1, 9])
def test_bounds_lose_nothing(second):
    """Probes and table lookup keep every pair within reach."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(scale=0.035, size=x.shape)
    y /= np.linalg.norm(y, axis=1)[:, None]
    reach = math.sqrt(0.04)
    near = np.linalg.norm(x - y, axis=1) <= reach
    book = annpq.fit(x, 12, second)
    home, _ = annpq.probes(y, book, reach)
    _, lists = annpq.probes(x, book, reach)
    assert near.sum() > 50 and all(home[i] in lists[i] for i in np.flatnonzero(near))
    for i in np.flatnonzero(near)[:50]:
        centre = book.centre(home[i : i + 1])
        codes, err = book.encode(y[i : i + 1] - centre)
        assert math.sqrt(book.lookup(x[i : i + 1] - centre, codes)[0, 0]) <= reach + err[0] + annpq.SLACK
        assert annpq.wanted(book, reach, np.array([1]), x[i : i + 1], np.array([2]), home[i : i + 1], codes, err).all()
    assert not annpq.wanted(book, reach, np.array([1]), x[:1], np.array([2]), home[:1], book.encode(-x[:1] - book.centre(home[:1]))[0], np.array([0.0])).any()
    assert len({int(h) for h in home}) > (12 if second > 1 else 1)


def test_screen_is_the_table_lookup():
    """Which entries are near enough, by the distances of single lookups."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[200:] = x[:100] + 0.02 * rng.normal(size=(100, 20))
    book = annpq.fit(x, 6, 3, 5, 16)
    home, _ = annpq.probes(x, book, 0.2)
    codes, err = book.encode(x - book.centre(home))
    inside = np.flatnonzero(home == home[0])
    adc = np.stack([book.lookup(x[inside] - book.centre(home[j : j + 1]), codes[j : j + 1])[:, 0] for j in range(300)], axis=1)
    want = ((np.sqrt(adc) <= 0.2 + err + annpq.SLACK) & (inside[:, None] != np.arange(300))).any(axis=0)
    assert (annpq.wanted(book, 0.2, inside, x[inside], np.arange(300), home, codes, err) == want).all() and 0 < want.sum() < 300


def test_screen_sends_few_vectors(spark):
    """On vectors without near ones, what is asked after the table lookup is a small part of what probes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    book = annpq.fit(unit, 20)
    home, lists = annpq.probes(unit, book, 0.2)
    codes, err = book.encode(unit - book.centre(home))
    sent = kept = 0
    for c in range(20):
        inside, entry = np.flatnonzero(home == c), np.array([i for i, ls in enumerate(lists) if c in ls])
        sent += len(entry)
        kept += int(annpq.wanted(book, 0.2, inside, unit[inside], entry, home[entry], codes[entry], err[entry]).sum())
    assert kept < 0.3 * sent


def test_probes_in_pieces(monkeypatch):
    """Small pieces give the same lists, and tables of distances stay small for a codebook of 200,000 lists."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    book = annpq.fit(x, 12, 9)
    home, lists = annpq.probes(x, book, 0.2)
    for piece in (1, 40, 1000):
        monkeypatch.setattr(annpq, "PIECE", piece)
        again = annpq.probes(x, book, 0.2)
        assert (again[0] == home).all() and all((a == b).all() for a, b in zip(again[1], lists, strict=True))
    monkeypatch.undo()
    x = rng.normal(size=(256, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    peaks = []
    for coarse, second in ((64, 16), (1024, 200)):
        part = lambda n, scale: scale * rng.normal(size=(n, 64)) / 8
        large = annpq.Codebook(part(coarse, 1.0), part(second, 0.7), book.words, book.cuts)
        tracemalloc.start()
        annpq.probes(x, large, 0.2)
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
    assert peaks[1] < 250, peaks
