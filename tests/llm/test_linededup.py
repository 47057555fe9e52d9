"""Line dedup against brute force, after any order of insertions and removals."""

import random
from collections import Counter

import numpy as np
import pytest

from emberframe.llm import linededup
from emberframe.llm.linededup import CuckooFilter, LineIndex

SCHEMA = "doc_id long, text string, key string, shard int, n_lines string"


def folded(line):
    line = line.strip(" \t\n\v\f\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line) if len(line) >= 20 else None


def brute(held, asked, min_docs=3):
    """Kept texts of ``asked`` rows (id, text) where the rows ``held`` are counted."""
    refs, last = Counter(), {}
    least = lambda d: -(1 << 63) if d is None else d
    for d, text in held:
        for k in {folded(x) for x in (text or "").split("\n")} - {None}:
            refs[k] += 1
            last[k] = max(last.get(k, -(1 << 63)), least(d))
    out = []
    for d, text in asked:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (refs[folded(x)] >= min_docs and last[folded(x)] != least(d)) or folded(x) is None]
        out.append((str(d), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    lines = ["", " ", "short", "x" * 19, "Y" * 20, " \tz" + "z" * 25, "É ligne répétée partout", "é ligne répétée partout", "  PADDED repeated Line of text \r", "padded repeated line of text\v",
             *(f"a common line of the corpus, number {i}" for i in range(12))]
    own = lambda: f"a line that stands nowhere else {r.randrange(10**12)}"
    texts = ["\n".join(r.choice(lines) if r.random() < 0.6 else own() for _ in range(r.choice((1, 3, 8, 40)))) for _ in range(70)]
    ids = [*range(60), 7, 7, None, None, None, 61, 62, 62, 63, 64]
    hot = "the line that every document holds, or nearly"
    out = [(d, t + ("\n" + hot if i % 3 else "")) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    return [*out, (90, None), (91, ""), (92, "\n"), (None, None), (93, "rep " * 30_000 + "\n" + hot), *[(94, f"{hot}\nsame row")] * 3]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 3, "clash") for d, t in rows], SCHEMA)


def result(index, spark, rows):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in index.clean(frame(spark, rows)).collect())


@pytest.mark.parametrize(("hot", "shards"), [(8192, 3), (4, 40)])
def test_against_brute_force(spark, rows, monkeypatch, hot, shards):
    """With few hot keys allowed, some keys take the broadcast table and some the filters."""
    monkeypatch.setattr(linededup, "HOT", hot)
    index = LineIndex(spark, shards=shards)
    index.insert(frame(spark, rows))
    assert result(index, spark, rows) == brute(rows, rows)
    assert sum(x[2] for x in brute(rows, rows)) > 100


@pytest.mark.parametrize("hot", [8192, 4])
def test_removal_undoes_insertion(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT", hot)
    index = LineIndex(spark, shards=5)
    a, b, c = rows[:30], rows[30:50], rows[50:]
    for part in (a, b):
        index.insert(frame(spark, part))
    first = brute(a + b, rows)
    assert result(index, spark, rows) == first
    index.insert(frame(spark, c))
    index.remove(frame(spark, b))
    assert result(index, spark, rows) == brute(a + c, rows)
    index.remove(frame(spark, c))  # the largest ids go: others are the largest holders now
    index.insert(frame(spark, b))
    assert result(index, spark, rows) == first
    # the filters hold what filters of the same documents hold
    fresh = LineIndex(spark, shards=5)
    fresh.insert(frame(spark, a + b))
    marks = lambda i: {r.shard: sorted(v for v in CuckooFilter.read(r.filter).table.ravel().tolist() if v) for r in i.filters.collect()}
    assert {k: v for k, v in marks(index).items() if v} == {k: v for k, v in marks(fresh).items() if v}
    index.remove(frame(spark, a + b))
    assert index.refs.count() == 0 and result(index, spark, rows) == brute([], rows)


def test_empty_table(spark, rows):
    assert linededup.dedup(frame(spark, rows).limit(0)).count() == 0
    assert [r.kept for r in linededup.dedup(frame(spark, [(1, None)])).collect()] == [""]


def test_cuckoo_filter():
    r = np.random.default_rng(3)
    for n in (1, 5, 700, 60_000):
        keys = r.integers(0, 1 << 63, n).astype(np.uint64)
        f = CuckooFilter.sized(n)
        for part in np.array_split(keys, 3):
            f.add(part)
            assert f.contains(part).all()
        f = CuckooFilter.read(f.dump())
        assert f.contains(keys).all()
        others = r.integers(0, 1 << 63, 50_000).astype(np.uint64)
        assert f.contains(others).mean() < 1e-3
        f.remove(keys[: n // 2])
        assert f.contains(keys[n // 2 :]).all() and np.count_nonzero(f.table) == n - n // 2
        f.remove(keys[n // 2 :])
        assert not f.table.any()
    f, many = CuckooFilter.sized(1), np.arange(100, dtype=np.uint64)  # what finds no slot stands in the stash
    f.add(many)
    f = CuckooFilter.read(f.dump())
    assert len(f.stash) == 100 - f.table.size and f.contains(many).all() and not f.contains(many + np.uint64(1000)).any()
    f.remove(many)
    assert not len(f.stash) and not f.table.any()
    same = np.full(6, 99, np.uint64)  # keys may share bucket and fingerprint
    f = CuckooFilter.sized(100)
    f.add(same)
    f.remove(same[:5])
    assert f.contains(same).all() and np.count_nonzero(f.table) == 1
