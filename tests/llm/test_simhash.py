import random
import re

import numpy as np
import pytest
import xxhash

from emberframe.llm import simhash
from emberframe.llm.workspace import Workspace, components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids_fps):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    fps = sorted({f for _, f in ids_fps})
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for d, f in ids_fps:
        if d is not None:
            low[find(f)] = min(low.get(find(f), d), d)
    return sorted(((d, f"{f:016x}", low.get(find(f))) for d, f in ids_fps), key=str)


def test_fingerprints(sf_dir):
    import duckdb

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()]
    for t in [*texts, None, "", " \t", "One", "one two", "ÉA b c d", "a\x0bb\x0cc d"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(9000, None), (9001, ""), (9002, "  "), (8999, rows[5][1]), (9003, rows[5][1]), (9003, rows[5][1]), (None, rows[5][1]), (None, "only here"), (9005, "w " * 30000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8192, 16])
def test_links_of_dense_fingerprints(spark, block):
    """A ball of near fingerprints, chains, and random ones; small blocks cut keys into block pairs."""
    r = random.Random(block)
    centre = r.getrandbits(64)
    fps = {r.getrandbits(64) for _ in range(300)}
    for _ in range(300):
        f = centre
        for b in r.sample(range(64), r.randint(0, 4)):
            f ^= 1 << b
        fps.add(f)
    step = r.getrandbits(64)
    for b in range(0, 60, 3):
        step ^= 7 << b
        fps.add(step)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    ws = Workspace(spark, "test")
    edges = simhash.links(ws, spark.createDataFrame(rows, "node long, fp long"), block)
    assert edges.count() < 16 * len(rows)
    roots = {r.node: r.root for r in components(ws, edges).collect()}
    got = sorted((i, f"{f % (1 << 64):016x}", roots.get(i, i)) for i, f in rows)
    assert got == sorted(plain_components([(i, f % (1 << 64)) for i, f in rows]))


def test_chain_filter_is_exact():
    r = random.Random(9)
    xs = [sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(4000)]
    passed = set()
    for first in range(4):
        x = np.array(xs, np.uint64)
        passed |= set(simhash.chain_ok(x, np.full(len(x), first)).tolist())
    assert passed == {i for i, x in enumerate(xs) if x.bit_count() <= 3}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    ws = Workspace(spark, "test")
    got = {r.node: r.root for r in components(ws, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(ws, spark.createDataFrame([], "a long, b long"), "none").count() == 0
