"""Near-duplicate groups against brute force over exact shingle similarities."""

import random

import corpus_pipeline
from emberframe.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def edited(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"edit{r.randrange(10**9)}"
    return " ".join(out)


def brute_roots(texts):
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root, pairs


def test_stage_keeps_one_of_edited_copies(spark):
    r = random.Random(4)
    texts, d = {}, 0
    for _ in range(60):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randint(150, 400))]
        for n in (0, 2, 4, 6, 9, 14):
            texts[d] = edited(r, words, n)
            d += 1
    root, pairs = brute_roots(texts)
    want = {d for d in texts if root[d] == d}
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], SCHEMA)
    got = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert len(pairs) > 150 and got == want


def test_band_recall_near_the_threshold():
    """Pairs at similarity 0.8 to 0.84 share a band."""
    r, hit, n = random.Random(6), 0, 0
    while n < 1500:
        words = [f"w{r.randrange(9000)}" for _ in range(200)]
        a, b = (neardup.shingle_set(" ".join(words)), neardup.shingle_set(edited(r, words, 4)))
        if 0.8 <= neardup.similarity(a, b) < 0.84:
            n += 1
            hit += bool((neardup.bands(a) == neardup.bands(b)).any())
    assert hit / n >= 0.995


def test_block_pairs_give_the_same_groups(spark, monkeypatch):
    r = random.Random(7)
    words = [f"w{r.randrange(4000)}" for _ in range(300)]
    rows = [(i, edited(r, words, 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, chunk in ((1024, 4096), (16, 4096), (16, 10)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        assert len({x.group for x in neardup.grouped(df, "doc_id").collect()}) == 1


def test_chains_need_every_pair_of_a_band(spark, monkeypatch):
    """Texts that drift: links hold between neighbours, seldom with a band's least node."""
    r = random.Random(12)
    texts, words = {}, [f"w{r.randrange(4000)}" for _ in range(250)]
    for i in range(80):
        texts[i] = " ".join(words)
        words = edited(r, words, 3).split()
    root, pairs = brute_roots(texts)
    for block in (1024, 8):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {x.doc_id: x.group for x in neardup.grouped(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id").collect()}
        assert len(set(got.values())) == len(set(root.values())) and len(pairs) > 80


def test_rows_not_ids_decide(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(4000)}" for _ in range(200)]
    other = [" ".join(f"w{r.randrange(4000)}" for _ in range(50)) for _ in range(6)]
    rows = [
        (7, " ".join(base)), (7, other[0]), (7, other[1]), (None, other[2]), (None, other[3]), (None, edited(r, base, 2)),
        (8, edited(r, base, 3)), (8, other[4]), (8, other[4]), (None, other[5]), (None, other[5]), (9, None), (None, None),
    ]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    want = sorted([(7, rows[0][1]), (7, other[0]), (7, other[1]), (None, other[2]), (None, other[3]), (8, other[4]), (None, other[5]), (9, None)], key=str)
    for part in (df, df.repartition(5), df.orderBy("text").coalesce(1)):
        assert sorted(((x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, part, "").collect()), key=str) == want


def test_candidates_come_through_pigeonring(spark, monkeypatch):
    """The stage asks operator 4's index: copies with one word in four hundred changed are candidates there, unlike texts are not."""
    r = random.Random(14)
    texts = {}
    for i in range(20):
        words = [f"w{r.randrange(4000)}" for _ in range(2000)]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), edited(r, words, 1)
    found = []
    plain = neardup.ring_candidates

    def spy(ws, nodes):
        out = plain(ws, nodes)
        found.append((nodes.collect(), [tuple(x) for x in out.collect()]))
        return out

    monkeypatch.setattr(neardup, "ring_candidates", spy)
    groups = {x.doc_id: x.group for x in neardup.grouped(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id").collect()}
    ((nodes, pairs),) = found
    fp = {x.node: x.fp & (1 << 64) - 1 for x in nodes}
    near = {(a, b) for a in fp for b in fp if b < a and (fp[a] ^ fp[b]).bit_count() <= 3}
    assert len(fp) == 40 and len(near) >= 10 and {(max(p), min(p)) for p in pairs} == near
    assert len(set(groups.values())) == 20 and all(groups[2 * i] == groups[2 * i + 1] for i in range(20))
