import random

from emberframe.llm import decontam


def brute(docs, items, threshold=0.8, k=5):
    out = []
    for d, t in docs:
        ws = decontam.words(t)
        for i, u in items:
            us = decontam.words(u)
            if not us:
                continue
            n = min(k, len(us))
            grams = lambda x: {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}  # noqa: E731, B023
            mine = grams(us)
            shared = len(mine & grams(ws))
            if shared >= threshold * len(mine) - 1e-9:
                out.append((d, i, len(mine), shared))
    return sorted(out, key=str)


def test_against_brute_force(spark, sf_dir):
    r = random.Random(4)
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, "two words"), (901, ""), (902, None), (None, items[0][1]), (903, "!!!"), (904, items[1][1])]
    for i in range(60):  # whole, cut and edited items inside long texts
        ws = r.choice(items[:40])[1].split()
        for _ in range(r.choice((0, 0, 1, 2))):
            ws[r.randrange(len(ws))] = "edited"
        ws = ws[: r.choice((len(ws), len(ws), int(len(ws) * 0.85)))]
        docs.append((5000 + i, f"{r.choice(docs)[1]} {' '.join(ws).upper()} {r.choice(docs)[1]}"))
    docs += [(None, items[2][1]), (6000, None), (6001, ""), (6002, "has two words"), (6002, "has two words"), (6003, f"{'far ' * 30000}{items[3][1]}")]
    ddf = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    idf = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    for chars in (8_000_000, 2000):  # items sent to the workers, and items as a table
        got = sorted(((x.doc_id, x.item_id, x.item_shingles, x.shared_shingles) for x in decontam.contaminated(ddf, idf, max_chars=chars).collect()), key=str)
        assert got == want
        kept = decontam.drop_contaminated(ddf, idf, max_chars=chars)
        assert kept.columns == ddf.columns
        hit = {w[0] for w in want}
        assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in hit), key=str)
    assert decontam.contaminated(ddf.limit(0), idf).count() == 0 == decontam.contaminated(ddf, idf.limit(0)).count()
    assert decontam.drop_contaminated(ddf, idf.limit(0)).count() == len(docs)


def test_common_shingles_do_not_fill_sketches():
    """Items with one header: sketches take the shingles that few items share, so a document with the header meets none of them."""
    r = random.Random(8)
    header = " ".join(f"h{i}" for i in range(12))
    items = [(i, f"{header} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(30))) for i in range(3000)]
    index = decontam.Index(items, 0.8, 5)
    assert max(len(t[2][t[1][i] : t[1][i + 1]]) for t in index.tables.values() for i in range(len(t[0]))) <= 3
    assert index.search(f"{header} and more") == [] and [f[0] for f in index.search(f"x {items[7][1]} y")] == [7]


def test_sketch_thresholds_follow_partitions():
    for n in range(1, 400):
        m, hits = decontam.sketch(n, 0.8)
        lacking = n - decontam.needed(n, 0.8)
        assert lacking < m <= n and 1 <= hits == max(1, m - lacking)
    assert len({decontam.sketch(n, 0.8)[0] for n in range(128, 256)}) <= 2
