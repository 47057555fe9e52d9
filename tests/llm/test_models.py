"""Language, quality and language-model scores: held-out accuracy, brute force, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import langid, lmscore, quality, queries

ODD = [(90001, None, "en", "s"), (90002, "", "en", "s"), (90003, "12 34 !!", None, None), (None, "the and of", "en", None), (90004, "the and " * 30000, None, "s"), (90004, "the and " * 30000, None, "s")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")


def test_language_held_out(spark):
    df = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rate, n = df.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and rate > 0.97


def plain_grams(text):
    """Sets of substrings: letters, with one space for anything between them."""
    import re

    t = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    return [{t[i : i + n] for i in range(len(t) - n + 1)} for n in range(1, langid.ORDERS + 1)]


def plain_kernel(a, b):
    return np.mean([len(x & y) / np.sqrt(len(x) * len(y)) if x and y else 0 for x, y in zip(a, b, strict=True)])


def test_language_against_plain_kernels():
    """The folded table gives the kernel expansion of ridge regression over landmarks, from sets of substrings."""
    texts = [f"{t} {'abcdef'[i % 6]} {'xyz' * i}" for i, t in enumerate(["the and of this", "le la des que", "der die und das", "el la que con"] * 6)]
    y, marks = np.arange(24) % 4, list(range(0, 24, 2)) + [1, 3]
    plain = [plain_grams(t) for t in texts]
    sets = [langid.grams(t) for t in texts]
    some = langid.Landmarks([sets[i] for i in marks])
    k = np.array([[plain_kernel(a, plain[j]) for j in marks] for a in plain])
    assert np.allclose([some.kernel(s) for s in sets], k)
    model = langid.fit_kernel(some, k[marks], k, y, list("abcd"))
    w, v = np.linalg.eigh(k[marks])
    good = w > w.max() * 1e-7
    root = v[:, good] / np.sqrt(w[good])
    f = k @ root
    want = f @ np.linalg.solve(f.T @ f + 1e-3 * 24 * np.eye(f.shape[1]), f.T @ np.where(y[:, None] == np.arange(4), 1.0, -1.0))
    assert np.allclose(model.margins(sets), want, atol=1e-4)
    assert (model.scores(sets).argmax(1) == y).all()


def test_language_of_very_long_texts(spark, docs):
    """Texts of 200,000 characters and more are told apart, and probabilities do not fade with length."""
    model = langid.fit(docs.where("length(text) < 10000"))
    long = docs.where("lang is not null").groupBy("lang").agg(F.substring(F.concat_ws(" ", F.collect_list("text")), 1, 400_000).alias("text"))
    got = langid.predict(long, model).select("lang", "lang_pred", "score", F.length("text").alias("n")).collect()
    assert len(got) == 4 and all(r.lang == r.lang_pred and r.score > 0.6 for r in got) and max(r.n for r in got) > 200_000


def test_every_language_is_learned(spark):
    """Three hundred languages of their own letters."""
    rows = [(i * 3 + j, " ".join(chr(0x4E00 + 40 * i + (7 * j + k) % 40) * 2 for k in range(30)), f"l{i:03}") for i in range(300) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.languages) == 300
    assert langid.predict(df, model).where("lang <> lang_pred").count() == 0


def test_stretches_do_not_change_sets(monkeypatch):
    text = "Ünd the quick brown-fox 12 jumps " * 50
    want = langid.grams(text)
    monkeypatch.setattr(langid, "STRETCH", 7)
    assert np.array_equal(langid.grams(text), want)


def test_language_odd_inputs(spark, docs):
    model = langid.fit(docs, per_language=60)
    df = spark.createDataFrame([(*r, 1.5) for r in ODD], SCHEMA + ", score double")
    got = [(r.doc_id, r.lang_pred, r.score > 0) for r in langid.predict(df, model).collect()]
    assert got[:3] == [(90001, "und", False), (90002, "und", False), (90003, "und", False)]
    assert [g[1] for g in got[3:]] == ["en"] * 3 and len(got) == len(ODD)
    assert langid.predict(df.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)) is None and {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen, hidden = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = quality.fit(docs, seen)
    assert len(model.rounds) == 5 and model.rounds[-1] > model.rounds[0]
    got = quality.score(docs, model).join(hidden, "doc_id").toPandas()
    rank = got.score.rank()
    good = got.quality == 1
    area = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.95 and got.keep[good].mean() > 0.95


def plain_text_view(text):
    """The text view from dictionaries of words."""
    from collections import Counter
    from math import log1p, sqrt

    import xxhash

    words = (text or "").split()
    out = [0.0] * (quality.WORD_SLOTS + quality.SHAPES)
    out[-1] = 1.0
    if not words:
        return out
    for slot, n in Counter(xxhash.xxh32_intdigest(w.lower().strip(".,;:!?").encode(), 5) % quality.WORD_SLOTS for w in words).items():
        out[slot] = sqrt(n / len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    marks = sum(not (c.isalnum() or c == "_" or c.isspace()) for c in text) / len(text)
    share = lambda test: sum(map(test, words)) / len(words)
    upper, bare, stops = share(str.isupper), share(lambda w: not any(map(str.isalnum, w))), share(lambda w: w[-1] in ".!?")
    odd, repeated, distinct = len(quality._ODD.findall(text)) / len(words), 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / len(words)
    shape = [upper, 5 * sum(map(str.isdigit, text)) / len(text), 4 * marks, odd, distinct, repeated, max(map(len, words)) / 60, len(text) / len(words) / 12, 2 * bare, 4 * stops, log1p(len(words)) / 10, log1p(len(lines)) / 8]
    shape = [min(1, v) if i not in (4, 5) else v for i, v in enumerate(shape)]
    out[quality.WORD_SLOTS : quality.WORD_SLOTS + 19] = [*shape, upper > 0.3, odd > 0.2, marks > 0.15, bare > 0.15, repeated > 0.2, distinct < 0.3, len(words) < 5]
    return out


def plain_cotrain(xt, xm, y, pool_t, pool_m, rounds, share):
    """Rounds, picks, calibration and combination in double precision, document by document."""

    def logistic(x, t, w, ridge=1e-3, steps=200):
        x, t, w = np.asarray(x, float), np.asarray(t, float), np.asarray(w, float) / np.sum(w)
        size = 1 / (0.25 * sum(wi * (xi @ xi) for wi, xi in zip(w, x, strict=True)) + ridge)
        a = b = np.zeros(x.shape[1])
        for i in range(steps):
            p = np.array([1 / (1 + np.exp(-(xi @ b))) for xi in x])
            new = b - size * (sum((wi * (pi - ti)) * xi for wi, pi, ti, xi in zip(w, p, t, x, strict=True)) + ridge * b)
            a, b = new, new + (i / (i + 3)) * (new - a)
        return a

    train, held = [i for i in range(len(y)) if i % 4], [i for i in range(len(y)) if i % 4 == 0]
    base = np.mean([y[i] for i in train])
    given = {"t": [], "m": []}
    model = lambda v, x, pool: logistic([*(x[i] for i in train), *(pool[j] for j, _ in given[v])], [*(float(y[i]) for i in train), *(s for _, s in given[v])], [1.0] * len(train) + [0.3] * len(given[v]))
    wt, wm = model("t", xt, pool_t), model("m", xm, pool_m)
    for _ in range(rounds):
        k = int(share * len(pool_t))
        for mine, own, other in ((wt, pool_t, "m"), (wm, pool_m, "t")):
            z, taken = own @ mine, {j for j, _ in given[other]}
            for sign, n in ((1, round(k * base)), (-1, k - round(k * base))):
                best = sorted((j for j in range(len(z)) if j not in taken and sign * z[j] > 0), key=lambda j: (-sign * z[j], j))[:n]
                given[other] += [(j, float(sign > 0)) for j in best]
                taken |= set(best)
        wt, wm = model("t", xt, pool_t), model("m", xm, pool_m)
    yh = [float(y[i]) for i in held]
    ones = lambda z: np.stack([z, np.ones(len(z))], 1)
    pt, pm = (logistic(ones(x[held] @ w), yh, np.ones(len(yh)), 1e-4, 400) for x, w in ((xt, wt), (xm, wm)))
    views = lambda a, b: (pt[0] * (a @ wt) + pt[1], pm[0] * (b @ wm) + pm[1])
    both = logistic(np.stack([*views(xt[held], xm[held]), np.ones(len(held))], 1), yh, np.ones(len(yh)), 1e-3, 400)
    return given, lambda a, b: 1 / (1 + np.exp(-(both[0] * views(a, b)[0] + both[1] * views(a, b)[1] + both[2])))


def test_quality_against_plain_cotraining(spark, docs):
    """Views, rounds, picks and the combined score of a small table, recomputed plainly."""
    rows = docs.orderBy("doc_id").limit(150).collect()
    texts = [r.text for r in rows] + ["", None, "A!! 99", "one\none\ntwo"]
    assert np.allclose([quality.text_view(t) for t in texts], [plain_text_view(t) for t in texts], atol=1e-6)
    quick = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    lab, free = [r for r in rows if r.doc_id in quick], [r for r in rows if r.doc_id not in quick]
    views = lambda some: (np.stack([quality.text_view(r.text) for r in some]), np.stack([quality.meta_view(r.source, r.lang, len(r.text or "")) for r in some]))
    (xt, xm), (pt, pm), y = views(lab), views(free), np.array([quick[r.doc_id] > 0 for r in lab])
    model = quality.cotrain(xt, xm, y, pt, pm, rounds=2)
    given, score = plain_cotrain(xt.astype(float), xm.astype(float), y, pt.astype(float), pm.astype(float), 2, 0.08)
    train = int(sum(i % 4 > 0 for i in range(len(y))))
    assert model.rounds[-1] == (train + len(given["t"]), train + len(given["m"])) and len(given["t"]) > 5
    assert np.allclose(model.scores(pt, pm)[2], score(pt, pm), atol=0.02)
    got = {r.doc_id: r.score for r in quality.score(docs.where(f"doc_id in ({', '.join(str(r.doc_id) for r in free)})"), model).collect()}
    assert all(abs(got[r.doc_id] - s) < 0.02 for r, s in zip(free, score(pt, pm), strict=True))


def test_quality_pool_size_changes_little(spark, docs):
    """A pool of 200 and all 800 unlabelled documents keep the same documents (ranks among scores beyond 0.9999 do differ)."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    small, large = (quality.score(docs, quality.fit(docs, labels, pool=n)).select("doc_id", F.col("keep").alias(f"k{n}")) for n in (200, 6000))
    assert small.join(large, "doc_id").where("k200 <> k6000").count() <= 0.01 * docs.count()


def test_quality_odd_inputs(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (7, 1, 1)], labels.schema))
    model = quality.fit(docs.unionByName(spark.createDataFrame(ODD, SCHEMA)), odd_labels, labelled=100, pool=50)
    got = quality.score(spark.createDataFrame([(*r, "x") for r in ODD], SCHEMA + ", keep string"), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and got[4][1:] == got[5][1:]
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs, labels.limit(0)) is None and quality.fit(docs, labels.where("quality = 1")) is None
    assert quality.score(docs, None).where("keep and score is null").count() == docs.count()


def brute_losses(rows, target):
    """Losses from dictionaries of words and pairs of words, each document's own counts left out."""
    from collections import Counter
    from math import log

    texts = [["<s>", *(t or "").lower().split()] for _, t in rows]
    side = [d in target for d, _ in rows]
    vocabulary = len({w for t in texts for w in t[1:]})
    amount = {m: sum(len(t) - 1 for t, s in zip(texts, side, strict=True) if s == m) for m in (True, False)}
    least = min(amount.values()) or max(amount.values())
    out = []
    for i, text in enumerate(texts):
        loss = {}
        for model in (True, False):
            others = [t for j, t in enumerate(texts) if j != i and side[j] == model]
            word, pair = Counter(w for t in others for w in t), Counter(p for t in others for p in zip(t, t[1:], strict=False))
            s = min(1.0, least / amount[model]) if amount[model] else 1.0
            n = sum(len(t) - 1 for t in others)
            loss[model] = 0.0
            for v, w in zip(text, text[1:], strict=False):
                seen = (s * word[w] + lmscore.ALPHA) / (s * n + lmscore.ALPHA * (vocabulary + 1))
                front = word[v] if v != "<s>" else sum(len(t) > 1 for t in others)
                loss[model] -= log((s * pair[v, w] + lmscore.PRIOR * seen) / (s * front + lmscore.PRIOR))
        n = len(text) - 1
        out.append((rows[i][0], side[i], n, *([loss[True] / n, loss[False] / n] if n else [None, None])))
    return out


def test_cross_entropy_against_brute_force(spark):
    import random

    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate(["a b c a b", "a b d", "x y z x y", "x y a b", "q r", "a b c", "x y x y z", "", None, "A  B\nc"])]
    rows += [(3, "x y a b"), (None, "a b c"), *((100 + i, " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(0, 60)))) for i in range(60))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chars int")
    ids = spark.createDataFrame([(0,), (1,), (5,), (5,), (None,), (77,), (9,), *((100 + i,) for i in range(0, 60, 3))], "doc_id long")
    want = sorted((tuple(w) for w in brute_losses(rows, {0, 1, 5, 9, *range(100, 160, 3)})), key=str)
    for size in (10, 300, 8_000_000):  # any number of blocks
        got = sorted((tuple(r) for r in lmscore.score(df, ids, size).collect()), key=str)
        for g, w in zip(got, want, strict=True):
            assert g[:3] == w[:3] and (w[3] is None or g[3:5] == pytest.approx(w[3:5], rel=1e-9))
            assert g[5] is None if w[3] is None else g[5] == pytest.approx(w[3] - w[4], abs=1e-9)
    assert lmscore.score(df.limit(0), ids).count() == 0
    none = [(r[0], None, *r[2:]) for r in brute_losses(rows, set())]
    got = sorted(((r[0], None, *r[2:5]) for r in lmscore.score(df, ids.limit(0)).collect()), key=str)
    assert [g[3] for g in got if g[3]] == pytest.approx([w[3] for w in sorted(none, key=str) if w[3]])


def test_cross_entropy_sets_copies_apart(spark):
    """A document that another repeats has seen pairs; one whose pairs are its own has none."""
    import random

    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(40))
    twice = [text() for _ in range(20)]
    rows = [(i, t) for i, t in enumerate([*twice, *twice, *(text() for _ in range(40))])]
    got = {x.doc_id: x.background_loss for x in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(200,)], "doc_id long")).collect()}
    assert max(got[i] for i in range(40)) < min(got[i] for i in range(40, 80))


def test_cross_entropy_tells_domains_apart(spark):
    import random

    r = random.Random(1)
    rows = [(i, " ".join(r.choice(("red", "blue", "green") if i % 2 else ("uno", "dos", "tres")) for _ in range(50))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(1, 31, 2)], "doc_id long")
    got = {x.doc_id: x.ce_difference for x in lmscore.score(df, ids).collect()}
    assert max(got[i] for i in range(31, 60, 2)) < min(got[i] for i in range(0, 60, 2))


def test_quality_samples_rows_of_one_id(spark, docs, monkeypatch):
    """An id that stands on most rows brings one labelled row; the others are drawn one by one."""
    held = []
    monkeypatch.setattr(quality, "cotrain", lambda xt, xm, y, pt, pm, rounds: held.append((len(y), len(pt))))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null")
    some = labels.orderBy("doc_id").first().doc_id
    many = docs.crossJoin(spark.range(20).select(F.col("id").alias("k"))).withColumn("text", F.concat("text", F.col("k").cast("string")))
    quality.fit(docs.unionByName(many.withColumn("doc_id", F.lit(some)).drop("k")), labels, labelled=6000, pool=300)
    quality.fit(many.withColumn("doc_id", F.lit(-5).cast("long")).drop("k").unionByName(docs), labels, labelled=6000, pool=300)
    known = labels.select("doc_id").distinct().join(docs, "doc_id").select("doc_id").distinct().count()
    assert [h[0] for h in held] == [known, known] and all(h[1] < 450 for h in held) and held[1][1] > 200


def test_benchmark_index_is_built_once_a_worker(monkeypatch):
    from emberframe.llm import decontam

    built = []
    monkeypatch.setattr(decontam, "Index", lambda *a: built.append(a) or len(built))
    monkeypatch.setattr(decontam, "_INDEX", {})
    assert [decontam._index(n, [], 0.8, 5) for n in ("a", "a", "b", "b")] == [1, 1, 2, 2]
