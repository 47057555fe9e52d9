"""The pipeline against the same decisions made plainly."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from emberframe.llm import decontam, langid, secretscan
from emberframe.llm.queries import tokenizer_path

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("*", "doc_id * 2 AS score", "'kept' AS lang_pred", "1 AS item_id", "2 AS component_id")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mask_secrets", "pack"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.count() > 0
        assert out.where("score <> doc_id * 2 or lang_pred <> 'kept'").count() == 0
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_stages_keep_columns_named_like_helpers(spark, monkeypatch):
    """Columns with the names that stages and their helpers use inside come out as they went in, maps and structs of maps too."""
    names = ["_row", "_ROW2", "_words", "_text", "t", "node", "bands", "own0", "group", "_text_hash", "_language_found", "_language_score", "draw", "h", "key", "a.b"]
    extra = [f"concat('mine ', doc_id) AS `{n}`" for n in names]
    maps = ["map('k', doc_id, 'l', null) AS m", "named_struct('x', array(map(doc_id, 'v'))) AS s"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("*", *extra, *maps)
    for path in ("map", "join"):
        if path == "join":
            monkeypatch.setattr(decontam, "_small", lambda *_: None)
        for name, stage in corpus_pipeline.STAGES[:-1] if path == "map" else [corpus_pipeline.STAGES[2]]:
            out = stage(spark, docs, DIR)
            assert out.columns == docs.columns and [f.dataType for f in out.schema.fields] == [f.dataType for f in docs.schema.fields], name
            wrong = " or ".join([*(f"`{n}` <> concat('mine ', doc_id)" for n in names), "m['k'] <> doc_id", "s.x[0][doc_id] <> 'v'"])
            plain = stage(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR)
            assert out.count() == plain.count() > 0 and out.where(wrong).count() == 0, name


def test_rows_that_differ_in_a_map_stay_apart(spark):
    """Map entries in another order are the same row; another value is not (both are copies of one text: one stays)."""
    df = spark.sql("SELECT 1L AS doc_id, 'one text of five words or more' AS text, map('a', 1, 'b', 2) AS m UNION ALL SELECT 1L, 'one text of five words or more', map('b', 2, 'a', 1)")
    assert corpus_pipeline.near_duplicates(spark, df, DIR).count() == 1


def test_one_id_on_all_rows_still_teaches_every_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.lit(7).cast("long"))
    model = langid.fit(docs, per_language=100)
    assert set(model.languages) == {r.lang for r in docs.select("lang").distinct().collect() if r.lang}


def test_against_plain_decisions(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(docs.where(~langid.held_out()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    net, index = secretscan.default_network(), decontam.Index(items, 0.8, 5)
    kept = {}
    for d, r in rows.items():
        p = langid.grams(r.text)
        if p is not None and float(model.scores([p]).max()) >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            kept[d] = r.text
    words = {d: t.lower().split() for d, t in kept.items()}
    sets = {d: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for d, w in words.items() if (k := min(5, len(w)))}
    root = {d: d for d in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {d: t for d, t in kept.items() if find(d) == d and not index.search(t)}
    t, want = Tokenizer.from_file(tokenizer_path()), {}
    for d, text in kept.items():
        out, end = [], 0
        for _, a, b, _ in secretscan.findings(text, net):
            if a >= end:
                out += [text[end:a], "[SECRET]"]
            end = max(end, b)
        want[d] = np.array([*t.encode("".join(out) + text[end:], add_special_tokens=False).ids, 1], "<u4")
    got = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum(map(len, want.values()))


def test_odd_documents(spark):
    odd = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "123", "en", "s", 3), (4, "the and of this that", None, "s", 9), (4, "the and of this that", None, "s", 9), (5, "the and of " * 9000, "en", "s", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id >= 100"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    ids = {r.doc_id for r in docs.where(F.col("doc_id") < 100).select("doc_id").distinct().collect()}
    assert ids == {4, 5}
