"""The opN_ queries: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; null texts are the closing token alone."""
    from emberframe.llm import packing

    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 400-byte strings standing twice cover, and the digest of the rest; null texts are empty."""
    from emberframe.llm import repeats

    found = repeats.repeated(table(spark, sf_dir, "documents"), length=400)
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def span_list(findings: Column) -> Column:
    return F.concat_ws(",", F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern findings of every document, and the spans that the network adds; null texts have none."""
    from emberframe.llm import secretscan

    found = secretscan.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("findings")).alias("spans"), count("model").alias("n_model"),
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; documents without a word have fingerprint zero and link like any other."""
    from emberframe.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items at containment 0.8 or more; rows without a word have none."""
    from emberframe.llm import decontam

    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated scores of every document by co-trained views; null texts are scored by their shape and metadata."""
    from emberframe.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of every document under models of good documents and of the rest; documents without a word have null losses."""
    from emberframe.llm import lmscore

    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lmscore.score(table(spark, sf_dir, "documents"), good)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it is kept, for every vector; vectors that are null, zero or not finite link with nothing."""
    from emberframe.llm import annpq

    return annpq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null and empty pages have an empty text."""
    from emberframe.llm import htmltext

    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document by a model of the folds that are not held out; null texts and texts without a letter are und."""
    from emberframe.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers; texts that either does not spell, null and empty ones are zeros."""
    from emberframe.llm import crosstok

    a, b = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    rows = crosstok.align(table(spark, sf_dir, "documents"), lambda: crosstok.byte_level(a), lambda: crosstok.sentence_pieces(b), digest=True)
    return rows.withColumnRenamed("groups", "groups_sha256")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped as repeated, and the digest of the rest; null and empty texts are one empty line."""
    from emberframe.llm import linededup

    cleaned = linededup.dedup(table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of all documents; null and empty texts have no words."""
    from emberframe.llm import spelling

    return spelling.groups(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_harmonic_packing, op2_repeated_bytes, op3_secret_scan, op4_simhash_near_dedup, op5_benchmark_decontamination,
    op6_quality_cotraining, op7_cross_entropy_difference, op8_embedding_near_dedup, op9_html_main_text, op10_language_id,
    op11_token_alignment, op12_line_dedup, op13_spelling_variants, pipeline,
)
QUERIES = {f.__name__: f for f in _ALL}
#: Tokenisers, XXH64, match positions and learnt models have no SQL; tests/llm hold those queries to brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_repeated_bytes": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, greatest(0, length(h) // 2 - 399))) AS i, h FROM d),
k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS g FROM s),
r AS (SELECT doc_id, i FROM k WHERE g IN (SELECT g FROM k GROUP BY g HAVING count(*) > 1)),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 400 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM n GROUP BY 1, 2),
c AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM u),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS tail FROM u GROUP BY 1),
p AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM c JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN p USING (doc_id)""",
    "op5_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM n)),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM n) WHERE len(w) >= k)),
t AS (SELECT item_id, count(*) AS item_shingles FROM ig GROUP BY 1)
SELECT doc_id, item_id, item_shingles, count(*) AS shared_shingles, count(*) / item_shingles AS containment
FROM ig JOIN dg USING (k, g) JOIN t USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles - 1e-9""",
    "op7_cross_entropy_difference": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS t, regexp_extract_all(lower(coalesce(text, '')), '[^\s]+') AS w FROM documents),
p AS (SELECT r, t, i, w[i] AS word, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS front FROM (SELECT r, t, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
op AS (SELECT r, t, front, word, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL),
ow AS (SELECT r, t, word, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL UNION ALL SELECT r, t, '', 1 FROM p WHERE i = 1),
tp AS (SELECT front, word, coalesce(sum(n) FILTER (t), 0) AS ct, coalesce(sum(n) FILTER (NOT t), 0) AS cb FROM op GROUP BY ALL),
tw AS (SELECT word, coalesce(sum(n) FILTER (t), 0) AS ct, coalesce(sum(n) FILTER (NOT t), 0) AS cb FROM ow GROUP BY ALL),
a AS (SELECT coalesce(sum(ct), 0) AS nt, coalesce(sum(cb), 0) AS nb, count(*) AS v FROM tw WHERE word <> ''),
s AS (SELECT *, CASE WHEN nt > 0 AND nb > 0 THEN least(1, nb / nt) ELSE 1 END AS st, CASE WHEN nt > 0 AND nb > 0 THEN least(1, nt / nb) ELSE 1 END AS sb FROM a),
x AS (SELECT op.r, op.n, len(d.w) AS words, st, sb, v, nt, nb, op.t,
    tp.ct - if(op.t, op.n, 0) AS pt, tp.cb - if(op.t, 0, op.n) AS pb, f.ct - if(op.t, fo.n, 0) AS ft, f.cb - if(op.t, 0, fo.n) AS fb, u.ct - if(op.t, uo.n, 0) AS ut, u.cb - if(op.t, 0, uo.n) AS ub
  FROM op JOIN d USING (r) JOIN tp USING (front, word) JOIN tw f ON f.word = op.front JOIN tw u ON u.word = op.word
  JOIN ow fo ON fo.r = op.r AND fo.word = op.front JOIN ow uo ON uo.r = op.r AND uo.word = op.word, s),
l AS (SELECT r,
    sum(-n * ln((st * pt + (st * ut + 0.5) / (st * (nt - if(t, words, 0)) + 0.5 * (v + 1))) / (st * ft + 1))) AS lt,
    sum(-n * ln((sb * pb + (sb * ub + 0.5) / (sb * (nb - if(t, 0, words)) + 0.5 * (v + 1))) / (sb * fb + 1))) AS lb FROM x GROUP BY r)
SELECT doc_id, t AS in_target, CAST(len(w) AS BIGINT) AS n_tokens, lt / len(w) AS target_loss, lb / len(w) AS background_loss, lt / len(w) - lb / len(w) AS ce_difference FROM d LEFT JOIN l USING (r)""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op12_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM l),
u AS (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, unnest(keys) AS key FROM k) WHERE length(key) >= 20),
h AS (SELECT key, max(doc_id) AS last FROM u GROUP BY key HAVING count(*) >= 3),
g AS (SELECT doc_id, list(key) AS gone FROM u JOIN h USING (key) WHERE doc_id <> last GROUP BY doc_id),
s AS (SELECT doc_id, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x, i: NOT list_contains(gone, keys[i])) END AS stay FROM k LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(stay) AS BIGINT) AS n_dropped, sha256(array_to_string(stay, chr(10))) AS kept_sha256 FROM s""",
    "op13_spelling_variants": r"""
WITH RECURSIVE b AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
u AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes FROM c),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: CAST(x AS BIGINT))), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM u, b),
t AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, x.word AS other, x.n AS m FROM v a JOIN v x ON a.rest = x.rest AND a.i = x.i AND a.word <> x.word
 UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
g AS (SELECT word, count(*) AS n_near, max(m) AS m FROM e GROUP BY 1),
f AS (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN m END AS form_n, CASE WHEN m >= 2 * w.n THEN (SELECT min(other) FROM e WHERE e.word = w.word AND e.m = g.m) END AS form FROM w LEFT JOIN g USING (word)),
p(word, root) AS (SELECT word, word FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL),
z AS (SELECT p.word, p.root FROM p JOIN f ON f.word = p.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z USING (word)""",
}
