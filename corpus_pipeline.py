"""A corpus pipeline of five stages: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what it kept with the columns of ``documents``, and any other columns that docs
has, untouched; the last returns packed pieces. Ids may be null or repeated: rows count, and no stage drops a row for its id. Empty
tables stay empty. ``run`` writes every stage's result to the shared workspace and
reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import decontam, langid, neardup, packing, secretscan
from emberframe.llm.queries import table, tokenizer_path
from emberframe.llm.workspace import Workspace, hashable, spare

#: SQL cannot express the learnt stages; tests/llm hold the pipeline to brute force instead.
ORACLE_SQL = None
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null, empty, digits alone) and those whose best language scores below MIN_LANGUAGE_SCORE; a null ``lang`` is filled.

    Where no row has a language, nothing can be learned and everything is rejected.
    """
    columns = docs.columns
    model = langid.fit(docs.where(~langid.held_out()))
    found, score = spare(columns, "_language_found", "_language_score")
    scored = langid.predict(docs, model, names=(found, score)).where((F.col(found) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return scored.withColumn("lang", F.coalesce("lang", found)).select([f"`{c}`" for c in columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by five-word similarity of 0.8 or more: the smallest id (null last), then by hash of the text and of all columns.

    Rows count, not ids: rows without an id, and different texts under one id, stay unless their texts are near copies. Texts without a
    word (null, empty, blank) are copies of each other. Candidates are those of operator 4's SimHash pigeonring, and of MinHash bands for pairs beyond its
    radius (a distance of few bits misses most pairs at similarity 0.8); links are checked on the shingles.
    """
    values = [v for f in docs.schema.fields for v in (hashable(F.col(f"`{f.name}`"), f.dataType), F.col(f"`{f.name}`").isNull())]
    one, two, words = spare(docs.columns, "_row", "_row2", "_words")
    rows = docs.withColumn(one, F.xxhash64(*values)).withColumn(two, F.xxhash64(F.lit(1), *values))
    found = neardup.grouped(rows.withColumn(words, F.xxhash64("text")), "doc_id", words, one, two)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", words, one, two)).alias("first")
    keep = found.groupBy("group").agg(first).select(f"first.{one}", f"first.{two}")
    return rows.dropDuplicates([one, two]).join(keep, [one, two], "left_semi").select([f"`{c}`" for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item (0.8 of its shingles or more), whether or not the item has an id; null and empty texts stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in ``text`` (n_chars follows); every document stays, null texts stay null."""
    return secretscan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a null text is its closing token. Columns are those of the packed pieces."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mask_secrets", mask_secrets), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    ws = Workspace(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if last:
            ws.drop(last)
        last = name
    return docs
