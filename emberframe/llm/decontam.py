"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Containment of an item in a document is the share of the item's different word shingles that the
document has. Items are partitioned by their number of shingles n (powers of two). A partition has its own
sketch size, m = 2 floor((1 - t) N) + 1 for its largest size N, and every item is kept as the m least of its
shingles in one order: those that fewer items share first, and by a random hash among these (a bottom-m MinHash whose order puts rare
shingles first, as prefix filters do; a purely random order would fill sketches with headers that all items share). A document that holds at
least t n of an item's shingles lacks at most n - t n of them, so at least m - (n - t n) of the sketch must be there: the
threshold of sketch hits that the item's partition and size give. The search so finds every match however long the document, where
banded signatures of whole documents would need thousands of hashes for an item of 30 words in a document of 20,000. A sent benchmark skips documents with
fewer shingles than its least item needs. Candidates are verified on the words themselves.

A benchmark of up to ``max_chars`` goes to the workers, and documents are read once. A larger one stays a table: documents send the shingles
that pass a bit map of all sketches, and meet the items in two joins; documents are read twice whatever the benchmark's size.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.workspace import Workspace, doc_rows, map_rows, ship, spare

_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "doc_id long, item_id long, item_shingles long, shared_shingles long, containment double"
_KNOWN: dict[str, int] = {}
_BITS = 1 << 27  # of the map that a large benchmark sends


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes; those of words seen lately are kept."""
    if len(_KNOWN) > 150_000:
        _KNOWN.clear()
    known, digest = _KNOWN, xxhash.xxh64_intdigest
    out = []
    for w in ws:
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w.encode("utf-8", "surrogatepass"), 7)
        out.append(h)
    return np.array(out, np.uint64)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def needed(n: int, threshold: float) -> int:
    """Shingles of an item of n that make a match."""
    return int(np.ceil(threshold * n - 1e-9))


def sketch(n: int, threshold: float) -> tuple[int, int]:
    """Sketch size of the partition of items of n shingles, and how many of the sketch a match must hold."""
    largest = (1 << n.bit_length()) - 1
    m = min(n, 2 * (largest - needed(largest, threshold)) + 1)
    return m, max(1, m - (n - needed(n, threshold)))


class Item:
    """Shingles of an item's text: their length k, the shingles, their hashes."""

    def __init__(self, ws: list[str], shingle: int):
        self.k = min(shingle, len(ws))
        self.shingles = frozenset(zip(*(ws[i:] for i in range(self.k)), strict=False))
        self.hashes = np.unique(shingle_hashes(word_hashes(ws), self.k))

    def shared(self, ws: list[str]) -> int:
        return len(self.shingles.intersection(zip(*(ws[j:] for j in range(self.k)), strict=False)))


class Index:
    """Sketches of items: for each shingle length sorted hashes and the items of each. Items of equal shingles are one."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float, shingle: int):
        kinds: dict[tuple, tuple[Item, list]] = {}
        for item_id, text in items:
            if ws := words(text):
                item = Item(ws, shingle)
                kinds.setdefault((item.k, item.shingles), (item, []))[1].append(item_id)
        self.items = [(item, ids, needed(len(item.shingles), threshold)) for item, ids in kinds.values()]
        common = Counter(x for item, _, _ in self.items for x in item.hashes.tolist())
        tables: dict[int, list[tuple[int, int]]] = {}
        self.hits = np.ones(len(self.items), np.int64)
        for i, (item, _, _) in enumerate(self.items):
            m, self.hits[i] = sketch(len(item.shingles), threshold)
            self.hits[i] = max(1, self.hits[i] - (len(item.shingles) - len(item.hashes)))
            tables.setdefault(item.k, []).extend((x, i) for x in sorted(item.hashes.tolist(), key=lambda x: (common[x], x))[:m])
        self.tables = {}
        for k, rows in tables.items():
            x, owner = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
            order = np.argsort(x, kind="stable")
            keys, starts = np.unique(x[order], return_index=True)
            seen = np.zeros(1 << 18, bool)
            seen[keys & np.uint64(len(seen) - 1)] = True
            least = min(self.items[i][2] for i in set(owner.tolist()))
            self.tables[k] = keys, np.append(starts, len(x)), owner[order], seen, least

    def search(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, its shingles, those in the text) of the items contained in the text."""
        ws = words(text)
        if not ws:
            return []
        h, found = word_hashes(ws), []
        for k, (keys, starts, owners, seen, least) in self.tables.items():
            s = shingle_hashes(h, k)
            if len(s) < least:
                continue
            s = np.unique(s[seen[s & np.uint64(len(seen) - 1)]])
            at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
            at = at[keys[at] == s]
            if not len(at):
                continue
            hit, n = np.unique(np.concatenate([owners[starts[i] : starts[i + 1]] for i in at.tolist()]), return_counts=True)
            mine = None
            for i in hit[n >= self.hits[hit]].tolist():
                item, ids, need = self.items[i]
                mine = mine or set(zip(*(ws[j:] for j in range(k)), strict=False))
                if (shared := len(item.shingles & mine)) >= need:
                    found += [(item_id, len(item.shingles), shared) for item_id in ids]
        return found


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("length(item) > 0")


def _small(benchmark: DataFrame, max_chars: int) -> list[tuple[int | None, str]] | None:
    """The items, if they have max_chars characters at most."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.length("item"))).first()[0] or 0) > max_chars:
        return None
    return sorted(((r[0], r[1]) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _pairs(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)]


_NAMES = ["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"]


def _joined(docs: DataFrame, benchmark: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """t (hash of a text), doc_id and the pair columns, for a benchmark of any size; a row for each of equal documents."""
    spark = docs.sparkSession
    ws = Workspace(spark, "decontam")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words(text):
                    item = Item(words(text), shingle)
                    n = len(item.shingles)
                    m, hits = sketch(n, threshold)
                    rows += [(key, x, m, max(1, hits - (n - len(item.hashes)))) for x in (item.hashes ^ np.uint64(item.k)).view(np.int64).tolist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_key", "h", "m", "hits"])

    items = _items(benchmark).withColumn("item_key", F.xxhash64("item"))
    kinds = items.select("item_key", "item").dropDuplicates(["item_key"])
    every = ws.save(kinds.mapInArrow(shingles, "item_key long, h long, m long, hits long"), "shingles")
    common = every.groupBy("h").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("item_key").orderBy("n", "h"))
    sketches = ws.save(every.join(common, "h").withColumn("place", place).where("place <= m").select("item_key", "h", "hits"), "sketches")

    def bits(table: pa.Table) -> pa.Table:
        seen = np.zeros(1 << 15, bool)
        seen[table["bit"].to_numpy()] = True
        return pa.table({"part": table["part"].slice(0, 1), "z": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    parts = sketches.select(F.pmod("h", F.lit(_BITS)).alias("bit")).select(F.expr("bit div 32768").alias("part"), (F.col("bit") % 32768).alias("bit")).distinct()
    seen = np.zeros((_BITS >> 15, 1 << 12), np.uint8)
    for r in parts.groupBy("part").applyInArrow(bits, "part long, z binary").toLocalIterator():
        seen[r["part"]] = np.frombuffer(r["z"], np.uint8)
    sent = spark.sparkContext.broadcast(seen.ravel())

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, found = [], []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = word_hashes(words(text.as_py()))
                for k in range(1, min(shingle, len(h)) + 1):
                    x = np.unique(shingle_hashes(h, k)) ^ np.uint64(k)
                    bit = np.mod(x.view(np.int64), _BITS)
                    x = x[(sent.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0]
                    ts.append(np.full(len(x), t, np.int64))
                    found.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)])) for c in (ts, found)], names=["t", "h"])

    rows = doc_rows(docs).withColumn("t", F.xxhash64("text"))
    met = rows.select("t", "text").mapInArrow(hashes, "t long, h long").distinct().join(sketches, "h")
    candidates = ws.save(met.groupBy("t", "item_key").agg(F.count("*").alias("n"), F.first("hits").alias("hits")).where("n >= hits").select("t", "item_key"), "candidates")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, key, text, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = Item(words(item), shingle)
                n, shared = len(known.shingles), known.shared(words(text))
                if shared >= needed(n, threshold):
                    out.append((t, key, n, shared, shared / n))
            yield pa.RecordBatch.from_arrays(_pairs(out), names=["t", "item_key", *_NAMES[2:]])

    texts = rows.join(candidates.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    pairs = candidates.join(texts, "t").join(kinds, "item_key").select("t", "item_key", "text", "item")
    pairs = ws.save(pairs.mapInArrow(verify, "t long, item_key long, item_shingles long, shared_shingles long, containment double"), "pairs")
    found = rows.select("doc_id", "t").join(pairs, "t").join(items.select("item_key", "item_id"), "item_key")
    return found.select("t", *_NAMES)


_INDEX: dict[str, Index] = {}


def _index(name: str, items: list, threshold: float, shingle: int) -> Index:
    """The index of a sent benchmark, built once in each worker; ``name`` tells benchmarks apart."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Index(items, threshold, shingle)
    return _INDEX[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, max_chars: int = 8_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item whose containment is ``threshold`` or more.

    Words are runs of letters, digits and underscores, lower-cased; an item of fewer than
    ``shingle`` words is one shingle. Items and documents without a word (null and empty texts too) match nothing; null ids of
    documents and items stay null in the pairs; repeated rows give repeated pairs; empty tables give no rows.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    items = _small(benchmark, max_chars)
    if items is None:
        return _joined(docs, benchmark, threshold, shingle).select(*_NAMES)
    sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, sent.value, threshold, shingle)
        for batch in batches:
            rows = [(d, i, n, s, s / n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, n, s in index.search(t.as_py())]
            yield pa.RecordBatch.from_arrays(_pairs(rows), names=_NAMES)

    return doc_rows(docs).mapInArrow(run, _SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, max_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs that hold no benchmark item (items without an id count), columns as they are: for a small benchmark a map
    over docs, for a larger one an anti-join on the texts' hashes."""
    spark = docs.sparkSession
    ship(spark)
    items = _small(benchmark, max_chars)
    if items is None:
        (name,) = spare(docs.columns, "_text_hash")
        found = _joined(docs, benchmark, threshold, shingle).select(F.col("t").alias(name)).distinct()
        return docs.withColumn(name, F.xxhash64(F.col("text").cast("string"))).join(found, name, "left_anti").select([f"`{c}`" for c in docs.columns])
    at, sent, name = docs.columns.index("text"), spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, sent.value, threshold, shingle)
        for batch in batches:
            yield batch.filter(pa.array([not index.search(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return map_rows(docs, run)
