"""Near-duplicate groups: documents linked by a Jaccard similarity of word shingles of ``threshold`` or more.

Candidates come from operator 4's method first: SimHash fingerprints of the shingle sets, met by pigeonring. That serves distances of a
few bits, and pairs at similarity 0.8 differ in ten of 64 bits on average and in up to sixteen, where seventeen segments of four bits
would be shared by nearly all pairs. So pairs beyond its radius are found by bands of a MinHash signature as well (BANDS bands of ROWS values: a pair
at similarity 0.8 shares none with probability 7e-4, and less above). Links are decided on the shingle sets themselves.

Documents with equal sets are one node. Only the texts of nodes that pigeonring joins or that share a band move, compressed. First every node meets
those that pigeonring joins it to and the least node of each of its bands, in linear work however large the band. Bands whose nodes are all
connected then are done. The nodes of the others meet in cells, where a pair that is connected already is skipped; large groups
are cut into a triangle of block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm import simhash
from emberframe.llm.decontam import shingle_hashes, word_hashes
from emberframe.llm.workspace import Workspace, components, partitions

BANDS, ROWS = 24, 6
BLOCK, BLOCK_BYTES, CHUNK = 1024, 16 << 20, 4096
_RNG = np.random.default_rng(8)
_MASK = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_FACTOR = _RNG.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_START = _RNG.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of a text's different word shingles: lower-cased, split at white space; a shorter text is one shingle."""
    h = word_hashes((text or "").lower().split())
    return np.unique(shingle_hashes(h, min(shingle, len(h)))) if len(h) else h


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set's MinHash signature."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        x = (low[i : i + 4096] ^ _MASK) * _FACTOR
        np.minimum(least, (x ^ (x >> np.uint32(15))).min(axis=1), out=least)
    out = _START.copy()
    for r in range(ROWS):
        out = (out ^ least.reshape(BANDS, ROWS)[:, r]) * _MIX[:, r]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def cell_links(sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray, threshold: float, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows that share a band; rows of one side (0 and 1: two blocks; 2: one block) don't meet,
    nor do rows with equal ``joined``."""
    root = np.arange(len(sets)) if joined is None else np.unique(joined, return_index=True)[1][np.unique(joined, return_inverse=True)[1]]
    tried, out = set(), []
    for column in keys.T:
        order = np.argsort(column, kind="stable")
        sorted_keys, lag, at = column[order], 1, np.arange(len(order) - 1)
        while len(at):
            at = at[at + lag < len(order)]
            at = at[sorted_keys[at] == sorted_keys[at + lag]]
            a, b = order[at], order[at + lag]
            meet = (root[a] != root[b]) & ((side[a] == 2) | (side[a] != side[b]))
            for i, j in zip(a[meet].tolist(), b[meet].tolist(), strict=True):
                pair = (min(i, j), max(i, j))
                if root[i] == root[j] or pair in tried:
                    continue
                tried.add(pair)
                if near(sets[i], sets[j], threshold):
                    out.append(pair)
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
            lag += 1
    return out


def near(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    small, large = sorted((len(a), len(b)))
    return small >= threshold * large - 1e-9 and similarity(a, b) >= threshold - 1e-9


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _unpacked(z: bytes, shingle: int) -> np.ndarray:
    return shingle_set(zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass"), shingle)


def _stars(batches: Iterator[pa.RecordBatch], threshold: float, shingle: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (b, chunk, side, node, z), sorted so that b itself (side 0) comes first in each chunk: it meets the others one by one."""
    centre = None
    for batch in batches:
        found: list[tuple[int, int]] = []
        for b, _, side, node, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if side == 0:
                centre = _unpacked(z, shingle)
            elif near(centre, _unpacked(z, shingle), threshold):
                found.append((node, b))
        yield _pairs([f[0] for f in found], [f[1] for f in found])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, shingle: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (root, cell, side, node, comp, bands, z) sorted by root and cell; a cell may cross batches."""
    now, rows = None, []

    def links() -> pa.RecordBatch:
        node = [r[1] for r in rows]
        found = cell_links([_unpacked(r[4], shingle) for r in rows], np.stack([np.frombuffer(r[3], np.int64) for r in rows]), np.array([r[0] for r in rows]), threshold, np.array([r[2] for r in rows]))
        return _pairs([node[i] for i, _ in found], [node[j] for _, j in found])

    for batch in batches:
        for root, cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, cell) != now:
                if len(rows) > 1:
                    yield links()
                now, rows = (root, cell), []
            rows.append(row)
    if len(rows) > 1:
        yield links()


def ring_candidates(ws: Workspace, nodes: DataFrame) -> DataFrame:
    """Pairs (node, b) to be checked among ``nodes`` (node, fp): nodes of equal fingerprints and those that pigeonring joins, each with the least of its set."""
    alike = nodes.groupBy("fp").agg(F.min("node").alias("b"))
    joined = simhash.links(ws, alike.select(F.col("b").alias("node"), "fp")).select(F.col("a").alias("node"), "b")
    return nodes.join(alike, "fp").select("node", "b").where("node <> b").unionByName(joined).distinct()


def grouped(docs: DataFrame, *names: str, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """The columns ``names`` of every row, and ``group``: equal where texts are connected by links.

    Texts without a word (null, empty, blank) are one group. Repeated rows are rows of their own; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "neardup")
    # docs' own columns keep their names beside those of this function
    own = [f"own{i}" for i in range(len(names))]
    text = F.col("text").cast("string")
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)], text.alias("text"), F.xxhash64(text).alias("t"))
    kept = T.StructType([*rows.select(*own).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(len(names))]
            cols = [
                batch.column(len(names) + 1),
                pa.array([xxhash.xxh64_intdigest(s.tobytes(), 5) - (1 << 63) for s in sets], pa.int64()),
                pa.array([bands(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], names=[*own, "t", "node", "bands", "fp"])

    schema = T.StructType([*kept.fields, T.StructField("t", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bands", T.BinaryType()), T.StructField("fp", T.LongType())])
    sets = ws.save(rows.mapInArrow(run, schema), "sets")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [(n, np.frombuffer(b, np.int64)) for n, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if b]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([n for n, _ in some], BANDS)), pa.array(np.concatenate([b for _, b in some]))], names=["node", "band"])

    keyed = sets.select("node", "bands").mapInArrow(explode, "node long, band long")
    low = keyed.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("m")).where("b <> m").select("band", "b")
    shared = ws.save(keyed.join(low, "band").select("node", "band", "b").distinct(), "shared")

    ring = ws.save(ring_candidates(ws, sets.where(F.length("bands") > 0).select("node", "fp").distinct()), "ring")
    edges = shared.select("node", "b").where("node <> b").unionByName(ring).distinct()

    # the texts of one row for each node that has a candidate
    sharing = shared.select("node").unionByName(ring.select("node")).unionByName(ring.select(F.col("b").alias("node"))).distinct()
    first = sets.join(sharing, "node").groupBy("node").agg(F.min("t").alias("t"), F.min("bands").alias("bands"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([z.compress(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in batch.column(0)], pa.binary())], names=["t", "z"])

    packed = rows.select("text", "t").mapInArrow(pack, "t long, z binary")
    met = ws.save(packed.join(first, "t").groupBy("node").agg(F.min("z").alias("z"), F.min("bands").alias("bands")), "met")

    sizes = edges.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("n"))
    others = edges.join(sizes, "b").join(met, "node").select("b", F.pmod(F.xxhash64("node"), F.col("n")).alias("chunk"), F.lit(1).alias("side"), "node", "z")
    centres = sizes.join(met.select(F.col("node").alias("b"), "z"), "b")
    centres = centres.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("b").alias("node"), "z")
    stars = others.unionByName(centres).repartition(partitions(ws.spark), "b", "chunk").sortWithinPartitions("b", "chunk", "side")
    links = ws.save(stars.mapInArrow(lambda b: _stars(b, threshold, shingle), "a long, b long"), "stars")
    comp = components(ws, links, "starred").select("node", F.col("root").alias("comp"))

    # bands that still hold more than one component
    named = shared.join(comp, "node", "left").select("node", "band", F.coalesce("comp", "node").alias("comp"))
    apart = named.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("band", "least")
    open_ = ws.save(named.join(apart, "band").select("node", "comp", "least").distinct(), "open")
    groups = components(ws, open_.select(F.col("comp").alias("a"), F.col("least").alias("b")), "apart").select(F.col("node").alias("comp"), "root")
    rest = open_.select("node", "comp").distinct().join(groups, "comp", "left").select("node", "comp", F.coalesce("root", "comp").alias("root")).join(met, "node")
    rest = ws.save(rest, "rest")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("z") * 3) / BLOCK_BYTES)).cast("long")
    large = rest.groupBy("root").agg(blocks.alias("n")).where("n > 1")
    cells = rest.join(large, "root", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    cells = cells.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        lambda c: F.struct(
            (F.least(c, F.col("mine")) * F.col("n") + F.greatest(c, F.col("mine"))).alias("cell"),
            F.when(c == F.col("mine"), 2).when(F.col("mine") < c, 0).otherwise(1).cast("long").alias("side"),
        ),
    )
    cells = (
        cells.select("root", "node", "comp", "bands", "z", F.explode(pairs).alias("p"))
        .select("root", "p.cell", "p.side", "node", "comp", "bands", "z")
        .repartition(partitions(ws.spark), "root", "cell").sortWithinPartitions("root", "cell")
    )
    more = cells.mapInArrow(lambda b: _verify(b, threshold, shingle), "a long, b long")
    roots = components(ws, links.unionByName(more), "linked")
    ws.drop("shared", "ring", "met", "stars", "open", "rest")
    named = [F.col(o).alias(c) for c, o in zip(names, own, strict=True)]
    return sets.select(*own, "node").join(roots, "node", "left").select(*named, F.coalesce("root", "node").alias("group"))
