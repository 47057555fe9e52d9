"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: majority bits of the XXH64 hashes of word shingles. Two fingerprints within ``limit``
bits, cut into limit + 1 segments on a ring, have a segment from which every chain of l
consecutive segments differs in at most l * limit / (limit + 1) bits (pigeonring principle). So the
first segment is equal, and the second differs in at most one bit: one of its halves is equal too.
The index key is that pair (segment and a half of the next); candidates of a key then pass the chain
budgets segment by segment before the full Hamming check.

Only different fingerprints meet: documents with equal ones are grouped first. A key's fingerprints
give a spanning forest of their links, never all their pairs; keys with very many fingerprints are
cut into a triangle of block pairs, so that no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.workspace import Workspace, components, doc_rows, partitions

BITS, LIMIT = 64, 3
SEGMENTS = LIMIT + 1
WIDTH = BITS // SEGMENTS
BLOCK = 8192


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the 64-bit hashes, as an unsigned number."""
    counts, n = np.zeros(BITS, np.int64), len(h)
    for i in range(0, n, 255 * 256):
        bits = np.unpackbits(h[i : i + 255 * 256].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            counts += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the whole text: A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    return majority(h)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long). Null, empty and blank texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, fp long")


def _segment(i: int):
    return F.shiftrightunsigned("fp", BITS - WIDTH * (i % SEGMENTS + 1)).bitwiseAND((1 << WIDTH) - 1)


def ring_keys(nodes: DataFrame) -> DataFrame:
    """Every fingerprint under 2 * SEGMENTS keys: a segment, and the upper or lower half of the next."""
    half = WIDTH // 2
    keys = []
    for i in range(SEGMENTS):
        for j, part in enumerate((F.shiftright(_segment(i + 1), half), _segment(i + 1).bitwiseAND((1 << half) - 1))):
            keys.append(F.lit((2 * i + j) << (WIDTH + half)) + F.shiftleft(_segment(i), half) + part)
    return nodes.select("node", "fp", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))


def chain_ok(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of differences x, which keep every chain from segment ``first`` within its budget; the last chain is the full check."""
    left = np.arange(len(x))
    total = np.zeros(len(x), np.int64)
    for l in range(SEGMENTS):
        shift = (BITS - WIDTH * ((first[left] + l) % SEGMENTS + 1)).astype(np.uint64)
        total = total + np.bitwise_count((x[left] >> shift) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
        keep = total * SEGMENTS <= (l + 1) * LIMIT
        left, total = left[keep], total[keep]
        if not len(left):
            break
    return left


def forest(cell: np.ndarray, first: np.ndarray, fp: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Roots of the linked sets among rows sorted by cell; rows of one side (0 and 1: two blocks; 2: one block) don't meet.

    Rows at distance 1, 2, ... in a cell are compared all at once; pairs that are joined already are skipped.
    """
    n = len(cell)
    root = np.arange(n)
    at, lag = np.arange(n - 1), 1
    while len(at):
        at = at[at + lag < n]
        at = at[cell[at] == cell[at + lag]]
        a = at[(root[at] != root[at + lag]) & ((side[at] == 2) | (side[at] != side[at + lag]))]
        b = a + lag
        if len(a):
            good = chain_ok(fp[a] ^ fp[b], first[a])
            a, b = a[good], b[good]
            while len(a):
                ra, rb = root[a], root[b]
                apart = ra != rb
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
        lag += 1
    return root


def _forest_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of rows (key, cell, side, fp, node) sorted by key and cell; a cell may cross batches."""
    kept: list[np.ndarray] = []

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        key, cell, side, fp, node = rows
        change = np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        group = np.cumsum(change)
        full = np.concatenate([change[1:], [True]]) & change  # groups of one row
        rest = ~full
        group, side, fp, node, key = group[rest], side[rest], fp[rest], node[rest], key[rest]
        root = forest(group, (key >> (WIDTH + WIDTH // 2)) // 2, fp.view(np.uint64), side)
        linked = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"])

    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns]) if batch.num_rows else np.zeros((5, 0), np.int64)
        rows = np.concatenate([*kept, rows], axis=1)
        if not rows.shape[1]:
            continue
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        end = last[-1] + 1 if len(last) else 0
        if end:
            yield edges(rows[:, :end])
        kept = [rows[:, end:]]
    if kept and kept[0].shape[1]:
        yield edges(kept[0])


def links(ws: Workspace, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs within LIMIT bits do. nodes: node, fp, all fp different."""
    keyed = ring_keys(nodes)
    large = ws.save(
        keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("n")), "large"
    )
    cells = keyed.join(large, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("long")
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1),
        lambda c: F.struct(
            (F.least(c, F.col("mine")) * F.col("n") + F.greatest(c, F.col("mine"))).alias("cell"),
            F.when(c == F.col("mine"), 2).when(F.col("mine") < c, 0).otherwise(1).cast("long").alias("side"),
        ),
    )
    cells = (
        cells.withColumn("mine", mine).select("key", "fp", "node", F.explode(pairs).alias("p"))
        .select("key", "p.cell", "p.side", "fp", "node")
        .repartition(partitions(ws.spark), "key", "cell").sortWithinPartitions("key", "cell")
    )
    return cells.mapInArrow(_forest_edges, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Null, empty and blank texts have fingerprint zero and link like any other. Rows that repeat an
    id keep a row each. Rows without an id join their fingerprint's component but do not name it
    (a component of such rows alone has a null id). Extra columns are ignored; an empty table gives
    no rows.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    fps = ws.save(fingerprints(docs, shingle), "fps")
    nodes = ws.save(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components(ws, links(ws, nodes, block))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
