"""Spelling variants: K-d trees over letter-count vectors find words one edit apart.

A replaced letter lowers one letter count by one and raises another; an inserted letter raises one. So each word searches
its own length with a box of one up and one down, and the next length with one up (which serves the shorter word and the longer).
Search descends a K-d tree whose nodes split on the count of one letter, into both sides only where an unused step of the box
crosses the split. What a leaf then holds is verified on the letters in their order.

Each length has a tree. Its upper part, cut from a sample of the words, is sent to the tasks and deals words and searches out to cells
of some CELL words; the sample moves only the splits. In a cell's task the tree goes on down to leaves of LEAF words, over the cell's own words. Searches come
in batches, so a task holds one cell's words and one batch.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.workspace import Workspace, doc_rows

CELL, LEAF, PAIRS, SEARCHES, FLUSH = 32_768, 24, 1 << 19, 1 << 12, 200_000
MAX_SAMPLE, MAX_CELLS = 1_000_000, 65_536
LETTERS = 26 + 64  # a-z, U+00C0-U+00FF
RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str | None) -> list[str]:
    """Letter runs of a text, A-Z lower-cased."""
    return RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def thinned(doc_id: int | None, text: str | None, modulus: int) -> Counter:
    """Counts of a document's runs; a run whose CRC-32 with the document's id ``modulus`` divides loses one letter, and what is left of it no other."""
    count = Counter(runs(text))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    # all leave before any arrives: what is left of one may be another of them
    for run, n in [(r, count.pop(r)) for r in [*count] if zlib.crc32(r.encode(), start) % modulus == 0]:
        k = zlib.crc32(run.encode(), start) % len(run)
        count[run[:k] + run[k + 1 :]] += n
    return count


def word_counts(docs: DataFrame, min_chars: int = 5, min_count: int = 3, modulus: int = 97) -> DataFrame:
    """word, n: words of ``min_chars`` letters that occur ``min_count`` times over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total.update({w: n for w, n in thinned(doc, text.as_py(), modulus).items() if len(w) >= min_chars})
                if len(total) >= FLUSH:
                    yield rows()
                    total.clear()
        if total:
            yield rows()

    return doc_rows(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def codes(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of letter numbers 0 .. LETTERS - 1."""
    c = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)
    return np.where(c >= 0xC0, c - (0xC0 - 26), c - 97).astype(np.uint8)


def counts(code: np.ndarray) -> np.ndarray:
    """Letter-count vectors of rows of codes."""
    n, length = code.shape
    flat = np.bincount((np.arange(n)[:, None] * LETTERS + code).ravel(), minlength=n * LETTERS)
    return flat.reshape(n, LETTERS).astype(np.uint8 if length < 256 else np.int32)


class Tree(NamedTuple):
    """Nodes of a K-d tree: where the count of ``letter`` is at most ``split``, ``low`` follows, else ``high``; leaves have letter -1 and their number in ``low``."""

    letter: np.ndarray
    split: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaves: int


def grow(vectors: np.ndarray, leaf: float, most: int = 1 << 30) -> tuple[Tree, np.ndarray]:
    """A tree with leaves of at most ``leaf`` vectors (more where they cannot be told apart, or once there are ``most`` leaves), and each vector's leaf."""
    nodes: list[list[int]] = [[-1, 0, 0, 0]]
    at, open_, leaves = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))], 0
    while open_:
        node, rows = open_.pop(0)
        cut = None
        if len(rows) > leaf and leaves + len(open_) + 1 < most:
            own, best = vectors[rows], len(rows)
            spread = np.flatnonzero(own.min(axis=0) < own.max(axis=0))
            for k in range(int(own.max()) if len(spread) else 0):
                share = np.abs(2 * (own[:, spread] <= k).sum(axis=0) - len(rows))
                if len(share) and share.min() < best:
                    best, cut = int(share.min()), (int(spread[share.argmin()]), k)
        if cut:
            side = own[:, cut[0]] <= cut[1]
            nodes[node] = [cut[0], cut[1], len(nodes), len(nodes) + 1]
            open_ += [(len(nodes), rows[side]), (len(nodes) + 1, rows[~side])]
            nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
        else:
            nodes[node] = [-1, 0, leaves, 0]
            at[rows] = leaves
            leaves += 1
    table = np.array(nodes, np.int64)
    return Tree(*table.T, leaves), at


def search(tree: Tree, vectors: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of vectors, leaf) for the leaves that hold vectors with at most ``up`` (0, 1) letters one more and ``down`` (0, 1) letters one less."""
    q, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    # the letter that a step was used on; -1: unused, -2: not allowed
    plus, minus = np.full(len(q), -1 if up else -2, np.int64), np.full(len(q), -1 if down else -2, np.int64)
    found_q, found_leaf = [], []
    while len(q):
        letter = tree.letter[node]
        done = letter < 0
        if done.any():
            found_q.append(q[done])
            found_leaf.append(tree.low[node[done]])
            q, node, plus, minus, letter = q[~done], node[~done], plus[~done], minus[~done], letter[~done]
        split = tree.split[node]
        c = vectors[q, letter].astype(np.int64) + (plus == letter) - (minus == letter)
        low = c <= split
        more = np.flatnonzero((c == split) & (plus == -1) & (minus != letter))
        less = np.flatnonzero((c == split + 1) & (minus == -1) & (plus != letter))
        near = np.where(low, tree.low[node], tree.high[node])
        q, node, plus, minus = (
            np.concatenate([q, q[more], q[less]]), np.concatenate([near, tree.high[node[more]], tree.low[node[less]]]),
            np.concatenate([plus, letter[more], plus[less]]), np.concatenate([minus, minus[more], letter[less]]),
        )
    return (np.concatenate(found_q), np.concatenate(found_leaf)) if found_q else (q, node)


def packed(code: np.ndarray) -> np.ndarray:
    """Rows of codes as 64-bit lanes of eight letters."""
    out = np.zeros((len(code), -(-code.shape[1] // 8) * 8), np.uint8)
    out[:, : code.shape[1]] = code
    return out.view(np.uint64)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of lanes differ in exactly one letter."""
    total = np.zeros(len(a), np.uint8)
    for k in range(a.shape[1]):
        x = a[:, k] ^ b[:, k]
        x |= x >> np.uint64(4)
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        total += np.minimum(np.bitwise_count(x & np.uint64(0x0101010101010101)), 2)
        total = np.minimum(total, 2)
    return total == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of b (one letter longer) are those of a with a letter inserted: equal up to some place, and from there shifted by one."""
    length = a.shape[1]
    head, tail = a != b[:, :length], (a != b[:, 1:])[:, ::-1]
    front = np.where(head.any(axis=1), head.argmax(axis=1), length)
    back = np.where(tail.any(axis=1), tail.argmax(axis=1), length)
    return front + back >= length


class Cell:
    """The words of one cell in a tree of their own."""

    def __init__(self, words: list[str], n: np.ndarray):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n, self.length = [words[i] for i in order], n[order], len(words[0])
        self.code = codes(self.words, self.length)
        self.lanes = packed(self.code)
        self.tree, leaf = grow(counts(self.code), LEAF)
        self.rows = np.argsort(leaf, kind="stable")
        self.ends = np.cumsum(np.bincount(leaf, minlength=self.tree.leaves))

    def near(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in words, row of this cell) of near words; words all have the cell's length or one letter less."""
        length = len(words[0])
        code = codes(words, length)
        lanes, shorter = packed(code), length < self.length
        q, leaf = search(self.tree, counts(code), 1, 0 if shorter else 1)
        size = np.diff(self.ends, prepend=0)
        todo = np.cumsum(size[leaf])
        for lo in range(0, int(todo[-1]) if len(todo) else 0, PAIRS):
            i, j = np.searchsorted(todo, lo, "right"), np.searchsorted(todo, lo + PAIRS, "left") + 1
            sizes, offset = size[leaf[i:j]], todo[i:j]
            flat = np.arange(lo, min(lo + PAIRS, int(todo[-1])))
            which = np.searchsorted(offset, flat, "right")
            rows = self.rows[(self.ends[leaf[i:j]] - sizes)[which] + flat - (offset - sizes)[which]]
            a = q[i:j][which]
            good = np.flatnonzero(one_inserted(code[a], self.code[rows]) if shorter else one_replaced(lanes[a], self.lanes[rows]))
            yield a[good], rows[good]


def _best(at: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value of ``at``: how often it stands there, and the place of its entry of largest n, then of smallest rank."""
    order = np.lexsort((rank, -n, at))
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    return at[order][first], np.diff(np.append(first, len(at))), order[first]


def _search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (length, leaf, side, word, n) sorted by the first three: words of the cell (side 0), then searches by words one letter shorter (1) or as long (2). Gives word, n_near, form_n, form as far as the cell knows."""

    def found(cell: Cell, words: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = [*cell.near(words)]
        if not parts:
            return
        q, rows = (np.concatenate(p) for p in zip(*parts, strict=True))
        ways = [(q, rows, words, cell.words, cell.n)]
        if len(words[0]) < cell.length:  # the longer words learn of the shorter ones in the same search
            ways.append((rows, q, cell.words, words, n))
        for at, other, own, names, number in ways:
            if len(at):
                rank = other if names is cell.words else np.argsort(np.argsort(np.array(names, object)))[other]
                where, many, best = _best(at, number[other], rank)
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([own[i] for i in where.tolist()], pa.string()), "n_near": pa.array(many, pa.int64()),
                    "form_n": pa.array(number[other[best]], pa.int64()), "form": pa.array([names[i] for i in other[best].tolist()], pa.string()),
                })

    now, cell, words, numbers = None, None, [], []
    for batch in batches:
        length, leaf, side = (batch.column(i).to_numpy() for i in range(3))
        n = batch.column(4).to_numpy()
        change = np.flatnonzero((np.diff(length, prepend=-1) != 0) | (np.diff(leaf, prepend=-1) != 0) | (np.diff(side, prepend=-1) != 0)).tolist()
        for i, j in zip(change, [*change[1:], len(side)], strict=True):
            if (length[i], leaf[i]) != now:
                now, cell, words, numbers = (length[i], leaf[i]), None, [], []
            part = batch.column(3).slice(i, j - i).to_pylist()
            if side[i] == 0:
                words += part
                numbers.append(n[i:j])
                continue
            if cell is None and words:
                cell, words = Cell(words, np.concatenate(numbers)), []
            if cell is not None:
                for k in range(0, len(part), SEARCHES):
                    yield from found(cell, part[k : k + SEARCHES], n[i:j][k : k + SEARCHES])


def upper_trees(words: DataFrame, cell: int = CELL) -> dict[int, Tree]:
    """Trees that deal the words of a length out to cells of some ``cell`` words, for lengths that have more. Splits come from a sample of
    at most some MAX_SAMPLE words; there are MAX_CELLS cells at most (about 3 MB of nodes), and larger cells beyond."""
    total = words.count()
    if total <= cell:
        return {}
    every = max(1, min(256, cell // 64), total // MAX_SAMPLE)
    sample: dict[int, list[str]] = {}
    for (word,) in words.where(F.pmod(F.xxhash64(F.lit(13), "word"), F.lit(every)) == 0).select("word").toLocalIterator():
        sample.setdefault(len(word), []).append(word)
    share = cell / every
    return {length: grow(counts(codes(own, length)), share, max(1, MAX_CELLS * len(own) * every // total))[0] for length, own in sample.items() if len(own) > share}


def variants(words: DataFrame, cell: int = CELL) -> DataFrame:
    """For each (word, n): word, form, root, n, n_near, form_n, where all words differ and have letters of RUN only.

    form is the near word (one letter inserted, deleted or replaced) of largest n, the first in code-point order among equals, if it has twice
    the word's n at least; root is the last form reached from the word.
    """
    ws = Workspace(words.sparkSession, "spelling")
    words = ws.save(words.select("word", F.col("n").cast("long").alias("n")), "words")
    trees = ws.spark.sparkContext.broadcast(upper_trees(words, cell))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trees.value
        for batch in batches:
            size = np.array([len(w) for w in batch.column(0).to_pylist()], np.int64)
            for length in np.unique(size).tolist():
                part = batch.filter(pa.array(size == length))
                vectors = counts(codes(part.column(0).to_pylist(), length))
                for side, target, up, down in ((0, length, 0, 0), (2, length, 1, 1), (1, length + 1, 1, 0)):
                    if target in known:
                        q, leaf = search(known[target], vectors, up, down)
                    else:
                        q, leaf = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
                    for i in range(0, len(q), 1 << 16):
                        some = part.take(pa.array(q[i : i + (1 << 16)]))
                        m = some.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, target, np.int32)), pa.array(leaf[i : i + m].astype(np.int32)), pa.array(np.full(m, side, np.int32)), *some.columns], names=["length", "leaf", "side", "word", "n"])

    dealt = words.mapInArrow(deal, "length int, leaf int, side int, word string, n long").repartition("length", "leaf").sortWithinPartitions("length", "leaf", "side")
    near = dealt.mapInArrow(_search_cells, "word string, n_near long, form_n long, form string")
    rows = near.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("less"), "form").alias("best"))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:bigint,form:string>").alias("best"))
    merged = rows.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    strong = -F.col("best.less") >= 2 * F.col("n")
    formed = merged.select("word", "n", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    formed = ws.save(formed, "formed")

    # forms are followed in doubling steps: n doubles with each, so there are 63 forms in a row at most
    paths = ws.save(formed.where("form is not null").select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "paths-0")
    for turn in range(1, 8):
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("beyond"), F.col("done").alias("ended"))
        moved = paths.where("not done").join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.coalesce("ended", F.lit(True)).alias("done"))
        paths = ws.save(paths.where("done").unionByName(moved), f"paths-{turn}")
        ws.drop(f"paths-{turn - 1}")
        if paths.where("not done").isEmpty():
            break
    roots = paths.select("word", "root")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def groups(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """Spelling variants among the words of documents: see ``word_counts`` and ``variants``.

    Null and empty texts have no words; a null id counts as an empty one. Rows that repeat an id count each. Other columns are ignored; a table without words
    gives no rows.
    """
    return variants(word_counts(docs), cell)
