"""Embedding near-duplicates by product quantisation with sufficient probes.

Different vectors of a label are scaled to length one and put into an inverted list: the nearest coarse centroid, and
the nearest of a second set of centroids for what is left. The residual is coded by one codeword in each subspace. Lists grow with the
number of vectors (the second set does), so a list holds about ``block`` of them. Cosine >= t means distance <= d =
sqrt(2 - 2t), and three bounds keep every such pair:

* probes: of two vectors within d of each other, x with centroid own and y with centroid c, x lies within d of the plane
  between c and own: |x-c|^2 - |x-own|^2 <= 2 d |c-own|. So x probes exactly these coarse centroids, and below each of them, by the same
  bound on the residuals, second ones;
* table lookup: the asymmetric distance misses the true one by at most the coded vector's own
  error, so a candidate must have adc <= d + error;
* rerank: the cosine of what is left, in double precision, decides.

Centroids and codewords are fitted on a bounded sample; they move only the cost, not the result.
Equal vectors are grouped first. A list's vectors are dealt into blocks of bounded size. First only ids and codes travel to the blocks of the lists
that they probe; a code that no vector of a block is near by table lookup goes no further. Vectors follow the rest, and a
block reports a count for each of them and a spanning forest of its links: never all pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.workspace import Workspace, components, partitions

SLACK = 1e-6
PIECE = 1 << 21


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """At most k centroids of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])


@dataclass
class Codebook:
    """Coarse centroids, second ones for their residuals, and for each subspace codewords of what is left."""

    coarse: np.ndarray
    second: np.ndarray
    words: list[np.ndarray]
    cuts: list[int]

    @functools.cached_property
    def coarse_gaps(self) -> np.ndarray:
        return np.sqrt(np.maximum(squared(self.coarse, self.coarse), 0))

    @functools.cached_property
    def second_gaps(self) -> np.ndarray:
        return np.sqrt(np.maximum(squared(self.second, self.second), 0))

    def centre(self, lists: np.ndarray) -> np.ndarray:
        """Centroids of lists by number (coarse * number of second ones + second)."""
        return self.coarse[lists // len(self.second)] + self.second[lists % len(self.second)]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, self.cuts, axis=1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each coded residual is from the true one."""
        codes = np.stack([nearest(p, w) for p, w in zip(self.parts(residual), self.words, strict=True)], axis=1)
        back = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((residual - back) ** 2).sum(1))

    def lookup(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to codes by table lookup."""
        out = np.zeros((len(residual), len(codes)))
        for i, (p, w) in enumerate(zip(self.parts(residual), self.words, strict=True)):
            out += squared(p, w)[:, codes[:, i]]
        return out


def fit(sample: np.ndarray, coarse: int, second: int = 1, subspaces: int = 8, words: int = 64) -> Codebook:
    first = kmeans(sample, coarse)
    residual = sample - first[nearest(sample, first)]
    rest = kmeans(residual, second) if second > 1 else np.zeros((1, sample.shape[1]))
    residual = residual - rest[nearest(residual, rest)]
    cuts = [len(p) for p in np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))]
    cuts = np.cumsum(cuts)[:-1].tolist()
    return Codebook(first, rest, [kmeans(p, words, 8) for p in np.split(residual, cuts, axis=1)], cuts)


def reachable(x: np.ndarray, centroids: np.ndarray, reach: float, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, and which centroids may be nearest to a vector within reach of it; gaps: distances of the centroids."""
    d = squared(x, centroids)
    home, at = d.argmin(1), np.arange(len(x))
    ok = d - d[at, home][:, None] <= 2 * reach * gaps[home] + SLACK
    ok[at, home] = True
    return home, ok


def probes(x: np.ndarray, book: Codebook, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home list of each vector, and all lists that may hold vectors within reach of it. Tables of distances hold PIECE numbers at a time."""
    k, homes, found = len(book.second), [], []
    for s in range(0, len(x), step := max(1, PIECE // len(book.coarse))):
        part = x[s : s + step]
        home, ok = reachable(part, book.coarse, reach, book.coarse_gaps)
        who, c = np.nonzero(ok)
        own, rows, lists = np.zeros(len(part), np.int64), [], []
        for i in range(0, len(who), inner := max(1, PIECE // k)):
            w, near = who[i : i + inner], c[i : i + inner]
            second, below = reachable(part[w] - book.coarse[near], book.second, reach, book.second_gaps)
            mine = near == home[w]
            own[w[mine]] = second[mine]
            row, t = np.nonzero(below)
            rows.append(w[row])
            lists.append(near[row] * k + t)
        homes.append(home * k + own)
        found += np.split(np.concatenate(lists), np.searchsorted(np.concatenate(rows), np.arange(1, len(part))))
    return np.concatenate(homes), found


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; root of every place."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


class Cell:
    """One block of a list: its vectors, then the queries that probe the list."""

    def __init__(self, book: Codebook, threshold: float, list_no: int, rows: pa.Table):
        self.book, self.threshold, self.centre = book, threshold, book.centre(np.array([list_no]))
        self.node, self.mult = rows["node"].to_numpy(), rows["mult"].to_numpy()
        self.x = matrix(rows["v"])
        self.unit = self.x / np.sqrt((self.x**2).sum(1))[:, None]
        self.codes, self.err = book.encode(self.unit - self.centre)
        self.root, self.hit = np.arange(len(self.node)), np.zeros(len(self.node), bool)
        self.reach = np.sqrt(max(0.0, 2 - 2 * threshold))

    def ask(self, node: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queries: links into the block; and an edge (query, block vector) where there is any."""
        unit = x / np.sqrt((x**2).sum(1))[:, None]
        adc = self.book.lookup(unit - self.centre, self.codes)
        q, j = np.nonzero(np.sqrt(adc) <= self.reach + self.err + SLACK)
        q, j = q[node[q] != self.node[j]], j[node[q] != self.node[j]]
        cos = np.concatenate([np.einsum("ij,ij->i", x[q[s : s + 65536]], self.x[j[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.zeros(0)])
        cos /= np.sqrt((x**2).sum(1))[q] * np.sqrt((self.x**2).sum(1))[j]
        q, j = q[cos >= self.threshold], j[cos >= self.threshold]
        links = np.bincount(q, self.mult[j], len(node)).astype(np.int64)
        first = np.full(len(node), -1)
        first[q[::-1]] = j[::-1]
        self.root = hook(self.root, first[q], j)
        self.hit[j] = True
        return links, first >= 0, self.node[first]

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges between the block's own vectors that its queries joined."""
        apart = self.hit & (self.root != np.arange(len(self.root)))
        return self.node[apart], self.node[self.root[apart]]


def matrix(column) -> np.ndarray:
    """Rows of a list column as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _edges(node, other, links) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(links, pa.int64())], names=["node", "other", "links"])


def wanted(book: Codebook, reach: float, node: np.ndarray, unit: np.ndarray, entry: np.ndarray, home: np.ndarray, codes: np.ndarray, err: np.ndarray) -> np.ndarray:
    """Which entries (id, list, code, error) have another vector of a block near enough by table lookup.

    With centroid c and codeword w, |x - c - w|^2 = |x - c|^2 - 2 x.w + (2 c.w + |w|^2): the first is a number for each x and list,
    the second a table for each x, the third a number for each entry.
    """
    out = np.zeros(len(entry), bool)
    lists, which = np.unique(home, return_inverse=True)
    first = squared(unit, book.centre(lists))
    tables = [-2 * p @ w.T for p, w in zip(book.parts(unit), book.words, strict=True)]
    for s in range(0, len(entry), 1024):
        part = slice(s, s + 1024)
        word = np.concatenate([w[codes[part, i]] for i, w in enumerate(book.words)], axis=1)
        adc = first[:, which[part]] + (word * (2 * book.centre(home[part]) + word)).sum(1)
        for i, t in enumerate(tables):
            adc += t[:, codes[part, i]]
        near = np.sqrt(np.maximum(adc, 0)) <= reach + err[part] + SLACK
        out[part] = (near & (node[:, None] != entry[part])).any(axis=0)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample: int = 20_000, block: int = 4096, coarse: int = 1024) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with cosine >= threshold and the same label), component_id, kept.

    Vectors that are null, zero, without a label or an id, or that hold null or non-finite
    components link with nothing, and so do vectors of different lengths. component_id is the
    smallest vec_id reachable, the row's own included. Equal rows are vectors of their own. A row without an id has a null
    component and is kept. Extra columns are ignored; an empty table gives no rows. ``coarse`` bounds the first level of centroids only.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "annpq")
    item = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{item}>").alias("v"), F.col("label").cast("string").alias("label"))
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    )
    sound = F.coalesce(sound, F.lit(False))
    v = F.col("v")
    if item == "double":  # keep squares in range
        top = F.array_max(F.transform("v", lambda c: F.abs(c)))
        v = F.when((top > 1e100) | (top < 1e-100), F.transform("v", lambda c: c / top)).otherwise(v)
    good = rows.where(sound).select("vec_id", "label", F.transform(v, lambda c: c + F.lit(0).cast(item)).alias("v"))
    nodes = ws.save(good.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult")), "nodes")
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.size("v").alias("d")).count().collect()}
    edges = None
    for d, n in sorted(sizes.items()):
        part = nodes.where(F.size("v") == d)
        draw = F.pmod(F.xxhash64(F.lit("fit"), "node"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n)) + 1
        x = np.array([r["v"] for r in part.where(draw).orderBy(F.xxhash64(F.lit("fit"), "node")).select("v").limit(sample).collect()])
        if not len(x):
            x = np.eye(1, d)
        x = x / np.sqrt((x**2).sum(1))[:, None]
        lists = max(1, min(coarse, int(np.sqrt(n) / 2)))
        found = _links(ws, part, fit(x, lists, min(len(x), -(-n // (lists * block)))), threshold, block, d)
        edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        edges = spark.createDataFrame([], "node long, other long, links long")
    edges = ws.save(edges, "edges")
    roots = components(ws, edges.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = edges.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(links, "node", "left").join(roots, "node", "left")
    known = known.select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id")
    ).withColumn("h", F.xxhash64("label", "v"))
    known = ws.save(known, "known")
    members = good.withColumn("h", F.xxhash64("label", "v")).join(known, ["h", "label", "v"]).select("vec_id", "n_links", "component_id")
    others = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(others).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(ws: Workspace, nodes: DataFrame, book: Codebook, threshold: float, block: int, d: int) -> DataFrame:
    """Rows (node, other, links): links to be summed by node, and edges of a spanning forest where other is set."""
    spark = ws.spark
    sent = spark.sparkContext.broadcast(book)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for start in range(0, batch.num_rows, 256):  # a vector may probe thousands of lists
                part = batch.slice(start, 256)
                x = matrix(part.column(1))
                unit = x / np.sqrt((x**2).sum(1))[:, None]
                home, lists = probes(unit, sent.value, reach)
                codes, err = sent.value.encode(unit - sent.value.centre(home))
                new = [pa.array(home, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=["label", "v", "node", "mult", "home", "lists", "code", "err"])

    kind = dict(nodes.dtypes)["v"]
    placed = ws.save(nodes.select("label", "v", "node", "mult").mapInArrow(place, f"label string, v {kind}, node long, mult long, home long, lists array<long>, code binary, err double"), f"placed{d}")
    full = placed.groupBy("label", F.col("home").alias("list")).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    index = placed.join(full.withColumnRenamed("list", "home"), ["label", "home"]).select(
        "label", F.col("home").alias("list"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), F.lit(0).cast("long").alias("role"), "node", "mult", "v", "home", "code", "err"
    )
    key = ["label", "list", "block"]
    copies = placed.select("label", "node", "home", "code", "err", F.explode("lists").alias("list")).join(full, ["label", "list"])
    copies = copies.select("label", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).cast("long").alias("role"), "node", F.lit(0).cast("long").alias("mult"), F.lit(None).cast(kind).alias("v"), "home", "code", "err")
    dealt = lambda df: df.repartition(partitions(spark), *key).sortWithinPartitions(*key, "role")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gathered, cell = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = list(zip(*(table[c].to_pylist() for c in (*key, "role")), strict=True))
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
                part = table.slice(a, b - a)
                if names[a][:3] != at:
                    at, gathered, cell = names[a][:3], [], None
                if names[a][3] == 0:
                    gathered.append(part.select(["node", "v"]))
                    continue
                if cell is None:
                    if not gathered:
                        continue
                    own = pa.concat_tables(gathered)
                    x = matrix(own["v"])
                    cell = own["node"].to_numpy(), x / np.sqrt((x**2).sum(1))[:, None]
                codes = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
                entry = part["node"].to_numpy()
                keep = entry[wanted(sent.value, reach, *cell, entry, part["home"].to_numpy(), codes, part["err"].to_numpy())]
                label, list_no, block_no = at
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(keep), pa.string()), pa.array([list_no] * len(keep), pa.int64()), pa.array([block_no] * len(keep), pa.int64()), pa.array(keep, pa.int64())], names=[*key, "node"])

    asks = ws.save(dealt(index.unionByName(copies)).mapInArrow(screen, "label string, list long, block long, node long"), f"asks{d}")
    asks = asks.join(placed.select("node", "mult", "v"), "node").select(*key, F.lit(1).cast("long").alias("role"), "node", "mult", "v")
    met = index.select(*key, "node", "mult", "v").join(asks.select(*key).distinct(), key, "left_semi").select(*key, F.lit(0).cast("long").alias("role"), "node", "mult", "v")
    cells = dealt(met.unionByName(asks))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gathered, cell = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = list(zip(*(table[c].to_pylist() for c in (*key, "role")), strict=True))
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
                part = table.slice(a, b - a)
                if names[a][:3] != at:
                    if cell:
                        yield _edges(*cell.rest(), np.zeros(len(cell.rest()[0]), np.int64))
                    at, gathered, cell = names[a][:3], [], None
                if names[a][3] == 0:
                    gathered.append(part)
                    continue
                if cell is None:
                    if not gathered:
                        continue
                    cell = Cell(sent.value, threshold, at[1], pa.concat_tables(gathered))
                for s in range(0, part.num_rows, 256):
                    some = part.slice(s, 256)
                    node = some["node"].to_numpy()
                    links, has, other = cell.ask(node, matrix(some["v"]))
                    yield _edges(node[has], other[has], links[has])
        if cell:
            yield _edges(*cell.rest(), np.zeros(len(cell.rest()[0]), np.int64))

    return cells.mapInArrow(search, "node long, other long, links long")
