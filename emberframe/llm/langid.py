"""Language identification with string kernels.

Blended-spectrum kernel: for each n-gram length up to ORDERS the sets of different n-grams of two texts are compared by
their normalised intersection, and the lengths are averaged. Nyström landmarks give an explicit
feature map, one-versus-rest kernel ridge regression the class scores. A class score is linear in the n-gram set of
the text, so landmarks and ridge weights fold into one table (n-gram of a landmark x language), and a batch
of texts is scored by one sparse matrix product with it.

N-grams have 64-bit ids: sets stay sets however long a text is. Only the training rows are sampled (``per_language``); every
text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.workspace import Workspace, doc_rows, map_rows, ship

ORDERS, STRETCH = 4, 1 << 20
_LETTER: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points; runs of anything else are one space; empty if there is no letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _LETTER[0][c]
    if not alpha.any():
        return np.zeros(0, np.uint32)
    c = np.where(alpha, c, np.uint32(32))
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    return np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)] * bool(alpha[-1])]).astype(np.uint32)


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def grams(text: str | None) -> np.ndarray | None:
    """Sorted ids of the text's different n-grams, the last two bits their length - 1; None without a letter."""
    c = letters(text) if text else ()
    if not len(c):
        return None
    found = np.zeros(0, np.uint64)
    for at in range(0, len(c), STRETCH):
        part, rows = c[at : at + STRETCH + ORDERS - 1], []
        h = part.astype(np.uint64)
        for n in range(ORDERS):
            if n:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + part[n:]
                h = h ^ (h >> np.uint64(31))
            x = h * np.uint64(0xD6E8FEB86659FD93)
            rows.append(((x ^ (x >> np.uint64(32))) & ~np.uint64(3)) | np.uint64(n))
        found = _distinct(np.concatenate([found, *rows]))
    return found


def sizes(x: np.ndarray) -> np.ndarray:
    """How many n-grams of each length a set holds."""
    return np.bincount((x & np.uint64(3)).astype(np.int64), minlength=ORDERS)


class Lookup:
    """Places of ids in a sorted list of them, found by their first bits."""

    def __init__(self, ids: np.ndarray):
        self.ids, bits = ids, max(1, len(ids).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(ids >> self.shift, np.arange(1 << bits, dtype=np.uint64))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, place) of the ids that are there."""
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, last = self.first[(x >> self.shift).astype(np.int64)], len(self.ids) - 1
        at = np.minimum(at, last)
        behind = np.flatnonzero(self.ids[at] < x)
        while len(behind):
            behind = behind[at[behind] < last]
            at[behind] += 1
            behind = behind[self.ids[at[behind]] < x[behind]]
        hit = np.flatnonzero(self.ids[at] == x)
        return hit, at[hit]


class Landmarks:
    """The landmarks' sets, by n-gram: ``owners[starts[i]:starts[i + 1]]`` hold n-gram i."""

    def __init__(self, sets: list[np.ndarray]):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.ids, self.starts = np.unique(every[order], return_index=True)
        self.owners = owner[order].astype(np.int32)
        self.size = np.array([sizes(s) for s in sets]).reshape(-1, ORDERS)
        self.look = Lookup(self.ids)

    def weight(self) -> np.ndarray:
        """Of every entry of owners: 1 / root of the owner's number of n-grams of that length, and of ORDERS."""
        length = np.repeat((self.ids & np.uint64(3)).astype(np.int64), np.diff(np.append(self.starts, len(self.owners))))
        return 1 / np.sqrt(self.size[self.owners, length] * ORDERS)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Kernel of a set with every landmark."""
        _, at = self.look(x)
        n = np.append(self.starts, len(self.owners))[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        length = np.repeat((self.ids[at] & np.uint64(3)).astype(np.int64), n)
        shared = np.bincount(self.owners[entry] * ORDERS + length, minlength=len(self.size) * ORDERS).reshape(-1, ORDERS)
        return (shared / np.sqrt(np.maximum(1, self.size * sizes(x)))).mean(axis=1)


@dataclass
class Model:
    languages: list[str]
    look: Lookup  # n-grams of the landmarks
    table: np.ndarray  # these x languages
    sharpness: float

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        """Class scores of a batch of sets: a sparse matrix of their n-grams times the table."""
        every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        weight = 1 / np.sqrt(np.maximum(1, np.array([sizes(s) for s in sets])) * ORDERS)
        hit, at = self.look(every)
        value = weight[of[hit], (every[hit] & np.uint64(3)).astype(np.int64)]
        return np.stack([np.bincount(of[hit], value * self.table[at, k], len(sets)) for k in range(len(self.languages))], axis=1)

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Probabilities of a batch of sets."""
        f = self.margins(sets) * self.sharpness
        e = np.exp(f - f.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_kernel(marks: Landmarks, among: np.ndarray, rows: np.ndarray, y: np.ndarray, languages: list[str], ridge: float = 1e-3, seed: int = 7) -> Model:
    """Nyström ridge regression from the kernels among the landmarks and of rows with them.

    Sharpness of the probabilities is set on a fifth of the rows that a first fit leaves out.
    """
    w, v = np.linalg.eigh(among.astype(np.float64))
    good = w > w.max() * 1e-7
    root = v[:, good] / np.sqrt(w[good])
    feats = rows @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)

    def solve(some: np.ndarray) -> np.ndarray:
        a = feats[some]
        return np.linalg.solve(a.T @ a + ridge * len(some) * np.eye(a.shape[1]), a.T @ target[some])

    part = np.random.default_rng(seed).permutation(len(y))
    held, rest = part[: len(y) // 5], part[len(y) // 5 :]
    best = (np.inf, 4.0)
    if len(held) and len(languages) > 1:
        f = feats[held] @ solve(rest)
        for s in (1.0, 2.0, 4.0, 6.0, 8.0):
            g = f * s
            loss = float(np.mean(np.log(np.exp(g - g.max(1, keepdims=True)).sum(1)) + g.max(1) - g[np.arange(len(held)), y[held]]))
            best = min(best, (loss, s))
    beta, weight = root @ solve(np.arange(len(y))), marks.weight()
    table = np.stack([np.add.reduceat(beta[marks.owners, k] * weight, marks.starts) for k in range(len(languages))], axis=1)
    return Model(languages, marks.look, table.astype(np.float32), best[1])


def fit(docs: DataFrame, per_language: int = 1000, landmarks: int = 256) -> Model | None:
    """Learns from ``text`` and non-null ``lang``: about per_language rows of each language, chosen by a hash of the id.

    Every language is learned, with two landmarks at least: what reaches the driver are landmark sets and one kernel row
    (a number for each landmark) of each training row. None if there is nothing to learn.
    """
    spark = docs.sparkSession
    rows = doc_rows(docs, "lang").where("lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    shares = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in counts.items()], "lang string, share double")
    ws = Workspace(spark, "langid")
    drawn = rows.join(F.broadcast(shares), "lang").withColumn("draw", F.rand(10)).where("draw < share").select("lang", "text", "draw")
    sample = ws.save(drawn.where(F.col("text").rlike(r"\p{L}")), "sample")

    each = max(2, -(-landmarks // len(counts)))
    first = sample.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("n") <= each)
    sets = [s for r in first.orderBy("lang", "n").select("text").collect() if (s := grams(r["text"])) is not None]
    if not sets:
        return None
    marks = Landmarks(sets)
    sent = spark.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(lang, g) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (g := grams(t.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([sent.value.kernel(g[1]).astype(np.float32).tobytes() for g in got], pa.binary())], names=["lang", "kernel"])

    kernels = ws.save(sample.select("lang", "text").mapInArrow(run, "lang string, kernel binary"), "kernels")
    got = sorted((r["lang"], bytes(r["kernel"])) for r in kernels.toLocalIterator())
    languages = sorted({g[0] for g in got})
    among = np.stack([marks.kernel(s) for s in sets])
    x = np.frombuffer(b"".join(g[1] for g in got), np.float32).reshape(len(got), -1).astype(np.float64)
    return fit_kernel(marks, among, x, np.array([languages.index(g[0]) for g in got]), languages)


def predict(docs: DataFrame, model: Model | None, batch_rows: int = 64, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, then a language (string) and its score (double) by ``names`` (columns of those names are replaced).

    ``und`` with score 0: the text is null, empty, has no letter, or the model is None. Repeated
    rows get the same answer; null ids do no harm; an empty table stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*names)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                sets = [grams(t.as_py()) if m else None for t in part.column(at)]
                lang, score = ["und"] * len(sets), [0.0] * len(sets)
                has = [i for i, s in enumerate(sets) if s is not None]
                if has:
                    p = m.scores([sets[i] for i in has])
                    for i, row in zip(has, p, strict=True):
                        k = int(row.argmax())
                        lang[i], score[i] = m.languages[k], float(row[k])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, *names])

    return map_rows(docs, run, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()))


def held_out(folds: int = 5):
    """True for the fold that no model learns from: crc32 of the id as text, remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
