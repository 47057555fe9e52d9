"""Cross-entropy difference of two matched bigram models with exact counts.

Target: documents whose label says so; background: all others. Both models share one vocabulary, all
words of the table. A word w behind v has the probability

    p(w | v) = (c(v w) + PRIOR * u(w)) / (c(v) + PRIOR),    u(w) = (c(w) + ALPHA) / (N + ALPHA * (V + 1))

with counts of one model, N its words and V the vocabulary (one place is left for unseen words). The larger model's counts are
scaled to the smaller one's amount of words, so that the two are matched. A document's own counts are left out of its model, so
no document is judged by a model that has read it.

Nothing is hashed into slots: every word and every pair of words has a 64-bit id, and its counts are
summed over the whole table. Documents are dealt to blocks of about ``block_bytes``; a block sends each of
its different ids once, with its counts, to the slice of the id space that it falls into, and gets the totals back
in the same order. A frequent pair so costs a block one number, what a task holds is
bounded by a block or a slice, and the number of both grows with the corpus. Ids travel as sorted differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.workspace import Workspace, doc_rows, partitions, row_key

PRIOR, ALPHA = 1.0, 0.5
START = np.uint64(2)  # stands in front of the first word
_TOTALS, _MARK, _DOC = 0, 1, 2
_IDS: dict[str, int] = {}
_SENT = "block long, kind int, k long, doc_id long, z binary"


def word_ids(text: str) -> np.ndarray:
    """Even 64-bit ids of the words: lower-cased, split at white space."""
    if len(_IDS) > 150_000:
        _IDS.clear()
    known, digest, out = _IDS, xxhash.xxh64_intdigest, []
    for w in text.lower().split():
        s = known.get(w)
        if s is None:
            s = known[w] = digest(w.encode("utf-8", "surrogatepass"), 9) & ~1
        out.append(s)
    return np.array(out, np.uint64)


def pair_ids(front: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Odd 64-bit ids of pairs of words."""
    h = (front * np.uint64(0x9E3779B97F4A7C15)) ^ (front >> np.uint64(29))
    h = (h + word) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xCA5A826395121157)
    return (h ^ (h >> np.uint64(29))) | np.uint64(1)


def _squeeze(x: np.ndarray) -> bytes:
    """Unsigned numbers by byte plane, compressed: planes of zeros cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _spread(z: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Block:
    """The documents of a block: their words, and the block's different ids in order."""

    def __init__(self, texts: list[str], target: np.ndarray):
        words = [word_ids(t) for t in texts]
        self.n = np.array([len(w) for w in words], np.int64)
        self.target = target
        word = np.concatenate([*words, np.zeros(0, np.uint64)])
        front = np.concatenate([*(np.concatenate([[START], w[:-1]]) for w in words if len(w)), np.zeros(0, np.uint64)]).astype(np.uint64)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.first = front == START
        self.ids, back = np.unique(np.concatenate([front, word, pair_ids(front, word)]), return_inverse=True)
        self.front, self.word, self.pair = np.split(back, 3)

    def counts(self) -> np.ndarray:
        """Counts of every id in (background, target); the mark in front of a text counts for each text that has words."""
        out = np.zeros((2, len(self.ids)), np.int64)
        for part, of in ((self.front[self.first], self.doc[self.first]), (self.word, self.doc), (self.pair, self.doc)):
            for side in (0, 1):
                out[side] += np.bincount(part[self.target[of] == side], minlength=len(self.ids))
        return out

    def own(self, key: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """How often each document holds the id ``key[i]`` itself."""
        at = self.doc * len(self.ids)
        have = at + (self.word if of is None else of)
        kinds, n = np.unique(have, return_counts=True)
        where = np.searchsorted(kinds, at + key)
        where[where == len(kinds)] = 0
        return np.where(kinds[where] == at + key, n[where], 0) if len(kinds) else np.zeros(len(key), np.int64)

    def losses(self, totals: np.ndarray, amount: np.ndarray, vocabulary: int) -> np.ndarray:
        """Summed loss of every document under (background, target)."""
        own_front = np.where(self.first, 1, self.own(self.front))
        own_word, own_pair = self.own(self.word), self.own(self.pair, self.pair)
        least = min(amount) or max(amount)
        out = np.zeros((2, len(self.n)))
        for side in (0, 1):
            mine = self.target[self.doc] == side
            scale = min(1.0, least / amount[side]) if amount[side] else 1.0
            c_pair, c_front, c_word = (scale * (totals[side][at] - mine * own) for at, own in ((self.pair, own_pair), (self.front, own_front), (self.word, own_word)))
            words = scale * (amount[side] - mine * self.n[self.doc])
            seen = (c_word + ALPHA) / (words + ALPHA * (vocabulary + 1))
            out[side] = np.bincount(self.doc, -np.log((c_pair + PRIOR * seen) / (c_front + PRIOR)), len(self.n))
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list]]]:
    """Rows sorted by block, gathered: block, rows (k, doc_id, z) by kind."""
    now, rows = None, {}
    for batch in batches:
        for block, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now:
                if now is not None:
                    yield now, rows
                now, rows = block, {_TOTALS: [], _MARK: [], _DOC: []}
            rows[kind].append(row)
    if now is not None:
        yield now, rows


def _open(rows: dict[int, list]) -> Block:
    marked, unpack = {k for k, _, _ in rows[_MARK]}, zstandard.ZstdDecompressor()
    texts = [unpack.decompress(z).decode("utf-8", "surrogatepass") for _, _, z in rows[_DOC]]
    return Block(texts, np.array([k in marked for k, _, _ in rows[_DOC]], np.int64))


def score(docs: DataFrame, target_ids: DataFrame, block_bytes: int = 4_000_000) -> DataFrame:
    """One row per document: doc_id, in_target, n_tokens, target_loss and background_loss (per token, nats), ce_difference.

    Low differences are close to the target. Null, empty and blank texts have no token: losses and
    difference are null. target_ids: a column doc_id; null and repeated ids there do no harm. Rows that
    repeat an id are scored each, and each leaves out its own counts only. An empty table gives no rows; without target documents
    every word is new to that model. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lmscore")
    total = doc_rows(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    slices = 1 << max(10, (total // 48_000_000).bit_length())  # a slice holds the ids of about 48 MB of text at most
    shift = np.uint64(64 - slices.bit_length() + 1)
    block = F.pmod("k", F.lit(blocks)).alias("block")

    # labels grow with the corpus: the same merge join at every size, never a broadcast that a larger input outgrows
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().hint("merge")
    keys = doc_rows(docs).select("doc_id", row_key().alias("k")).where("doc_id is not null")
    marks = ws.save(keys.join(wanted, "doc_id", "left_semi").select("k").distinct().select(block, F.lit(_MARK).alias("kind"), "k", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("z")), "marks")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [z.compress(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_DOC] * batch.num_rows, pa.int32()), batch.column(1), batch.column(2), pa.array(texts, pa.binary())], names=["block", "kind", "k", "doc_id", "z"])

    def dealt(*more: DataFrame) -> DataFrame:
        rows = doc_rows(docs).withColumn("k", row_key()).select(block, "k", "doc_id", "text").mapInArrow(pack, _SENT)
        for m in more:
            rows = rows.unionByName(m)
        return rows.repartition(partitions(spark), "block").sortWithinPartitions("block", "kind", "k")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _groups(batches):
            found = _open(rows)
            if not len(found.ids):
                continue
            counts, of = found.counts(), (found.ids >> shift).astype(np.int64)
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            ends = np.append(starts[1:], len(of))
            ids = [_squeeze(np.diff(found.ids[i:j], prepend=np.uint64(0))) for i, j in zip(starts, ends, strict=True)]
            sums = [_squeeze(counts[:, i:j].ravel()) for i, j in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(of[starts]), pa.array([b] * len(starts), pa.int64()), pa.array(ids, pa.binary()), pa.array(sums, pa.binary())], names=["slice", "block", "ids", "counts"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(_spread(z), dtype=np.uint64) for z in table["ids"].to_pylist()]
        ids, back = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.concatenate([_spread(z).reshape(2, -1) for z in table["counts"].to_pylist()], axis=1)
        totals = np.stack([np.bincount(back, c, len(ids)) for c in counts])
        word = (ids & np.uint64(1) == 0) & (ids != START)
        sums = np.array([word.sum(), *totals[:, word].sum(1)])
        ends = np.cumsum([len(p) for p in parts])
        answers = [_squeeze(totals[:, back[e - len(p) : e]].ravel()) for e, p in zip(ends, parts, strict=True)]
        n, at = len(parts) + 1, table["slice"][0].as_py()
        return pa.table({
            "block": pa.array([*table["block"].to_pylist(), -1], pa.int64()), "kind": pa.array([_TOTALS] * n, pa.int32()), "k": pa.array([at] * n, pa.int64()),
            "doc_id": pa.nulls(n, pa.int64()), "z": pa.array([*answers, _squeeze(sums)], pa.binary()),
        })

    sent = dealt(marks).mapInArrow(gather, "slice long, block long, ids binary, counts binary")
    totals = ws.save(sent.groupBy("slice").applyInArrow(add, _SENT), "totals")
    # three numbers of each slice
    sums = [_spread(bytes(r["z"])) for r in totals.where("block = -1").select("z").toLocalIterator()]
    vocabulary, *amount = (int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            found = _open(rows)
            got = [_spread(z).reshape(2, -1) for _, _, z in sorted(rows[_TOTALS], key=lambda r: r[0])]
            loss = found.losses(np.concatenate(got, axis=1) if got else np.zeros((2, 0)), np.array(amount), vocabulary)
            ids, n, empty = [d for _, d, _ in rows[_DOC]], found.n, found.n == 0
            b, t = loss / np.maximum(n, 1)
            kinds = [pa.array(x, pa.float64(), mask=empty) for x in (t, b, t - b)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found.target == 1), pa.array(n), *kinds], names=["doc_id", "in_target", "n_tokens", "target_loss", "background_loss", "ce_difference"])

    schema = "doc_id long, in_target boolean, n_tokens long, target_loss double, background_loss double, ce_difference double"
    return dealt(marks, totals.where("block >= 0")).mapInArrow(run, schema)
