"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is 128 bits of the line, stripped and lower-cased. Per key the exact table holds how many documents
have it (refs) and the largest id among them (last); a log of (key, document, +1 or -1) is what both follow from. A key with
``min_docs`` references or more is repeated; each shard keeps its repeated keys in a cuckoo filter. Inserting
documents adds to the log and the counts, and puts the keys that become repeated into the filters; removing documents subtracts,
finds the next largest holder where the largest has gone, and takes the keys that are no longer repeated out again. So any
order of insertions and removals leaves the same decisions as the documents that remain.

To clean documents, their lines' keys probe the filter of their shard; only keys that hit it are looked up in the exact table, so
a filter's false positives cost a look-up and change nothing. Keys that more than one in HOT of all references belong to (HOT at most) skip the
shards and meet a broadcast table, so no shard or join key holds more than that share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm.workspace import Workspace, partitions

BLANKS = " \t\n\v\f\r"
HOT = 8192
SLOTS, LOAD, KICKS = 4, 0.85, 500


class CuckooFilter:
    """Approximate set of 64-bit hashes with deletion: 16-bit fingerprints in buckets of four, each in one of two buckets.

    Never denies a member; claims one in some 8,000 others. Keys are added, removed and probed by the array. Marks that
    find no slot after KICKS rounds stand in a stash, so that adding never fails.
    """

    def __init__(self, table: np.ndarray, stash: np.ndarray | None = None):
        self.table, self.stash = table, np.zeros(0, np.int64) if stash is None else stash

    @staticmethod
    def sized(n: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n) / (SLOTS * LOAD)))))
        return CuckooFilter(np.zeros((buckets, SLOTS), np.uint16))

    @staticmethod
    def read(data: bytes) -> CuckooFilter:
        buckets = int.from_bytes(data[:8], "little")
        table = np.frombuffer(data, "<u2", buckets * SLOTS, 8).astype(np.uint16).reshape(-1, SLOTS)
        return CuckooFilter(table, np.frombuffer(data, "<i8", offset=8 + 2 * buckets * SLOTS).astype(np.int64))

    def dump(self) -> bytes:
        return len(self.table).to_bytes(8, "little") + self.table.astype("<u2").tobytes() + self.stash.astype("<i8").tobytes()

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        mixed = (mark.astype(np.uint64) * np.uint64(0x5BD1E995) ^ (mark.astype(np.uint64) << np.uint64(7))).astype(np.int64)
        return bucket ^ (mixed & (len(self.table) - 1))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64)
        mark = np.maximum(h & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        return ((h >> np.uint64(16)) & np.uint64(len(self.table) - 1)).astype(np.int64), mark

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        bucket, mark = self._places(hashes)
        found = ((self.table[bucket] == mark[:, None]) | (self.table[self._other(bucket, mark)] == mark[:, None])).any(axis=1)
        return found | np.isin(self._code(bucket, mark), self.stash) if len(self.stash) else found

    def _code(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Names a mark in either of its buckets."""
        return np.minimum(bucket, self._other(bucket, mark)) << 16 | mark

    def _settle(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts marks into free slots of their buckets; which found none."""
        order = np.argsort(bucket, kind="stable")
        own = bucket[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        free = self.table[own] == 0
        fits = rank < free.sum(axis=1)
        slot = (np.cumsum(free, axis=1) == (rank + 1)[:, None]).argmax(axis=1)
        self.table[own[fits], slot[fits]] = mark[order][fits]
        left = np.ones(len(bucket), bool)
        left[order[fits]] = False
        return left

    def add(self, hashes: np.ndarray) -> None:
        bucket, mark = self._places(hashes)
        left = self._settle(bucket, mark)
        bucket, mark = self._other(bucket[left], mark[left]), mark[left]
        for turn in range(KICKS):
            left = self._settle(bucket, mark)
            bucket, mark = bucket[left], mark[left]
            if not len(bucket):
                return
            # one mark a bucket puts another out, which goes to its other bucket; the rest wait
            _, one = np.unique(bucket, return_index=True)
            slot = (mark[one].astype(np.int64) + turn) % SLOTS
            out = self.table[bucket[one], slot]
            self.table[bucket[one], slot] = mark[one]
            bucket[one], mark[one] = self._other(bucket[one], out), out
        self.stash = np.append(self.stash, self._code(bucket, mark))

    def remove(self, hashes: np.ndarray) -> None:
        """Takes one fingerprint of each key out; keys must have been added."""
        bucket, mark = self._places(hashes)
        while len(bucket):
            own = self.table[bucket] == mark[:, None]
            at = np.where(own.any(axis=1), bucket, self._other(bucket, mark))
            own = self.table[at] == mark[:, None]
            if not (held := own.any(axis=1)).all():
                for code in self._code(bucket[~held], mark[~held]).tolist():
                    where = np.flatnonzero(self.stash == code)
                    if not len(where):
                        raise KeyError("a key that is not in the filter")
                    self.stash = np.delete(self.stash, where[0])
                bucket, mark, at, own = bucket[held], mark[held], at[held], own[held]
                continue
            slot = own.argmax(axis=1)
            _, one = np.unique(at * SLOTS + slot, return_index=True)
            self.table[at[one], slot[one]] = 0
            rest = np.ones(len(bucket), bool)
            rest[one] = False
            bucket, mark = bucket[rest], mark[rest]


def line_key(line: str, min_chars: int = 20) -> bytes | None:
    """128 bits of a line without blanks at its ends, A-Z lower-cased; None below ``min_chars`` code points."""
    line = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()) if len(line) >= min_chars else None


def _hashes(keys: pa.Array) -> np.ndarray:
    """The upper 64 bits of 16-byte keys."""
    return np.frombuffer(b"".join(keys.to_pylist()), ">u8")[::2].astype(np.uint64)


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, size, filter, key, step) sorted by shard and step: step 0 is the shard's old filter (null: none) and its number of keys; -1 takes a key out, 1 puts it in."""

    def build(shard, size, old, keys) -> bytes:
        remove, add = (np.concatenate(keys[s]) if keys[s] else np.zeros(0, np.uint64) for s in (-1, 1))
        f = CuckooFilter.read(old) if old else CuckooFilter.sized(size)
        f.remove(remove)
        f.add(add)
        return f.dump()

    now, size, old, keys = None, 0, None, {-1: [], 1: []}
    for batch in batches:
        shard = batch.column(0).to_numpy()
        starts = [*np.flatnonzero(np.diff(shard, prepend=np.nan if len(shard) else [])), len(shard)]
        for i, j in zip(starts, starts[1:], strict=False):
            if shard[i] != now:
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "filter": [build(now, size, old, keys)]})
                now, size, old, keys = shard[i], 0, None, {-1: [], 1: []}
            step = batch.column(4).slice(i, j - i).to_numpy()
            for k in np.flatnonzero(step == 0).tolist():
                size, old = batch.column(1)[i + k].as_py(), batch.column(2)[i + k].as_py()
            for s in (-1, 1):
                at = np.flatnonzero(step == s)
                if len(at):
                    keys[s].append(_hashes(batch.column(3).take(pa.array(at + i))))
    if now is not None:
        yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "filter": [build(now, size, old, keys)]})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, filter, key, ...) sorted by shard with its filter first, those whose key may be in it. A shard without a filter holds nothing."""
    now, held = None, None
    for batch in batches:
        shard = batch.column(0).to_numpy()
        hit = np.zeros(len(shard), bool)
        starts = [*np.flatnonzero(np.diff(shard, prepend=np.nan if len(shard) else [])), len(shard)]
        for i, j in zip(starts, starts[1:], strict=False):
            if shard[i] != now:
                now, held = shard[i], None
            if (data := batch.column(1)[i].as_py()) is not None:
                held, i = CuckooFilter.read(data), i + 1
            if held is not None and j > i:
                hit[i:j] = held.contains(_hashes(batch.column(2).slice(i, j - i)))
        yield pa.RecordBatch.from_arrays(batch.columns[2:], names=batch.schema.names[2:]).filter(pa.array(hit))


class LineIndex:
    """Lines of the documents inserted and not removed since, as tables below the workspace; decisions follow ``min_docs`` and ``min_chars``.

    Documents are rows: a row counts once for each key it holds, and rows that repeat an id count each. A null id sorts below all
    others. ``shards`` defaults to four for each shuffle partition; shards of one filter each never move between them.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 3, min_chars: int = 20, shards: int = 0):
        self.ws = Workspace(spark, "lines")
        self.min_docs, self.min_chars = min_docs, min_chars
        self.shards = shards or 4 * partitions(spark)
        self.version, self.total = 0, 0
        self.logs: list[DataFrame] = []
        self.refs = spark.createDataFrame([], "shard int, key binary, refs long, last long")
        self.filters = spark.createDataFrame([], "shard int, filter binary")

    @staticmethod
    def _rows(docs: DataFrame) -> DataFrame:
        """doc (the id, null as the least), text, and 128 bits that name the row."""
        doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
        return docs.select(doc.alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(12), "text", "doc_id").alias("r2"))

    def keys(self, docs: DataFrame) -> DataFrame:
        """One row (shard, key, doc, r1, r2) for each different key of each document."""
        shards, least = self.shards, self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, at = [], []
                for i, text in enumerate(batch.column(0)):
                    own = {k for line in (text.as_py() or "").split("\n") if (k := line_key(line, least))}
                    found += own
                    at += [i] * len(own)
                # the filter reads the upper half of a key, the shard the lower
                low = np.frombuffer(b"".join(found), ">u8")[1::2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((low % np.uint64(shards)).astype(np.int32)), pa.array(found, pa.binary()), *(c.take(pa.array(at, pa.int64())) for c in batch.columns[1:])], names=["shard", "key", "doc", "r1", "r2"]
                )

        rows = self._rows(docs).select("text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "r1", "r2")
        return rows.mapInArrow(run, "shard int, key binary, doc long, r1 long, r2 long")

    def _hot(self, refs: DataFrame) -> DataFrame:
        """Keys with over one in HOT of all references: fewer than HOT, so they may be broadcast."""
        return refs.where(F.col("refs") > self.total / HOT)

    def _commit(self, refs: DataFrame) -> None:
        """Takes refs (shard, key, refs, last, before: refs before the change) as the exact table and brings the filters up to it."""
        self.version += 1
        many, was = F.col("refs") >= self.min_docs, F.col("before") >= self.min_docs
        new = self.ws.save(refs, f"refs-{self.version}")
        self.total = new.agg(F.sum("refs")).first()[0] or 0
        sizes = new.where(many).groupBy("shard").agg(F.count("*").alias("size"))
        sized = sizes.join(self.filters, "shard", "full").select("shard", F.coalesce("size", F.lit(0)).alias("size"), "filter")
        # a filter without room for the shard's keys is built anew from the exact table
        fits = F.col("size") <= (F.length("filter") - 8) / 2 * LOAD
        sized = self.ws.save(sized.select("shard", "size", F.when(fits, F.col("filter")).alias("filter")), f"sized-{self.version}")
        anew = sized.where("filter is null").select("shard", F.lit(True).alias("anew"))
        steps = new.join(anew, "shard", "left").select("shard", "key", F.when(F.col("anew"), many.cast("int")).otherwise(many.cast("int") - was.cast("int")).alias("step"))
        rows = sized.withColumn("step", F.lit(0)).unionByName(steps.where("step <> 0"), allowMissingColumns=True)
        rows = rows.select("shard", "size", "filter", "key", "step").repartition("shard").sortWithinPartitions("shard", "step")
        self.filters = self.ws.save(rows.mapInArrow(_update, "shard int, filter binary"), f"filters-{self.version}")
        self.ws.drop(f"sized-{self.version}", f"refs-{self.version - 1}", f"filters-{self.version - 1}")
        self.refs = new.where("refs > 0").select("shard", "key", "refs", "last")

    def insert(self, docs: DataFrame) -> None:
        """Counts documents in."""
        log = self.ws.save(self.keys(docs).select("shard", "key", "doc", F.lit(1).alias("step")), f"log-{len(self.logs)}")
        self.logs.append(log)
        more = log.groupBy("shard", "key").agg(F.count("*").alias("refs"), F.max("doc").alias("last"))
        rows = self.refs.withColumn("before", F.col("refs")).unionByName(more.withColumn("before", F.lit(0).cast("long")))
        self._commit(rows.groupBy("shard", "key").agg(*(f(c).alias(c) for f, c in ((F.sum, "refs"), (F.max, "last"), (F.sum, "before")))))

    def remove(self, docs: DataFrame) -> None:
        """Counts documents (rows that were inserted) out again."""
        log = self.ws.save(self.keys(docs).select("shard", "key", "doc", F.lit(-1).alias("step")), f"log-{len(self.logs)}")
        self.logs.append(log)
        less = log.groupBy("shard", "key").agg(F.count("*").alias("less"), F.max("doc").alias("gone"))
        rows = self.refs.join(less, ["shard", "key"], "left").select("shard", "key", "refs", "last", F.coalesce("less", F.lit(0)).alias("less"), "gone")
        rows = self.ws.save(rows, f"less-{len(self.logs)}")
        # the largest holder has gone: the next one stands in the log
        lost = rows.where("gone >= last and refs > less").select("key", "refs")
        every = self.logs[0]
        for log in self.logs[1:]:
            every = every.unionByName(log)
        hot = self._hot(lost).select("key")
        cold = lost.where(F.col("refs") <= self.total / HOT).select("key")
        left = every.join(F.broadcast(hot), "key", "left_semi").unionByName(every.join(cold, "key", "left_semi"))
        left = left.groupBy("key", "doc").agg(F.sum("step").alias("n")).where("n > 0").groupBy("key").agg(F.max("doc").alias("next"))
        rows = rows.join(left, "key", "left").select("shard", "key", (F.col("refs") - F.col("less")).alias("refs"), F.coalesce("next", "last").alias("last"), F.col("refs").alias("before"))
        self._commit(rows)
        self.ws.drop(f"less-{len(self.logs)}")

    def _repeats(self, docs: DataFrame) -> DataFrame:
        """r1, r2 and the array ``drop`` of the keys whose lines a document loses, for documents that lose any."""
        many = self.refs.where(F.col("refs") >= self.min_docs)
        hot = F.broadcast(self._hot(many).select("key", F.col("last").alias("hot_last")))
        rows = self.keys(docs).join(hot, "key", "left")
        gone = rows.where("hot_last <> doc").select("r1", "r2", "key")
        cold = rows.where("hot_last is null").select("shard", F.lit(None).cast("binary").alias("filter"), "key", "doc", "r1", "r2")
        held = self.filters.unionByName(cold, allowMissingColumns=True).select("shard", "filter", "key", "doc", "r1", "r2")
        hits = held.repartition("shard").sortWithinPartitions("shard", F.col("filter").asc_nulls_last()).mapInArrow(_probe, "key binary, doc long, r1 long, r2 long")
        exact = hits.join(many.select("key", "last"), "key").where("doc <> last").select("r1", "r2", "key")
        return gone.unionByName(exact).groupBy("r1", "r2").agg(F.collect_set("key").alias("drop"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """One row per document: doc_id, n_lines, n_dropped and kept, the text without lines whose key is repeated and whose largest holder is another id.

        Null and empty texts are one empty line, which stays. Rows that repeat an id each get a row; other columns are ignored. An
        empty table gives no rows.
        """
        least = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, lost, kept = [], [], []
                for text, drop in zip(batch.column(1), batch.column(2), strict=True):
                    lines = (text.as_py() or "").split("\n")
                    stay = lines
                    if drop.is_valid:
                        gone = set(drop.as_py())
                        stay = [line for line in lines if line_key(line, least) not in gone]
                    n.append(len(lines))
                    lost.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

        # texts too short for a key lose nothing: a number of their own keeps empty ones from meeting in one task
        short: Column = F.coalesce(F.length("text"), F.lit(0)) < least
        rows = self._rows(docs).withColumn("r1", F.when(short, F.monotonically_increasing_id()).otherwise(F.col("r1")))
        rows = rows.withColumn("r2", F.when(short, F.lit(None)).otherwise(F.col("r2")))
        both = rows.join(self._repeats(docs), ["r1", "r2"], "left").select("doc_id", "text", "drop")
        return both.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """The documents of a table without lines that ``min_docs`` of them or more hold, but for the largest id: see ``LineIndex.clean``."""
    index = LineIndex(docs.sparkSession, min_docs, min_chars)
    index.insert(docs)
    return index.clean(docs)
