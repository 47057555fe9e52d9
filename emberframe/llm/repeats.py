"""Exact repeated byte strings across a corpus by prefix-free parsing.

A rolling hash over WINDOW bytes sets triggers (its local minima), and the triggers cut every text into phrases that
are the same wherever the same bytes stand. As in prefix-free parsing, a string that starts inside a
phrase is given by the rest of that phrase (a dictionary suffix) and by the parse from the next trigger on (a parse suffix).

1. inner keys: a hash of the INNER bytes behind every trigger. A string that holds a trigger whose inner key
   is unique in the corpus is unique. That settles all text that repeats nothing; equal hashes of different bytes only leave
   more to do.
2. classes: for the triggers left, a 128-bit BLAKE2 digest of the phrase suffix in front and all bytes that the trigger's strings reach.
   A class that stands in two places settles all strings that begin in it: they repeat.
3. suffix arrays: only where an inner key has several classes (the ends of repeated passages, edits in near copies) does every string
   count. One representative of each class gives its bytes. The representatives of an inner key are sorted by the bytes from the
   trigger on (the parse's suffix array) and by the bytes in front of it read backwards (the dictionary's), each with the lengths of the
   common prefixes of neighbours. For every length of the part in front, a string is a pair of intervals of equal prefix in the two arrays;
   equal pairs are equal strings, compared on their bytes.

Two kinds of strings are counted by 128-bit MD5 digests instead: those without a trigger in their first ``length - INNER`` bytes (text of one
letter, say), and those of an inner key with very many classes, which is dealt out in parts: each part gives its strings, once if they
repeat within it. Digests are counted with partial sums and joined back as tables that Spark can split, so a passage in a third of all documents
stays spread. Text is shuffled compressed, twice.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.workspace import Workspace, doc_rows, partitions, row_key

WINDOW, RADIUS = 16, 28  # a trigger is a least rolling hash among the RADIUS on either side
PART = 4096  # representatives of an inner key that are compared at once
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.array([(i + 1) * 0xD1B54A32D192ED03 % (1 << 64) ^ (i + 1) ** 9 % (1 << 64) for i in range(256)], np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64, kept and doubled as needed."""
    p = _POWERS.get(base)
    if p is None:
        p = np.ones(1, np.uint64)
    while len(p) < n:
        step = np.uint64(pow(base, len(p), 1 << 64))
        p = np.concatenate([p, p * step])
    _POWERS[base] = p
    return p[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


@dataclass
class Parse:
    """One text: prefix sums of its polynomial hash, and its triggers."""

    length: int  # of the strings looked for
    n: int
    sums: np.ndarray
    inverse: np.ndarray
    triggers: np.ndarray

    @property
    def inner(self) -> int:
        return self.length * 12 // 25

    @property
    def reach(self) -> int:
        """How far from a string's start its first trigger may stand for the trigger to own the string."""
        return self.length - self.inner

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fingerprints of bytes a to b."""
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def first_owned(self) -> np.ndarray:
        """The first string start that each trigger owns; the last is the trigger itself."""
        before = np.concatenate([[-1], self.triggers[:-1]])
        return np.maximum(before + 1, self.triggers - self.reach)

    def inner_keys(self) -> np.ndarray:
        return self.keys(self.triggers, self.triggers + self.inner)

    def strings(self) -> int:
        return max(0, self.n - self.length + 1)

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """For every string the index of its first trigger and of the one behind its last trigger; equal if it has none."""
        at = np.arange(self.strings())
        return np.searchsorted(self.triggers, at), np.searchsorted(self.triggers, at + self.reach, side="right")


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def parse(data: bytes, length: int) -> Parse:
    """The parse of a text; a text shorter than ``length`` has no triggers.

    A trigger stands at the first byte that its choice depends on.
    """
    n = len(data)
    if n < length:
        return Parse(length, n, np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.int64))
    values = _BYTES[np.frombuffer(data, np.uint8)] * _powers(_BASE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    out = Parse(length, n, sums, _powers(_INVERSE, n + 1), np.zeros(0, np.int64))
    rolling = (sums[WINDOW:] - sums[:-WINDOW]) * out.inverse[: n - WINDOW + 1]
    rolling = (rolling ^ (rolling >> np.uint64(31))) * np.uint64(0xCA5A826395121157)
    least = _least(rolling, 2 * RADIUS + 1) == rolling[RADIUS : len(rolling) - RADIUS]
    out.triggers = np.flatnonzero(least[: n - out.inner + 1])
    return out


def parses(data: bytes, length: int, core: int = 1 << 20) -> Iterator[tuple[int, int, int, Parse]]:
    """Parses of a text's stretches, so that memory does not follow its length: where the stretch begins,
    the part of it (from, to) that is its own, and its parse. Margins hold all that an own trigger or string
    depends on, and keys do not depend on where a stretch begins."""
    n = len(data)
    for low in range(0, n if n >= length else 0, core):
        high = min(low + core, n)
        begin = max(0, low - 2 * length)
        yield begin, low - begin, high - begin, parse(data[begin : min(n, high + 3 * length)], length)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _batch(names: str, *columns: list[np.ndarray]) -> pa.RecordBatch:
    cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([_signed(c) if c.dtype == np.uint64 else pa.array(c.astype(np.int64)) for c in cols], names=names.split())


def _text_bytes(value) -> bytes:
    """UTF-8 of an Arrow string without decoding it; null: empty."""
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _digests(data: bytes, starts: list[int], ends: list[int], kind=hashlib.md5) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of data's pieces as two columns."""
    raw = b"".join(kind(data[a:b]).digest() for a, b in zip(starts, ends, strict=True))
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _blake(data: bytes):
    return hashlib.blake2b(data, digest_size=16)


def _class_digests(p: Parse, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of all bytes that the strings of each trigger reach."""
    return _digests(data, p.first_owned().tolist(), np.minimum(p.triggers + p.length, p.n).tolist(), _blake)


def _parses(docs: DataFrame, length: int, schema: str, rows):
    """rows(parse, its bytes) -> columns by trigger, put before the text's key ``k``; the column ``b`` holds places."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _text_bytes(text)
                for begin, low, high, p in parses(data, length):
                    own = (p.triggers >= low) & (p.triggers < high)
                    if own.any():
                        got = [v[own] + begin if name == "b" else v[own] for name, v in zip(names, rows(p, data[begin : begin + p.n]), strict=False)]
                        for c, v in zip(columns, [*got, np.full(len(got[0]), k, np.int64)], strict=True):
                            c.append(v)
            yield _batch(" ".join(names), *columns)

    return doc_rows(docs).select(row_key().alias("k"), "text").mapInArrow(run, schema)


def _settled(p: Parse, low: int, high: int, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the flags of the triggers (0: unique, else bit 1: seen, bit 2: repeats, bit 4: gives its bytes):
    starts from low to high known to repeat, and starts without a trigger."""
    first, end = p.owners()
    none = first == end
    unique = np.concatenate([[0], np.cumsum(flags == 0)])
    open_ = ~none & (unique[end] == unique[first])
    own = flags[np.minimum(first, max(0, len(flags) - 1))] if len(flags) else np.zeros(len(first), np.int64)
    part = np.arange(len(first))
    part = (part >= low) & (part < high)
    return np.flatnonzero(part & open_ & (own & 2 > 0)), np.flatnonzero(part & none)


def _intervals(sorted_rows: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of bytes with the row before; -1 where a group begins."""
    out = np.full(len(group), -1)
    if len(group) > 1:
        differ = sorted_rows[1:] != sorted_rows[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), sorted_rows.shape[1])
        out[1:] = np.where(group[1:] == group[:-1], np.minimum(same, np.minimum(lengths[1:], lengths[:-1])), -1)
    return out


def _padded(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width), np.array([len(r) for r in rows])


def repeated_starts(group: np.ndarray, back: list[bytes], ahead: list[bytes], weight: np.ndarray, length: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Of representatives and of every number a of bytes in front (representative, a): strings that stand twice in their group, and
    strings that stand once. A string is the last a bytes of ``back`` and the first length - a of ``ahead``; a weight of 2 is two places.
    """
    n, reach = len(group), length - inner
    mirrored = [x[::-1] for x in back]
    order_b = sorted(range(n), key=lambda i: (group[i], mirrored[i]))
    order_a = sorted(range(n), key=lambda i: (group[i], ahead[i]))
    (rows_b, size_b), (rows_a, size_a) = _padded([mirrored[i] for i in order_b], reach), _padded([ahead[i] for i in order_a], length)
    common_b, common_a = _intervals(rows_b, size_b, group[order_b]), _intervals(rows_a, size_a, group[order_a])
    have_b, have_a = np.array([len(x) for x in back]), np.array([len(x) for x in ahead])
    at_b, at_a = np.empty(n, np.int64), np.empty(n, np.int64)
    again, alone = [], []
    for a in range(reach + 1):
        at_b[order_b] = np.cumsum(common_b < a)
        at_a[order_a] = np.cumsum(common_a < length - a)
        there = np.flatnonzero((have_b >= a) & (have_a >= length - a))
        if not len(there):
            continue
        _, which = np.unique(at_b[there] * (n + 1) + at_a[there], return_inverse=True)
        twice = np.bincount(which, weight[there])[which] > 1
        again.append(np.stack([there[twice], np.full(twice.sum(), a)]))
        alone.append(np.stack([there[~twice], np.full((~twice).sum(), a)]))
    none = np.zeros((2, 0), np.int64)
    return np.concatenate([none, *again], axis=1), np.concatenate([none, *alone], axis=1)


def _flags(p: Parse, begin: int, packed: np.ndarray) -> np.ndarray:
    """Flags of a stretch's triggers from place * 8 + flag of the whole text."""
    out = np.zeros(len(p.triggers), np.int64)
    place = (packed >> 3) - begin
    inside = np.isin(place, p.triggers)
    np.bitwise_or.at(out, np.searchsorted(p.triggers, place[inside]), packed[inside] & 7)
    return out


def _longs(value) -> np.ndarray:
    """An Arrow list (or null) as an array."""
    return np.asarray(value.values, np.int64) if value.is_valid else np.zeros(0, np.int64)


def _compressed(docs: DataFrame) -> DataFrame:
    """doc_id, k, and the text's bytes compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([pack.compress(_text_bytes(t)) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], names=["doc_id", "k", "z"])

    return doc_rows(docs).select("doc_id", row_key().alias("k"), "text").mapInArrow(run, "doc_id long, k long, z binary")


def _unpack(z) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z.as_py())


def _settle(ws: Workspace, df: DataFrame, name: str) -> DataFrame:
    """Saves df; then lets Spark delete the shuffle files behind it, which the table replaces."""
    out = ws.save(df, name)
    del df
    gc.collect()
    ws.spark._jvm.System.gc()
    return out


def repeated(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (array of start and end of removed runs), kept (the other bytes).

    Removed is each byte covered by a ``length``-byte string of the text's UTF-8 that also starts
    anywhere else in the table, the same document included; overlaps count, and nothing crosses
    documents. Null texts are empty: no bytes, no spans. Shorter texts keep everything. Rows that
    repeat an id are documents of their own, and rows that are equal in id and text repeat each
    other. Null ids stay null, extra columns are ignored, an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "repeats")
    inner = _parses(docs, length, "h long, k long", lambda p, _: (p.inner_keys(),)).select("h")
    twice = _settle(ws, inner.groupBy("h").count().where("count > 1").select("h"), "twice")
    places = _parses(docs, length, "h long, e long, f long, b long, k long", lambda p, data: (p.inner_keys(), *_class_digests(p, data), p.triggers))
    seen = _settle(ws, places.join(twice, "h", "left_semi"), "seen")

    classes = _settle(ws, seen.groupBy("h", "e", "f").agg(F.count("*").alias("c"), F.min(F.struct("k", "b")).alias("one")), "classes")
    several = classes.groupBy("h").count().where("count > 1").select("h", F.lit(4).alias("several"), F.ceil(F.col("count") / PART).cast("long").alias("parts"))
    classes = _settle(ws, classes.join(several.drop("parts"), "h", "left").select("h", "e", "f", "c", "one", F.coalesce("several", F.lit(0)).alias("several")), "classes2")
    write = (F.col("c") == 1) | ((F.col("k") == F.col("one.k")) & (F.col("b") == F.col("one.b")))
    packed = F.shiftleft("b", 3) + 1 + F.when(F.col("c") > 1, 2).otherwise(0) + F.when(write, F.col("several")).otherwise(0)
    flags = _settle(ws, seen.join(classes, ["h", "e", "f"]).select("k", packed.cast("long").alias("v")), "flags")
    large = _settle(ws, several.where("parts > 1").select("h", "parts"), "large")
    ws.drop("seen", "twice", "classes", "classes2")
    by_doc = _settle(ws, flags.groupBy("k").agg(F.collect_set("v").alias("flags")), "by_doc")
    ws.drop("flags")

    gives = "h long, g long, w long, k long, s long, back binary, ahead binary"
    names = ["h", "g", "w", "k", "s", "back", "ahead"]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Representatives (trigger ``s``), and strings without a trigger: their digest (h, g) and no bytes."""
        for batch in batches:
            rows: list[tuple] = []
            for k, z, fl in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                packed, data = _longs(fl), _unpack(z)
                for begin, low, high, p in parses(data, length):
                    flags, text = _flags(p, begin, packed), data[begin : begin + p.n]
                    for i in np.flatnonzero((flags & 4 > 0) & (p.triggers >= low) & (p.triggers < high)).tolist():
                        t, first = int(p.triggers[i]), int(p.first_owned()[i])
                        key = int(p.keys(p.triggers[i : i + 1], p.triggers[i : i + 1] + p.inner).view(np.int64)[0])
                        rows.append((key, 0, 2 if flags[i] & 2 else 1, k, t + begin, text[first:t], text[t : t + length]))
                    loose = _settled(p, low, high, flags)[1].tolist()
                    if loose:
                        x, y = _digests(text, loose, [s + length for s in loose])
                        rows += [(h, g, 1, k, s + begin, None, None) for h, g, s in zip(x.view(np.int64).tolist(), y.view(np.int64).tolist(), loose, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.binary()] * 2, strict=True)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of representatives sorted by inner key and part: repeated strings (h null), and of a part of several all strings by digest,
        those that repeat in it once with a weight of 2: another part may hold them once more."""
        held: list[tuple] = []

        def strings(rows: list[tuple], at: np.ndarray) -> np.ndarray:
            raw = (hashlib.md5(rows[i][6][len(rows[i][6]) - a :] + rows[i][7][: length - a]).digest() for i, a in at.T.tolist())
            return np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            group = np.cumsum([0] + [a[:2] != b[:2] for a, b in zip(rows, rows[1:], strict=False)])
            weight, parts = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
            again, alone = repeated_starts(group, [r[6] for r in rows], [r[7] for r in rows], weight, length, length * 12 // 25)
            known, twice, once = again[:, weight[again[0]] == 1], again[:, parts[again[0]] > 1], alone[:, parts[alone[0]] > 1]
            first = np.unique(strings(rows, twice), axis=0, return_index=True)[1]  # other parts need to hear of a string once
            twice = twice[:, first]
            hashes = strings(rows, np.concatenate([twice, once], axis=1))
            i, a = np.concatenate([known, twice, once], axis=1)
            w = np.repeat([2, 2, 1], [known.shape[1], twice.shape[1], once.shape[1]])
            null = np.arange(len(i)) < known.shape[1]
            h, g = np.concatenate([np.zeros((known.shape[1], 2), np.int64), hashes]).T
            k, t = np.array([r[4] for r in rows], np.int64)[i], np.array([r[5] for r in rows], np.int64)[i]
            return pa.RecordBatch.from_arrays([pa.array(h, mask=null), pa.array(g, mask=null), pa.array(w), pa.array(k), pa.array(t - a)], names=["h", "g", "w", "k", "s"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= PART and row[:2] != held[-1][:2]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    texts = _compressed(docs).join(by_doc, "k", "left")
    given = _settle(ws, texts.select("k", "z", "flags").mapInArrow(give, gives), "given")
    ours = given.where("ahead is not null").join(large, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    ours = ours.select("h", F.pmod(F.xxhash64("k", "s"), F.col("parts")).alias("part"), "parts", "w", "k", "s", "back", "ahead")
    met = ours.repartition(partitions(ws.spark), "h", "part").sortWithinPartitions("h", "part").mapInArrow(meet, "h long, g long, w long, k long, s long")
    met = _settle(ws, met, "met")
    loose = given.where("ahead is null").select("h", "g", "w", "k", "s").unionByName(met.where("h is not null"))
    again = _settle(ws, loose.groupBy("h", "g").agg(F.sum("w").alias("w")).where("w > 1").select("h", "g"), "again")
    found = met.where("h is null").select("k", "s").unionByName(loose.where("w = 1").join(again, ["h", "g"], "left_semi").select("k", "s"))
    hits = found.groupBy("k").agg(F.collect_set("s").alias("hits"))
    hits = _settle(ws, by_doc.join(hits, "k", "full"), "hits")
    ws.drop("given", "met", "again", "by_doc", "large")

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for z, fl, hit in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = _unpack(z)
                sizes.append(len(data))
                if not fl.is_valid and not hit.is_valid:
                    spans.append([])
                    kept.append(data)
                    continue
                packed = _longs(fl)
                known = [_settled(p, low, high, _flags(p, begin, packed))[0] + begin for begin, low, high, p in parses(data, length)]
                starts = np.unique(np.concatenate([*known, _longs(hit)]))
                edge = np.zeros(len(data) + 1, np.int8)
                edge[starts] += 1
                edge[starts + length] -= 1
                covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
                kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    texts = _compressed(docs).join(hits, "k", "left").select("doc_id", "z", "flags", "hits")
    return texts.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
