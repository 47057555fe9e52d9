"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece of length n belongs to class k = capacity // n (lengths in (C/(k+1), C/k]), and a bin of
class k takes exactly k pieces. Since documents may be cut, a document's tail is cut at the upper
ends C/1, C/2, ... C/min_class of the classes, where k pieces fill a bin almost to the last token.
Classes do not look at each other and partitions do not talk to each other: one map over the input,
no shuffle, and each worker holds fewer than k open pieces of each class.

What is left in open bins when a partition ends (less than one bin a class) is laid end to end and
cut anew at the capacity; the very last rest is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberframe.llm.workspace import doc_rows, ship

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_LOADED: dict = {}


def encoder(path: str):
    """text -> list of ids, as ``tokenizers`` gives them for ``path`` without special tokens.

    Where the same vocabulary lies beside it as ranks (.tiktoken), ordinary texts go through the
    faster byte-pair code; the tests hold both to the same ids. A text that spells a special token
    always takes ``tokenizers``, which is loaded for the first such text.
    """
    if path not in _LOADED:
        import base64
        import json
        import os

        def plain(text: str) -> list[int]:
            if (path, "plain") not in _LOADED:
                from tokenizers import Tokenizer

                _LOADED[path, "plain"] = Tokenizer.from_file(path)
            return _LOADED[path, "plain"].encode(text, add_special_tokens=False).ids

        ranks_file = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_file):
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            with open(path, encoding="utf-8") as f:
                special = [x["content"] for x in json.load(f).get("added_tokens", [])]
            _LOADED[path] = lambda text: plain(text) if any(s in text for s in special) else fast.encode_ordinary(text)
        else:
            _LOADED[path] = plain
    return _LOADED[path]


def cuts(n: int, capacity: int, min_piece: int) -> list[int]:
    """Piece lengths for n tokens: whole sequences, then the largest class end that fits, and so on.

    A rest stays whole once it is short (min_piece) or its class's bins waste no more than 1/64.
    """
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r > min_piece and capacity % r > capacity // 64:
        out.append(capacity // -(-capacity // r))  # the largest capacity // k that is at most r
        r -= out[-1]
    return [*out, r] if r else out


class Packer:
    """One partition's open bins."""

    def __init__(self, part: int, capacity: int, min_piece: int):
        self.capacity, self.min_piece, self.next = capacity, min_piece, part << 32
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        for n in cuts(len(ids), self.capacity, self.min_piece):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[start : start + n], len(ids)))
            start += n
            if len(bin_) == k:
                self.close(self.open.pop(k))

    def finish(self) -> None:
        """Lays the open bins' pieces end to end; piece ends stay wherever a cut is not needed."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        rest.reverse()
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            room, pieces = size, []
            while room:
                doc, start, ids, total = rest.pop()
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                pieces.append((doc, start, ids, total))
                room -= len(ids)
            self.close(pieces)
            left -= size

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * 7, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, min_piece: int = 64) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and then ``end_id``. Null and empty texts are ``end_id`` alone. Rows that
    repeat an id are packed as documents of their own; a null doc_id stays null. An empty table
    gives no rows. Further columns are ignored. Texts of any length are tokenised whole.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, encode = TaskContext.get(), encoder(tokenizer)
        packer = Packer(context.partitionId() if context else 0, capacity, min_piece)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = encode(text.as_py() or "")
                ids = np.empty(len(got) + 1, np.uint32)
                ids[:-1] = got
                ids[-1] = end_id
                packer.add(doc, ids)
                if len(packer.rows) >= 4000:
                    yield packer.take()
        packer.finish()
        if packer.rows:
            yield packer.take()

    return doc_rows(docs).mapInArrow(run, SCHEMA)
