"""Alignment of two tokenizers over the same bytes, by galloping intersection of their token ends.

A text's tokens under A and under B are two rising lists of byte offsets at which tokens end. The shorter
list drives: each of its offsets is searched in the longer one from a guess, in doubling steps and then by
bisection. Offsets found in both cut the text into groups. The ranks found say besides how the two lists
interleave: between two neighbouring ends of either list lies exactly one pair of overlapping tokens (a link).

How often an id pair is linked in the whole corpus is counted over blocks of documents: a block lists its different
pairs once, Spark adds the lists up by pair, and the totals go back to the blocks that asked. Rows are
blocks x their different pairs, at most the number of links, and no pair has more rows than there are blocks.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.workspace import Workspace, doc_rows

BLOCK_BYTES, CHUNK_BYTES = 16 << 20, 1 << 20
_LOADED: dict = {}


class Tokenizer(NamedTuple):
    """encode gives the ids of a text; pieces are the bytes of every id, one after the other, piece i ending at ends[i]."""

    encode: Callable[[str], np.ndarray]
    pieces: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(encode: Callable[[str], np.ndarray], pieces: list[bytes]) -> Tokenizer:
        return Tokenizer(encode, np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]))

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens, joined, and where each ends."""
        size = self.ends[ids + 1] - self.ends[ids]
        ends = np.cumsum(size)
        return self.pieces[np.repeat(self.ends[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


def byte_values() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: themselves where they print, else those from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE of ``tokenizers``. A space goes before each text; special tokens' strings are plain text.

    Where the vocabulary lies beside it as ranks (.tiktoken), the faster byte-pair code is used; tests hold both to the same ids.
    """
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        value, vocab = byte_values(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for piece, i in vocab.items():
            pieces[i] = piece.encode() if piece in added else bytes(value[c] for c in piece)
        ranks_file = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_file):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = Tokenizer.of(lambda text: np.array(fast.encode_ordinary(" " + text), np.int64), pieces)
        else:
            from tokenizers import Tokenizer as Loaded

            slow = Loaded.from_file(path)
            slow.encode_special_tokens = True
            _LOADED[path] = Tokenizer.of(lambda text: np.array(slow.encode(" " + text, add_special_tokens=False).ids, np.int64), pieces)
    return _LOADED[path]


def sentence_pieces(path: str) -> Tokenizer:
    """A sentencepiece model, which puts a space before each text itself."""
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def spelled(i: int) -> bytes:
            if model.is_byte(i):
                return bytes([int(model.id_to_piece(i)[3:5], 16)])
            return b"" if model.is_unknown(i) or model.is_control(i) else model.id_to_piece(i).replace("▁", " ").encode()

        _LOADED[path] = Tokenizer.of(lambda text: np.array(model.encode(text, num_threads=1), np.int64), [spelled(i) for i in range(model.get_piece_size())])
    return _LOADED[path]


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the rank of the first value in ``long`` that is not smaller; no value exceeds the last of ``long``.

    Each search leaves its guess in doubling steps, towards the value, and then bisects the last step; all searches advance together.
    """
    low, high = guess.copy(), guess.copy()
    behind = long[guess] < short
    low[behind] += 1
    live, step = np.flatnonzero(behind), 1
    while len(live):
        high[live] = np.minimum(guess[live] + step, len(long) - 1)
        live = live[long[high[live]] < short[live]]
        low[live] = high[live] + 1
        step *= 2
    live, step = np.flatnonzero(~behind), 1
    while len(live):
        at = np.maximum(guess[live] - step, 0)
        below = long[at] < short[live]
        low[live] = np.where(below, at + 1, at)
        high[live] = np.where(below, high[live], at)
        live = live[~below & (at > 0)]
        step *= 2
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        below = long[mid] < short[live]
        low[live] = np.where(below, mid + 1, low[live])
        high[live] = np.where(below, high[live], mid)
        live = live[low[live] < high[live]]
    return low


class Aligned(NamedTuple):
    """Tokens of texts that follow each other: whether each ends a group, and the ids of every link with its text's number."""

    a_cut: np.ndarray
    b_cut: np.ndarray
    link_text: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _rests(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... (sizes[k] of them), for one k after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def align_ends(a_ids: np.ndarray, a_ends: np.ndarray, a_sizes: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Aligns texts that follow each other (offsets rise over all of them); sizes are each text's numbers of tokens, above 0."""
    swap = a_sizes > b_sizes  # B drives
    a_from, b_from = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    # the shorter and the longer list of each text, as ranks in A followed by B
    ends, ids = np.concatenate([a_ends, b_ends]), np.concatenate([a_ids, b_ids])
    s_sizes, l_sizes = np.where(swap, b_sizes, a_sizes), np.where(swap, a_sizes, b_sizes)
    s = _rests(np.where(swap, b_from + len(a_ids), a_from), s_sizes)
    l = _rests(np.where(swap, a_from, b_from + len(a_ids)), l_sizes)
    s_from, l_from = np.cumsum(s_sizes) - s_sizes, np.cumsum(l_sizes) - l_sizes
    text = np.repeat(np.arange(len(swap)), s_sizes)
    guess = l_from[text] + (np.arange(len(s)) - s_from[text]) * l_sizes[text] // s_sizes[text]
    rank = gallop(ends[s], ends[l], guess)
    common = ends[l][rank] == ends[s]
    cut = np.zeros(len(ends), bool)
    cut[s[common]] = cut[l[rank[common]]] = True
    # ends of both lists in one order: where each of the shorter list comes, and what is left for the longer one
    place = np.arange(len(s)) + rank - (np.cumsum(common) - common)
    of_s = np.zeros(len(s) + len(l) - int(common.sum()), bool)
    of_s[place] = True
    of_l = ~of_s
    of_l[place[common]] = True
    s_at, l_at = np.cumsum(of_s) - of_s, np.cumsum(of_l) - of_l
    link_text = text[s_at]
    x, y, turned = ids[s[s_at]], ids[l[l_at]], swap[link_text]
    return Aligned(cut[: len(a_ids)], cut[len(a_ids) :], link_text, np.where(turned, y, x), np.where(turned, x, y))


def group_texts(a_ids: np.ndarray, b_ids: np.ndarray, got: Aligned, a_sizes: np.ndarray, b_sizes: np.ndarray) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    a_ends, b_ends = np.flatnonzero(got.a_cut) + 1, np.flatnonzero(got.b_cut) + 1
    a_place = np.arange(len(a_ids)) + np.concatenate([[0], b_ends])[np.cumsum(got.a_cut) - got.a_cut]
    b_place = np.arange(len(b_ids)) + a_ends[np.cumsum(got.b_cut) - got.b_cut]
    ids, mark = np.empty(len(a_ids) + len(b_ids), np.int64), np.empty(len(a_ids) + len(b_ids), np.uint8)
    ids[a_place], ids[b_place] = a_ids, b_ids
    mark[a_place], mark[b_place] = np.where(got.a_cut, ord("|"), ord(",")), np.where(got.b_cut, ord(";"), ord(","))
    width = len(str(int(ids.max(initial=0))))
    tens = 10 ** np.arange(width, dtype=np.int64)
    digits = 1 + (ids[:, None] >= tens[1:]).sum(axis=1)
    at = np.cumsum(digits + 1)  # behind each mark
    out = np.empty(at[-1] if len(at) else 0, np.uint8)
    out[at - 1] = mark
    for k in range(width):
        some = digits > k
        out[at[some] - 2 - k] = 48 + ids[some] // tens[k] % 10
    ends = np.concatenate([[0], at])[np.cumsum(a_sizes + b_sizes)]
    flat = out.tobytes()
    return [flat[i : j - 1] for i, j in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


class Row(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    pairs: np.ndarray
    counts: np.ndarray


_NONE = Row(0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))


def align_texts(texts: list[str | None], a: Tokenizer, b: Tokenizer) -> list[Row]:
    """Tokens, groups and different linked id pairs (a << 32 | b) with their counts, for each text."""
    out, kept, tokens = [_NONE] * len(texts), [], ([], [])
    whole = []
    for i, text in enumerate(texts):
        if text:
            x, y, raw = a.encode(text), b.encode(text), b" " + text.encode("utf-8", "surrogatepass")
            if len(x) and len(y) and all((t.ends[v + 1] - t.ends[v]).sum() == len(raw) for t, v in ((a, x), (b, y))):
                kept.append(i)
                whole.append(raw)
                tokens[0].append(x)
                tokens[1].append(y)
    if not kept:
        return out
    want = np.frombuffer(b"".join(whole), np.uint8)
    limits = np.cumsum([0, *map(len, whole)])
    same = np.ones(len(kept), bool)
    for t, v in zip((a, b), tokens, strict=True):
        wrong = np.flatnonzero(t.spelled(np.concatenate(v))[0] != want)
        same[np.searchsorted(limits, wrong, "right") - 1] = False
    keep = np.flatnonzero(same).tolist()
    if not keep:
        return out
    xs, ys = [tokens[0][k] for k in keep], [tokens[1][k] for k in keep]
    x, y = np.concatenate(xs), np.concatenate(ys)
    x_sizes, y_sizes = np.array([len(v) for v in xs]), np.array([len(v) for v in ys])
    got = align_ends(x, np.cumsum(a.ends[x + 1] - a.ends[x]), x_sizes, y, np.cumsum(b.ends[y + 1] - b.ends[y]), y_sizes)
    groups = group_texts(x, y, got, x_sizes, y_sizes)
    n_groups = np.add.reduceat(got.a_cut, np.cumsum(x_sizes) - x_sizes, dtype=np.int64)
    pair = got.link_a << 32 | got.link_b
    order = np.lexsort((pair, got.link_text))
    pair, text = pair[order], got.link_text[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])]))
    count, pair, text = np.diff(np.append(first, len(pair))), pair[first], text[first]
    at = np.searchsorted(text, np.arange(len(keep) + 1))
    for k, g in enumerate(keep):
        i, j = at[k], at[k + 1]
        out[kept[g]] = Row(len(xs[k]), len(ys[k]), int(n_groups[k]), len(xs[k]) + len(ys[k]) - int(n_groups[k]), groups[k], pair[i:j], count[i:j])
    return out


_COLUMNS = [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.binary()), ("counts", pa.binary())]
_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, counts binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], names=[n for n, _ in _COLUMNS])


def _block_rows(block: int, ids: list, rows: list[Row], digest: bool) -> Iterator[pa.RecordBatch]:
    """A block's documents, whose pairs are ranks among the block's own (as differences), and one row (n_a null) of these pairs with their counts."""
    every = np.concatenate([r.pairs for r in rows]) if rows else np.zeros(0, np.int64)
    pairs, rank = np.unique(every, return_inverse=True)
    total = np.bincount(rank, np.concatenate([r.counts for r in rows]), len(pairs)).astype(np.int64)
    out, at = [(block, None, None, None, None, None, None, pairs.astype("<i8").tobytes(), total.astype("<i8").tobytes())], 0
    for doc, r in zip(ids, rows, strict=True):
        steps = np.diff(rank[at : at + len(r.pairs)], prepend=0)
        at += len(r.pairs)
        groups = (hashlib.sha256(r.groups).hexdigest() if r.n_a else "") if digest else r.groups.decode()
        out.append((block, doc, r.n_a, r.n_b, r.n_groups, r.n_links, groups, steps.astype("<u4").tobytes(), r.counts.astype("<u4").tobytes()))
        if len(out) >= 2000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, pair, total, best, ...a document's columns) sorted by block and pair, documents (no pair) last: sums of totals and of best links."""
    now, got, best, total, flag = None, [], [], None, None
    for batch in batches:
        block, pair = batch.column(0).to_numpy(), batch.column(1)
        out = []
        starts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]).tolist() if len(block) else []
        for i, j in zip(starts, starts[1:], strict=False):
            if block[i] != now:
                now, got, best, total = block[i], [], [], None
            m = j - pair.slice(i, j - i).null_count
            if m > i:
                got.append(batch.column(2).slice(i, m - i).to_numpy())
                best.append(batch.column(3).slice(i, m - i).to_numpy(zero_copy_only=False))
            if m == j:
                continue
            if total is None:
                total = np.concatenate(got) if got else np.zeros(0, np.int64)
                flag = np.concatenate(best) if best else np.zeros(0, bool)
                got, best = [], []
            for k in range(m, j):
                rank = np.cumsum(np.frombuffer(batch.column(10)[k].as_py(), "<u4"), dtype=np.int64)
                n = np.frombuffer(batch.column(11)[k].as_py(), "<u4").astype(np.int64)
                out.append((k, int(n[flag[rank]].sum()), int((n * total[rank]).sum())))
        if out:
            at = pa.array([o[0] for o in out])
            cols = [batch.column(c).take(at) for c in range(4, 10)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])


def align(docs: DataFrame, a: Callable[[], Tokenizer], b: Callable[[], Tokenizer], digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``, or its SHA-256 with ``digest``), n_best, count_sum.

    n_best are the links whose pair is linked at least as often in the whole corpus as any other pair of its B id; count_sum
    adds up the pairs' corpus counts over the links. Null and empty texts, and texts that the joined bytes of either tokenizer do
    not spell (with a space in front), have no tokens: zeros and empty groups, and nothing of them is counted. Rows that repeat an id are documents of their
    own and count each; a null id stays null. Other columns are ignored; an empty table gives no rows. ``a`` and ``b`` are called in the tasks.
    """
    ws = Workspace(docs.sparkSession, "crosstok")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        block, (one, two) = (context.partitionId() if context else 0) << 32, (a(), b())
        ids, rows, size, chunk, chunk_size = [], [], 0, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc)
                chunk.append(text)
                chunk_size += len(text or "")
                if chunk_size >= CHUNK_BYTES or len(chunk) >= 20_000:
                    rows += align_texts(chunk, one, two)
                    size, chunk, chunk_size = size + chunk_size, [], 0
                    if size >= block_bytes or len(rows) >= 200_000:
                        yield from _block_rows(block, ids, rows, digest)
                        block, ids, rows, size = block + 1, [], [], 0
        rows += align_texts(chunk, one, two)
        if rows:
            yield from _block_rows(block, ids, rows, digest)

    encoded = ws.save(doc_rows(docs).mapInArrow(encode, _SCHEMA), "encoded")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(batch.column(0).to_pylist()):
                pair, n = (np.frombuffer(batch.column(c)[k].as_py(), "<i8") for c in (1, 2))
                for i in range(0, len(pair), 1 << 16):
                    part = pair[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(n[i : i + (1 << 16)])], names=["block", "pair", "n"])

    lists = encoded.where("n_a is null").select("block", "pairs", "counts").mapInArrow(asked, "block long, pair long, n long")
    totals = ws.save(lists.groupBy("pair").agg(F.sum("n").alias("total")), "totals")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("most"))  # as many rows as B has ids at most
    named = totals.join(F.broadcast(most), b_id == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    answers = lists.select("block", "pair").join(named, "pair").select("block", "pair", "total", "best")
    own = encoded.where("n_a is not null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "counts")
    both = answers.unionByName(own, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("pair").asc_nulls_last())
    return both.mapInArrow(_answer, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
