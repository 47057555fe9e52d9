"""Elements of one array of a JSON file of any size, read by many tasks.

Where a byte stands (in a string, how deep) depends on all bytes before it. So tasks first sum up each share of a file for every
state that it may begin in: where that leaves one, and how the depth changes. The shares' summaries, put one after the other, tell
each share's true state. Then the array is found, and each task cuts out the elements that begin in its share, reading on to the end of its last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberframe.session import portable
from emberframe.sources.files import Ranges, listed

portable(__name__)
SPLIT_BYTES, WINDOW = 64 << 20, 8 << 20
# States between two bytes: outside strings, inside one, inside one behind a backslash that escapes what follows.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def scan(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which bytes are outside strings (quotes are not), the change of depth at each, and the state behind the last; from a state before the first."""
    b = np.frombuffer(data, np.uint8)
    slash = b == ord("\\")
    # a byte is escaped behind an odd number of backslashes
    start = np.flatnonzero(slash & ~np.concatenate([[False], slash[:-1]]))
    escaped = np.zeros(len(b) + 1, bool)
    if len(start):
        end = np.flatnonzero(slash & ~np.concatenate([slash[1:], [False]])) + 1
        length = end - start
        if state == ESCAPED and start[0] == 0:
            length[0] -= 1  # the first backslash is escaped itself
        escaped[end[length % 2 == 1]] = True
    if state == ESCAPED and len(b) and not slash[0]:
        escaped[0] = True
    quotes = (b == ord('"')) & ~escaped[:-1]
    inside = (np.cumsum(quotes) + (state != OUTSIDE)) % 2 == 1
    outside = ~inside & ~quotes
    last = bool(inside[-1]) if len(b) else state != OUTSIDE
    after = OUTSIDE if not last else ESCAPED if escaped[-1] or (not len(b) and state == ESCAPED) else INSIDE
    return outside, np.where(outside, _STEP[b], 0).astype(np.int64), after


def _windows(file: Ranges, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    for at in range(start, end, WINDOW):
        yield at, file.read(at, min(WINDOW, end - at))


def _tasks(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One task a row."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of shares (path, k, start, end): for each state before it (before), the state behind it (after) and the change of depth (depth)."""
    for batch in batches:
        out = []
        for path, k, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            file = Ranges(path)
            for before in (OUTSIDE, INSIDE, ESCAPED):
                state, depth = before, 0
                for _, data in _windows(file, start, end):
                    _, step, state = scan(data, state)
                    depth += int(step.sum())
                out.append((path, k, before, state, depth))
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["path", "k", "before", "after", "depth"])


def _openings(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Of shares (path, start, end, state, depth): the places behind brackets that open (1) or close (-1) an array of the outermost object; an opening only where ``key`` stands before it."""
    import json
    import re

    wanted = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', re.DOTALL)
    for batch in batches:
        out = []
        for path, start, end, state, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            file = Ranges(path)
            for at, data in _windows(file, start, end):
                outside, step, state = scan(data, state)
                level = depth + np.cumsum(step)
                b = np.frombuffer(data, np.uint8)
                for i in np.flatnonzero(outside & (b == ord("[")) & (level == 2)).tolist():
                    front = file.read(max(0, at + i - 4096), min(4096, at + i))
                    found = wanted.search(front)
                    if found and json.loads(found[1]) == key:
                        out.append((path, at + i + 1, 1))
                out += [(path, at + i + 1, -1) for i in np.flatnonzero(outside & (b == ord("]")) & (level == 1)).tolist()]
                depth = int(level[-1]) if len(level) else depth
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32())], names=["path", "at", "kind"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of shares (path, start, end, state, depth, low, high: the array's inside): its elements that are objects and begin in the share, as text."""
    for batch in batches:
        for path, start, end, state, depth, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            file, begun, parts = Ranges(path), None, []
            for at, data in _windows(file, start, high):
                outside, step, state = scan(data, state)
                level = depth + np.cumsum(step)
                depth = int(level[-1]) if len(level) else depth
                place = at + np.arange(len(data))
                opens = np.flatnonzero(outside & (step == 1) & (level == 3) & (place >= low) & (place < high) & (np.frombuffer(data, np.uint8) == ord("{")))
                closes = np.flatnonzero(outside & (step == -1) & (level == 2) & (place >= low) & (np.frombuffer(data, np.uint8) == ord("}")))
                done, kept = [], 0
                for i, kind in sorted([(int(i), 1) for i in opens] + [(int(i), -1) for i in closes]):
                    if kind == 1 and at + i < end:
                        begun, kept, parts = at + i, i, []
                    elif kind == -1 and begun is not None:
                        done.append((path, begun, b"".join([*parts, data[kept : i + 1]]).decode()))
                        begun, parts = None, []
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "at", "value"])
                if begun is not None:
                    parts.append(data[kept:] if begun >= at else data)
                elif at + len(data) >= end:
                    break
            file.close()


def read_elements(spark: SparkSession, path: str, key: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, at (the byte where it begins) and value (its text) of each object in the array that the outermost object of JSON files holds under ``key``.

    Files are UTF-8 JSON with one object each; those without the key give no rows. A task holds one element and a window of its share. Per share, three
    numbers for each of three states reach the driver, and where the outermost object's arrays begin and end.
    """
    shares = [(p, k, k * split_bytes, min(size, (k + 1) * split_bytes)) for p, size in listed(path) for k in range(-(-size // split_bytes))]
    if not shares:
        return spark.createDataFrame([], "path string, at long, value string")
    sums = _tasks(spark, shares, "path string, k long, start long, end long").mapInArrow(_summaries, "path string, k long, before long, after long, depth long")
    known = {(r["path"], r["k"], r["before"]): (r["after"], r["depth"]) for r in sums.collect()}
    placed, now = [], None
    for p, k, start, end in shares:
        state, depth = (OUTSIDE, 0) if k == 0 else now
        placed.append((p, start, end, state, depth))
        after, change = known[p, k, state]
        now = (after, depth + change)
    found = _tasks(spark, placed, "path string, start long, end long, state int, depth long").mapInArrow(lambda b: _openings(b, key), "path string, at long, kind int")
    arrays: dict[str, list[tuple[int, int]]] = {}
    for r in found.sort("path", "at").collect():
        own = arrays.setdefault(r["path"], [])
        if r["kind"] == 1:
            own.append((r["at"], -1))
        elif own and own[-1][1] < 0:
            own[-1] = (own[-1][0], r["at"] - 1)
    rows = [(*s, *arrays[s[0]][-1]) for s in placed if arrays.get(s[0]) and s[1] < arrays[s[0]][-1][1] and s[2] > arrays[s[0]][-1][0]]
    return _tasks(spark, rows, "path string, start long, end long, state int, depth long, low long, high long").mapInArrow(_elements, "path string, at long, value string")
