"""GeoTIFF rasters as a data source: tasks read the tiles that filters leave, one row of pixels of a tile a row.

A file is cut into shares of its tiles or strips, so one raster of any size is read by many tasks, and a task holds one tile. Filters
on rows and on the bounds of what a row covers reach the source: tiles that cannot hold such rows are not read. Where only Spark can open
a file, ``read_geotiff`` takes its bytes from the binaryFile source, a whole file in a task.

Baseline and Big TIFF of one band or several: strips or tiles, without compression or with deflate, LZW or PackBits,
with or without horizontal differences; north-up georeferencing by pixel scale and tie point, or by an affine matrix.
"""

from __future__ import annotations

import operator
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from emberframe.operators import geometry
from emberframe.session import portable
from emberframe.sources.files import Ranges, listed
from emberframe.sources.rasters import PRODUCTS

portable(__name__)
# Sizes of the field types and numbers of the tags of the TIFF format.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
SCALE, TIE_POINT, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
NONE, LZW, DEFLATE, PACK_BITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
SCHEMA = "grid_id string, epsg int, nodata double, x0 double, dx double, y0 double, dy double, width long, height long, row long, values array<double>"
SCAN_SCHEMA = "grid_id string, epsg int, nodata double, x0 double, dx double, y0 double, dy double, width long, height long, row long, col long, west double, east double, south double, north double, values array<double>"
#: Bytes of a file for each task, and pixels of an uncompressed strip that are read at once.
SPLIT_BYTES, PIECE_PIXELS = 64 << 20, 1 << 20


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, each width left one code early."""
    out, table, width, held, bits, before = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            entry = table[code] if code < len(table) else before + before[:1]
            if before is not None:
                table.append(before + entry[:1])
            out += entry
            before = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """Runs and literals of PackBits."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n == 128:
            at += 1
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


_UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACK_BITS: unpack_bits}


class Bytes:
    """A file that is in memory, read like ``Ranges``."""

    def __init__(self, data: bytes):
        self.data = data

    def read(self, at: int, size: int) -> bytes:
        return self.data[at : at + size]


class Held(NamedTuple):
    """A tag's values that stay in the file until they are asked for."""

    at: int
    kind: int
    count: int


class Block(NamedTuple):
    """A tile, a strip or a piece of one: its pixels, its number among the offsets, and the bytes of its rows in front of it."""

    row: int
    col: int
    rows: int
    cols: int
    number: int
    skip: int


class Tiff:
    """The first image of a file: its tags, georeferencing, and blocks of pixels. Only the header, and the offsets and blocks asked for, are read."""

    def __init__(self, file: bytes | Bytes | Ranges):
        self.file = Bytes(file) if isinstance(file, (bytes, bytearray, memoryview)) else file
        head = self.file.read(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(bytes(head[:2]))
        if self.order is None:
            raise ValueError("not a TIFF file")
        big = self._values(head, "H", 2)[0] == 43
        at = self._values(head, "Q" if big else "I", 8 if big else 4)[0]
        first, size, inside = (8, 20, 8) if big else (2, 12, 4)
        n = self._values(self.file.read(at, first), "Q" if big else "H", 0)[0]
        entries = self.file.read(at + first, n * size)
        self.tags: dict[int, tuple | Held] = {}
        for entry in range(0, n * size, size):
            tag, kind, count = (*self._values(entries, "HH", entry), self._values(entries, "Q" if big else "I", entry + 4)[0])
            field = entry + (12 if big else 8)
            held = Held(at + first + field if _SIZES.get(kind, 1) * count <= inside else self._values(entries, "Q" if big else "I", field)[0], kind, count)
            if kind == 2:
                self.tags[tag] = (bytes(self.file.read(held.at, count)).split(b"\0")[0].decode("latin-1"),)
            elif kind in _CODES:
                self.tags[tag] = held if count > 64 else self._load(held, 0, count)
        self.width, self.height, self.samples = self.one(WIDTH), self.one(HEIGHT), self.one(SAMPLES, 1)
        letter = {1: "u", 2: "i", 3: "f"}[self.one(FORMAT, 1)]
        self.dtype = np.dtype(f"{self.order}{letter}{self.one(BITS, 8) // 8}")
        if self.one(COMPRESSION, NONE) not in _UNPACK:
            raise ValueError(f"unknown compression {self.one(COMPRESSION)}")
        if self.one(PREDICTOR, 1) not in (1, 2):
            raise ValueError(f"unknown predictor {self.one(PREDICTOR)}")

    def _values(self, data: bytes, codes: str, at: int) -> tuple:
        return struct.unpack_from(self.order + codes, data, at)

    def _load(self, held: Held, start: int, count: int) -> tuple:
        size = _SIZES[held.kind]
        return self._values(self.file.read(held.at + start * size, count * size), f"{count}{_CODES[held.kind]}", 0)

    def at(self, tag: int, k: int) -> int:
        """The k-th value of a tag."""
        held = self.tags[tag]
        return self._load(held, k, 1)[0] if isinstance(held, Held) else held[k]

    def one(self, tag: int, default=None):
        return self.at(tag, 0) if tag in self.tags else default

    def placing(self) -> tuple[float, float, float, float]:
        """x of column 0, x step, y of row 0, y step."""
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            if m[1] or m[4]:
                raise ValueError("rotated rasters have no rows and columns on axes")
            return m[3], m[0], m[7], m[5]
        if SCALE in self.tags and TIE_POINT in self.tags:
            (sx, sy), (i, j, _, x, y, _) = self.tags[SCALE][:2], self.tags[TIE_POINT][:6]
            return x - i * sx, sx, y + j * sy, -sy
        return 0.0, 1.0, 0.0, 1.0

    def epsg(self) -> int | None:
        """Code of the projected system, else of the geographic one."""
        keys = self.tags.get(GEO_KEYS, ())
        keys = self._load(keys, 0, keys.count) if isinstance(keys, Held) else keys
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = found.get(3072) or found.get(2048)
        return code if code and code != 32767 else None

    def nodata(self) -> float | None:
        text = str(self.one(NODATA, "")).strip()
        return float(text) if text else None

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """First rows and first columns of the lines and columns of blocks, with the height and width behind them."""
        if TILES in self.tags:
            return np.append(np.arange(0, self.height, self.one(TILE_HEIGHT)), self.height), np.append(np.arange(0, self.width, self.one(TILE_WIDTH)), self.width)
        strip = min(self.one(ROWS_PER_STRIP, self.height), self.height)
        piece = strip
        if self.one(COMPRESSION, NONE) == NONE:  # rows of a plain strip can be read one by one
            piece = min(strip, max(1, PIECE_PIXELS // self.width))
        return np.array([r + k for r in range(0, self.height, strip) for k in range(0, min(strip, self.height - r), piece)] + [self.height]), np.array([0, self.width])

    def block(self, r: int, c: int, edges: tuple[np.ndarray, np.ndarray], band: int = 1) -> Block:
        """The block of line r and column c of ``edges``."""
        (row, end), (col, side) = edges[0][r : r + 2].tolist(), edges[1][c : c + 2].tolist()
        separate = self.one(PLANAR, 1) == 2
        if TILES in self.tags:
            number, total, skip = r * (len(edges[1]) - 1) + c, (len(edges[0]) - 1) * (len(edges[1]) - 1), 0
        else:
            strip = min(self.one(ROWS_PER_STRIP, self.height), self.height)
            number, total = row // strip, -(-self.height // strip)
            skip = (row - number * strip) * self.width * (1 if separate else self.samples) * self.dtype.itemsize
        return Block(row, col, end - row, side - col, number + (band - 1) * total if separate else number, skip)

    def pixels(self, b: Block, band: int = 1) -> np.ndarray:
        """A block's values of one band."""
        tiled, separate = TILES in self.tags, self.one(PLANAR, 1) == 2
        samples, pick = (1, 0) if separate else (self.samples, band - 1)
        rows, columns = (self.one(TILE_HEIGHT), self.one(TILE_WIDTH)) if tiled else (b.rows, self.width)
        size = rows * columns * samples * self.dtype.itemsize
        offset, length = self.at(TILES if tiled else STRIPS, b.number), self.at(TILE_BYTES if tiled else STRIP_BYTES, b.number)
        plain = self.one(COMPRESSION, NONE) == NONE
        raw = self.file.read(offset + b.skip, min(size, length - b.skip)) if plain else _UNPACK[self.one(COMPRESSION, NONE)](self.file.read(offset, length))
        got = np.frombuffer(raw, self.dtype, count=min(len(raw) // self.dtype.itemsize, rows * columns * samples))
        block = np.zeros(rows * columns * samples, self.dtype)
        block[: len(got)] = got
        block = block.reshape(rows, columns, samples)
        if self.one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        return block[: b.rows, : b.cols, pick]

    def rows(self, band: int = 1) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, pixels) of one band, a strip or a line of tiles at a time."""
        edges = self.edges()
        for r in range(len(edges[0]) - 1):
            line = [self.pixels(self.block(r, c, edges, band), band) for c in range(len(edges[1]) - 1)]
            yield int(edges[0][r]), np.concatenate(line, axis=1)


def encode(values: np.ndarray, x0: float, dx: float, y0: float, dy: float, epsg: int | None = None, nodata: float | None = None, compress: bool = True, rows_per_strip: int = 64) -> bytes:
    """A one-band TIFF of strips, deflated with horizontal differences for whole numbers, or plain."""
    values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    h, w = values.shape
    whole = compress and values.dtype.kind in "iu"
    strips = []
    for r in range(0, h, rows_per_strip):
        part = values[r : r + rows_per_strip]
        raw = (np.diff(part, axis=1, prepend=part[:, :1] * 0).astype(part.dtype) if whole else part).tobytes()
        strips.append(zlib.compress(raw) if compress else raw)
    fields: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (values.dtype.itemsize * 8,)), (COMPRESSION, 3, (DEFLATE if compress else NONE,)), (PHOTOMETRIC, 3, (1,)), (STRIPS, 4, (0,) * len(strips)),
        (SAMPLES, 3, (1,)), (ROWS_PER_STRIP, 4, (rows_per_strip,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (PREDICTOR, 3, (2 if whole else 1,)), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[values.dtype.kind],)),
        (SCALE, 12, (dx, -dy, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, x0, y0, 0.0)),
    ]
    if epsg:
        geographic = 4000 <= epsg < 5000
        fields.append((GEO_KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, epsg)))
    if nodata is not None:
        fields.append((NODATA, 2, f"{nodata:g}\0".encode()))
    extra_at = 8 + 2 + 12 * len(fields) + 4
    sizes = [len(v) if isinstance(v, bytes) else _SIZES[t] * len(v) for _, t, v in fields]
    at = extra_at + sum(s + s % 2 for s in sizes if s > 4)
    places = tuple(at + sum(map(len, strips[:i])) for i in range(len(strips)))
    head, extra = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    for (tag, kind, v), size in zip(fields, sizes, strict=True):
        v = places if tag == STRIPS else v
        raw = v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_CODES[kind]}", *v)
        head += struct.pack("<HHI", tag, kind, len(v)) + (raw.ljust(4, b"\0") if size <= 4 else struct.pack("<I", extra_at + len(extra)))
        extra += raw + b"\0" * (size % 2) if size > 4 else b""
    return head + b"\0" * 4 + extra + b"".join(strips)


class Share(ds.InputPartition):
    """The k-th of n shares of a file's blocks."""

    def __init__(self, path: str, k: int, n: int):
        self.path, self.k, self.n = path, k, n


_TESTS = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


def _bounds(start: float, step: float, first, end) -> tuple:
    """Least and largest coordinate of the pixels from ``first`` to before ``end``, half a pixel wider on each side."""
    a, b = start + (first - 0.5) * step, start + (end + 0.5) * step
    return np.minimum(a, b), np.maximum(a, b)


class GeoTiffReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.band, self.split = options["path"], int(options.get("band", "1")), int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[tuple[str, type, float | str]] = []

    def pushFilters(self, filters: list[ds.Filter]):  # noqa: N802
        """Comparisons of row, bounds and file name choose what is read; Spark applies all filters to what was read."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("grid_id", "row", "west", "east", "south", "north"):
                self.tests.append((f.attribute[0], type(f), f.value))
            yield f

    def partitions(self) -> list[Share]:
        """Shares of the files by their size; files are only listed here."""
        names = [v for c, kind, v in self.tests if c == "grid_id" and kind is ds.EqualTo]
        found = [f for f in listed(self.path) if all(f[0] == v for v in names)]
        return [Share(path, k, n) for path, size in found for n in [max(1, -(-size // self.split))] for k in range(n)]

    def chosen(self, t: Tiff, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines and columns of blocks that can hold rows which pass the filters."""
        x0, dx, y0, dy = t.placing()
        first, last = rows[:-1], rows[1:] - 1
        west, east = _bounds(x0, dx, cols[:-1], cols[1:])
        ys = [_bounds(y0, dy, r, r + 1) for r in (first, last)]
        values = {"west": [west], "east": [east], "row": [first, last], "south": [y[0] for y in ys], "north": [y[1] for y in ys]}
        line, column = np.ones(len(first), bool), np.ones(len(cols) - 1, bool)
        for name, kind, v in self.tests:
            if name == "grid_id":
                continue
            own = np.stack(values[name])
            ok = (own.min(axis=0) <= v) & (v <= own.max(axis=0)) if kind is ds.EqualTo else _TESTS[kind](own, v).any(axis=0)
            if name in ("west", "east"):
                column &= ok
            else:
                line &= ok
        return np.flatnonzero(line), np.flatnonzero(column)

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        file = Ranges(share.path)
        try:
            t = Tiff(file)
            edges = t.edges()
            lines, columns = self.chosen(t, *edges)
            total, (x0, dx, y0, dy), epsg, nodata = len(lines) * len(columns), t.placing(), t.epsg(), t.nodata()
            for i in range(share.k * total // share.n, (share.k + 1) * total // share.n):
                b = t.block(int(lines[i // len(columns)]), int(columns[i % len(columns)]), edges, self.band)
                yield self.batch(t, b, share.path, (x0, dx, y0, dy), epsg, nodata)
        finally:
            file.close()

    def batch(self, t: Tiff, b: Block, path: str, placing: tuple, epsg: int | None, nodata: float | None) -> pa.RecordBatch:
        x0, dx, y0, dy = placing
        n, row = b.rows, b.row + np.arange(b.rows)
        (west, east), (south, north) = _bounds(x0, dx, b.col, b.col + b.cols), _bounds(y0, dy, row, row + 1)
        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * b.cols), pa.array(t.pixels(b, self.band).astype(float).ravel()))
        same = lambda v, kind: pa.array([v] * n, kind)
        columns = {
            "grid_id": same(path, pa.string()), "epsg": same(epsg, pa.int32()), "nodata": same(nodata, pa.float64()), "x0": same(x0, pa.float64()), "dx": same(dx, pa.float64()),
            "y0": same(y0, pa.float64()), "dy": same(dy, pa.float64()), "width": same(t.width, pa.int64()), "height": same(t.height, pa.int64()), "row": pa.array(row), "col": same(b.col, pa.int64()),
            "west": same(float(west), pa.float64()), "east": same(float(east), pa.float64()), "south": pa.array(south), "north": pa.array(north), "values": values,
        }
        return pa.RecordBatch.from_pydict(columns)


class GeoTiff(ds.DataSource):
    """``spark.read.format("geotiff")``: options path, band (1 by default) and splitbytes."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCAN_SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader({k.lower(): v for k, v in self.options.items()})


def scan_geotiff(spark: SparkSession, path: str, band: int = 1, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of pixels of the tiles (or strips) of a file, a folder's files or those a pattern matches, with the file's name, coordinate
    system, missing value and placing, the row, its first column, and the bounds of its pixels, half a pixel wider on each side.

    The files must lie where Python tasks reach them: a shared folder, or a store that pyarrow knows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    return spark.read.format("geotiff").options(path=path, band=band, splitbytes=split_bytes).load()


def read_geotiff(spark: SparkSession, path: str, band: int = 1) -> DataFrame:
    """Rows of pixels with the file's name, code of its coordinate system, missing value and placing."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                t = Tiff(content)
                x0, dx, y0, dy = t.placing()
                for first, block in t.rows(band):
                    yield pd.DataFrame({
                        "grid_id": name, "epsg": pd.array([t.epsg()] * len(block), "Int32"), "nodata": t.nodata(), "x0": x0, "dx": dx, "y0": y0, "dy": dy, "width": t.width, "height": t.height,
                        "row": np.arange(first, first + len(block)), "values": list(block.astype(float)),
                    })

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, SCHEMA)


def _col(rows: DataFrame):
    """First column of a row's values: whole rows begin at 0."""
    return F.col("col") if "col" in rows.columns else F.lit(0).cast("long")


def grid(rows: DataFrame, fill: float | None = None) -> DataFrame:
    """Long table grid_id, epsg, row, col, x, y, value of rows of pixels; x and y place a pixel's first corner. ``fill`` overrides the file's missing value."""
    long = rows.select("*", _col(rows).alias("_first"), F.posexplode("values").alias("c", "v"))
    missing = F.lit(fill) if fill is not None else F.col("nodata")
    value = F.nanvl(F.when(missing.isNull() | (F.col("v") != missing), F.col("v")), F.lit(None))
    col = F.col("_first") + F.col("c")
    return long.select("grid_id", "epsg", "row", col.alias("col"), (F.col("x0") + col * F.col("dx")).alias("x"), (F.col("y0") + F.col("row") * F.col("dy")).alias("y"), value.alias("value"))


def window(rows: DataFrame, west: float, south: float, east: float, north: float, projection: str = "EPSG:4326") -> DataFrame:
    """The rows and columns that a box in degrees covers, of rows of pixels in ``projection``: the box's sides are projected at 21 points each, and the
    projected bounds rounded to whole pixels. Placing, width, height, rows and columns become the window's.

    Of ``scan_geotiff``, only tiles that the box meets are read.
    """
    west, east, south, north = min(west, east), max(west, east), min(south, north), max(south, north)
    left, low, right, high = (west, south, east, north) if projection == "EPSG:4326" else geometry.projected_bounds(west, south, east, north, projection)
    edge = lambda v, start, step: F.round((F.lit(v) - F.col(start)) / F.col(step)).cast("long")
    c0, c1 = F.greatest(edge(left, "x0", "dx"), F.lit(0)), F.least(edge(right, "x0", "dx"), F.col("width"))
    a, b = edge(high, "y0", "dy"), edge(low, "y0", "dy")
    r0, r1 = F.greatest(F.least(a, b), F.lit(0)), F.least(F.greatest(a, b), F.col("height"))
    if "west" in rows.columns:  # bounds are half a pixel wide of the pixels, as far as rounding can move a side
        rows = rows.where((F.col("east") >= left) & (F.col("west") <= right) & (F.col("north") >= low) & (F.col("south") <= high))
    first, n = _col(rows), F.size("values")
    inside = rows.withColumns({"_c0": c0, "_c1": c1, "_r0": r0, "_r1": r1, "_a": F.greatest(c0, first), "_b": F.least(c1, first + n)})
    inside = inside.where((F.col("row") >= F.col("_r0")) & (F.col("row") < F.col("_r1")) & (F.col("_b") > F.col("_a")))
    return inside.select(
        "grid_id", "epsg", "nodata", (F.col("x0") + F.col("_c0") * F.col("dx")).alias("x0"), "dx", (F.col("y0") + F.col("_r0") * F.col("dy")).alias("y0"), "dy", (F.col("_c1") - F.col("_c0")).alias("width"),
        (F.col("_r1") - F.col("_r0")).alias("height"), (F.col("row") - F.col("_r0")).alias("row"), (F.col("_a") - F.col("_c0")).alias("col"),
        F.slice("values", (F.col("_a") - first + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")).alias("values"),
    )


def standardize(rows: DataFrame, product: str) -> DataFrame:
    """A product's pixels as grid_id, row, col, lon, lat, x, y and its standard name: the product's own missing value comes before the file's.

    Files in EPSG:5070 are projected back; those in degrees stay; other systems fail the query.
    """
    name, fill = PRODUCTS[product]
    g = grid(rows, fill)
    lon, lat = geometry.unproject(F.col("x"), F.col("y"), "EPSG:5070")
    degrees = F.col("epsg").isin(4326, 4269)
    known = lambda own, back: F.when(degrees, own).when(F.col("epsg") == 5070, back).otherwise(F.raise_error(F.concat(F.lit("no projection for EPSG:"), F.col("epsg").cast("string"))).cast("double"))
    return g.select("grid_id", "row", "col", known(F.col("x"), lon).alias("lon"), known(F.col("y"), lat).alias("lat"), "x", "y", F.col("value").alias(name))


def file_info(rows: DataFrame) -> DataFrame:
    """grid_id, epsg, width, height and missing value of each file."""
    return rows.groupBy("grid_id").agg(*[F.first(c).alias(c) for c in ("epsg", "width", "height", "nodata")])

