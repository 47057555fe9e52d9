"""Equal-area projections as columns, polygon overlap, and filled contours of rasters.

A polygon table has polygon_id and ring, an array of (x, y) structs: longitude and latitude in degrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.operators import overlay
from emberframe.operators.overlay import group_starts, whole_groups
from emberframe.session import portable, saved

portable(__name__)
# Ellipsoid and parameters of the equal-area projections (standard parallels or latitude of origin, central meridian).
_A, _F = 6378137.0, 1 / 298.257222101
PROJECTIONS = {
    "EPSG:5070": ("albers", 29.5, 45.5, 23.0, -96.0), "EPSG:102001": ("albers", 50.0, 70.0, 40.0, -96.0),
    "EPSG:6933": ("cylinder", 30.0, None, 0.0, 0.0), "EPSG:3035": ("lambert", None, None, 52.0, 10.0),
}
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _authalic(sin: float | Column) -> float | Column:
    """q of the sine of a latitude (Snyder 1987, 3-12), for numbers and columns."""
    log = (F.log((1 - _E * sin) / (1 + _E * sin)) if isinstance(sin, Column) else math.log((1 - _E * sin) / (1 + _E * sin))) / (2 * _E)
    return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - log)


def project(lon: Column, lat: Column, projection: str = "EPSG:5070") -> tuple[Column, Column]:
    """x and y in metres; ValueError for a projection that is not equal-area or not known."""
    if projection not in PROJECTIONS:
        raise ValueError(f"not one of the equal-area projections {sorted(PROJECTIONS)}: {projection}")
    kind, p1, p2, lat0, lon0 = PROJECTIONS[projection]
    sin, dlon = F.sin(F.radians(lat)), F.radians(lon - lon0)
    q, qp = _authalic(sin), _authalic(1.0)
    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - _E2 * math.sin(math.radians(d)) ** 2)
    s = lambda d: math.sin(math.radians(d))
    if kind == "albers":
        n = (m(p1) ** 2 - m(p2) ** 2) / (_authalic(s(p2)) - _authalic(s(p1)))
        c = m(p1) ** 2 + n * _authalic(s(p1))
        rho, rho0 = F.sqrt(c - n * q) * (_A / n), _A * math.sqrt(c - n * _authalic(s(lat0))) / n
        return rho * F.sin(dlon * n), rho0 - rho * F.cos(dlon * n)
    if kind == "cylinder":
        return dlon * (_A * m(p1)), q * (_A / (2 * m(p1)))
    rq = _A * math.sqrt(qp / 2)
    b, b0 = F.asin(F.greatest(F.least(q / qp, F.lit(1.0)), F.lit(-1.0))), math.asin(_authalic(s(lat0)) / qp)
    d = _A * m(lat0) / (rq * math.cos(b0))
    k = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(dlon)))
    return k * d * F.cos(b) * F.sin(dlon), k / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(dlon))


def _albers(projection: str) -> tuple[float, float, float, float]:
    """Cone constant, C, radius of the origin's parallel, and central meridian (Snyder 1987, 14-3 to 14-6)."""
    kind, p1, p2, lat0, lon0 = PROJECTIONS.get(projection, ("none", 0, 0, 0, 0))
    if kind != "albers":
        raise ValueError(f"not an Albers projection: {projection}")
    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - _E2 * math.sin(math.radians(d)) ** 2)
    q = lambda d: _authalic(math.sin(math.radians(d)))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return n, c, _A * math.sqrt(c - n * q(lat0)) / n, lon0


def unproject(x: Column, y: Column, projection: str = "EPSG:5070") -> tuple[Column, Column]:
    """Longitude and latitude in degrees of Albers coordinates; the latitude by the series of the authalic one (Snyder 1987, 3-18)."""
    n, c, rho0, lon0 = _albers(projection)
    rho = F.sqrt(x * x + (rho0 - y) * (rho0 - y))
    q = (c - rho * rho * (n * n / (_A * _A))) / n
    beta = F.asin(F.greatest(F.least(q / _authalic(1.0), F.lit(1.0)), F.lit(-1.0)))
    e2, e4, e6 = _E2, _E2**2, _E2**3
    lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    return F.degrees(F.atan2(x, rho0 - y) / n) + lon0, F.degrees(lat)


def projected_bounds(west: float, south: float, east: float, north: float, projection: str = "EPSG:5070", points: int = 21) -> tuple[float, float, float, float]:
    """Least and largest x and y (x, y, x, y) of a box in degrees whose sides are projected at ``points`` inner points each."""
    n, c, rho0, lon0 = _albers(projection)
    steps = [k / (points + 1) for k in range(points + 2)]
    sides = [(west + t * (east - west), lat) for t in steps for lat in (south, north)] + [(lon, south + t * (north - south)) for t in steps for lon in (west, east)]
    at = []
    for lon, lat in sides:
        rho = _A * math.sqrt(c - n * _authalic(math.sin(math.radians(lat)))) / n
        at.append((rho * math.sin(n * math.radians(lon - lon0)), rho0 - rho * math.cos(n * math.radians(lon - lon0))))
    return min(p[0] for p in at), min(p[1] for p in at), max(p[0] for p in at), max(p[1] for p in at)


def project_ring(ring: Column, projection: str = "EPSG:5070") -> Column:
    def point(p: Column) -> Column:
        x, y = project(p["x"], p["y"], projection)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, point)


def ring_area(ring: Column) -> Column:
    """Area of a simple ring (shoelace), whatever its direction; the ring may be open or closed."""
    return F.abs(ring_signed_area(ring))


def ring_signed_area(ring: Column) -> Column:
    """Area of a ring, positive if it runs counter-clockwise."""
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def overlap_area(first: list[tuple[float, float]], second: list[tuple[float, float]]) -> float:
    """Area that two simple polygons share, convex or not."""
    return float(overlay.shared_areas([(first, second)])[0])


def _shared(a: str, b: str) -> Column:
    """Area that two columns of simple rings share."""

    def areas(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        side = lambda x, y: (np.concatenate(x.to_list()), np.concatenate(y.to_list()), x.map(len).to_numpy())
        return pd.Series(overlay.shared_of(side(ax, ay), side(bx, by), len(ax)) if len(ax) else [])

    along = lambda ring, c: F.transform(ring, lambda p: p[c].cast("double"))
    return F.pandas_udf(areas, "double")(*[along(ring, c) for ring in (a, b) for c in ("x", "y")])


def polygon_overlap(pairs: DataFrame, a: str = "ring_a", b: str = "ring_b", projection: str = "EPSG:5070") -> DataFrame:
    """pairs with area_a, area_b, area_both (m2), jaccard and dice of two simple rings in degrees.

    Projection and areas are columns; only the shared area of pairs runs in Python. A ring may be
    concave; shapes of several parts and holes are for ``shape_overlap``.
    """
    projected = pairs.withColumn("_a", project_ring(F.col(a), projection)).withColumn("_b", project_ring(F.col(b), projection))

    areas = projected.withColumns({"area_a": ring_area(F.col("_a")), "area_b": ring_area(F.col("_b")), "area_both": _shared("_a", "_b")}).drop("_a", "_b")
    return overlay.with_scores(areas)


def shape_overlap(rings: DataFrame, *key: str, projection: str = "EPSG:5070") -> DataFrame:
    """Overlap of shapes of several parts and holes in degrees: key, area_a, area_b, area_both, area_union (m2), jaccard, dice.

    rings: the key, side ('a' or 'b'), hole (true for a hole) and ring; see ``overlay.overlay``. Parts of one shape that overlap count once.
    """
    return overlay.overlay(rings.select(*key, "side", "hole", project_ring(F.col("ring"), projection).alias("ring")), *key)


def reflected(at: np.ndarray, n: int) -> np.ndarray:
    """Places of a line of n pixels mirrored at both ends, as often as needed."""
    at = np.mod(at, 2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def smooth(grid: DataFrame, sigma: float, grid_id: str = "grid_id", row: str = "row", col: str = "col", value: str = "value", tile: int = 256) -> DataFrame:
    """grid with Gaussian-smoothed values: mirrored edges, kernel cut at four sigma; missing values spread as far as the kernel reaches.

    Rasters are cut into tiles, each of which gets the pixels around it that the kernel reaches: only these are sent twice. A tile is smoothed in
    its task, one direction after the other. Pixels that are not in the table count as missing, and have no row in the result.
    """
    radius = int(4 * sigma + 0.5)
    side = max(tile, radius)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    sizes = grid.groupBy(grid_id).agg((F.max(row) + 1).cast("long").alias("_rows"), (F.max(col) + 1).cast("long").alias("_cols"))
    tiles = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - radius) / side), F.lit(0)), F.least(F.floor((F.col(c) + radius) / side), F.floor((F.col(n) - 1) / side)))
    sent = grid.withColumn(value, F.col(value).cast("double")).join(sizes, grid_id).withColumn("_tr", F.explode(tiles(row, "_rows"))).withColumn("_tc", F.explode(tiles(col, "_cols")))
    home = (F.floor(F.col(row) / side) == F.col("_tr")) & (F.floor(F.col(col) / side) == F.col("_tc"))
    # pixels from around a tile bring their value alone
    names = grid.columns
    others = [c for c in names if c not in (grid_id, row, col, value)]
    sent = sent.withColumn("_home", home).withColumns({c: F.when(F.col("_home"), F.col(f"`{c}`")) for c in others})

    def convolve(t: pa.Table) -> pa.Table:
        at = {c: t.column(c).to_numpy() for c in (row, col)}
        (tr, tc, rows, cols), own = (t.column(c)[0].as_py() for c in ("_tr", "_tc", "_rows", "_cols")), t.column("_home").to_numpy()
        r, c = (np.arange(k * side - radius, min((k + 1) * side, n) + radius) for k, n in ((tr, rows), (tc, cols)))
        low = [max(0, v[0]) for v in (r, c)]
        held = np.full((min(r[-1] + 1, rows) - low[0], min(c[-1] + 1, cols) - low[1]), np.nan)
        held[at[row] - low[0], at[col] - low[1]] = t.column(value).to_numpy()
        line = held[:, reflected(c, cols) - low[1]]
        line = sum(w * line[:, k : line.shape[1] - 2 * radius + k] for k, w in enumerate(weights))
        line = line[reflected(r, rows) - low[0]]
        line = sum(w * line[k : len(line) - 2 * radius + k] for k, w in enumerate(weights))
        out = t.filter(t.column("_home")).select(names)
        done = line[at[row][own] - tr * side, at[col][own] - tc * side]
        return out.set_column(out.schema.get_field_index(value), value, pa.array(done, pa.float64(), mask=np.isnan(done)))

    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name == value else f.dataType) for f in grid.schema.fields])
    return sent.groupBy(grid_id, "_tr", "_tc").applyInArrow(convolve, schema)


#: Cells of a tile's side, and rows of pixels or sides that a task works on at once.
_TILE, _ROWS = 256, 1 << 18


def _tiles(grid: DataFrame, grid_id: str, row: str, col: str, x: str, y: str, value: str) -> DataFrame:
    """Pixels with a value (grid_id, tr, tc, row, col, x, y, v), sorted within partitions; a pixel is in every tile that holds a cell at one of its corners."""
    known = grid.select(grid_id, F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("v")).where("v is not null")
    tile = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / _TILE), F.floor(F.col(c) / _TILE)))
    order = [F.col(f"`{grid_id}`"), *map(F.col, ("tr", "tc"))]
    return known.withColumn("tr", tile("row")).withColumn("tc", tile("col")).select(*order, "row", "col", "x", "y", "v").repartition(*order).sortWithinPartitions(*order, "row", "col")


def _squares(rows: pa.Table, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of sorted pixels whose four corners are there once: the number of their tile, the place of their first corner, and x, y and v of corners in turn (3, 4, cells)."""
    tile = np.cumsum(fresh) - 1
    tr, tc, r, k = (rows.column(i).to_numpy() for i in range(1, 5))
    r, k, side = r - tr * _TILE, k - tc * _TILE, _TILE + 1
    key = (tile * side + r) * side + k
    first = np.flatnonzero(np.diff(key, prepend=-1))
    once = np.diff(np.append(first, len(key))) == 1
    key = key[first]
    corners = [np.flatnonzero((r[first] < _TILE) & (k[first] < _TILE))]
    good = once[corners[0]]
    for step in (1, side + 1, side):
        at = np.minimum(np.searchsorted(key, key[corners[0]] + step), len(key) - 1)
        good &= (key[at] == key[corners[0]] + step) & once[at]
        corners.append(at)
    at = first[np.stack(corners)[:, good]]
    return tile[at[0]], at[0], np.stack([rows.column(i).to_numpy()[at] for i in (5, 6, 7)])


def _pieces(corners: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Convex pieces of cells (x, y and v of corners in turn): each piece's cell and number of points, and x and y of all points.

    Where a side crosses the level is worked out from its inner end, so that pieces on both sides of it have the very same point.
    """
    inside = corners[2] <= level
    whole, cut = np.flatnonzero(inside.all(axis=0)), np.flatnonzero(inside.any(axis=0) & ~inside.all(axis=0))
    x, y = (corners[i][:, whole].T.ravel() for i in (0, 1))
    c = corners[:, :, cut]
    centre = (c[:, 0] + c[:, 1] + c[:, 2] + c[:, 3]) / 4
    # four triangles a cell: two corners and the centre
    p = np.stack([c, np.roll(c, -1, axis=1), np.broadcast_to(centre[:, None], c.shape)], axis=1).reshape(3, 3, -1)
    q = np.roll(p, -1, axis=1)
    into, out = p[2] <= level, q[2] <= level
    a, b = np.where(into, p, q), np.where(into, q, p)
    with np.errstate(all="ignore"):
        cross = a[:2] + (level - a[2]) / (b[2] - a[2]) * (b[:2] - a[:2])
    points = np.stack([p[:2], cross], axis=2).reshape(2, 6, -1)
    held = np.stack([into, into != out], axis=1).reshape(6, -1)
    held &= held.sum(axis=0) >= 3
    size = held.sum(axis=0)
    cell = np.tile(cut, 4)
    sizes = np.concatenate([np.full(len(whole), 4), size[size > 0]])
    return np.concatenate([whole, cell[size > 0]]), sizes, np.concatenate([x, points[0].T[held.T]]), np.concatenate([y, points[1].T[held.T]])


def _ahead(sizes: np.ndarray) -> np.ndarray:
    """The place of the point after each one, of rings that follow each other."""
    ends = np.cumsum(sizes)
    ahead = np.arange(1, int(sizes.sum()) + 1)
    ahead[ends - 1] = ends - sizes
    return ahead


def _signed_areas(sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    ahead = _ahead(sizes)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), x * y[ahead] - x[ahead] * y, len(sizes)) / 2


def _points(x: np.ndarray, y: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], ["x", "y"])


def _of_tiles(grid: DataFrame, level: float, make, schema: str, grid_id: str = "grid_id", row: str = "row", col: str = "col", x: str = "lon", y: str = "lat", value: str = "value") -> DataFrame:
    """What ``make`` gives for the pieces of whole tiles: arguments are the pixels, the place of each piece's first corner, and ``_pieces``' sizes, x and y; rows begin with grid_id.

    Pixels meet in tiles, so a raster of any size is spread over tasks; many small rasters are worked on at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, fresh in whole_groups(batches, 3, _ROWS):
            _, at, corners = _squares(rows, fresh)
            cell, sizes, px, py = _pieces(corners, level)
            if len(cell):
                yield make(rows, at[cell], sizes, px, py)

    return _tiles(grid, grid_id, row, col, x, y, value).mapInArrow(run, f"`{grid_id}` {dict(grid.dtypes)[grid_id]}, {schema}")


def filled_cells(grid: DataFrame, level: float, **columns: str) -> DataFrame:
    """The region where a raster's value is at most ``level``, as convex pieces: grid_id, row, col, ring.

    Every cell is four triangles about its centre (its mean value), so the pieces of neighbours meet
    without gaps, and their areas add up to the filled contour's area, holes left out. A cell
    with a missing corner, or one that is there twice, has no piece. ``columns`` names grid_id, row, col, x (lon), y (lat) and value where they differ.
    """

    def make(rows: pa.Table, at: np.ndarray, sizes: np.ndarray, px: np.ndarray, py: np.ndarray) -> pa.RecordBatch:
        ring = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), _points(px, py))
        own = [rows.column(i).take(pa.array(at)).combine_chunks() for i in (0, 3, 4)]
        return pa.RecordBatch.from_arrays([*own, ring], names=[rows.column_names[0], "row", "col", "ring"])

    return _of_tiles(grid, level, make, "row long, col long, ring array<struct<x:double,y:double>>", **columns)


def _filled_sides(grid: DataFrame, level: float, digits: int, **columns: str) -> DataFrame:
    """Sides (grid_id, a, b) of the pieces of ``filled_cells`` as ``_piece_sides`` gives them, but for those that cancel within a tile: they never leave its task."""

    def make(rows: pa.Table, at: np.ndarray, sizes: np.ndarray, px: np.ndarray, py: np.ndarray) -> pa.RecordBatch:
        area = np.repeat(_signed_areas(sizes, px, py), sizes)
        ahead, px, py = _ahead(sizes), np.round(px, digits) + 0.0, np.round(py, digits) + 0.0
        i, j = np.where(area < 0, ahead, np.arange(len(ahead))), np.where(area < 0, np.arange(len(ahead)), ahead)
        keep = (area != 0) & ((px[i] != px[j]) | (py[i] != py[j]))
        i, j = i[keep], j[keep]
        at = np.repeat(at, sizes)[keep]
        # rasters of this part by number: their rows follow each other
        raster = (np.cumsum(group_starts(rows, 1)) - 1)[at]
        forward = (px[i] < px[j]) | ((px[i] == px[j]) & (py[i] < py[j]))
        low, high = np.where(forward, i, j), np.where(forward, j, i)
        order = np.lexsort((py[high], px[high], py[low], px[low], raster))
        fields = [v[order] for v in (raster, px[low], py[low], px[high], py[high])]
        fresh = np.concatenate([[True], np.any([f[1:] != f[:-1] for f in fields], axis=0)]) if len(order) else np.zeros(0, bool)
        n = np.bincount(np.cumsum(fresh) - 1, np.where(forward, 1, -1)[order], int(fresh.sum())).astype(np.int64)
        first = np.flatnonzero(fresh)
        # what is left more than once stays more than once
        left = np.repeat(order[first], np.abs(n))
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at[left])).combine_chunks(), *(_points(px[e], py[e]) for e in _ends(low[left], high[left], np.repeat(n, np.abs(n))))], names=[rows.column_names[0], "a", "b"])

    return _of_tiles(grid, level, make, "a struct<x:double,y:double>, b struct<x:double,y:double>", **columns)


def _ends(low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(n > 0, low, high), np.where(n > 0, high, low)


def _piece_sides(pieces: DataFrame, digits: int) -> DataFrame:
    """Directed sides (key, a, b) of pieces turned counter-clockwise."""
    key = pieces.columns[0]
    area = ring_signed_area(F.col("ring"))
    turned = F.when(area < 0, F.reverse("ring")).otherwise(F.col("ring"))
    snapped = F.transform(turned, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    ahead = F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1))
    return pieces.where(area != 0).select(key, snapped.alias("r")).select(key, F.explode(F.arrays_zip(F.col("r").alias("a"), ahead.alias("b"))).alias("s")).select(key, "s.a", "s.b").where("a <> b")


def stitched_rings(pieces: DataFrame, digits: int = 9, alone: int = 1 << 16) -> DataFrame:
    """Boundary rings of the pieces of ``filled_cells``: grid_id, ring_id, hole, ring (not closed).

    Sides that two pieces share run in opposite directions and cancel in one aggregate, so only the region's outline is
    left; where outlines touch in a point they part there. Rasters whose outline has at most ``alone`` sides are followed in a task each; longer
    outlines are ranked by pointer doubling over all tasks. Outer rings run counter-clockwise, holes clockwise; ring_id tells a raster's rings apart.
    """
    return _stitched(_piece_sides(pieces, digits), alone)


def _stitched(sides: DataFrame, alone: int = 1 << 16) -> DataFrame:
    """Rings of directed sides (key, a, b)."""
    key = sides.columns[0]
    forward = F.when(F.col("a") < F.col("b"), 1).otherwise(-1)
    left = sides.groupBy(key, F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.sum(forward).alias("n")).where("n <> 0")
    left = left.select(key, F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("high")).alias("a"), F.when(F.col("n") > 0, F.col("high")).otherwise(F.col("low")).alias("b"))
    left = saved(left.withColumn("side", F.monotonically_increasing_id()), "outline")
    large = left.groupBy(key).count().where(F.col("count") > alone).select(key)
    some = bool(large.limit(1).count())
    few = left.join(large, key, "left_anti") if some else left

    def follow(ends: Iterator[tuple[float, float, float, float]]) -> list[list[tuple]]:
        out: dict[tuple, list] = {}
        for ax, ay, bx, by in ends:
            out.setdefault((ax, ay), []).append((bx, by))
        rings = []
        for start in sorted(out):
            while out[start]:
                ring, at, before = [], start, None
                while out[at]:
                    ways = out[at]
                    if before is not None and len(ways) > 1:  # the sharpest turn to the left keeps touching outlines apart
                        back = math.atan2(before[1] - at[1], before[0] - at[0])
                        ways.sort(key=lambda p: (back - math.atan2(p[1] - at[1], p[0] - at[0])) % (2 * math.pi))
                    ring.append(at)
                    before, at = at, ways.pop(0)
                rings.append(ring)
        return rings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, fresh in whole_groups(batches, 1, _ROWS):
            first = np.flatnonzero(fresh)
            ends = [rows.column(i).to_numpy() for i in range(1, 5)]
            found = [follow(zip(*(e[i:j].tolist() for e in ends), strict=True)) for i, j in zip(first, [*first[1:], len(fresh)], strict=True)]
            own = np.repeat(first, [len(f) for f in found])
            flat = np.array([p for f in found for ring in f for p in ring], float).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(ring) for f in found for ring in f])])
            ids = np.concatenate([np.arange(len(f)) for f in found])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(own)).combine_chunks(), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _points(flat[:, 0], flat[:, 1]))], names=[key, "ring_id", "ring"])

    flat = few.select(key, *[F.col(f"{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"]).repartition(key).sortWithinPartitions(key)
    short = flat.mapInArrow(run, f"`{key}` {dict(sides.dtypes)[key]}, ring_id long, ring array<struct<x:double,y:double>>")
    rings = short.unionByName(_ranked_rings(left.join(large, key, "left_semi"), key)) if some else short
    return rings.select(key, "ring_id", (ring_signed_area(F.col("ring")) < 0).alias("hole"), "ring")


def _ranked_rings(sides: DataFrame, key: str) -> DataFrame:
    """Rings of directed sides (key, a, b, side: a number of its own), by list ranking: key, ring_id, ring.

    Each side points to the next one, at a touching point the one of the sharpest turn to the left. In every round a side
    learns from the side it points to the least number ahead and how far away it is, and then points twice as far. Once
    nothing changes, the least number names the ring, and the distance to it gives the place. Rounds grow with the logarithm of the longest ring.
    """
    after = sides.select(key, F.col("a").alias("b"), F.col("b").alias("to"), F.col("side").alias("next"))
    angle = lambda p, q: F.atan2(q["y"] - p["y"], q["x"] - p["x"])
    turn = F.pmod(angle(F.col("b"), F.col("a")) - angle(F.col("b"), F.col("to")), F.lit(2 * math.pi))
    ways = sides.join(after, [key, "b"]).groupBy("side").agg(F.min_by("next", turn).alias("next"))
    # each side knows the least of the ``step`` sides from itself on, and points to the one behind them
    state, step = saved(ways.select("side", "next", F.col("side").alias("least"), F.lit(0).cast("long").alias("far")), "ranks"), 1
    while True:
        on = state.select(F.col("side").alias("next"), F.col("next").alias("beyond"), F.col("least").alias("theirs"), F.col("far").alias("ahead"))
        closer = F.col("theirs") < F.col("least")
        new = state.join(on, "next").select("side", F.col("beyond").alias("next"), F.least("least", "theirs").alias("least"), F.when(closer, F.col("ahead") + step).otherwise(F.col("far")).alias("far"), closer.alias("changed"))
        state, step = saved(new, "ranks"), step * 2
        if not state.where("changed").limit(1).count():
            break
        state = state.drop("changed")
    sizes = state.groupBy("least").agg(F.count("*").alias("length"))
    placed = sides.join(state.select("side", "least", "far"), "side").join(sizes, "least")
    place = F.pmod(F.col("length") - F.col("far"), F.col("length"))
    rings = placed.groupBy(key, "least").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), "a"))).alias("at"))
    return rings.select(key, F.col("least").alias("ring_id"), F.transform("at", lambda s: s["a"]).alias("ring"))


def filled_rings(grid: DataFrame, level: float, sigma: float = 0.0, **columns: str) -> DataFrame:
    """Rings with holes of the region where a raster, smoothed if ``sigma`` is above 0, is at most ``level``."""
    return _stitched(_filled_sides(smooth(grid, sigma) if sigma > 0 else grid, level, 9, **columns))


def joined_grids(first: DataFrame, second: DataFrame, *key: str, value: str = "value") -> DataFrame:
    """Two rasters on one grid pixel by pixel: key (grid_id, row and col by default), x of the first, ref of the second; ready for the metrics.

    Rasters of different shapes fail the query, as arrays of different shapes do: a pixel on one side only is an error.
    """
    on = list(key) or ["grid_id", "row", "col"]
    one = lambda g, name: g.select(*on, F.struct(F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("v")).alias(name))
    both = one(first, "_x").join(one(second, "_ref"), on, "full")
    alone = F.col("_x").isNull() | F.col("_ref").isNull()
    x = F.when(alone, F.raise_error(F.lit("rasters of different shapes")).cast("double")).otherwise(F.col("_x.v"))
    return both.select(*on, x.alias("x"), F.col("_ref.v").alias("ref"))


def filled_area(grid: DataFrame, level: float, **columns: str) -> DataFrame:
    """Area of the filled contour of each raster, in the units of its coordinates."""

    def make(rows: pa.Table, at: np.ndarray, sizes: np.ndarray, px: np.ndarray, py: np.ndarray) -> pa.RecordBatch:
        raster = (np.cumsum(group_starts(rows, 1)) - 1)[at]
        n, order = int(raster.max()) + 1, np.argsort(raster, kind="stable")
        area, there = np.bincount(raster, np.abs(_signed_areas(sizes, px, py)), n), np.unique(raster[order], return_index=True)
        own = rows.column(0).take(pa.array(at[order][there[1]])).combine_chunks()
        return pa.RecordBatch.from_arrays([own, pa.array(area[there[0]])], names=[rows.column_names[0], "area"])

    parts = _of_tiles(grid, level, make, "area double", **columns)
    return parts.groupBy(parts.columns[0]).agg(F.sum("area").alias("area"))


def filled_overlap(first: DataFrame, second: DataFrame, level: float, projection: str | None = None, **columns: str) -> DataFrame:
    """Overlap of the filled contours of two rasters on one grid: grid_id, area_a, area_b, area_both, jaccard, dice.

    Pieces meet by cell, so the work follows the number of cells and is spread like them. With a
    projection, coordinates are degrees and areas square metres.
    """
    a, b = (filled_cells(g, level, **columns) for g in (first, second))
    if projection:
        a, b = (g.withColumn("ring", project_ring(F.col("ring"), projection)) for g in (a, b))
    key = a.columns[0]
    area = lambda g, name: g.groupBy(key).agg(F.sum(ring_area(F.col("ring"))).alias(name))
    both = a.withColumnRenamed("ring", "ra").join(b.withColumnRenamed("ring", "rb"), [key, "row", "col"]).groupBy(key).agg(F.sum(_shared("ra", "rb")).alias("area_both"))
    out = area(a, "area_a").join(area(b, "area_b"), key, "full").join(both, key, "left").fillna(0.0, ["area_a", "area_b", "area_both"])
    return overlay.with_scores(out)
