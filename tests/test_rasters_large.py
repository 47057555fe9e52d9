"""Smoothing on tiles and outlines ranked over tasks, against plain recomputation and against outlines of one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import geometry


def mirrored(a, sigma):
    """Gaussian along both axes with mirrored edges, by padding as often as needed."""
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        p = np.pad(a, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        a = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, p)
    return a


@pytest.mark.parametrize(("shape", "sigma", "tile"), [((37, 52), 1.3, 8), ((37, 52), 1.3, 256), ((5, 3), 2.0, 4), ((1, 40), 0.7, 16), ((20, 20), 2.5, 1)])
def test_tiles_give_what_the_whole_raster_gives(spark, shape, sigma, tile):
    r = np.random.default_rng(5)
    a, b = r.normal(size=shape), r.normal(size=shape)
    b[0, 1 % shape[1]] = np.nan
    rows = [(g, i, j, None if g == "b" and np.isnan(v) else float(v), f"{i}-{j}", {"m": i}) for g, m in (("a", a), ("b", b)) for (i, j), v in np.ndenumerate(m)]
    df = spark.createDataFrame(rows, "grid_id string, row int, col int, value double, name string, m map<string,int>").repartition(3)
    out = geometry.smooth(df, sigma, tile=tile)
    assert out.columns == df.columns
    got = out.toPandas()
    assert (got["name"] == got["row"].astype(str) + "-" + got["col"].astype(str)).all() and len(got) == 2 * a.size
    for g, m in (("a", a), ("b", b)):
        want = mirrored(m, sigma)
        own = got[got["grid_id"] == g].pivot(index="row", columns="col", values="value").to_numpy().astype(float)
        assert np.allclose(own, want, equal_nan=True, atol=1e-12)


def canonical(rings):
    """Rings as sets of rows: each begins with its least point."""
    out = []
    for r in rings:
        points = [(p["x"], p["y"]) for p in r.ring]
        k = points.index(min(points))
        out.append((r.grid_id, r.hole, tuple(points[k:] + points[:k])))
    return sorted(out, key=str)


def test_ranked_outlines_are_those_of_one_task(spark):
    r = np.random.default_rng(2)
    blocks = (r.random((2, 24, 24)) < 0.6).astype(int)  # many outlines, holes, islands in holes, touching corners
    square = lambda x, y: [{"x": float(x), "y": float(y)}, {"x": x + 1.0, "y": float(y)}, {"x": x + 1.0, "y": y + 1.0}, {"x": float(x), "y": y + 1.0}]
    pieces = spark.createDataFrame([(f"g{g}", square(j, i)) for g, i, j in np.argwhere(blocks).tolist()], "grid_id string, ring array<struct<x:double,y:double>>")
    one, ranked = (geometry.stitched_rings(pieces, alone=n) for n in (1 << 16, 0))
    assert one.columns == ranked.columns and canonical(one.collect()) == canonical(ranked.collect())
    total = ranked.groupBy("grid_id").agg(F.sum(geometry.ring_signed_area(F.col("ring"))).alias("a"), F.count_if("hole").alias("holes"), F.countDistinct("ring_id").alias("ids"), F.count("*").alias("n")).collect()
    assert {x.grid_id: x.a for x in total} == {f"g{g}": blocks[g].sum() for g in (0, 1)} and all(x.holes > 0 and x.ids == x.n for x in total)


def test_one_long_outline_over_many_tasks(spark):
    """A comb of 1500 teeth: one ring of about 6,000 sides, ranked in some 13 rounds."""
    n = 1500
    part = lambda x, y, w, h: F.array(*[F.struct((x + a * w).cast("double").alias("x"), F.lit(float(y + b * h)).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    base = spark.range(2 * n).select(F.lit(1).alias("grid_id"), part(F.col("id"), 0, 1, 1).alias("ring"))
    teeth = spark.range(n).select(F.lit(1).alias("grid_id"), part(F.col("id") * 2, 1, 1, 5).alias("ring"))
    rings = geometry.stitched_rings(base.unionByName(teeth), alone=100).collect()
    points = [(p["x"], p["y"]) for p in rings[0].ring]
    assert len(rings) == 1 and not rings[0].hole and len(points) == len(set(points)) > 4 * n
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2
    assert area == 2 * n + 5 * n


@pytest.mark.parametrize(("n", "m"), [(300, 400), (40, 1), (60, 3), (5, 0)])
def test_nearest_without_a_radius(spark, n, m):
    from emberframe.sources import rasters

    r = np.random.default_rng(n)
    cluster = r.normal(0, 1e-3, (m // 2, 2)) + (5, 5)
    g = np.concatenate([cluster, r.uniform(0, 10, (m - m // 2, 2))])
    p = np.concatenate([r.uniform(-5, 15, (n - 3, 2)), [(1e6, -1e6), (5, 5), (0, 1e4)]])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(n, None, 1.0)], "point_id int, x double, y double")
    grid = spark.createDataFrame([(float(a), float(b), i) for i, (a, b) in enumerate(g)] + [(None, 2.0, -1)], "x double, y double, value int")
    got = {x.point_id: (x.value, x.distance) for x in rasters.nearest(points, grid).collect()}
    assert len(got) == n + 1 and got[n] == (None, None)
    for i, q in enumerate(p):
        d = np.hypot(*(g - q).T) if m else np.zeros(0)
        assert got[i] == ((d.argmin(), pytest.approx(d.min(), rel=1e-12)) if m else (None, None))


def test_resample_between_unlike_spacings(spark):
    from emberframe.sources import rasters

    r = np.random.default_rng(8)
    pieces, layers = [], {}
    for g, (h, w, x0, dx, y0, dy) in enumerate(((7, 5, 10.0, 2.5, 40.0, -1.5), (3, 9, -4.0, 0.7, 0.0, 3.0))):
        a = r.integers(0, 100, (h, w)).astype(float)
        a[0, 0] = np.nan
        layers[g] = (a, x0, dx, y0, dy)
        pieces += [(g, x0, dx, y0, dy, w, h, i, c, a[i, c : c + 3].tolist()) for i in range(h) for c in range(0, w, 3)]
    source = spark.createDataFrame(pieces, "g int, x0 double, dx double, y0 double, dy double, width long, height long, row long, col long, values array<double>")
    at = [(g, float(x), float(y), f"{i}") for i, (g, x, y) in enumerate(zip(r.integers(0, 3, 400), r.uniform(-10, 30, 400), r.uniform(-5, 50, 400), strict=True)) for g in [int(g)]]
    target = spark.createDataFrame(at, "g int, x double, y double, name string")
    turned = rasters.resample(target.select("g", F.col("y").alias("x"), F.col("x").alias("y"), "name"), source, "g", to_source=lambda x, y: (y, x))
    for out in (rasters.resample(target, source, "g"), turned):
        got = {x.name: x.value for x in out.collect()}
        for g, x, y, name in at:
            want = None
            if g in layers:
                a, x0, dx, y0, dy = layers[g]
                # the nearest pixel centre, along each axis
                v = a[np.abs(y0 + (np.arange(a.shape[0]) + 0.5) * dy - y).argmin(), np.abs(x0 + (np.arange(a.shape[1]) + 0.5) * dx - x).argmin()]
                want = None if np.isnan(v) else v
            assert got[name] == want


def test_filled_pieces_meet_in_tiles(spark, monkeypatch):
    """Tiles of any size give the same area and rings; a pixel that is there twice or missing leaves its four cells out; sides inside a tile are not sent."""
    r = np.random.default_rng(3)
    v = r.random((23, 19)) + np.hypot(*np.mgrid[-1:1:23j, -1:1:19j])
    rows = [(g, i - 2, j - 3, float(j), float(-i if g == "b" else i), float(v[i, j])) for g in "ab" for i in range(23) for j in range(19) if (i, j) != (9, 9)]
    rows += [r for r in rows if (r[1] + 2, r[2] + 3) == (4, 4)]
    grid = spark.createDataFrame(rows, "grid_id string, row int, col int, lon double, lat double, value double")
    found = []
    for tile in (256, 5, 1):
        monkeypatch.setattr(geometry, "_TILE", tile)
        area = {x.grid_id: x.area for x in geometry.filled_area(grid, 0.9).collect()}
        rings = geometry.filled_rings(grid, 0.9)
        plain = geometry.stitched_rings(geometry.filled_cells(grid, 0.9))
        rings, plain = (sorted((x.grid_id, x.hole, sorted((round(p.x, 6), round(p.y, 6)) for p in x.ring)) for x in t.collect()) for t in (rings, plain))
        assert rings == plain and len(rings) > 6
        found.append((rings, {k: round(a, 9) for k, a in area.items()}))
        sides = geometry._filled_sides(grid, 0.9, 9).count()
        if tile == 256:
            assert sides == sum(len(p) for *_, p in rings)
    assert found[0] == found[1] == found[2]
    cells = {(x.row, x.col) for x in geometry.filled_cells(grid, 9.0).where("grid_id = 'a'").collect()}
    assert len(cells) == 22 * 18 - 8
