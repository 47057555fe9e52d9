"""Overlay and spatial join against counting cells, clipping triangles, and all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import overlay

RING = "array<struct<x:double,y:double>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def staircase(r, n):
    """A simple polygon on whole numbers: two rising staircases; and its unit cells."""
    cols = sorted(r.sample(range(0, 40), n))
    low = sorted(r.sample(range(0, 30), n - 1))
    high = [v + r.randint(1, 8) for v in low]
    for i in range(1, n - 1):
        high[i] = max(high[i], high[i - 1])
    up = [(x, v) for i, v in enumerate(low) for x in cols[i : i + 2]]
    down = [(x, v) for i, v in enumerate(high) for x in cols[i : i + 2]][::-1]
    cells = {(x, y) for i in range(n - 1) for x in range(cols[i], cols[i + 1]) for y in range(low[i], high[i])}
    return up + down, cells


def convex_clip(a, b):
    """Area of the part of triangle a inside triangle b (both counter-clockwise), by clipping."""
    out = list(a)
    for (x0, y0), (x1, y1) in zip(b, b[1:] + b[:1], strict=True):
        side = lambda p: (x1 - x0) * (p[1] - y0) - (y1 - y0) * (p[0] - x0)  # noqa: B023, E731
        part = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            if side(p) >= 0:
                part.append(p)
            if (side(p) >= 0) != (side(q) >= 0):
                t = side(p) / (side(p) - side(q))
                part.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = part
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1], strict=True))) / 2 if len(out) > 2 else 0.0


def triangle(r):
    t = [(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(3)]
    return t if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(t, t[1:] + t[:1], strict=True)) > 0 else t[::-1]


@pytest.mark.parametrize(("edges", "strips", "at_once"), [(4096, 1024, 1 << 20), (10, 16, 30)])
def test_overlapping_parts_and_holes_count_cells(spark, monkeypatch, edges, strips, at_once):
    for name, v in (("EDGES", edges), ("STRIPS", strips), ("AT_ONCE", at_once)):
        monkeypatch.setattr(overlay, name, v)
    r, rows, want = random.Random(3), [], {}
    for k in range(25):
        cells = {"a": set(), "b": set()}
        for side in "ab":
            for _ in range(r.choice((0, 1, 3, 6))):
                points, own = staircase(r, r.randint(3, 9))
                rows.append((k, f"g{k % 3}" if k else None, side, r.choice((None, False)), ring(points if r.random() < 0.5 else points[::-1] + points[-1:])))
                cells[side] |= own
        if k % 5 == 4:  # a hole in a part of its own, part of it covered by others
            rows += [(k, f"g{k % 3}", "a", h, ring([(x, y), (w, y), (w, z), (x, z)])) for h, x, y, w, z in ((False, 100, 0, 120, 20), (True, 105, 5, 115, 15), (False, 110, 0, 130, 9))]
            cells["a"] |= {(x, y) for x in range(100, 130) for y in range(20) if (x < 120 and not (105 <= x < 115 and 5 <= y < 15)) or (x >= 110 and y < 9)}
        want[k] = (len(cells["a"]), len(cells["b"]), len(cells["a"] & cells["b"]), len(cells["a"] | cells["b"]))
    rows += [(99, "x", "a", False, ring([(0, 0), (1, 1)])), (99, "x", "b", False, []), (99, "x", "b", False, None)]
    df = spark.createDataFrame(rows, f"k int, name string, side string, hole boolean, ring {RING}")
    got = {x.k: x for x in overlay.overlay(df, "k", "name").collect()}
    assert set(got) == {k for k, w in want.items() if w[3]}
    for k, x in got.items():
        assert (x.area_a, x.area_b, x.area_both, x.area_union) == pytest.approx(want[k], abs=1e-9)
        assert x.jaccard == pytest.approx(want[k][2] / want[k][3]) and x.dice == pytest.approx(2 * want[k][2] / (want[k][0] + want[k][1]))


def test_crossing_triangles(spark, monkeypatch):
    r = random.Random(1)
    pairs = [(triangle(r), triangle(r)) for _ in range(200)]
    want = [convex_clip(a, b) for a, b in pairs]
    assert overlay.shared_areas(pairs) == pytest.approx(want, abs=1e-9)
    assert overlay.shared_areas([(a[::-1], b) for a, b in pairs]) == pytest.approx(want, abs=1e-9)
    # three triangles on a side: union by inclusion and exclusion of pairs is not enough, so count points of a fine grid
    sides = [[triangle(r) for _ in range(4)] for _ in range(2)]
    df = spark.createDataFrame([("k", s, False, ring(t)) for s, ts in zip("ab", sides, strict=True) for t in ts], f"k string, side string, hole boolean, ring {RING}")
    x, y = np.meshgrid(np.arange(0.005, 10, 0.01), np.arange(0.005, 10, 0.01))
    within = lambda t: np.all([(q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0 for p, q in zip(t, t[1:] + t[:1], strict=True)], axis=0)
    a, b = (np.any([within(t) for t in ts], axis=0) for ts in sides)
    for edges in (4096, 2):
        monkeypatch.setattr(overlay, "EDGES", edges)
        got = overlay.overlay(df, "k").first()
        assert (got.area_a, got.area_b, got.area_both) == pytest.approx([m.mean() * 100 for m in (a, b, a & b)], abs=0.05)


def test_a_large_shape_is_swept_in_strips(spark):
    n = 30_000
    angle = F.col("id") * (2 * np.pi / n)
    star = spark.range(n).select(F.struct((F.cos(angle) * (1 + 0.1 * F.sin(9 * angle))).alias("x"), (F.sin(angle) * (1 + 0.1 * F.sin(9 * angle))).alias("y")).alias("p"), "id")
    rings = star.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda s: s["p"]).alias("ring"))
    moved = F.transform("ring", lambda p: F.struct((p["x"] + 0.5).alias("x"), p["y"].alias("y")))
    df = rings.select(F.lit("k").alias("k"), F.lit("a").alias("side"), F.lit(False).alias("hole"), "ring")
    df = df.unionByName(df.withColumn("side", F.lit("b"))).unionByName(df.withColumn("ring", moved))
    strips = overlay._strips(overlay._edges(df, ["k"]), ["k"])
    sizes = [x["count"] for x in strips.groupBy("strip").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 2 * overlay.EDGES
    got = overlay.overlay(df, "k").first()
    assert got.area_b == pytest.approx(np.pi * 1.005, rel=1e-5) and got.area_both == pytest.approx(got.area_b, rel=1e-9)
    assert got.area_b < got.area_a < 2 * got.area_b


def test_layers_without_a_common_key(spark):
    r = random.Random(7)

    def layer(n, sizes):
        out = []
        for i in range(n):
            x, y, s = r.uniform(-50, 50), r.uniform(-50, 50), r.choice(sizes)
            out.append((i, [(x + r.uniform(-s, s), y + r.uniform(-s, s)) for _ in range(3)]))
        return out

    left, right = layer(250, (0.5, 2, 2, 40)), layer(220, (0.01, 1, 3, 9))
    left.append((1000, [(0, 0), (0, 0), (0, 0)]))
    right.append((1000, [(0, 0), (1, 0), (0, 1)]))
    right.append((1001, [(32, 32), (64, 32), (64, 64), (32, 64)]))
    frames = [spark.createDataFrame([(i, ring(p)) for i, p in rows] + [(5000, None), (5001, [])], f"{n} int, ring {RING}") for rows, n in ((left, "l_id"), (right, "r_id"))]
    box = lambda p: (min(x for x, _ in p), max(x for x, _ in p), min(y for _, y in p), max(y for _, y in p))
    boxes = [(a, b) for a, p in left for b, q in right for u, v in [(box(p), box(q))] if u[0] <= v[1] and v[0] <= u[1] and u[2] <= v[3] and v[2] <= u[3]]
    got = [tuple(x) for x in overlay.spatial_join(*frames, "l_id", "r_id", exact=False).collect()]
    assert sorted(got) == sorted(boxes) and len(set(got)) == len(got) > 300
    of = lambda t: t if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(t, t[1:] + t[:1], strict=True)) > 0 else t[::-1]
    shared = {(a, b): convex_clip(of(dict(left)[a]), of(dict(right)[b])) for a, b in boxes}
    exact = {tuple(x) for x in overlay.spatial_join(*frames, "l_id", "r_id").collect()}
    assert {k for k, v in shared.items() if v > 1e-9} <= exact <= set(boxes) and (1000, 1000) in exact
    assert all(overlay.rings_meet(np.array(dict(left)[a]), np.array(dict(right)[b])) == ((a, b) in exact) for a, b in boxes)
    areas = {(x.l_id, x.r_id): x.area_both for x in overlay.layer_overlap(*frames, "l_id", "r_id").collect()}
    assert areas == pytest.approx({k: v for k, v in shared.items() if k in areas}) and {k for k, v in shared.items() if v > 1e-9} <= set(areas)


def test_rings_meet():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    meets = lambda p: overlay.rings_meet(square, np.array(p, float))
    assert meets([(1, 1), (2, 1), (1, 2)]) and meets([(-9, -9), (9, -9), (9, 9), (-9, 9)])  # one inside the other
    assert meets([(4, 4), (5, 4), (5, 5)]) and meets([(4, 1), (6, 1), (6, 3)]) and meets([(2, 4), (2, 9), (1, 9)])  # corner, side, point on a side
    assert not meets([(4.1, 0), (5, 0), (5, 9)]) and not meets([(5, 5), (6, 5), (5, 6)])


def test_pruned_bands_have_the_areas_of_the_whole():
    """Boxes, triangles and holes on each other: bands without deep edges give the same areas, from far fewer edges beside each other."""
    r = np.random.default_rng(2)
    for holes, corners in ((0, 4), (40, 4), (0, 3), (40, 3)):
        n = 1200
        low, size = r.random((n, 2)) * 100, r.random((n, 2)) * 12 + 4
        if corners == 4:
            x, y = (np.stack([low[:, k] + size[:, k] * c for c in part], axis=1).ravel() for k, part in ((0, (0, 1, 1, 0)), (1, (0, 0, 1, 1))))
        else:
            x, y = (np.stack([low[:, k] + size[:, k] * r.random(n) for _ in range(3)], axis=1).ravel() for k in (0, 1))
        ring, edge, turn = overlay.ring_edges(x, y, np.full(n, corners))
        turn = np.where(ring < holes, -turn, turn)
        second = ring % 3 == 0
        zero = np.zeros(len(ring), np.int64)
        want = overlay.sweep(zero, second, edge, turn, 1)
        assert overlay.pruned_sweep(zero, second, edge, turn, 1)[0] == pytest.approx(want[0], rel=1e-9)
        work = lambda e: np.subtract(*(np.searchsorted(np.unique(e[[1, 3]]), e[i]) for i in (3, 1))).sum()
        parts = list(overlay.pruned(edge, second, turn))
        if corners == 4:
            deep = [np.concatenate([v] * 8, axis=-1) for v in (edge, second, turn)]
            deep[0] = deep[0] + np.repeat(r.random(8), edge.shape[1]) * [[1], [0], [1], [0]] + np.repeat(r.random(8), edge.shape[1]) * [[0], [1], [0], [1]]
            eight = sum(work(e) for e, *_ in overlay.pruned(*deep))
            assert eight < 0.1 * work(deep[0]) and len(parts) > 10


def test_layer_overlap_sweeps_pairs_where_they_meet(spark, monkeypatch):
    """Sides of short rings are not dealt out again; long rings go through strips, with the same areas."""
    r = random.Random(6)

    def layer(name, n):
        rows = []
        for i in range(n):
            x, y, w, h = r.uniform(0, 20), r.uniform(0, 20), r.uniform(1, 4), r.uniform(1, 4)
            ring = [(x, y), (x + w, y + h / 3), (x + w, y + h), (x, y + h / 2)]
            rows.append((i, ring[::-1] if i % 2 else ring))
        return spark.createDataFrame(rows, f"{name} int, ring array<struct<x:double,y:double>>")

    a, b = layer("p", 40), layer("q", 50)
    got = []
    for edges in (4096, 7):
        monkeypatch.setattr(overlay, "EDGES", edges)
        out = overlay.layer_overlap(a, b, "p", "q")
        got.append(sorted(tuple(round(v, 9) for v in x) for x in out.collect()))
        assert ("Generate explode(arrays_zip" in out._jdf.queryExecution().optimizedPlan().toString()) == (edges == 7)
    assert got[0] == got[1] and len(got[0]) > 40 and out.columns == ["p", "q", "area_a", "area_b", "area_both", "area_union", "jaccard", "dice"]
