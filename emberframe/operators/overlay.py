"""Overlay of polygon layers whose parts may overlap, and joins of layers by place.

Areas come from a sweep: between neighbouring heights of vertices and of crossings edges are straight and do not cross, so every stretch
between two of them is a trapezoid, inside a layer where the layer's edges wind around it. Large shapes are cut into strips of some
EDGES edges each, at heights taken from the edges' own distribution, and strips are spread over tasks. Small shapes are swept many at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.session import portable

portable(__name__)
#: Edges of a strip, edges in slabs that are swept at once, and strips of one shape at most.
EDGES, AT_ONCE, STRIPS = 4096, 1 << 20, 1024
#: Edges that begin or end in a band of ``pruned``.
LEAF = 48


def _x(y: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where edges (rows x0, y0, x1, y1) are at heights y."""
    x0, y0, x1, y1 = edge
    return x0 + (y - y0) / (y1 - y0) * (x1 - x0)


def _widths(x: np.ndarray, turn: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Stretches between neighbours of each line of sorted x that are inside the first layer, the second, and both."""
    first, other = (np.cumsum(np.where(second == s, turn, 0), axis=-1)[..., :-1] > 0 for s in (False, True))
    step = np.diff(x, axis=-1)
    return [step * first, step * other, step * (first & other)]


def sweep(group: np.ndarray, second: np.ndarray, edge: np.ndarray, turn: np.ndarray, groups: int) -> np.ndarray:
    """Areas of the first layer, the second and what they share (three columns), for each group.

    Edges are rows x0, y0, x1, y1 with y0 < y1; ``second`` tells the layer, ``turn`` is +1 where the inside lies to the right of the
    edge and -1 where it lies to the left. A layer is where turns from the left add up to more than 0.
    """
    area, n = np.zeros((groups, 3)), len(group)
    if not n:
        return area
    heights, owner = np.concatenate([edge[1], edge[3]]), np.concatenate([group, group])
    order = np.lexsort((heights, owner))
    fresh = np.concatenate([[True], (np.diff(heights[order]) != 0) | (np.diff(owner[order]) != 0)])
    level = np.empty(2 * n, np.int64)
    level[order] = np.cumsum(fresh) - 1
    y, of = heights[order][fresh], owner[order][fresh]
    low, high = level[:n], level[n:]
    active = np.cumsum(np.bincount(low, minlength=len(y)) - np.bincount(high, minlength=len(y)))
    total = np.concatenate([[0], np.cumsum(active)])
    start = 0
    while start < len(y) - 1:
        end = max(start + 1, int(np.searchsorted(total, total[start] + AT_ONCE, "right")) - 1)
        end = min(end, len(y) - 1)
        own = np.flatnonzero((low < end) & (high > start))
        a, b = np.maximum(low[own], start), np.minimum(high[own], end)
        e = np.repeat(own, b - a)
        slab = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(int((b - a).sum()))
        bottom, top = _x(y[slab], edge[:, e]), _x(y[slab + 1], edge[:, e])
        order = np.lexsort((top, bottom, slab))
        e, slab, bottom, top = e[order], slab[order], bottom[order], top[order]
        same = slab[1:] == slab[:-1]
        crossed = np.unique(slab[1:][same & (top[1:] < top[:-1] - 1e-12 * (1 + np.abs(top[1:])))])
        # every slab's turns add up to 0, so one running sum serves all of them
        widths = _widths((bottom + top) / 2, turn[e], second[e])
        plain = same & ~np.isin(slab[1:], crossed)
        for k in range(3):
            area[:, k] += np.bincount(of[slab[1:]][plain], (widths[k] * (y[slab + 1] - y[slab])[1:])[plain], groups)
        for s in crossed.tolist():
            i, j = np.searchsorted(slab, [s, s + 1])
            area[of[s]] += _crossed(edge[:, e[i:j]], turn[e[i:j]], second[e[i:j]], bottom[i:j], top[i:j], y[s], y[s + 1])
        start = end
    return area


def _crossed(edge: np.ndarray, turn: np.ndarray, second: np.ndarray, bottom: np.ndarray, top: np.ndarray, y0: float, y1: float) -> np.ndarray:
    """Areas of one slab whose edges cross: it is cut at the crossings."""
    cuts = [np.array([0.0, 1.0])]
    for i in range(len(bottom) - 1):  # edges are sorted by where they begin
        behind = np.flatnonzero(top[i + 1 :] < top[i]) + i + 1
        gap = bottom[behind] - bottom[i]
        cuts.append(gap / (gap + top[i] - top[behind]))
    t = np.unique(np.concatenate(cuts))
    out = np.zeros(3)
    for k in range(0, len(t) - 1, max(1, AT_ONCE // len(bottom))):
        part = t[k : k + max(1, AT_ONCE // len(bottom)) + 1]
        x = bottom + ((part[1:] + part[:-1]) / 2)[:, None] * (top - bottom)
        order = np.argsort(x, axis=1)
        widths = _widths(np.take_along_axis(x, order, 1), turn[order], second[order])
        out += [(w.sum(axis=1) * np.diff(part) * (y1 - y0)).sum() for w in widths]
    return out


def pruned(edge: np.ndarray, second: np.ndarray, turn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edges of one group cut into bands whose areas add up to the group's, without those that lie deep inside their layer (edge, second, turn of each band).

    A band is halved while more than LEAF edges begin or end in it. Of the edges that run through it, a layer's are taken together where the layer is at least one turn deeper than
    the others could take away: there it is full, whatever they do. What they turn is added to the last of them. So where many parts lie on
    each other the work follows the number of edges, not that of all edges beside each other at every height.
    """
    todo = [(edge[1].min(), edge[3].max(), edge, second, turn)]
    while todo:
        lo, hi, e, s, t = todo.pop()
        at = lambda y, e=e: np.where(y == e[1], e[0], np.where(y == e[3], e[2], _x(y, e)))
        bottom, top = np.maximum(e[1], lo), np.minimum(e[3], hi)
        e = np.stack([at(bottom), bottom, at(top), top])
        through = (bottom == lo) & (top == hi)
        keep = np.ones(len(s), bool)
        t = t.copy()
        for layer in (False, True):
            own = np.flatnonzero(through & (s == layer))
            away = -np.minimum(t[~through & (s == layer)], 0).sum()
            own = own[np.lexsort((e[2, own], e[0, own]))]
            if len(own) < 3 or (np.diff(e[2, own]) < 0).any():
                continue
            full = np.cumsum(t[own]) > away
            inner = np.flatnonzero(full[1:-1] & full[:-2]) + 1  # full on both sides
            if len(inner):
                # the next edge that stays takes over what those before it turn
                stays = np.ones(len(own), bool)
                stays[inner] = False
                run = np.cumsum(t[own])[stays]
                t[own[stays]] = np.diff(run, prepend=0)
                keep[own[inner]] = False
        ends = np.unique(np.concatenate([bottom[bottom > lo], top[top < hi]]))
        e, s, t = e[:, keep], s[keep], t[keep]
        if len(ends) < 2 or (~through).sum() <= LEAF:
            yield e, s, t
            continue
        middle = ends[len(ends) // 2]
        for a, b in ((lo, middle), (middle, hi)):
            part = (e[1] < b) & (e[3] > a)
            if part.any():
                todo.append((a, b, e[:, part], s[part], t[part]))


def pruned_sweep(group: np.ndarray, second: np.ndarray, edge: np.ndarray, turn: np.ndarray, groups: int) -> np.ndarray:
    """``sweep`` of edges sorted by group, where groups of many edges are pruned first."""
    size = np.bincount(group, minlength=groups)
    ends, of, parts = np.cumsum(size), [], []
    for g in np.flatnonzero(size > 8 * LEAF).tolist():
        i, j = ends[g] - size[g], ends[g]
        for part in pruned(edge[:, i:j], second[i:j], turn[i:j]):
            of.append(g)
            parts.append(part)
    small = size[group] <= 8 * LEAF
    if not parts:
        return sweep(group, second, edge, turn, groups)
    band = np.repeat(np.arange(len(parts)) + groups, [len(p[1]) for p in parts])
    got = sweep(np.concatenate([group[small], band]), np.concatenate([second[small], *(p[1] for p in parts)]), np.concatenate([edge[:, small], *(p[0] for p in parts)], axis=1), np.concatenate([turn[small], *(p[2] for p in parts)]), groups + len(parts))
    np.add.at(got, np.array(of), got[groups:])
    return got[:groups]


def ring_edges(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings' numbers, edges and turns for ``sweep``, of rings whose points follow each other; they turn one way, however they run."""
    ends = np.cumsum(sizes)
    ahead = np.arange(1, len(x) + 1)
    ahead[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    ring = np.repeat(np.arange(len(sizes)), sizes)
    clockwise = np.bincount(ring, x * y[ahead] - x[ahead] * y, len(sizes))[ring] < 0
    up, steep = y < y[ahead], y != y[ahead]
    low, high = np.where(up, np.arange(len(x)), ahead)[steep], np.where(up, ahead, np.arange(len(x)))[steep]
    return ring[steep], np.stack([x[low], y[low], x[high], y[high]]), np.where(up == clockwise, 1, -1)[steep]


def shared_areas(pairs: list[tuple[list, list]]) -> np.ndarray:
    """Areas that the two simple rings of each pair share; rings are lists of (x, y)."""
    sides = [[np.asarray(ring, float).reshape(-1, 2) for ring in side] for side in zip(*pairs, strict=True)] if pairs else [[], []]
    flat = [(*(np.concatenate([r[:, k] for r in side]) if side else np.zeros(0) for k in (0, 1)), np.array([len(r) for r in side], np.int64)) for side in sides]
    return shared_of(*flat, len(pairs))


def shared_of(first: tuple, second: tuple, n: int) -> np.ndarray:
    """Areas that rings share, number by number; each side is x and y of all points and the rings' sizes."""
    (r, e, t), (s, f, u) = ring_edges(*first), ring_edges(*second)
    return sweep(np.concatenate([r, s]), np.repeat([False, True], [len(r), len(s)]), np.concatenate([e, f], axis=1), np.concatenate([t, u]), n)[:, 2]


def _edges(rings: DataFrame, key: list[str]) -> DataFrame:
    """Edges that are not level: key, second, turn, x0, y0, x1, y1 with y0 < y1."""
    from emberframe.operators import geometry

    # what is exploded is worked out once a ring, columns beside it once an edge: so rings are turned first
    clockwise = geometry.ring_signed_area(F.col("ring")) < 0
    turned = F.when(clockwise != F.coalesce("hole", F.lit(False)), F.reverse("ring")).otherwise(F.col("ring"))
    ahead = F.concat(F.slice(turned, 2, F.size("ring")), F.slice(turned, 1, 1))
    sides = rings.where(F.size("ring") > 2).select(*key, (F.col("side") == "b").alias("second"), F.explode(F.arrays_zip(turned.alias("p"), ahead.alias("q"))).alias("s"))
    up = F.col("s.p.y") < F.col("s.q.y")
    end = lambda first, c: F.when(up == first, F.col(f"s.p.{c}")).otherwise(F.col(f"s.q.{c}")).cast("double")
    return sides.where("s.p.y <> s.q.y").select(*key, "second", F.when(up, -1).otherwise(1).alias("turn"), end(True, "x").alias("x0"), end(True, "y").alias("y0"), end(False, "x").alias("x1"), end(False, "y").alias("y1"))


def _strips(edges: DataFrame, key: list[str]) -> DataFrame:
    """Edges with the strip they are in; those of shapes of more than EDGES edges are cut where strips meet."""
    cuts = F.percentile_approx("y0", F.array(*[F.lit(k / STRIPS) for k in range(1, STRIPS)]), 10 * STRIPS)
    large = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("y0").alias("low"), F.max("y1").alias("high")).where(F.col("n") > EDGES)
    cut = edges.join(large.select(*key), key, "left_semi").groupBy(*key).agg(cuts.alias("cuts"), F.count("*").alias("n"), F.min("y0").alias("low"), F.max("y1").alias("high"))
    every = F.greatest(F.floor(F.lit(STRIPS) * EDGES / F.col("n")), F.lit(1))
    some = F.filter("cuts", lambda v, i: (i + 1) % every == 0)
    bounds = F.array_distinct(F.array_sort(F.concat(F.array("low"), some, F.array("high"))))
    placed = edges.join(cut.select(*key, bounds.alias("bounds")), key, "left")
    inside = F.filter(F.sequence(F.lit(1), F.size("bounds") - 1), lambda i: (F.element_at("bounds", i) < F.col("y1")) & (F.element_at("bounds", i + 1) > F.col("y0")))
    strips = placed.withColumn("strip", F.explode(F.when(F.col("bounds").isNull(), F.array(F.lit(0))).otherwise(inside)))
    lo, hi = (F.when(F.col("strip") > 0, F.element_at("bounds", F.greatest(F.col("strip"), F.lit(1)) + k)) for k in (0, 1))
    bottom, top = F.greatest("y0", lo), F.least("y1", hi)
    at = lambda y: F.when(y == F.col("y0"), F.col("x0")).when(y == F.col("y1"), F.col("x1")).otherwise(F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    return strips.select(*key, "strip", "second", "turn", at(bottom).alias("x0"), bottom.alias("y0"), at(top).alias("x1"), top.alias("y1"))


def group_starts(rows: pa.Table, k: int) -> np.ndarray:
    """Which rows begin a group: those unlike the row before in one of the first k columns; nulls are alike."""
    fresh = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        fresh[1:] = False
        for i in range(k):
            c = rows.column(i)
            a, b = c.slice(1), c.slice(0, rows.num_rows - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))  # noqa: FBT003
            fresh[1:] |= ~same.to_numpy()
    return fresh


def whole_groups(batches: Iterator[pa.RecordBatch], k: int, rows_at_once: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, of some ``rows_at_once`` rows or one group's, and which of their rows begin a group."""
    held: list[pa.RecordBatch] = []
    n, least = 0, rows_at_once
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        rows = pa.Table.from_batches(held)
        fresh = group_starts(rows, k)
        last = int(np.flatnonzero(fresh)[-1]) if n else 0
        if last:  # the last group may go on in the next batch
            yield rows.slice(0, last), fresh[:last]
            held = rows.slice(last).combine_chunks().to_batches()
            n = rows.num_rows - last
        # a group longer than that is looked at again once it has doubled
        least = max(rows_at_once, 2 * n if n >= rows_at_once else 0)
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield rows, group_starts(rows, k)


def overlay(rings: DataFrame, *key: str) -> DataFrame:
    """Areas of two layers of each key: area_a, area_b, area_both, area_union, jaccard, dice, in the units of the coordinates.

    rings: the key, side ('a' or 'b'), hole (null: false) and ring, an array of (x, y) structs, open or closed, run either way. Parts of one side may
    overlap each other: what they cover counts once. A hole takes away from one part that covers it. Rings of fewer than three points have no area; a key without
    one side shares nothing; without any area jaccard and dice are null.
    """
    keys = list(key)
    strips = _strips(_edges(rings, keys), keys).repartition(*keys, "strip").sortWithinPartitions(*keys, "strip")
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def areas(rows: pa.Table, fresh: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(fresh)
            edge = np.stack([rows.column(k + 3 + i).to_numpy() for i in range(4)])
            got = pruned_sweep(np.cumsum(fresh) - 1, rows.column(k + 1).to_numpy(), edge, rows.column(k + 2).to_numpy(), len(first))
            own = rows.select(range(k)).take(pa.array(first))
            return pa.Table.from_arrays([*own.columns, *(pa.array(got[:, i]) for i in range(3))], names=[*keys, "a", "b", "both"]).combine_chunks().to_batches()[0]

        for rows, fresh in whole_groups(batches, k + 1):
            yield areas(rows, fresh)

    types = dict(rings.dtypes)
    parts = strips.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keys), "a double, b double, both double"]))
    both = parts.groupBy(*keys).agg(F.sum("a").alias("area_a"), F.sum("b").alias("area_b"), F.sum("both").alias("area_both"))
    union = F.col("area_a") + F.col("area_b") - F.col("area_both")
    return with_scores(both.withColumn("area_union", union))


def with_scores(areas: DataFrame) -> DataFrame:
    """area_a, area_b and area_both with jaccard and dice."""
    union = F.col("area_a") + F.col("area_b") - F.col("area_both")
    return areas.withColumns({"jaccard": F.try_divide(F.col("area_both"), union), "dice": F.try_divide(2 * F.col("area_both"), F.col("area_a") + F.col("area_b"))})


def _box(ring: Column) -> dict[str, Column]:
    at = lambda f, c: f(F.transform(ring, lambda p: p[c].cast("double")))
    return {"west": at(F.array_min, "x"), "east": at(F.array_max, "x"), "south": at(F.array_min, "y"), "north": at(F.array_max, "y")}


def rings_meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two simple polygons (rows x, y) share a point: sides that cross or touch, or one inside the other."""
    a2, b2 = np.roll(a, -1, axis=0), np.roll(b, -1, axis=0)
    turn = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    between = lambda p, q, r: ((np.minimum(p, q) <= r) & (r <= np.maximum(p, q))).all(axis=-1)
    for i in range(0, len(a), 512):  # sides of a by sides of b
        p, q, r, s = a[i : i + 512, None], a2[i : i + 512, None], b[None], b2[None]
        o1, o2, o3, o4 = turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)
        touch = ((o1 == 0) & between(p, q, r)) | ((o2 == 0) & between(p, q, s)) | ((o3 == 0) & between(r, s, p)) | ((o4 == 0) & between(r, s, q))
        if (touch | ((o1 * o2 < 0) & (o3 * o4 < 0))).any():
            return True

    def inside(point: np.ndarray, ring: np.ndarray, ahead: np.ndarray) -> bool:
        spans = (ring[:, 1] <= point[1]) != (ahead[:, 1] <= point[1])
        r, s = ring[spans], ahead[spans]
        return bool((r[:, 0] + (point[1] - r[:, 1]) / (s[:, 1] - r[:, 1]) * (s[:, 0] - r[:, 0]) < point[0]).sum() % 2)

    return inside(a[0], b, b2) or inside(b[0], a, a2)


def spatial_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, exact: bool = True) -> DataFrame:
    """Pairs (left_id, right_id) of polygons of two layers that share a point; with ``exact`` false, those whose boxes do.

    Both layers have an id that is theirs alone and ``ring``, an array of (x, y) structs. Each polygon takes a place in a pyramid of grids by
    its size: cells of a level are at least as wide as its polygons, which cover four cells at most. Two polygons meet at the coarser of their levels, in the
    cell that holds the lower left corner of what their boxes share, so no pair is listed twice. Only ids and boxes travel; rings are fetched for
    the pairs whose boxes meet. Null and empty rings meet nothing.
    """
    boxes = [d.select(F.col(i).alias(n), *[c.alias(k) for k, c in _box(F.col("ring")).items()]).where("west is not null and south is not null") for d, i, n in ((left, left_id, "l"), (right, right_id, "r"))]
    size = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    # two numbers for each layer: sizes below 2**-20 of the largest share the finest level
    largest = max([r[0] or 0.0 for r in (b.agg(F.max(size)).first() for b in boxes)]) or 1.0
    top = int(np.ceil(np.log2(largest)))
    level = F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(largest * 2.0**-20)))), F.lit(top - 20)).cast("int")
    levels = [sorted(r[0] for r in b.select(level.alias("v")).distinct().collect()) for b in boxes]  # 21 at most

    def dealt(b: DataFrame, others: list[int]) -> DataFrame:
        own = b.withColumn("level", level)
        at = F.array_distinct(F.concat(F.array("level"), F.filter(F.array(*[F.lit(v) for v in others]).cast("array<int>"), lambda v: v > F.col("level"))))
        rows = own.withColumn("at", F.explode(at)).withColumn("w", F.pow(F.lit(2.0), F.col("at")))
        cell = lambda a, z: F.sequence(F.floor(F.col(a) / F.col("w")), F.floor(F.col(z) / F.col("w")))
        return rows.withColumn("cx", F.explode(cell("west", "east"))).withColumn("cy", F.explode(cell("south", "north")))

    a, b = dealt(boxes[0], levels[1]).alias("a"), dealt(boxes[1], levels[0]).alias("b")
    low = lambda c: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / F.col("a.w"))
    meet = (F.col("a.west") <= F.col("b.east")) & (F.col("b.west") <= F.col("a.east")) & (F.col("a.south") <= F.col("b.north")) & (F.col("b.south") <= F.col("a.north"))
    once = (F.greatest("a.level", "b.level") == F.col("a.at")) & (low("west") == F.col("a.cx")) & (low("south") == F.col("a.cy"))
    same = (F.col("a.at") == F.col("b.at")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    pairs = a.join(b, same & meet & once).select("l", "r")
    if exact:

        @F.pandas_udf("boolean")
        def touching(p: pd.Series, q: pd.Series) -> pd.Series:
            points = lambda ring: np.array([(v["x"], v["y"]) for v in ring], float)
            return pd.Series([rings_meet(points(x), points(y)) for x, y in zip(p, q, strict=True)])

        rings = [d.select(F.col(i).alias(n), F.col("ring").alias(f"ring_{n}")) for d, i, n in ((left, left_id, "l"), (right, right_id, "r"))]
        pairs = pairs.join(rings[0], "l").join(rings[1], "r").where(touching("ring_l", "ring_r")).select("l", "r")
    return pairs.select(F.col("l").alias(left_id), F.col("r").alias(right_id))


def layer_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs of polygons of two layers that share an area, with area_a, area_b, area_both, area_union, jaccard and dice.

    Where the two rings of a pair have EDGES points at most they are swept where they meet, many pairs at once; pairs of longer rings go through ``overlay``.
    """
    pairs = spatial_join(left, right, left_id, right_id, exact=False)
    both = pairs
    for d, i, n in ((left, left_id, "_a"), (right, right_id, "_b")):
        both = both.join(d.select(i, F.col("ring").alias(n)), i)

    @F.pandas_udf("area_a double, area_b double, area_both double")
    def areas(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
        side = lambda x, y: ring_edges(np.concatenate(x.to_list()), np.concatenate(y.to_list()), x.map(len).to_numpy())
        (r, e, t), (s, f, u) = (side(ax, ay), side(bx, by)) if len(ax) else [(np.zeros(0, np.int64), np.zeros((4, 0)), np.zeros(0, np.int64))] * 2
        got = sweep(np.concatenate([r, s]), np.repeat([False, True], [len(r), len(s)]), np.concatenate([e, f], axis=1), np.concatenate([t, u]), len(ax))
        return pd.DataFrame(got, columns=["area_a", "area_b", "area_both"])

    along = lambda ring, c: F.transform(ring, lambda p: p[c].cast("double"))
    small = F.size("_a") + F.size("_b") <= EDGES
    swept = both.where(small).select(left_id, right_id, areas(*[along(F.col(ring), c) for ring in ("_a", "_b") for c in "xy"]).alias("v")).select(left_id, right_id, "v.*")
    union = F.col("area_a") + F.col("area_b") - F.col("area_both")
    out = with_scores(swept.withColumn("area_union", union))
    # one number a layer: the longest ring
    if sum(d.agg(F.max(F.size("ring"))).first()[0] or 0 for d in (left, right)) > EDGES:
        sides = [both.where(~small).select(left_id, right_id, F.lit(s).alias("side"), F.lit(False).alias("hole"), F.col(n).alias("ring")) for n, s in (("_a", "a"), ("_b", "b"))]
        out = out.unionByName(overlay(sides[0].unionByName(sides[1]), left_id, right_id))
    return out.where("area_both > 0")
