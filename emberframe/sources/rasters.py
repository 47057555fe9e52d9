"""Rasters as long tables: coordinates by an affine transform, windows by box, fill values as NULL.

Pixels come from arrays of rows: ``read_npy`` decodes NumPy files in tasks, ``geotiff`` GeoTIFF ones.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberframe.session import portable

portable(__name__)
# Products, the standard name of their values, and the fill value that the product itself names.
PRODUCTS = {
    "mtbs": ("fire_burn_severity", 0), "landfire": ("fuel_class", None), "ravg_cc": ("ravg_canopy_cover_loss", 0),
    "ravg_cbi": ("ravg_composite_burn_index_severity", 0), "ravg_ba": ("ravg_live_basal_area_loss", 0),
}


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """grid_id (the file) and one row of pixels per row: row, values."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                for start in range(0, len(a), 512):
                    part = a[start : start + 512].astype(float)
                    yield pd.DataFrame({"grid_id": name, "row": np.arange(start, start + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "grid_id string, row long, values array<double>")


def to_grid(rows: DataFrame, origin: tuple[float, float], step: tuple[float, float], fill: float | None = None, nodata: float | None = None) -> DataFrame:
    """Long table grid_id, row, col, x, y, value of pixel rows; x and y are the pixels' upper left corners.

    ``fill`` overrides ``nodata``; both become NULL when given as the value.
    """
    missing = fill if fill is not None else nodata
    long = rows.select("grid_id", "row", F.posexplode("values").alias("col", "v"))
    value = F.nanvl(F.col("v").cast("double"), F.lit(None))
    value = value if missing is None else F.when(value != missing, value)
    return long.select("grid_id", "row", F.col("col").cast("long").alias("col"), (F.col("col") * step[0] + origin[0]).alias("x"), (F.col("row") * step[1] + origin[1]).alias("y"), value.alias("value"))


def standardize(rows: DataFrame, product: str, origin: tuple[float, float], step: tuple[float, float], nodata: float | None = None) -> DataFrame:
    """A product's grid with its standard name as the value column."""
    name, fill = PRODUCTS[product]
    return to_grid(rows, origin, step, fill, nodata).withColumnRenamed("value", name)


def window(grid: DataFrame, west: float, south: float, east: float, north: float, x: str = "x", y: str = "y") -> DataFrame:
    """The pixels in a box; on Parquet the bounds reach the scan."""
    return grid.where(F.col(x).between(west, east) & F.col(y).between(south, north))


def canopy_loss(severity: Column, *layers: Column) -> Column:
    """Masked canopy loss: 1 for class 5, 0 for classes 1 to 4, NULL elsewhere or where a layer is not positive."""
    ok = F.lit(True)
    for layer in layers:
        ok = ok & F.coalesce(layer > 0, F.lit(False))
    return F.when(ok & (severity == 5), 1).when(ok & severity.between(1, 4), 0)


def damage_burnt(damage: Column) -> Column:
    """Building damage as burnt or not: Major and Destroyed burn, Inaccessible is unknown."""
    return F.when(damage.startswith("Inaccessible"), None).when(damage.isNotNull(), damage.startswith("Major") | damage.startswith("Destroyed"))


#: Grid points of a box that a row of ``nearest_cell`` holds at once, or some more.
_BUNDLE = 256


def nearest_cell(points: DataFrame, grid: DataFrame, size: float, point_id: str = "point_id", x: str = "x", y: str = "y") -> DataFrame:
    """points and the value of the nearest grid point within ``size``: an equi-join on boxes of that size; of equally near ones the least (x, y, value).

    Points fall into one box, grid points into nine, so near pairs always meet. A box's grid points come in bundles of _BUNDLE at most, and each point
    picks the nearest of a bundle where it meets it, so what is left to be grouped is a row for each point and bundle. Points without a grid point
    within ``size`` have NULL.
    """
    box = lambda c: F.floor(F.col(c) / size).cast("long")
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    known = grid.select(F.col(x).alias("gx"), F.col(y).alias("gy"), "value", box(x).alias("hx"), box(y).alias("hy"))
    # grid points of a box are dealt to as many bundles as they fill
    filled = known.groupBy("hx", "hy").agg(F.ceil(F.count("*") / _BUNDLE).alias("parts"))
    dealt = known.join(filled, ["hx", "hy"]).withColumn("part", F.pmod(F.xxhash64("gx", "gy", "value"), F.col("parts")))
    g = dealt.groupBy("hx", "hy", "part").agg(F.collect_list(F.struct("gx", "gy", "value")).alias("bundle")).withColumn("n", near)
    g = g.select((F.col("hx") + F.col("n.i")).alias("_bx"), (F.col("hy") + F.col("n.j")).alias("_by"), "bundle")
    p = points.select(F.col(point_id).alias("_id"), F.col(x).alias("_px"), F.col(y).alias("_py"), box(x).alias("_bx"), box(y).alias("_by"))
    d2 = lambda v: (v["gx"] - F.col("_px")) * (v["gx"] - F.col("_px")) + (v["gy"] - F.col("_py")) * (v["gy"] - F.col("_py"))
    # least distances first: only equally near grid points become rows of their own
    met = p.join(g, ["_bx", "_by"]).withColumn("_m", F.array_min(F.transform("bundle", d2))).where(F.col("_m") <= size * size)
    least = F.array_min(F.filter("bundle", lambda v: d2(v) == F.col("_m")))
    best = met.select("_id", F.struct(F.col("_m").alias("d2"), least.alias("g")).alias("b")).groupBy("_id").agg(F.min("b").alias("b"))
    return points.join(best.select(F.col("_id").alias(point_id), F.col("b.g.value").alias("value"), F.sqrt("b.d2").alias("distance")), point_id, "left")


def resample(target: DataFrame, source: DataFrame, *key: str, value: str = "value", to_source: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """target (key, x, y of pixel centres, and more) with ``value``: that of the source pixel that holds the point, or of the one nearest to it at the raster's edge.

    source: rows of pixels (key, x0, dx, y0, dy, width, height, row, values, and col where rows are pieces), as GeoTIFF sources give them. The
    pixel follows from the raster's placing by arithmetic, so points meet pixels by an equi-join on row and column, however unlike the spacings are.
    ``to_source`` projects a target's x and y into the source's coordinates. Targets whose key has no raster get NULL.
    """
    placing = source.groupBy(*key).agg(*[F.first(c).alias(f"_{c}") for c in ("x0", "dx", "y0", "dy", "width", "height")])
    x, y = to_source(F.col("x"), F.col("y")) if to_source else (F.col("x"), F.col("y"))
    place = lambda v, start, step, n: F.greatest(F.least(F.floor((v - F.col(start)) / F.col(step)), F.col(n) - 1), F.lit(0)).cast("long")
    points = target.join(placing, list(key), "left").withColumns({"_row": place(y, "_y0", "_dy", "_height"), "_col": place(x, "_x0", "_dx", "_width")})
    first = F.col("col") if "col" in source.columns else F.lit(0)
    pixels = source.select(*key, F.col("row").alias("_row"), first.alias("_first"), F.posexplode("values").alias("_k", "_v")).select(*key, "_row", (F.col("_first") + F.col("_k")).cast("long").alias("_col"), F.nanvl(F.col("_v").cast("double"), F.lit(None)).alias(value))
    return points.join(pixels, [*key, "_row", "_col"], "left").select(*target.columns, value)


#: Cells of the coarsest grid that ``nearest`` begins with, and how much narrower those of the next are.
_FIRST, _NARROWER = 64, 4


def nearest(points: DataFrame, grid: DataFrame, point_id: str = "point_id", x: str = "x", y: str = "y") -> DataFrame:
    """points and the value and distance of the nearest grid point, however far away; of equally near ones the least (x, y, value).

    Grid points lie in a pyramid of cells. All points descend it at once: a point keeps the cells that are not farther away than the farthest corner of its
    nearest one, then looks at the cells inside them that hold anything. Levels grow with the logarithm of the grid's extent over its spacing.
    Points without coordinates, and all points where the grid is empty, have NULL. ``point_id`` tells points apart.
    """
    known = grid.select(F.col(x).cast("double").alias("gx"), F.col(y).cast("double").alias("gy"), "value").where("gx is not null and gy is not null")
    e = known.agg(F.min("gx"), F.max("gx"), F.min("gy"), F.max("gy"), F.count("*")).first()
    none = points.withColumns({"value": F.lit(None).cast(known.schema["value"].dataType), "distance": F.lit(None).cast("double")})
    if not e[4]:
        return none
    extent = max(e[1] - e[0], e[3] - e[2]) or 1.0
    sizes = [extent / (int(_FIRST**0.5) - 1)]
    while sizes[-1] > extent / e[4] ** 0.5:
        sizes.append(sizes[-1] / _NARROWER)
    corner = lambda c, low, size: F.floor((F.col(c) - low) / size).cast("long")
    cells = [known.select(corner("gx", e[0], size).alias("cx"), corner("gy", e[2], size).alias("cy")).distinct() for size in sizes]
    # up to _FIRST cells begin, as a literal
    first = [(int(r[0]), int(r[1])) for r in cells[0].collect()]
    at = points.select(F.col(point_id).alias("p"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where("px is not null and py is not null")
    held = at.withColumn("c", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("cx"), F.lit(b).cast("long").alias("cy")) for a, b in first]))).select("p", "px", "py", "c.cx", "c.cy")

    def pruned(held: DataFrame, size: float) -> DataFrame:
        gap = lambda v, c, low: F.greatest(F.lit(low) + F.col(c) * size - F.col(v), F.col(v) - (F.lit(low) + (F.col(c) + 1) * size), F.lit(0.0))
        far = lambda v, c, low: F.greatest(F.abs(F.lit(low) + F.col(c) * size - F.col(v)), F.abs(F.lit(low) + (F.col(c) + 1) * size - F.col(v)))
        near2 = gap("px", "cx", e[0]) ** 2 + gap("py", "cy", e[2]) ** 2
        bound = F.min(far("px", "cx", e[0]) ** 2 + far("py", "cy", e[2]) ** 2).over(Window.partitionBy("p"))
        return held.withColumn("near2", near2).withColumn("bound", bound).where(F.col("near2") <= F.col("bound") * (1 + 1e-9)).drop("near2", "bound")

    for k, size in enumerate(sizes):
        held = pruned(held, size)
        if k + 1 < len(sizes):
            inner = cells[k + 1].select(F.floor(F.col("cx") / _NARROWER).alias("cx"), F.floor(F.col("cy") / _NARROWER).alias("cy"), F.col("cx").alias("ix"), F.col("cy").alias("iy"))
            held = held.join(inner, ["cx", "cy"]).select("p", "px", "py", F.col("ix").alias("cx"), F.col("iy").alias("cy"))
    inside = known.select(corner("gx", e[0], sizes[-1]).alias("cx"), corner("gy", e[2], sizes[-1]).alias("cy"), "gx", "gy", "value")
    d2 = (F.col("gx") - F.col("px")) ** 2 + (F.col("gy") - F.col("py")) ** 2
    best = held.join(inside, ["cx", "cy"]).groupBy("p").agg(F.min(F.struct(d2.alias("d2"), "gx", "gy", "value")).alias("b"))
    return points.join(best.select(F.col("p").alias(point_id), F.col("b.value").alias("value"), F.sqrt("b.d2").alias("distance")), point_id, "left")
