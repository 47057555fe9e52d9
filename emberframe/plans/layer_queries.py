"""Queries of polygon layers and contours over the tables, with SQL over boxes and closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators import geometry, overlay
from emberframe.plans.metric_queries import query
from emberframe.session import load


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A box as a ring."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((west, south), (east, south), (east, north), (west, north))])


_Q = "(0.9933056199957391 * (s / (1 - 0.006694380022903416 * s * s) - ln((1 - 0.08181919104281579 * s) / (1 + 0.08181919104281579 * s)) / 0.16363838208563158))"


@query(f"""
WITH p AS (SELECT o_orderkey AS id, o_custkey % 80 AS x, o_orderkey % 60 AS y, 1 + o_orderkey % 3 AS w, 1 + o_custkey % 2 AS h, 0.3 * (o_orderkey % 5) AS dx, 0.25 * (o_custkey % 4) AS dy FROM orders),
q AS (SELECT id, w, dx, list_transform([y, y + h, y + dy, y + dy + h], lambda v: list_transform([sin(radians(v))], lambda s: {_Q})[1]) AS q FROM p),
a AS (SELECT id, w * (q[2] - q[1]) AS a, w * (q[4] - q[3]) AS b, greatest(0, w - dx) * greatest(0, q[2] - q[3]) AS c FROM q)
SELECT id, round(c / (a + b - c), 6) AS jaccard, round(2 * c / (a + b), 6) AS dice FROM a""")
def g_polygon_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two boxes in degrees for each order, on an equal-area cylinder, where boxes stay boxes."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y, w, h, dx, dy = c % 80, o % 60, 1 + o % 3, 1 + c % 2, 0.3 * (o % 5), 0.25 * (c % 4)
    pairs = load(spark, sf_dir, "orders").select(o.alias("id"), box(x, y, x + w, y + h).alias("ring_a"), box(x + dx, y + dy, x + dx + w, y + dy + h).alias("ring_b"))
    return geometry.polygon_overlap(pairs, projection="EPSG:6933").select("id", F.round("jaccard", 6).alias("jaccard"), F.round("dice", 6).alias("dice"))


_ORDER_BOX = "o_custkey * 40.0 AS west, o_totalprice / 10 AS south, o_custkey * 40.0 + 1 + o_orderkey % 90 AS east, o_totalprice / 10 + 1 + o_orderkey % 50 AS north"
_CUSTOMER_BOX = "c_custkey * 40.0 - 30 AS west, 3 * c_acctbal AS south, c_custkey * 40.0 + 20 + c_nationkey * 60 AS east, 3 * c_acctbal + 400 + c_nationkey * 20 AS north"


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boxes of orders and, up to hundreds of times as large, of customers."""
    ring = box(F.col("west"), F.col("south"), F.col("east"), F.col("north")).alias("ring")
    orders = load(spark, sf_dir, "orders").selectExpr("o_orderkey", *_ORDER_BOX.split(", ")).select("o_orderkey", ring)
    customers = load(spark, sf_dir, "customer").selectExpr("c_custkey", *_CUSTOMER_BOX.split(", ")).select("c_custkey", ring)
    return orders, customers


@query(f"""
SELECT c_custkey, count(*) AS orders, sum(o_orderkey) AS keys FROM (SELECT o_orderkey, {_ORDER_BOX} FROM orders) a JOIN (SELECT c_custkey, {_CUSTOMER_BOX} FROM customer) b
ON a.west <= b.east AND b.west <= a.east AND a.south <= b.north AND b.south <= a.north GROUP BY 1""")
def g_spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of boxes without a common key: the orders' boxes that meet each customer's."""
    pairs = overlay.spatial_join(*_layers(spark, sf_dir), "o_orderkey", "c_custkey")
    return pairs.groupBy("c_custkey").agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("keys"))


@query(f"""
SELECT c_custkey, count(*) AS orders, round(sum(w * h / (a + b - w * h)), 6) AS jaccard FROM (SELECT c_custkey, least(a.east, b.east) - greatest(a.west, b.west) AS w, least(a.north, b.north) - greatest(a.south, b.south) AS h,
 (a.east - a.west) * (a.north - a.south) AS a, (b.east - b.west) * (b.north - b.south) AS b
FROM (SELECT o_orderkey, {_ORDER_BOX} FROM orders) a JOIN (SELECT c_custkey, {_CUSTOMER_BOX} FROM customer) b ON a.west < b.east AND b.west < a.east AND a.south < b.north AND b.south < a.north) GROUP BY 1""")
def g_layer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the boxes of two layers share, pair by pair."""
    pairs = overlay.layer_overlap(*_layers(spark, sf_dir), "o_orderkey", "c_custkey")
    return pairs.groupBy("c_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("jaccard"), 6).alias("jaccard"))


_PARTS = """(SELECT s_nationkey AS k, 'a' AS side, s_suppkey % 97 * 10.0 AS x0, s_acctbal / 10 AS y0, s_suppkey % 97 * 10.0 + 200 AS x1, s_acctbal / 10 + 60 AS y1 FROM supplier
UNION ALL SELECT c_nationkey, 'b', c_custkey % 89 * 10.0, c_acctbal / 10, c_custkey % 89 * 10.0 + 15, c_acctbal / 10 + 40 FROM customer)"""


@query(f"""
WITH p AS (SELECT k, side, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM {_PARTS}),
y AS (SELECT DISTINCT k, y0 AS y FROM p UNION SELECT DISTINCT k, y1 FROM p), s AS (SELECT k, y AS lo, lead(y) OVER (PARTITION BY k ORDER BY y) AS hi FROM y),
e AS (SELECT s.k, lo, hi, side, x0 AS x, 1 AS d FROM s JOIN p ON p.k = s.k AND p.y0 <= lo AND p.y1 >= hi UNION ALL SELECT s.k, lo, hi, side, x1, -1 FROM s JOIN p ON p.k = s.k AND p.y0 <= lo AND p.y1 >= hi),
w AS (SELECT k, hi - lo AS h, lead(x) OVER v - x AS w, sum(CASE WHEN side = 'a' THEN d ELSE 0 END) OVER v > 0 AS a, sum(CASE WHEN side = 'b' THEN d ELSE 0 END) OVER v > 0 AS b
 FROM e WINDOW v AS (PARTITION BY k, lo ORDER BY x, d, side ROWS UNBOUNDED PRECEDING)),
t AS (SELECT k, coalesce(sum(w * h) FILTER (a), 0) AS a, coalesce(sum(w * h) FILTER (b), 0) AS b, coalesce(sum(w * h) FILTER (a AND b), 0) AS c FROM w GROUP BY 1)
SELECT k, round(a, 4) AS area_a, round(b, 4) AS area_b, round(c, 4) AS area_both, round(c / (a + b - c), 6) AS jaccard, round(2 * c / (a + b), 6) AS dice FROM t""")
def g_layer_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of suppliers' and customers' boxes in each nation: boxes of one layer overlap, and what they cover counts once."""
    s, c = F.col("s_suppkey") % 97 * 10.0, F.col("c_custkey") % 89 * 10.0
    ys, yc = F.col("s_acctbal") / 10, F.col("c_acctbal") / 10
    a = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("a").alias("side"), box(s, ys, s + 200, ys + 60).alias("ring"))
    b = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("b").alias("side"), box(c, yc, c + 15, yc + 40).alias("ring"))
    out = overlay.overlay(a.unionByName(b).withColumn("hole", F.lit(False)), "k")
    return out.select("k", *[F.round(n, 4).alias(n) for n in ("area_a", "area_b", "area_both")], F.round("jaccard", 6).alias("jaccard"), F.round("dice", 6).alias("dice"))


def cells(keys: DataFrame, n: int, low: float, high: float) -> DataFrame:
    """An n x n raster for each row of keys (grid_id and more): row, col, lon and lat from low to high."""
    step = (high - low) / (n - 1)
    at = keys.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))).withColumn("row", (F.col("k") / n).cast("long")).withColumn("col", (F.col("k") % n).cast("long"))
    return at.withColumn("lon", F.col("col") * step + low).withColumn("lat", F.col("row") * step + low)


@query("SELECT s_suppkey AS grid_id, round(CASE WHEN l <= 1 THEN l * l / 2 ELSE 1 - (2 - l) * (2 - l) / 2 END, 6) AS area FROM (SELECT s_suppkey, CAST(0.25 + s_suppkey % 50 * 0.03 AS DOUBLE) AS l FROM supplier)")
def g_filled_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of a half plane's part of the unit square, for each supplier a plane: the contour of linear values is exact."""
    keys = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("grid_id"), (F.col("s_suppkey") % 50 * 0.03 + 0.25).alias("l"))
    grid = cells(keys, 16, 0.0, 1.0).withColumn("value", (F.col("lon") + F.col("lat")) / F.col("l"))
    return geometry.filled_area(grid, 1.0).select("grid_id", F.round("area", 6).alias("area"))


def rings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disc for each supplier of even key, an annulus for the others."""
    keys = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("grid_id"))
    r2 = F.col("lon") * F.col("lon") + F.col("lat") * F.col("lat")
    return cells(keys, 24, -2.0, 2.0).withColumn("value", F.when(F.col("grid_id") % 2 == 0, r2).otherwise(F.abs(r2 - 1.6)))


@query("SELECT s_suppkey AS grid_id, 1 AS outer_rings, CAST(s_suppkey % 2 AS INT) AS holes, CAST(1 AS DOUBLE) AS same_area FROM supplier")
def g_filled_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discs and annuli as stitched rings: their signed areas are those of the pieces."""
    grid = rings_grid(spark, sf_dir)
    rings = geometry.filled_rings(grid, 1.0)
    whole = rings.groupBy("grid_id").agg(F.count_if(~F.col("hole")).cast("int").alias("outer_rings"), F.count_if("hole").cast("int").alias("holes"), F.sum(geometry.ring_signed_area(F.col("ring"))).alias("a"))
    return whole.join(geometry.filled_area(grid, 1.0), "grid_id").select("grid_id", "outer_rings", "holes", F.round(F.col("a") / F.col("area"), 6).alias("same_area"))
