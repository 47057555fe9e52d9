"""Fire perimeters of KML files, by Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RING = "struct<LinearRing:struct<coordinates:string>>"
_POLYGON = f"struct<outerBoundaryIs:{_RING},innerBoundaryIs:array<{_RING}>>"
SCHEMA = f"name string, description string, Polygon array<{_POLYGON}>, MultiGeometry struct<Polygon:array<{_POLYGON}>>"


def ring(coordinates: Column) -> Column:
    """(x, y) structs of 'lon,lat[,height] ...', the closing point left out."""
    points = F.filter(F.split(F.trim(coordinates), r"\s+"), lambda t: t != "")
    pairs = F.transform(points, lambda t: F.split(t, ","))
    xy = F.transform(pairs, lambda p: F.struct(F.element_at(p, 1).cast("double").alias("x"), F.element_at(p, 2).cast("double").alias("y")))
    closed = (F.size(xy) > 1) & (F.element_at(xy, 1) == F.element_at(xy, -1))
    return F.when(closed, F.slice(xy, 1, F.size(xy) - 1)).otherwise(xy)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """file, name, part (polygon of the placemark, from 0), hole and ring (longitude and latitude, not closed) of every placemark's polygons."""
    marks = spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", "true").schema(SCHEMA).load(path)
    none = F.array().cast(f"array<{_POLYGON}>")
    parts = F.concat(F.coalesce("Polygon", none), F.coalesce(F.col("MultiGeometry.Polygon"), none))
    rows = marks.select(F.input_file_name().alias("file"), "name", F.posexplode(parts).alias("part", "p"))
    outer = F.array(F.struct(F.lit(False).alias("hole"), F.col("p.outerBoundaryIs.LinearRing.coordinates").alias("c")))
    inner = F.transform(F.coalesce(F.col("p.innerBoundaryIs"), F.array().cast(f"array<{_RING}>")), lambda r: F.struct(F.lit(True).alias("hole"), r["LinearRing"]["coordinates"].alias("c")))
    return rows.select("file", "name", "part", F.explode(F.concat(outer, inner)).alias("r")).select("file", "name", "part", "r.hole", ring(F.col("r.c")).alias("ring"))
