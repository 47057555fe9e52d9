"""Fuel-class tables: derived columns, classes by properties, and samples crossed with classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions import units


def _add(df: DataFrame, name: str, value: Column, overwrite: bool) -> DataFrame:
    if name in df.columns and not overwrite:
        raise ValueError(f"{name} exists; pass overwrite=True to replace it")
    return df.withColumn(name, value)


def _need(df: DataFrame, *names: str) -> list[Column]:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing fuel columns: {missing}")
    return [F.col(n) for n in names]


_DEAD = ("fuel_load_dry_1h", "fuel_load_dry_10h", "fuel_load_dry_100h")
_LIVE = ("fuel_load_dry_live_herb", "fuel_load_dry_live_woody")


def total_load(df: DataFrame, overwrite: bool = False) -> DataFrame:
    """fuel_load_dry_total of five size classes."""
    return _add(df, "fuel_load_dry_total", sum(_need(df, *_DEAD, *_LIVE)[1:], F.col(_DEAD[0])), overwrite)


def total_savr(df: DataFrame, overwrite: bool = False) -> DataFrame:
    """Load-weighted surface-area-to-volume ratio of 1 h dead, herbaceous and woody fuel; zero load fails the query."""
    loads = _need(df, "fuel_load_dry_1h", *_LIVE)
    ratios = _need(df, "fuel_surface_area_volume_ratio_dead_1h", "fuel_surface_area_volume_ratio_live_herb", "fuel_surface_area_volume_ratio_live_woody")
    top = sum((a * b for a, b in zip(loads[1:], ratios[1:], strict=True)), loads[0] * ratios[0])
    bottom = loads[0] + loads[1] + loads[2]
    return _add(df, "fuel_surface_area_volume_ratio", F.when(bottom == 0, F.raise_error(F.lit("total fuel load is zero")).cast("double")).otherwise(top / bottom), overwrite)


def dead_ratio(df: DataFrame, overwrite: bool = False) -> DataFrame:
    """Share of dead fuel in five size classes; NULL without fuel."""
    a, b, c, d, e = _need(df, *_DEAD, *_LIVE)
    return _add(df, "fuel_load_dead_ratio", F.try_divide(a + b + c, a + b + c + d + e), overwrite)


def dead_ratio_13(df: DataFrame, only_1h: bool = False, overwrite: bool = False) -> DataFrame:
    """Share of dead fuel where live fuel is one class; only_1h counts 1 h fuel alone as the dead part above the line."""
    a, b, c, live = _need(df, *_DEAD, "fuel_load_dry_live")
    return _add(df, "fuel_load_dead_ratio", F.try_divide(a if only_1h else a + b + c, a + b + c + live), overwrite)


MOST_CLASSES = 10_000  # of a class table that is folded into an array


def _folded(classes: DataFrame, row: Column) -> DataFrame:
    """The rows of a class table as one array; a table of more than MOST_CLASSES is no class table and fails the query."""
    small = F.when(F.count("*") <= MOST_CLASSES, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {MOST_CLASSES} classes")).cast("boolean"))
    return classes.limit(MOST_CLASSES + 1).agg(F.array_sort(F.collect_list(row)).alias("c"), small.alias("ok")).where("ok").select("c")


def closest_class(observations: DataFrame, classes: DataFrame, properties: list[str], class_column: str = "fuel_class", weights: dict[str, float] | None = None) -> DataFrame:
    """observations and the class with the least weighted distance sum |class - target| * weight.

    The default weight is 1 / |target|, and 1 for a target of 0. A missing distance wins over any
    other, ties go to the smaller class. Units of both sides are aligned by column metadata.
    The class table is folded into one array (its rows are the fuel classes, tens of them), which a scalar
    subquery hands to every row: no join, no shuffle.
    """
    row = F.struct(F.col(class_column).alias("c"), *[units.convert(F.col(p).cast("double"), units.units_of(classes, p), units.units_of(observations, p)).alias(p) for p in properties])
    packed = _folded(classes, row)

    def distance(c: Column) -> Column:
        parts = []
        for p in properties:
            target = F.col(p).cast("double")
            weight = F.lit(float(weights[p])) if weights else F.when(target == 0, 1.0).otherwise(1 / F.nullif(F.abs(target), F.lit(0.0)))
            parts.append(F.abs(c[p] - target) * weight)
        total = sum(parts[1:], parts[0])
        return F.struct(F.when(total.isNull() | F.isnan(total), 0).otherwise(1).alias("known"), F.coalesce(total, F.lit(0.0)).alias("d"), c["c"].alias("c"))

    best = F.array_min(F.transform("_classes", distance))["c"]
    return observations.withColumn("_classes", packed.scalar()).withColumn("closest_class", best).drop("_classes")


def sample_classes(samples: DataFrame, fuel: DataFrame) -> DataFrame:
    """Every sample with every fuel class: the class table, folded into an array, is unfolded at each sample."""
    packed = _folded(fuel, F.struct(*fuel.columns))
    out = samples.select("*", F.inline(packed.scalar()))
    for c in fuel.columns:
        out = out.withMetadata(c, fuel.schema[c].metadata)
    return out


def value_by_category(values: Column, category: Column) -> Column:
    """The category-th of an array, from 1; categories below 1 and beyond the end fail the query."""
    bad = F.when(category < 1, F.lit("category must be 1 or more")).otherwise(F.lit("category beyond the last class"))
    return F.when(category.between(1, F.size(values)), F.try_element_at(values, category)).when(category.isNull(), None).otherwise(F.raise_error(bad).cast("double"))


def merge_columns(left: DataFrame, right: DataFrame, on: list[str], prefer: int = 0) -> DataFrame:
    """Union of the columns of two tables on a key; prefer 0: a shared column is an error, 1: left wins, 2: right wins."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    if shared and prefer not in (1, 2):
        raise ValueError(f"columns on both sides: {shared}")
    a, b = left.alias("a"), right.alias("b")
    pick = {1: ("a", "b"), 2: ("b", "a")}.get(prefer, ("a", "b"))
    joined = a.join(b, on, "full")
    cols = [F.coalesce(F.col(f"{pick[0]}.{c}"), F.col(f"{pick[1]}.{c}")).alias(c) if c in shared else F.col(f"a.{c}") for c in left.columns if c not in on]
    return joined.select(*on, *cols, *[F.col(f"b.{c}") for c in right.columns if c not in on and c not in shared])
