"""Model contracts, input preparation, and the registry of spread models."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions import physics, units

INF = math.inf


@dataclass(frozen=True)
class Param:
    """An input: kernel argument, standard name, unit, inclusive range; a default makes it optional."""

    arg: str
    std_name: str
    units: str
    low: float = -INF
    high: float = INF
    default: float | None = None


@dataclass(frozen=True)
class Model:
    """A spread model: its inputs and the kernel that takes them by name."""

    name: str
    params: tuple[Param, ...]
    kernel: Callable[..., Column]
    output: str = "rate_of_spread"
    output_units: str = "m s-1"

    def required(self) -> list[Param]:
        return [p for p in self.params if p.default is None]

    def apply(self, df: DataFrame, **options) -> DataFrame:
        """df and the output column, from inputs that are in the model's units already; missing optional inputs take their default."""
        missing = [p.std_name for p in self.required() if p.std_name not in df.columns]
        if missing:
            raise ValueError(f"{self.name}: missing inputs {missing}")
        args = {p.arg: F.col(p.std_name) if p.std_name in df.columns else F.lit(p.default) for p in self.params}
        return df.withColumn(self.output, self.kernel(**args, **options)).withMetadata(self.output, {"units": self.output_units, "std_name": self.output})


_WIND = Param("wind", "wind_speed", "m s-1")
_SLOPE = Param("slope", "slope_angle", "degree", -90, 90)
_MOISTURE = Param("moisture", "fuel_moisture_content", "percent", 0, 200)
_URBAN = (
    Param("side", "building_length_side", "m", 0), Param("separation", "building_length_separation", "m", 0), Param("wind_u", "wind_speed_u", "m s-1"), Param("wind_v", "wind_speed_v", "m s-1"),
    Param("normal_x", "normal_spread_dir_x", "1", -1, 1), Param("normal_y", "normal_spread_dir_y", "1", -1, 1), Param("resistant", "building_ratio_fire_resistant", "1", 0, 1, 0.6),
)
_AIR = (Param("ignition_temperature", "fuel_temperature_ignition", "K", 0, INF, 600.0), Param("air_temperature", "air_temperature", "K", 0, INF, 300.0), Param("air_density", "air_density", "kg m-3", 0, INF, 1.125))

REGISTRY: dict[str, Model] = {}


def register(model: Model) -> Model:
    """Adds a model of your own: any kernel of columns, or a pandas UDF that takes the same arguments."""
    REGISTRY[model.name] = model
    return model


register(Model("rothermel", (
    Param("fuel_load", "fuel_load_dry_total", "kg m-2", 0), Param("height", "fuel_height", "m", 0), Param("density", "fuel_density", "lb ft-3", 0),
    Param("savr", "fuel_surface_area_volume_ratio", "ft-1", 0), Param("extinction", "fuel_moisture_extinction", "percent", 0), Param("mineral_total", "fuel_mineral_content_total", "1", 0, 1),
    Param("mineral_effective", "fuel_mineral_content_effective", "1", 0, 1), Param("chaparral", "fuel_chaparral_flag", "1", 0, 1), _WIND, _SLOPE, _MOISTURE,
), physics.rothermel))
register(Model("balbi", (
    Param("dead_ratio", "fuel_load_dead_ratio", "1", 0, 1), Param("fuel_load", "fuel_load_dry_total", "kg m-2", 0), Param("height", "fuel_height", "m", 0), Param("density", "fuel_density", "kg m-3", 0),
    Param("savr", "fuel_surface_area_volume_ratio", "m-1", 0), _WIND, _SLOPE, _MOISTURE, Param("ignition_length", "ignition_length", "m", 0, INF, 50.0), *_AIR,
), physics.balbi))
register(Model("santoni", (
    Param("fuel_load", "fuel_load_dry_total", "kg m-2", 0), Param("dead_ratio", "fuel_load_dead_ratio", "1", 0, 1), Param("height", "fuel_height", "m", 0), Param("density_dead", "fuel_density_dead", "kg m-3", 0),
    Param("density_live", "fuel_density_live", "kg m-3", 0), Param("savr_dead", "fuel_surface_area_volume_ratio_dead", "m-1", 0), Param("savr_live", "fuel_surface_area_volume_ratio_live", "m-1", 0),
    _WIND, _SLOPE, Param("moisture_dead", "fuel_moisture_content_dead", "percent", 0, 200), Param("moisture_live", "fuel_moisture_content_live", "percent", 0, 500), *_AIR,
), physics.santoni))
register(Model("hamada_1", _URBAN, physics.hamada_1))
register(Model("hamada_2", (
    *_URBAN, Param("bare", "building_ratio_structure_wood_bare", "1", 0, 1, 0.2), Param("mortar", "building_ratio_structure_wood_mortar", "1", 0, 1, 0.2), Param("beta", "beta", "1", 2, INF, 5.0),
), physics.hamada_2))


def check_completeness(df: DataFrame, model: Model) -> list[str]:
    """Names of the optional inputs that df lacks; ValueError if a required one is missing."""
    missing = [p.std_name for p in model.required() if p.std_name not in df.columns]
    if missing:
        raise ValueError(f"{model.name}: missing inputs {missing}")
    return [p.std_name for p in model.params if p.std_name not in df.columns]


def with_defaults(df: DataFrame, model: Model, fill: bool = False) -> DataFrame:
    """df with every optional input of the model: those it lacks get their default, and with ``fill`` also missing values of those it has."""
    optional = [p for p in model.params if p.default is not None]
    new = {p.std_name: F.lit(float(p.default)) for p in optional if p.std_name not in df.columns}
    held = {p.std_name: F.coalesce(F.nanvl(F.col(p.std_name).cast("double"), F.lit(None)), F.lit(float(p.default))) for p in optional if fill and p.std_name in df.columns}
    return df.withColumns(new | held)


def convert_units(df: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """The model's inputs in its units, by each column's metadata; other columns go, but for ``keep``."""
    inputs = [
        units.with_units(units.convert(F.col(p.std_name).cast("double"), units.units_of(df, p.std_name), p.units), p.std_name, p.units)
        for p in model.params
        if p.std_name in df.columns
    ]
    return df.select(*keep, *inputs)


def range_violations(df: DataFrame, model: Model) -> DataFrame:
    """One row per input: least and largest value, the allowed range and whether it holds; a single pass."""
    inside = [p for p in model.params if p.std_name in df.columns]
    found = df.agg(F.array(*[
        F.struct(F.lit(p.std_name).alias("std_name"), F.min(F.nanvl(F.col(p.std_name).cast("double"), F.lit(None))).alias("least"), F.max(F.nanvl(F.col(p.std_name).cast("double"), F.lit(None))).alias("largest"), F.lit(float(p.low)).alias("low"), F.lit(float(p.high)).alias("high"))
        for p in inside
    ]).alias("r"))
    rows = found.select(F.inline("r"))
    return rows.withColumn("valid", F.coalesce((F.col("least") >= F.col("low")) & (F.col("largest") <= F.col("high")), F.lit(True)))


def check_ranges(df: DataFrame, model: Model) -> None:
    """ValueError naming the inputs outside their range."""
    bad = [(r.std_name, r.least, r.largest) for r in range_violations(df, model).where("not valid").collect()]
    if bad:
        raise ValueError(f"{model.name}: outside the valid range: {bad}")


def checked(df: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """Completeness, units and ranges; the converted inputs."""
    check_completeness(df, model)
    out = convert_units(df, model, keep)
    check_ranges(out, model)
    return out
