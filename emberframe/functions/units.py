"""Unit conversion as column arithmetic. A unit is (dimension, factor, offset): base = value * factor + offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOOT, _POUND, _SHORT_TON, _ACRE = 0.3048, 0.45359237, 907.18474, 4046.8564224
UNITS: dict[str, tuple[str, float, float]] = {
    "1": ("ratio", 1.0, 0.0), "percent": ("ratio", 0.01, 0.0),
    "m": ("length", 1.0, 0.0), "ft": ("length", _FOOT, 0.0), "km": ("length", 1000.0, 0.0),
    "m-1": ("inverse length", 1.0, 0.0), "ft-1": ("inverse length", 1 / _FOOT, 0.0), "cm-1": ("inverse length", 100.0, 0.0),
    "kg m-2": ("load", 1.0, 0.0), "short ton acre-1": ("load", _SHORT_TON / _ACRE, 0.0), "lb ft-2": ("load", _POUND / _FOOT**2, 0.0),
    "kg m-3": ("density", 1.0, 0.0), "lb ft-3": ("density", _POUND / _FOOT**3, 0.0),
    "m s-1": ("speed", 1.0, 0.0), "km h-1": ("speed", 1 / 3.6, 0.0), "m min-1": ("speed", 1 / 60, 0.0), "ft min-1": ("speed", _FOOT / 60, 0.0), "mph": ("speed", 0.44704, 0.0),
    "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15), "degF": ("temperature", 5 / 9, 459.67 * 5 / 9),
    "radian": ("angle", 1.0, 0.0), "degree": ("angle", 0.017453292519943295, 0.0),
    "s": ("time", 1.0, 0.0), "min": ("time", 60.0, 0.0), "h": ("time", 3600.0, 0.0),
    "m2": ("area", 1.0, 0.0), "acre": ("area", _ACRE, 0.0), "ha": ("area", 1e4, 0.0),
    "J kg-1": ("heat content", 1.0, 0.0), "BTU lb-1": ("heat content", 2326.0, 0.0),
    "W m-2": ("flux", 1.0, 0.0), "W m-1 K-1": ("conductivity", 1.0, 0.0),
}
ALIASES = {"": "1", "dimensionless": "1", "%": "percent", "m/s": "m s-1", "km/h": "km h-1", "kg/m^2": "kg m-2", "kg/m^3": "kg m-3", "lb/ft^3": "lb ft-3", "1/ft": "ft-1", "1/m": "m-1", "W/m^2": "W m-2", "deg": "degree", "meter": "m", "ton acre-1": "short ton acre-1"}


def unit(name: str) -> tuple[str, float, float]:
    """Dimension, factor and offset of a unit; ValueError if it is not known."""
    key = ALIASES.get(name, name)
    if key not in UNITS:
        raise ValueError(f"unknown unit: {name}")
    return UNITS[key]


def convert(value: Column, source: str, target: str) -> Column:
    """value in target units; ValueError between dimensions."""
    (d1, f1, o1), (d2, f2, o2) = unit(source), unit(target)
    if d1 != d2:
        raise ValueError(f"cannot convert {source} ({d1}) to {target} ({d2})")
    if (f1, o1) == (f2, o2):
        return value
    return value * (f1 / f2) if o1 == o2 == 0 else (value * f1 + (o1 - o2)) / f2


def units_of(df: DataFrame, column: str) -> str:
    """The unit in a column's metadata; dimensionless if it has none."""
    return df.schema[column].metadata.get("units", "1")


def with_units(value: Column, name: str, units: str, std_name: str | None = None) -> Column:
    return value.alias(name, metadata={"units": units, "std_name": std_name or name})


def slope_percent_to_degrees(percent: Column) -> Column:
    return F.degrees(F.atan(percent / 100))
