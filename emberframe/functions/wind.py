"""Wind at flame height: reduction factors and the urban canyon profile."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe.functions.physics import col, let


def apply_reduction(wind: Column, factor: Column) -> Column:
    return wind * factor


def reduction_20ft(flame_height, vegetation_height) -> Column:
    """Unsheltered factor for wind 20 ft above vegetation (Baughman and Albini 1980); heights in ft."""
    return let(
        {"f": col(flame_height), "h": col(vegetation_height)},
        lambda v: (1 + 0.36 * v["h"] / v["f"]) * (F.log((0.36 + v["f"] / v["h"]) / 0.13) - 1) / F.log((20 + 0.36 * v["h"]) / (0.13 * v["h"])),
    )


def reduction_general(wind_height, flame_height, vegetation_height, above_vegetation: bool) -> Column:
    """The same for wind at any height, over the ground or over the vegetation: mean log profile over the flame."""

    def profile(z: Column, v: Column) -> Column:
        return (z - 0.64 * v["h"]) * F.log((z - 0.64 * v["h"]) / (0.13 * v["h"])) - z

    def factor(v: Column) -> Column:
        mean = (profile(v["h"] + v["f"], v) - profile(v["h"], v)) / v["f"]
        z = v["z"] + v["h"] if above_vegetation else v["z"]
        return mean / F.log((z - 0.64 * v["h"]) / (0.13 * v["h"]))

    return let({"z": col(wind_height), "f": col(flame_height), "h": col(vegetation_height)}, factor)


def urban_canyon(wind, height, building_height, separation) -> Column:
    """Wind in a street canyon (Masson), from the wind above at ``height``."""

    def speed(v: Column) -> Column:
        z0 = 0.1 * F.greatest(F.lit(5.0), v["h"])
        return 2 / math.pi * F.exp(-0.25 * v["h"] / v["d"]) * F.log(v["h"] / (3 * z0)) / F.log((v["z"] - 2 * v["h"] / 3) / z0) * F.abs(v["u"])

    return let({"u": col(wind), "z": col(height), "h": col(building_height), "d": col(separation)}, speed)
