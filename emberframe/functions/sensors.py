"""Confidence half-widths of fuel-moisture sensors."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe.session import require

# Root-mean-square error below 10, 20, 30 % moisture and above.
RMS = {"CS505": (1.22, 1.82, 3.04, 3.65), "CS506": (0.76, 1.22, 2.07, 2.50)}


def z_score(level: float) -> float:
    """Two-sided standard score of a confidence level in (0, 1)."""
    if not 0 < level < 1:
        raise ValueError("confidence level must lie between 0 and 1")
    return NormalDist().inv_cdf(0.5 + level / 2)


def half_width(sensor: str, moisture: Column, level_percent: float) -> Column:
    """Half-width in % moisture; moisture outside [0, 50] fails the query, NULL stays NULL."""
    a, b, c, d = RMS[sensor]
    z = z_score(level_percent / 100)
    width = F.when(moisture < 10, a).when(moisture < 20, b).when(moisture < 30, c).otherwise(d) * z
    return F.when(moisture.isNotNull(), require(moisture.between(0, 50), f"{sensor}: moisture outside [0, 50]", width))
