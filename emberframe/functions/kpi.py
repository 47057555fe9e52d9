"""Indicators to scores between 0 and 100. Values outside a norm's domain fail the query; NULL stays NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe.session import require


def _guard(x: Column, ok: Column, message: str, value: Column) -> Column:
    return F.when(x.isNotNull(), require(ok, message, value))


def bounded_linear(x: Column, a: float, b: float) -> Column:
    """100 (x - a) / (b - a) on [a, b]; rounding noise (1e-12 relative) at the bounds is let in."""
    near = lambda v: F.abs(x - v) <= 1e-15 + 1e-12 * abs(v)
    return _guard(x, x.between(a, b) | near(a) | near(b), "bounded norm: value outside [a, b]", (x - a) * (100.0 / (b - a)))


def _open(m: float, a: float) -> None:
    if m <= a:
        raise ValueError("m must lie above the start of the domain")


def half_open_linear(x: Column, a: float, m: float) -> Column:
    """100 at a, falling to 0 at m and beyond."""
    _open(m, a)
    return _guard(x, x >= a, "half-open norm: value below a", F.greatest(F.lit(0.0), 1 - (x - a) / (m - a)) * 100)


def half_open_exponential(x: Column, a: float, m: float) -> Column:
    """100 at a, 50 at m."""
    _open(m, a)
    return _guard(x, x >= a, "half-open norm: value below a", F.exp((x - a) * (-math.log(2) / (m - a))) * 100)


def symmetric_linear(x: Column, m: float) -> Column:
    _open(m, 0)
    return F.greatest(F.lit(0.0), 1 - F.abs(x) / m) * 100


def symmetric_exponential(x: Column, m: float) -> Column:
    _open(m, 0)
    return F.exp(F.abs(x) * (-math.log(2) / m)) * 100


def color(score: Column) -> Column:
    """Traffic light of a score."""
    return F.when(score < 33.33, "red").when(score < 66.66, "yellow").when(score.isNotNull(), "green")
