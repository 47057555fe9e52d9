"""Error, circular, confusion and overlap metrics as aggregate columns.

Every function returns a plain aggregate, so the same metric works in a global aggregate, a group, a
window or a stream. Missing values are NULL (see ``session.nan_to_null``).
x is the evaluated value, ref the reference.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.session import require


def rmse(x: Column, ref: Column) -> Column:
    """Pairs with a missing side drop out."""
    return F.sqrt(F.avg((x - ref) * (x - ref)))


def nmse_range(x: Column, ref: Column) -> Column:
    """rmse over the range of all references; a constant reference fails the query."""
    width = F.max(ref) - F.min(ref)
    return F.when(width.isNotNull(), require(width != 0, "nmse_range: reference range is zero", rmse(x, ref) / F.nullif(width, F.lit(0.0))))


def nmse_power(x: Column, ref: Column) -> Column:
    """Mean squared error over the product of the means, each mean over its own values; a zero product fails."""
    power = F.avg(x) * F.avg(ref)
    return F.when(power.isNotNull(), require(power != 0, "nmse_power: product of means is zero", F.avg((x - ref) * (x - ref)) / F.nullif(power, F.lit(0.0))))


def bias(x: Column, ref: Column) -> Column:
    """Mean of x where ref is known, less the mean of every known ref."""
    return F.avg(F.when(ref.isNotNull(), x)) - F.avg(ref)


def mae(x: Column, ref: Column) -> Column:
    return F.avg(F.abs(x - ref))


def correlation(x: Column, ref: Column) -> Column:
    return F.corr(x, ref)


def circular_bias(x: Column, ref: Column) -> Column:
    """Difference of mean directions in degrees, in [-180, 180); pairs with a missing side drop out."""
    both = x.isNotNull() & ref.isNotNull()

    def mean_angle(d: Column) -> Column:
        r = F.radians(F.when(both, d))
        return F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))

    return F.degrees(F.pmod(mean_angle(x) - mean_angle(ref) + math.pi, F.lit(2 * math.pi)) - math.pi)


def _safe(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """top / bottom, and ``empty`` where bottom is 0."""
    ratio = top / F.nullif(bottom, F.lit(0))
    return ratio if empty is None else F.when(bottom == 0, F.lit(empty)).otherwise(ratio)


class Confusion:
    """Counts and rates of a binary prediction against a reference; rows with a missing side drop out."""

    def __init__(self, predicted: Column, actual: Column):
        p, a = predicted.cast("boolean"), actual.cast("boolean")
        self.tp, self.tn = F.count_if(p & a), F.count_if(~p & ~a)
        self.fp, self.fn = F.count_if(p & ~a), F.count_if(~p & a)

    def matrix(self) -> Column:
        return F.struct(self.tn.alias("tn"), self.fp.alias("fp"), self.fn.alias("fn"), self.tp.alias("tp"))

    def accuracy(self) -> Column:
        """NULL without rows."""
        return _safe(self.tp + self.tn, self.tp + self.tn + self.fp + self.fn, None)

    def precision(self) -> Column:
        return _safe(self.tp, self.tp + self.fp)

    def false_positive_rate(self) -> Column:
        return _safe(self.fp, self.fp + self.tn)

    def negative_predictive_value(self) -> Column:
        return _safe(self.tn, self.fn + self.tn)

    def recall(self) -> Column:
        return _safe(self.tp, self.tp + self.fn)

    def specificity(self) -> Column:
        return _safe(self.tn, self.tn + self.fp)

    def f_score(self) -> Column:
        p, r = self.precision(), self.recall()
        return _safe(2 * p * r, p + r)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two masks in [0, 1]; two empty masks agree."""
    return F.least(F.greatest(_safe(F.count_if(a & b), F.count_if(a | b), 1.0), F.lit(0.0)), F.lit(1.0))


def dice(a: Column, b: Column) -> Column:
    """Twice the overlap over the sum of the masks' values in [0, 1]; two empty masks agree."""
    size = F.coalesce(F.sum(a.cast("double")), F.lit(0.0)) + F.coalesce(F.sum(b.cast("double")), F.lit(0.0))
    return F.least(F.greatest(_safe(2 * F.count_if(a.cast("boolean") & b.cast("boolean")), size, 1.0), F.lit(0.0)), F.lit(1.0))


def severity_matrix(df: DataFrame, ref: str, evaluated: str) -> DataFrame:
    """Long confusion matrix of classes: ref_class, eval_class, n, row_percent. Cells without rows are left out."""
    from pyspark.sql import Window

    cells = df.where(F.col(ref).isNotNull() & F.col(evaluated).isNotNull()).groupBy(F.col(ref).alias("ref_class"), F.col(evaluated).alias("eval_class")).agg(F.count("*").alias("n"))
    return cells.withColumn("row_percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("ref_class")))


def severity_accuracy(df: DataFrame, ref: str, evaluated: str, no_data: int = 0) -> DataFrame:
    """Per class: accuracy among pixels evaluated as a burnt class, and among all that either side gives the class.

    accuracy_burnt leaves out what is evaluated as ``no_data`` and is 0 without such pixels;
    accuracy_total adds the pixels that are ``no_data`` in the reference and have the class.
    """
    cells = severity_matrix(df, ref, evaluated)
    hit = F.col("ref_class") == F.col("eval_class")
    rows = cells.groupBy(F.col("ref_class").alias("class")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("in_ref"),
        F.sum(F.when(F.col("eval_class") != no_data, F.col("n")).otherwise(0)).alias("burnt"),
    )
    extra = cells.where(F.col("ref_class") == no_data).select(F.col("eval_class").alias("class"), F.col("n").alias("unseen"))
    joined = rows.where(F.col("class") != no_data).join(extra, "class", "left")
    return joined.select(
        "class", _safe(F.col("hits"), F.col("burnt")).alias("accuracy_burnt"), (F.col("hits") / (F.col("in_ref") + F.coalesce("unseen", F.lit(0)))).alias("accuracy_total")
    )


# Burn-severity classes.
SEVERITY_CLASSES = ((0, "no data"), (1, "unburnt to low"), (2, "low"), (3, "moderate"), (4, "high"), (5, "increased greenness"))


def station_summary(df: DataFrame, station: str, metric: Callable[[Column, Column], Column], x: str, ref: str, *group: str) -> DataFrame:
    """Minimum, mean and maximum over stations of a metric taken per station (of stations where it is known)."""
    per = df.groupBy(*group, station).agg(metric(F.col(x), F.col(ref)).alias("kpi"))
    return per.groupBy(*group).agg(F.min("kpi").alias("kpi_min"), F.avg("kpi").alias("kpi_mean"), F.max("kpi").alias("kpi_max"), F.count("kpi").alias("stations"))


def nice_bins(low: float, high: float, max_bins: int = 20) -> tuple[float, float]:
    """(start, width) of a histogram: width 1, 2, 5 or 10 times a power of ten nearest to range / max_bins, start 0.

    A constant sample has one bin of width 1 from its value.
    """
    if high == low:
        return low, 1.0
    wanted = (high - low) / max_bins
    power = 10.0 ** math.floor(math.log10(wanted))
    return 0.0, min((1, 2, 5, 10), key=lambda s: abs(wanted - s * power)) * power


def histogram(df: DataFrame, column: str, max_bins: int = 20) -> DataFrame:
    """Counts per nice bin: bin_start, n. Negative values lie below the first edge and are not counted."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin_start double, n long")
    start, width = nice_bins(low, high, max_bins)
    place = F.floor((F.col(column) - start) / width)
    return df.where(F.col(column) >= start).groupBy((place * width + start).alias("bin_start")).agg(F.count("*").alias("n"))
