"""Whole evaluations: fuel-model import, validation against observed spread, sensitivity studies, weather scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import kpi, units
from emberframe.operators import fuels, metrics, models, sensitivity
from emberframe.sources import tables


def import_forty_classes(spark: SparkSession, path: str) -> DataFrame:
    """A table of five size classes with total load, mean surface-area ratio and dead share."""
    return fuels.dead_ratio(fuels.total_savr(fuels.total_load(tables.read_fuel_model(spark, path), overwrite=True), overwrite=True))


def import_thirteen_classes(spark: SparkSession, path: str, only_1h: bool = False) -> DataFrame:
    """A table with one live class, and its dead share."""
    return fuels.dead_ratio_13(tables.read_fuel_model(spark, path), only_1h)


def import_urban_classes(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_fuel_model(spark, path)


def validate(observations: DataFrame, classes: DataFrame, properties: list[str], model: models.Model, observed: str, wind_factor: Column | None = None, class_column: str = "fuel_class") -> DataFrame:
    """observations with their closest class, the model's spread, and the class's properties; incomplete rows drop out.

    Inputs that the observations do not have come from the class. ``wind_factor`` reduces the wind speed. Units follow column metadata.
    """
    known = observations.dropna(subset=[*properties, observed])
    placed = fuels.closest_class(known, classes, properties, class_column)
    own = [c for c in classes.columns if c not in observations.columns and c != class_column]
    joined = placed.join(classes.select(F.col(class_column).alias("closest_class"), *own), "closest_class")
    if wind_factor is not None:
        meta = units.units_of(joined, "wind_speed")
        joined = joined.withColumn("wind_speed", F.col("wind_speed") * wind_factor).withMetadata("wind_speed", {"units": meta})
    models.check_completeness(joined, model)
    inputs = [p for p in model.params if p.std_name in joined.columns]
    ready = joined.withColumns({p.std_name: units.convert(F.col(p.std_name).cast("double"), units.units_of(joined, p.std_name), p.units) for p in inputs})
    return model.apply(ready)


def accuracy(df: DataFrame, computed: str, observed: str, *group: str) -> DataFrame:
    """rmse, nmse_range, bias and correlation of computed against observed."""
    x, r = F.col(computed), F.col(observed)
    return df.groupBy(*group).agg(metrics.rmse(x, r).alias("rmse"), metrics.nmse_range(x, r).alias("nmse_range"), metrics.bias(x, r).alias("bias"), metrics.correlation(x, r).alias("correlation"), F.count("*").alias("n"))


def sensitivity_study(spark: SparkSession, fuel: DataFrame, model: models.Model, bounds: dict[str, tuple[float, float]], n: int, resamples: int = 0, class_column: str = "fuel_class") -> DataFrame:
    """Sobol indices of the model's output to the variables, for each fuel class: samples x classes in one job."""
    runs = model.apply(fuels.sample_classes(sensitivity.saltelli(spark, n, bounds), fuel))
    return sensitivity.sobol_indices(runs, list(bounds), model.output, class_column, resamples=resamples, ordered=True)


def weather_scores(pairs: DataFrame, periods: DataFrame, m: dict[str, float], metric: Callable[[Column, Column], Column] = metrics.rmse, trusted: Column | None = None) -> DataFrame:
    """Scores of weather variables by study period: min, mean and max over stations of a station's metric, each to 0-100.

    pairs: station_id, variable, ts, x, ref; periods: period, start, end (an interval may overlap others); m: the
    difference worth 50 points for each variable. ``trusted`` filters observations. Periods meet observations by day, and
    then by time.
    """
    inside = pairs.where(trusted) if trusted is not None else pairs
    days = periods.withColumn("_day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    inside = inside.withColumn("_day", F.to_date("ts")).join(days, "_day").where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))).drop("_day")
    summary = metrics.station_summary(inside, "station_id", metric, "x", "ref", "variable", "period")
    long = summary.select("variable", "period", F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(f"kpi_{s}").alias("kpi")) for s in ("min", "mean", "max")])).alias("s")).select("variable", "period", "s.*")
    score = None
    for variable, half in m.items():
        value = kpi.symmetric_exponential(F.col("kpi"), half)
        score = F.when(F.col("variable") == variable, value) if score is None else score.when(F.col("variable") == variable, value)
    return long.withColumn("score", score)
