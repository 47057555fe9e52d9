"""Weather-station JSON to time series, and the lookup of sensor heights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import timefmt
from emberframe.sources import json_split

# Station variables (source name, standard name, unit, default sensor height in m).
VARIABLES = (
    ("air_temp_set_1", "air_temperature", "degC", 2.0), ("relative_humidity_set_1", "relative_humidity", "percent", 2.0), ("wind_direction_set_1", "wind_direction", "degree", 10.0),
    ("wind_speed_set_1", "wind_speed", "m s-1", 10.0), ("wind_gust_set_1", "wind_gust", "m s-1", 10.0), ("solar_radiation_set_1", "solar_radiation", "W m-2", 2.0),
    ("fuel_moisture_set_1", "fuel_moisture_content_10h", "percent", 0.3),
)
# Usual sensor heights of providers, in m.
PROVIDER_HEIGHTS = (
    ("California Irrigation Management Information System", "air_temp_set_1", 1.5), ("California Irrigation Management Information System", "relative_humidity_set_1", 1.5),
    ("California Irrigation Management Information System", "solar_radiation_set_1", 2.0), ("California Irrigation Management Information System", "wind_direction_set_1", 2.0),
    ("Bureau of Land Management", "air_temp_set_1", 2.0), ("Bureau of Land Management", "fuel_moisture_set_1", 0.3), ("Bureau of Land Management", "relative_humidity_set_1", 2.0),
    ("Bureau of Land Management", "solar_radiation_set_1", 2.0), ("Bureau of Land Management", "wind_direction_set_1", 6.1), ("Bureau of Land Management", "wind_gust_set_1", 6.1),
    ("Bureau of Land Management", "wind_speed_set_1", 6.1), ("National Weather Service", "air_temp_set_1", 2.0), ("National Weather Service", "relative_humidity_set_1", 2.0),
    ("National Weather Service", "wind_direction_set_1", 10.0), ("National Weather Service", "wind_gust_set_1", 10.0), ("National Weather Service", "wind_speed_set_1", 10.0),
)
TRUST_HIGHEST, TRUST_PROVIDER, TRUST_NONE = 2, 1, 0
_STATION = """
STATION array<struct<STID:string, NAME:string, TIMEZONE:string, LATITUDE:string, LONGITUDE:string, ELEVATION:string,
PROVIDERS:array<struct<name:string>>, OBSERVATIONS:map<string,array<string>>,
SENSOR_VARIABLES:map<string,map<string,struct<position:string>>>>>
"""


def variable_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VARIABLES), "source string, variable string, units string, default_height double")


def provider_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROVIDER_HEIGHTS), "provider string, source string, height double")


def read_heights(spark: SparkSession, path: str) -> DataFrame:
    """station_id, provider, source, height from JSON of the form {station: {variable: height, "provider": name}}."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("station_id", "m"))
    rows = raw.select("station_id", F.element_at("m", "provider").alias("provider"), F.explode(F.map_filter("m", lambda k, _: k != "provider")).alias("source", "height"))
    return rows.withColumn("height", F.col("height").try_cast("double"))


def trusted_heights(heights: DataFrame) -> DataFrame:
    """The heights that came with the stations' own data: the history of the next import."""
    return heights.where("height_source = 'from_data'").select("station_id", "provider", "source", "height")


def height_statistics(heights: DataFrame) -> DataFrame:
    """Variables by source of their sensor height, and how many of these are trusted."""
    return heights.groupBy("height_source").agg(F.count("*").alias("variables"), F.count_if(F.col("trust") == TRUST_HIGHEST).alias("trusted"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """One row per station of JSON files of the station service."""
    return spark.read.schema(_STATION).json(path, multiLine=True).select(F.inline("STATION"))


def scan_stations(spark: SparkSession, path: str, split_bytes: int = json_split.SPLIT_BYTES) -> DataFrame:
    """The rows of ``read_stations``, of files of any size: each is cut between its stations and read by many tasks. The files must lie where Python tasks reach them."""
    kind = spark.createDataFrame([], _STATION).schema["STATION"].dataType.elementType
    return json_split.read_elements(spark, path, "STATION", split_bytes).select(F.from_json("value", kind).alias("s")).select("s.*")


def sensor_heights(sensors: DataFrame, trusted: DataFrame, history: DataFrame, providers: DataFrame, defaults: DataFrame) -> DataFrame:
    """sensors (station_id, provider, source, data_height) with height, height_source and trust.

    First the station's own data, then trusted stations (station_id, source, height), their
    history, the provider's usual height (provider, source, height) and the variable's default (source, default_height).
    """
    s = sensors.join(trusted.select("station_id", "source", F.col("height").alias("_t")), ["station_id", "source"], "left")
    s = s.join(history.select("station_id", "source", F.col("height").alias("_h")), ["station_id", "source"], "left")
    s = s.join(providers.select("provider", "source", F.col("height").alias("_p")), ["provider", "source"], "left")
    s = s.join(defaults.select("source", F.col("default_height").alias("_d")), "source", "left")
    own = F.col("data_height").cast("double")
    steps = ((own, "from_data", TRUST_HIGHEST), (F.col("_t"), "trusted_stations", TRUST_HIGHEST), (F.col("_h"), "trusted_history", TRUST_HIGHEST), (F.col("_p"), "provider_default", TRUST_PROVIDER), (F.col("_d"), "default", TRUST_NONE))
    pick = lambda i: F.coalesce(*[F.when(v.isNotNull(), v.cast("double") if i == 0 else F.lit((n, t)[i - 1])) for v, n, t in steps])
    return s.select("station_id", "provider", "source", pick(0).alias("height"), pick(1).alias("height_source"), pick(2).alias("trust"))


def sensors_of(stations: DataFrame) -> DataFrame:
    """station_id, provider, source and data_height of every known variable that a station observed."""
    known = F.array(*[F.lit(v[0]) for v in VARIABLES])
    seen = F.array_intersect(F.map_keys("OBSERVATIONS"), known)
    meta = F.flatten(F.transform(F.map_values("SENSOR_VARIABLES"), lambda m: F.map_entries(m)))
    position = lambda v: F.try_element_at(F.transform(F.filter(meta, lambda e: e["key"] == v), lambda e: e["value"]["position"]), F.lit(1))
    rows = stations.select(F.col("STID").alias("station_id"), F.try_element_at("PROVIDERS", F.lit(1))["name"].alias("provider"), F.explode(F.transform(seen, lambda v: F.struct(v.alias("source"), position(v).try_cast("double").alias("data_height")))).alias("s"))
    return rows.select("station_id", "provider", "s.source", "s.data_height")


def time_series(stations: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """Long series: station_id, variable, units, ts (UTC), minutes since the station's first observation, value.

    Wall-clock times are read in the station's zone, so minutes are elapsed time across clock changes.
    Unknown variables are left out; missing values stay NULL.
    """
    rows = stations.where(~F.col("STID").isin(skip)) if skip else stations
    clock = F.transform(F.element_at("OBSERVATIONS", "date_time"), lambda t: timefmt.instant(t, F.col("TIMEZONE")))
    rows = rows.select("STID", clock.alias("t"), F.map_filter("OBSERVATIONS", lambda k, _: k != "date_time").alias("o"))
    rows = rows.select("STID", "t", F.explode("o").alias("source", "values"))
    rows = rows.select("STID", "source", F.element_at("t", 1).alias("t0"), F.explode(F.arrays_zip("t", "values")).alias("z"))
    names = stations.sparkSession.createDataFrame([v[:3] for v in VARIABLES], "source string, variable string, units string")
    return rows.join(F.broadcast(names), "source").select(
        F.col("STID").alias("station_id"), "variable", "units", F.col("z.t").alias("ts"), ((F.unix_micros("z.t") - F.unix_micros("t0")) / 60e6).alias("minutes"), F.col("z.values").try_cast("double").alias("value")
    )
