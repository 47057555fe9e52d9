"""Queries of whole evaluations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators import fuels, metrics, models, workflows
from emberframe.plans import model_queries  # noqa: F401  (its SQL checks the contracts)
from emberframe.plans.metric_queries import PERIODS, SQL, Q, query
from emberframe.session import load
from emberframe.sources import rasters

_HALF = {"click": 40.0, "view": 60.0, "purchase": 80.0, "signup": 50.0, "error": 70.0}


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urban classes from parts: one per size."""
    parts = load(spark, sf_dir, "part").groupBy(F.col("p_size").alias("fuel_class")).agg(F.avg("p_retailprice").alias("price"))
    return parts.withColumns({"building_length_side": 10 + F.col("fuel_class") / 5.0, "building_length_separation": 3 + F.col("fuel_class") / 10.0})


@query("""
WITH c AS (SELECT p_size AS c, avg(p_retailprice) AS price FROM part GROUP BY 1), s AS (SELECT s_suppkey, s_acctbal AS price FROM supplier WHERE s_acctbal <> 0),
d AS (SELECT s_suppkey, c, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(abs(c.price - s.price) / abs(s.price), 12), c) AS k FROM s, c)
SELECT c AS closest_class, count(*) AS n FROM d WHERE k = 1 GROUP BY 1""")
def h_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each class is the closest one."""
    obs = load(spark, sf_dir, "supplier").where("s_acctbal <> 0").select("s_suppkey", F.col("s_acctbal").alias("price"))
    return fuels.closest_class(obs, _classes(spark, sf_dir), ["price"]).groupBy("closest_class").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT p_size AS c, avg(p_retailprice) AS price, 10 + p_size / 5.0 AS side, 3 + p_size / 10.0 AS sep FROM part GROUP BY p_size),
s AS (SELECT s_suppkey, s_nationkey, s_acctbal AS price, 0.4 * (1 + s_nationkey / 5.0) AS u, 0.05 + s_acctbal / 200000 AS obs FROM supplier WHERE s_suppkey % 10 <> 0 AND s_acctbal <> 0),
d AS (SELECT s.*, c.side, c.sep, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(abs(c.price - s.price) / abs(s.price), 12), c) AS k FROM s, c),
r AS (SELECT *, 0.16 * (side + sep) * (1 + 0.1 * u + 0.007 * u * u) / ((0.2 + 5 * 0.2 / 3) * (3 + 3 * side / 8 + 8 * sep / (1.15 * 5 * (5 + 0.5 * u)))) AS rd FROM d WHERE k = 1),
m AS (SELECT s_nationkey % 5 AS region, rd / 60 AS ros, obs FROM r)
SELECT region, round(sqrt(avg((ros - obs) * (ros - obs))), 6) AS rmse, round(sqrt(avg((ros - obs) * (ros - obs))) / (max(obs) - min(obs)), 6) AS nmse_range, round(avg(ros) - avg(obs), 6) AS bias, count(*) AS n
FROM m GROUP BY 1 HAVING count(*) > 1""")
def wf_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed against computed spread: incomplete rows, closest class, wind reduction, model, metrics."""
    s = load(spark, sf_dir, "supplier").where("s_acctbal <> 0")
    obs = s.select(
        (F.col("s_nationkey") % 5).alias("region"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_acctbal")).alias("price"), (1 + F.col("s_nationkey") / 5.0).alias("wind_speed"),
        (0.05 + F.col("s_acctbal") / 200000).alias("observed"),
    )
    classes = _classes(spark, sf_dir)
    obs = obs.withColumns({"wind_speed_u": F.col("wind_speed") * 0.4, "wind_speed_v": F.lit(0.0), "normal_spread_dir_x": F.lit(1.0), "normal_spread_dir_y": F.lit(0.0)})
    for name, unit in (("wind_speed_u", "m s-1"), ("wind_speed_v", "m s-1")):
        obs = obs.withMetadata(name, {"units": unit})
    for name in ("building_length_side", "building_length_separation"):
        classes = classes.withMetadata(name, {"units": "m"})
    out = workflows.validate(obs, classes, ["price"], models.REGISTRY["hamada_2"], "observed")
    table = workflows.accuracy(out, "rate_of_spread", "observed", "region").where("n > 1")
    return table.select("region", *[F.round(c, 6).alias(c) for c in ("rmse", "nmse_range", "bias")], "n")


@query(f"""
WITH p AS (SELECT p AS period, event_type AS variable, user_id, sqrt(avg((value - 100) * (value - 100))) AS k FROM events
 JOIN (VALUES {", ".join(f"('{p}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for p, a, b in PERIODS)}) t(p, a, b) ON ts >= a AND ts < b WHERE user_id % 4 <> 0 GROUP BY 1, 2, 3),
s AS (SELECT variable, period, 'min' AS statistic, min(k) AS kpi FROM p GROUP BY 1, 2 UNION ALL SELECT variable, period, 'mean', avg(k) FROM p GROUP BY 1, 2 UNION ALL SELECT variable, period, 'max', max(k) FROM p GROUP BY 1, 2)
SELECT variable, period, statistic, round(kpi, 6) AS kpi, round(100 * exp(-ln(2) * abs(kpi) / CASE variable {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _HALF.items())} END), 6) AS score FROM s""")
def wf_weather_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather scores by study period over trusted stations."""
    pairs = load(spark, sf_dir, "events").select(F.col("user_id").alias("station_id"), F.col("event_type").alias("variable"), "ts", F.col("value").alias("x"), F.lit(100.0).alias("ref"))
    periods = spark.createDataFrame(list(PERIODS), "period string, start string, end string").select("period", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")])
    out = workflows.weather_scores(pairs, periods, _HALF, trusted=F.col("station_id") % 4 != 0)
    return out.select("variable", "period", "statistic", F.round("kpi", 6).alias("kpi"), F.round("score", 6).alias("score"))


def _contract(name: str, kernel_query: str, columns) -> None:
    """A model's contract over all lineitems, by standard names; the kernel's SQL checks it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from emberframe.plans.model_queries import _IN, inputs

        c = {k: F.col(k) for k in _IN}
        df = inputs(spark, sf_dir).select("l_orderkey", "l_linenumber", *[v.cast("double").alias(k) for k, v in columns(c).items()])
        return models.REGISTRY[name].apply(df).select("l_orderkey", "l_linenumber", F.round("rate_of_spread", 6).alias("ros"))

    Q[f"c_{name}"], SQL[f"c_{name}"] = run, SQL[kernel_query]


_contract("rothermel", "k_rothermel", lambda c: {
    "fuel_load_dry_total": c["load"], "fuel_height": c["height"], "fuel_density": F.lit(32), "fuel_surface_area_volume_ratio": c["savr"], "fuel_moisture_extinction": F.lit(0.3), "fuel_mineral_content_total": F.lit(0.0555),
    "fuel_mineral_content_effective": F.lit(0.01), "fuel_chaparral_flag": F.lit(0), "wind_speed": c["wind"], "slope_angle": c["slope"], "fuel_moisture_content": c["moisture"],
})
_contract("balbi", "k_balbi", lambda c: {
    "fuel_load_dead_ratio": c["dead"], "fuel_load_dry_total": c["load"], "fuel_height": c["height"], "fuel_density": F.lit(500), "fuel_surface_area_volume_ratio": c["savr"] * 3, "wind_speed": c["wind"], "slope_angle": c["slope"],
    "fuel_moisture_content": c["moisture"],
})
_contract("santoni", "k_santoni", lambda c: {
    "fuel_load_dry_total": c["load"], "fuel_load_dead_ratio": c["dead"], "fuel_height": c["height"], "fuel_density_dead": F.lit(500), "fuel_density_live": F.lit(480), "fuel_surface_area_volume_ratio_dead": c["savr"] * 3,
    "fuel_surface_area_volume_ratio_live": c["savr"] * 2, "wind_speed": c["wind"], "slope_angle": c["slope"], "fuel_moisture_content_dead": c["moisture"], "fuel_moisture_content_live": c["moisture"] * 3,
})
_contract("hamada_1", "k_hamada1", lambda c: {
    "building_length_side": 10 + c["slope"] / 2, "building_length_separation": 3 + c["height"], "wind_speed_u": c["wind"], "wind_speed_v": c["load"], "normal_spread_dir_x": F.lit(0.8), "normal_spread_dir_y": F.lit(0.6),
})


@query("SELECT l_orderkey, l_linenumber, round((0.1 + 0.02 * l_quantity) * (1 + CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE l_discount END), 6) AS ros FROM lineitem")
def p_user_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of one's own: two inputs, one of them optional with a default, and a kernel of columns."""
    mine = models.register(models.Model("linear", (models.Param("wind", "wind_speed", "m s-1", 0), models.Param("gain", "fuel_gain", "1", 0, 1, 0.5)), lambda wind, gain: (0.1 + 0.02 * wind) * (1 + gain)))
    try:
        items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("wind_speed"), F.col("l_discount").alias("fuel_gain"))
        even = F.col("l_linenumber") % 2 == 0
        runs = [mine.apply(items.where(even).drop("fuel_gain")), mine.apply(items.where(~even)).drop("fuel_gain")]
    finally:
        del models.REGISTRY["linear"]
    return runs[0].unionByName(runs[1]).select("l_orderkey", "l_linenumber", F.round(mine.output, 6).alias("ros"))


_DAMAGE = ("No Damage", "Affected (1-9%)", "Major (26-50%)", "Destroyed (>50%)", "Inaccessible")


@query("""
WITH d AS (SELECT s_nationkey % 5 AS region, CASE s_suppkey % 5 WHEN 4 THEN NULL ELSE s_suppkey % 5 IN (2, 3) END AS observed, s_acctbal > 4000 AS burnt FROM supplier)
SELECT region, count(*) FILTER (burnt AND observed) AS tp, count(*) FILTER (NOT burnt AND observed) AS fn, count(*) FILTER (burnt AND NOT observed) AS fp, count(*) FILTER (NOT burnt AND NOT observed) AS tn,
 round(count(*) FILTER (burnt = observed) / count(observed), 6) AS accuracy FROM d GROUP BY 1 HAVING count(observed) > 0""")
def wf_structure_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building damage reports as burnt or not, against a model's burnt buildings; inaccessible ones drop out, and regions without any other."""
    damage = F.element_at(F.array(*[F.lit(d) for d in _DAMAGE]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    df = load(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("region"), rasters.damage_burnt(damage).alias("observed"), (F.col("s_acctbal") > 4000).alias("burnt"))
    c = metrics.Confusion(F.col("burnt"), F.col("observed"))
    return df.where("observed is not null").groupBy("region").agg(c.tp.alias("tp"), c.fn.alias("fn"), c.fp.alias("fp"), c.tn.alias("tn"), F.round(c.accuracy(), 6).alias("accuracy"))


@query("""
WITH p AS (SELECT o_orderkey // 2500 AS grid_id, o_orderkey % 2500 // 50 AS r, o_orderkey % 50 AS c, o_custkey % 6 AS severity, o_totalprice > 200000 AS modelled FROM orders),
v AS (SELECT o_orderkey // 2500 AS grid_id, o_orderkey % 2500 // 20 AS r, o_orderkey % 2500 % 20 AS c, o_custkey % 4 AS a, o_custkey % 5 AS b FROM orders WHERE o_orderkey % 2500 < 400),
m AS (SELECT p.grid_id, modelled, CASE WHEN a > 0 AND b > 0 AND severity = 5 THEN 1 WHEN a > 0 AND b > 0 AND severity BETWEEN 1 AND 4 THEN 0 END AS lost
 FROM p LEFT JOIN v ON p.grid_id = v.grid_id AND v.r = CAST(floor((p.r + 0.5) / 2.5) AS BIGINT) AND v.c = CAST(floor((p.c + 0.5) / 2.5) AS BIGINT))
SELECT grid_id, count(lost) AS pixels, sum(lost) AS lost, round(count(*) FILTER (modelled AND lost = 1) / count(*) FILTER (lost IS NOT NULL AND (modelled OR lost = 1)), 6) AS jaccard FROM m GROUP BY 1""")
def wf_canopy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canopy lost where two vegetation layers of a coarser grid are positive, against a model's mask: severity in 50 x 50 pixels, layers in 20 x 20."""
    k = F.col("o_orderkey")
    orders = load(spark, sf_dir, "orders").withColumn("grid_id", F.floor(k / 2500)).withColumn("k", k % 2500)
    severity = orders.select("grid_id", (F.col("k") % 50 + 0.5).alias("x"), (F.floor(F.col("k") / 50) + 0.5).alias("y"), (F.col("o_custkey") % 6).alias("severity"), (F.col("o_totalprice") > 200000).alias("modelled"))
    coarse = orders.where("k < 400").groupBy("grid_id", F.floor(F.col("k") / 20).alias("row")).agg(F.array_sort(F.collect_list(F.struct("k", "o_custkey"))).alias("o"))
    for name, m in (("a", 4), ("b", 5)):
        layer = coarse.select("grid_id", *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("dx", 2.5), ("y0", 0.0), ("dy", 2.5), ("width", 20), ("height", 20))], "row", F.transform("o", lambda s: s["o_custkey"] % m).alias("values"))  # noqa: B023
        severity = rasters.resample(severity, layer, "grid_id", value=name)
    df = severity.select("grid_id", rasters.canopy_loss(F.col("severity"), F.col("a"), F.col("b")).alias("lost"), "modelled")
    known = F.col("lost").isNotNull()
    return df.groupBy("grid_id").agg(F.count("lost").alias("pixels"), F.sum("lost").alias("lost"), F.round(metrics.jaccard(F.col("modelled") & known, F.coalesce(F.col("lost") == 1, F.lit(False))), 6).alias("jaccard"))


@query("""
WITH p AS (SELECT o_orderkey % 7 AS grid_id, nullif(o_custkey % 6, 0) = 4 AS observed, o_totalprice > 200000 AS modelled FROM orders)
SELECT grid_id, count(observed) AS pixels, round(count(*) FILTER (modelled AND observed) / count(*) FILTER (modelled AND observed IS NOT NULL), 6) AS precision, round(count(*) FILTER (modelled AND observed) / count(*) FILTER (observed), 6) AS recall FROM p GROUP BY 1""")
def wf_high_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High burn severity (class 4 of the catalogue, no data left out) against a model's mask."""
    classes = spark.createDataFrame(list(metrics.SEVERITY_CLASSES), "severity int, name string")
    df = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("grid_id"), (F.col("o_custkey") % 6).cast("int").alias("severity"), (F.col("o_totalprice") > 200000).alias("modelled"))
    named = df.join(classes, "severity").where("name <> 'no data'").withColumn("observed", F.col("name") == "high")
    c = metrics.Confusion(F.col("modelled"), F.col("observed"))
    return named.groupBy("grid_id").agg(F.count("*").alias("pixels"), F.round(c.precision(), 6).alias("precision"), F.round(c.recall(), 6).alias("recall"))
