"""Queries of kernels, preparation, designs, station data and standard datasets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from emberframe.functions import physics, sensors, timefmt, units, wind
from emberframe.operators import fuels, models, provenance, sensitivity, standard, workflows
from emberframe.plans.metric_queries import Q, SQL, query
from emberframe.session import load, scratch
from emberframe.sources import stations
from emberframe.streaming import windows

# lineitem columns rescaled into the ranges of the kernels
_IN = {
    "load": "0.2 + l_quantity / 50", "height": "0.2 + l_tax * 10", "wind": "l_quantity / 5 - 2", "slope": "l_linenumber * 4 - 14", "moisture": "2 + l_discount * 300",
    "savr": "1000 + l_linenumber * 150", "dead": "0.5 + l_discount * 4",
}
_BASE = "(SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _IN.items()) + " FROM lineitem)"


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"CAST({v} AS DOUBLE) AS {k}" for k, v in _IN.items()])


def _kernel(name: str, column, sql: str) -> None:
    """A kernel over all lineitems; SQL computes ``ros`` from ``_BASE``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = {k: F.col(k) for k in _IN}
        return inputs(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(column(**c), 6).alias("ros"))

    Q[name], SQL[name] = run, sql


_kernel(
    "k_rothermel",
    lambda load, height, wind, slope, moisture, savr, dead: physics.rothermel(load, height, 32, savr, 0.3, 0.0555, 0.01, 0, wind, slope, moisture),
    f"""WITH a AS (SELECT *, load * 0.3048 ** 2 * 2.205 AS w, height / 0.3048 AS d, moisture / 100 AS m FROM {_BASE}),
b AS (SELECT *, w / (d * 32) AS beta, w / (d * 32) / (3.348 * savr ** -0.8189) AS r, (m / 0.3) AS x, 1 / (4.774 * savr ** 0.1 - 7.27) AS aa FROM a),
c AS (SELECT *, savr ** 1.5 / (495 + 0.0594 * savr ** 1.5) * r ** aa * exp(aa * (1 - r)) * w / 1.0555 * 17.433e6 * 4.3e-4
  * least(1, greatest(0, 1 - 2.59 * x + 5.11 * x * x - 3.52 * x * x * x)) * 0.174 * 0.01 ** -0.19 AS ir, exp((0.792 + 0.681 * sqrt(savr)) * (beta + 0.1)) / (192 + 0.2595 * savr) AS xi FROM b),
e AS (SELECT *, ir * xi / (w / d * exp(-138 / savr) * (250 + 1116 * m)) AS r0, (least(30, greatest(0, wind)) * 196.85) ** (0.02526 * savr ** 0.54) * 7.47 * exp(-0.133 * savr ** 0.55) * r ** (-0.715 * exp(-3.59e-4 * savr)) AS pw,
  5.275 * beta ** -0.3 * greatest(0, tan(radians(slope))) ** 2 AS ps FROM c)
SELECT l_orderkey, l_linenumber, round(least(6, r0 * (1 + pw + ps) * 0.00508), 6) AS ros FROM e""",
)
_kernel(
    "k_santoni",
    lambda load, height, wind, slope, moisture, savr, dead: physics.santoni(load, dead, height, 500, 480, savr * 3, savr * 2, wind, slope, moisture, moisture * 3),
    f"""WITH a AS (SELECT *, savr * 2 * load * (1 - dead) / 480 AS sl, savr * 3 * load * dead / 500 AS sd, moisture / 100 AS md, moisture * 3 / 100 AS ml, 1200 * 300 AS q FROM {_BASE}),
b AS (SELECT *, (ml - md) * sl * 2.3e6 / (sd * 1.7433e7) AS xi, least(1, sd / 4) AS nu FROM a),
c AS (SELECT *, 300 + 1.7433e7 * 0.7 * (1 - xi) / (1150 * 9.3) AS tn FROM b),
d AS (SELECT *, atan(tan(radians(slope)) + wind / (2 * nu * 4 * 9.3 * tn * 500 / (1.125 * 300 * 75591))) AS g,
  height * 5.670373e-8 * tn ** 4 / q / (load * dead * (1 + 2.3e6 / q * md)) * (sd / (sd + sl)) ** 2 AS r0, nu * 0.25 * 0.3 * 1.7433e7 / q * (1 - xi) / (1 + 2.3e6 / q * md) AS aa, savr * 3 * 2.5e-5 AS rs FROM c),
e AS (SELECT *, r0 + aa * rs * (1 + sin(g) - cos(g)) / cos(g) - rs / cos(g) AS rt FROM d)
SELECT l_orderkey, l_linenumber, round(least(6, CASE WHEN g > 0 THEN 0.5 * (rt + sqrt(rt * rt + 4 * rs * r0 / cos(g))) ELSE r0 END), 6) AS ros FROM e""",
)
_kernel(
    "k_balbi",
    lambda load, height, wind, slope, moisture, savr, dead: physics.balbi(dead, load, height, 500, savr * 3, wind, slope, moisture),
    f"""WITH a AS (SELECT *, moisture / 100 AS m, load * (1 + moisture / 100) AS st, savr * 3 AS s FROM {_BASE}),
b AS (SELECT *, st * dead / (height * 500) AS beta, st / (height * 500) AS bt, s * height * st * dead / (height * 500) AS lai, s * height * st / (height * 500) AS lt, 1200 * 300 + m * (2.3e6 + 4180 * 73.15) AS q, 300 + 1.7433e7 * 0.7 / (1150 * 18) AS tf FROM a),
c AS (SELECT *, least(lt / (2 * pi()), 1) * (lai / lt) ** 2 * 5.670373e-8 * tf ** 4 / (beta * 500 * q) AS rb, least(lai / (2 * pi()), lai / lt) * 0.3 * 1.7433e7 / (4 * q) AS aa,
  greatest(0, atan(tan(radians(slope)) + wind / (2 * 18 * 500 * tf * least(lai, 2 * pi() * lai / lt) / (75591 * 1.125 * 300)))) AS g FROM b),
d AS (SELECT *, 0.025 * 1.7433e7 * 1.125 * 300 * s * sqrt(height) / (2 * q * 18 * 500 * tf) AS k1, least(2 * pi() * lai / lt, lai) * tan(g) * 18 * 500 * tf / (1.125 * 300 * 75591) AS k2, cos(g) / (s * 2.5e-5) AS den FROM c),
e AS (SELECT l_orderkey, l_linenumber, list_reduce(list_transform(range(21), lambda i: {{'r': rb, 'done': false}}), lambda z, y: CASE WHEN z.done THEN z ELSE
  {{'r': rb + greatest(0, k1 * (k2 + wind * exp(-bt * z.r))) + aa * z.r * (1 - sin(g) + cos(g)) / (1 + z.r * den),
    'done': abs(rb + greatest(0, k1 * (k2 + wind * exp(-bt * z.r))) + aa * z.r * (1 - sin(g) + cos(g)) / (1 + z.r * den) - z.r) < 1e-4}} END) AS z FROM d)
SELECT l_orderkey, l_linenumber, round(CASE WHEN z.done THEN least(6, z.r) ELSE 0 END, 6) AS ros FROM e""",
)
_kernel(
    "k_hamada1",
    lambda load, height, wind, slope, moisture, savr, dead: physics.hamada_1(10 + slope / 2, 3 + height, wind, load, 0.8, 0.6),
    f"""WITH a AS (SELECT *, 10 + slope / 2 AS s, 3 + height AS d, sqrt(wind * wind + load * load) AS w FROM {_BASE}),
t AS (SELECT *, (0.4 * (3 + 0.375 * s + 8 * d / (25 + 2.5 * w)) + 0.6 * (5 + 0.625 * s + 16 * d / (25 + 2.5 * w))) / (1.5 * (1 + 0.1 * w + 0.007 * w * w)) AS td,
 (0.4 * (3 + 0.375 * s + 8 * d / (5 + 0.25 * w)) + 0.6 * (5 + 0.625 * s + 16 * d / (5 + 0.25 * w))) / (1 + 0.005 * w * w) AS tx,
 (0.4 * (3 + 0.375 * s + 8 * d / (5 + 0.2 * w)) + 0.6 * (5 + 0.625 * s + 16 * d / (5 + 0.2 * w))) / (1 + 0.002 * w * w) AS tu, (0.8 * wind + 0.6 * load) / w AS k FROM a),
r AS (SELECT *, (s + d) / td AS rd, (s + d) / tx AS rx, (s + d) / tu AS ru FROM t)
SELECT l_orderkey, l_linenumber, round(CASE WHEN k >= 0 THEN rd * rd / (2 * rd - rx) * (1 - ((rd - rx) / rd) ** 2) / (1 - (rd - rx) / rd * k) ELSE rx * ru / sqrt(ru * ru * (1 - k * k) + rx * rx * k * k) END / 60, 6) AS ros FROM r""",
)
_kernel(
    "k_hamada2",
    lambda load, height, wind, slope, moisture, savr, dead: physics.hamada_2(10 + slope / 2, 3 + height, wind, load, 0.8, 0.6, 0.6, 0.25, 0.15, 4),
    f"""WITH a AS (SELECT *, 10 + slope / 2 AS s, 3 + height AS d, sqrt(wind * wind + load * load) AS w FROM {_BASE}),
r AS (SELECT *, 0.4 * 0.4 * (s + d) * (1 + 0.1 * w + 0.007 * w * w) / ((0.25 + 5 * 0.15 / 3) * (3 + 3 * s / 8 + 8 * d / (1.15 * 4 * (5 + 0.5 * w)))) AS rd,
 0.4 * 0.4 * (s + d) * (1 + 0.002 * w * w) / ((0.25 + 5 * 0.15 / 3) * (3 + 3 * s / 8 + 8 * d / (1.15 * (5 + 0.5 * w)))) AS rx, (0.8 * wind + 0.6 * load) / w AS k FROM a)
SELECT l_orderkey, l_linenumber, round(rd * rd / (2 * rd - rx) * (1 - ((rd - rx) / rd) ** 2) / (1 - (rd - rx) / rd * k) / 60, 6) AS ros FROM r""",
)


@query("""
WITH a AS (SELECT p_partkey, 2 + p_size / 5.0 AS f, 1 + p_retailprice / 1000 AS h, 20 + p_size AS z FROM part)
SELECT p_partkey, round((1 + 0.36 * h / f) * (ln((0.36 + f / h) / 0.13) - 1) / ln((20 + 0.36 * h) / (0.13 * h)), 6) AS wrf_20ft,
 round((((h + f - 0.64 * h) * ln((h + f - 0.64 * h) / (0.13 * h)) - (h + f)) - ((h - 0.64 * h) * ln((h - 0.64 * h) / (0.13 * h)) - h)) / f / ln((z + h - 0.64 * h) / (0.13 * h)), 6) AS wrf_above,
 round((((h + f - 0.64 * h) * ln((h + f - 0.64 * h) / (0.13 * h)) - (h + f)) - ((h - 0.64 * h) * ln((h - 0.64 * h) / (0.13 * h)) - h)) / f / ln((z - 0.64 * h) / (0.13 * h)), 6) AS wrf_ground,
 round(2 / pi() * exp(-0.25 * 3 * h / f) * ln(3 * h / (0.3 * greatest(5, 3 * h))) / ln((100 - 2 * h) / (0.1 * greatest(5, 3 * h))) * 10, 6) AS canyon FROM a""")
def w_wind_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind factors and the canyon profile over parts."""
    f, h, z = 2 + F.col("p_size") / 5.0, 1 + F.col("p_retailprice") / 1000, 20 + F.col("p_size")
    out = {"wrf_20ft": wind.reduction_20ft(f, h), "wrf_above": wind.reduction_general(z, f, h, True), "wrf_ground": wind.reduction_general(z, f, h, False), "canyon": wind.urban_canyon(F.lit(10.0), F.lit(100.0), 3 * h, f)}
    return load(spark, sf_dir, "part").select("p_partkey", *[F.round(v, 6).alias(k) for k, v in out.items()])


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * (0.3 + l_tax), 6) AS wind FROM lineitem")
def w_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(wind.apply_reduction(F.col("l_quantity"), 0.3 + F.col("l_tax")), 6).alias("wind"))


_STEP = "CASE WHEN l_quantity < 10 THEN {} WHEN l_quantity < 20 THEN {} WHEN l_quantity < 30 THEN {} ELSE {} END"


@query(f"SELECT l_orderkey, l_linenumber, round({_STEP.format(*sensors.RMS['CS505'])} * 1.959963984540054, 6) AS cs505, round({_STEP.format(*sensors.RMS['CS506'])} * 1.959963984540054, 6) AS cs506 FROM lineitem")
def n_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % half-widths of both sensors."""
    q = F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(sensors.half_width(s, q, 95), 6).alias(s.lower()) for s in ("CS505", "CS506")])


@query("""
WITH c AS (SELECT p_size AS c, avg(p_retailprice) AS price FROM part GROUP BY 1), s AS (SELECT s_suppkey, s_acctbal AS price, CAST(s_nationkey AS DOUBLE) AS size FROM supplier),
d AS (SELECT s_suppkey, c, abs(c.price - s.price) * CASE WHEN s.price = 0 THEN 1 ELSE 1 / abs(s.price) END + abs(c - size) * CASE WHEN size = 0 THEN 1 ELSE 1 / abs(size) END AS dist FROM s, c)
SELECT s_suppkey, c AS closest_class FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(dist, 9), c) AS k FROM d) WHERE k = 1""")
def p_closest_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to the nearest class of parts by price and size."""
    classes = load(spark, sf_dir, "part").groupBy(F.col("p_size").alias("fuel_class")).agg(F.avg("p_retailprice").alias("price")).withColumn("size", F.col("fuel_class").cast("double"))
    obs = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("price"), F.col("s_nationkey").cast("double").alias("size"))
    return fuels.closest_class(obs, classes, ["price", "size"]).select("s_suppkey", "closest_class")


_FUEL = "l_quantity / 50 AS a, l_discount AS b, l_tax AS c, 0.1 + l_discount / 2 AS d, 0.2 + l_tax / 2 AS e"


@query(f"""SELECT l_orderkey, l_linenumber, round(a + b + c + d + e, 6) AS fuel_load_dry_total, round((a * 2000 + d * 1500 + e * 1800) / (a + d + e), 6) AS fuel_surface_area_volume_ratio,
 round((a + b + c) / (a + b + c + d + e), 6) AS fuel_load_dead_ratio FROM (SELECT l_orderkey, l_linenumber, {_FUEL} FROM lineitem)""")
def p_fuel_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total load, weighted ratio and dead share of five size classes."""
    names = ["fuel_load_dry_1h", "fuel_load_dry_10h", "fuel_load_dry_100h", "fuel_load_dry_live_herb", "fuel_load_dry_live_woody"]
    parts = [x.split(" AS ")[0] for x in _FUEL.split(", ")]
    df = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{v} AS {n}" for v, n in zip(parts, names, strict=True)])
    df = df.withColumns({f"fuel_surface_area_volume_ratio_{k}": F.lit(v) for k, v in (("dead_1h", 2000.0), ("live_herb", 1500.0), ("live_woody", 1800.0))})
    df = fuels.dead_ratio(fuels.total_savr(fuels.total_load(df)))
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("fuel_load_dry_total", "fuel_surface_area_volume_ratio", "fuel_load_dead_ratio")])


@query("""SELECT p_partkey, round(p_size * 0.3048, 6) AS metres, round(p_size + 273.15, 6) AS kelvin, round(p_size / 3.6, 6) AS speed, round(p_size * 0.45359237 / 0.3048 ** 3, 6) AS density,
 round(p_size / 0.3048, 6) AS ratio, round(p_size * 907.18474 / 4046.8564224, 6) AS load, round(degrees(atan(p_size / 100.0)), 6) AS slope FROM part""")
def p_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_size").cast("double")
    pairs = {"metres": ("ft", "m"), "kelvin": ("degC", "K"), "speed": ("km h-1", "m s-1"), "density": ("lb ft-3", "kg m-3"), "ratio": ("ft-1", "m-1"), "load": ("short ton acre-1", "kg m-2")}
    return load(spark, sf_dir, "part").select("p_partkey", *[F.round(units.convert(v, *p), 6).alias(k) for k, p in pairs.items()], F.round(units.slope_percent_to_degrees(v), 6).alias("slope"))


@query("""SELECT * FROM (SELECT 'fuel_load_dry_total' AS std_name, min(l_quantity / 10) AS least, max(l_quantity / 10) AS largest, true AS valid FROM lineitem
 UNION ALL SELECT 'slope_angle', min(l_quantity * 2), max(l_quantity * 2), max(l_quantity * 2) <= 90 FROM lineitem UNION ALL SELECT 'fuel_moisture_content', min(l_tax * 100), max(l_tax * 100), true FROM lineitem)""")
def p_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range check of a model's inputs in one pass."""
    df = load(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("fuel_load_dry_total"), (F.col("l_quantity") * 2).alias("slope_angle"), (F.col("l_tax") * 100).alias("fuel_moisture_content"))
    return models.range_violations(df, models.REGISTRY["rothermel"]).select("std_name", "least", "largest", "valid")


@query("SELECT l_orderkey, l_linenumber, 50.0::DOUBLE AS ignition_length, coalesce(CASE WHEN l_linenumber > 3 THEN l_quantity END, 300) AS air_temperature FROM lineitem")
def p_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults of optional inputs that a table lacks, and of values that are missing."""
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 3, F.col("l_quantity")).alias("air_temperature"))
    return models.with_defaults(items, models.REGISTRY["balbi"], fill=True).select("l_orderkey", "l_linenumber", "ignition_length", "air_temperature")


_DESIGN = {"wind": (0.0, 10.0), "moisture": (2.0, 30.0), "slope": (0.0, 30.0)}


@query("""
WITH RECURSIVE v(k, v1, v2) AS (SELECT 0, 1073741824::BIGINT, 1073741824::BIGINT UNION ALL SELECT k + 1, v1 // 2, xor(v2, v2 // 2) FROM v WHERE k < 30),
b AS (SELECT min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem), n AS (SELECT row_number() OVER () AS i FROM supplier),
p AS (SELECT i, bit_xor(CASE WHEN (xor(i, i // 2) >> k) & 1 = 1 THEN v1 ELSE 0 END) AS a, bit_xor(CASE WHEN (xor(i, i // 2) >> k) & 1 = 1 THEN v2 ELSE 0 END) AS b FROM n, v GROUP BY 1)
SELECT i - 1 AS point_id, block, CASE WHEN block IN ('A', 'BA_wind') THEN p.a ELSE p.b END / 2147483648.0::DOUBLE * (high - low) + low AS wind FROM p, b, (VALUES ('A'), ('B'), ('AB_wind'), ('BA_wind')) t(block)
""")
def d_saltelli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design of one variable between the bounds of the line items' quantities, with a point for each supplier: N (2 D + 2) rows."""
    low, high = load(spark, sf_dir, "lineitem").agg(F.min("l_quantity"), F.max("l_quantity")).first()
    return sensitivity.saltelli(spark, load(spark, sf_dir, "supplier").count(), {"wind": (float(low), float(high))})


@query("""
WITH p AS (SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, CAST(embedding[3] AS DOUBLE) AS x2, CAST(embedding[4] AS DOUBLE) AS x3, CAST(embedding[5] AS DOUBLE) AS x4, CAST(embedding[6] AS DOUBLE) AS x5 FROM embeddings),
y AS (SELECT *, x0 + 2 * x1 * x1 + 3 * x2 * x0 AS a, x3 + 2 * x4 * x4 + 3 * x5 * x3 AS b, x3 + 2 * x1 * x1 + 3 * x2 * x3 AS c0, x0 + 2 * x4 * x4 + 3 * x2 * x0 AS c1, x0 + 2 * x1 * x1 + 3 * x5 * x0 AS c2 FROM p),
u AS (SELECT 'u' AS variable, a, b, c0 AS ab FROM y UNION ALL SELECT 'v', a, b, c1 FROM y UNION ALL SELECT 'w', a, b, c2 FROM y)
SELECT variable, round(avg(b * (ab - a)) / (avg(a * a + b * b) / 2 - (avg(a + b) / 2) ** 2), 6) AS s1, round(avg((a - ab) * (a - ab)) / 2 / (avg(a * a + b * b) / 2 - (avg(a + b) / 2) ** 2), 6) AS st FROM u GROUP BY 1""")
def d_sobol_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of u + 2 v^2 + 3 w u, where each vector's first components are a point of either sample."""
    pts = load(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(6)])
    rows = pts.withColumn("block", F.explode(F.array(*[F.lit(b) for b in ("A", "B", "AB_u", "AB_v", "AB_w")])))
    pick = lambda i, v: F.when((F.col("block") == "B") | (F.col("block") == f"AB_{v}"), F.col(f"x{i + 3}")).otherwise(F.col(f"x{i}"))
    u, v, w = pick(0, "u"), pick(1, "v"), pick(2, "w")
    results = rows.select(F.col("vec_id").alias("point_id"), "block", (u + 2 * v * v + 3 * w * u).alias("y"))
    return sensitivity.sobol_indices(results, ["u", "v", "w"], "y", ordered=True).select("variable", F.round("s1", 6).alias("s1"), F.round("st", 6).alias("st"))


@query()
def d_model_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity studies of two models over thirteen fuel classes, made of the parts by size, 1,024 base points each: indices per model, class and variable, with intervals."""
    names = {"wind_speed": _DESIGN["wind"], "slope_angle": _DESIGN["slope"], "fuel_moisture_content": _DESIGN["moisture"]}
    parts = load(spark, sf_dir, "part").groupBy((F.col("p_size") % 13 + 1).cast("int").alias("fuel_class")).agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    fuel = parts.select("fuel_class", (0.3 + F.col("price") / 1000).alias("fuel_load_dry_total"), (0.2 + F.col("size") / 40).alias("fuel_height"), (1000.0 + 20 * F.col("size")).alias("fuel_surface_area_volume_ratio"))
    given = {
        "rothermel": {"fuel_density": 32.0, "fuel_moisture_extinction": 0.3, "fuel_mineral_content_total": 0.0555, "fuel_mineral_content_effective": 0.01, "fuel_chaparral_flag": 0.0},
        "balbi": {"fuel_density": 500.0, "fuel_load_dead_ratio": 0.8},
    }
    out = None
    for name, values in given.items():
        table = fuel.withColumns({k: F.lit(v) for k, v in values.items()})
        if name == "balbi":
            table = table.withColumn("fuel_surface_area_volume_ratio", F.col("fuel_surface_area_volume_ratio") * 3)
        one = workflows.sensitivity_study(spark, table, models.REGISTRY[name], names, 1024, resamples=10).select(F.lit(name).alias("model"), "fuel_class", "variable", *[F.round(c, 6).alias(c) for c in ("s1", "st", "s1_conf", "st_conf")])
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT user_id, event_id, round((epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 60e6, 6) AS minutes FROM events""")
def t_time_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes since a station's first observation."""
    minutes = timefmt.minutes_since_first(F.col("ts"), "user_id", "ts", "event_id")
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.round(minutes, 6).alias("minutes"))


@query("""
WITH s AS (SELECT DISTINCT user_id AS station_id, event_type AS source, user_id % 5 AS provider FROM events)
SELECT station_id, source, CASE WHEN station_id % 7 = 0 THEN 9.0 WHEN station_id % 4 = 0 THEN 4.0 WHEN station_id % 3 = 0 THEN 3.0 WHEN provider < 2 THEN 6.0 ELSE 2.0 END AS height,
 CASE WHEN station_id % 7 = 0 THEN 'from_data' WHEN station_id % 4 = 0 THEN 'trusted_stations' WHEN station_id % 3 = 0 THEN 'trusted_history' WHEN provider < 2 THEN 'provider_default' ELSE 'default' END AS height_source,
 CASE WHEN station_id % 7 = 0 OR station_id % 4 = 0 OR station_id % 3 = 0 THEN 2 WHEN provider < 2 THEN 1 ELSE 0 END AS trust FROM s""")
def t_sensor_height_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor heights by priority: own data, trusted station, history, provider, default."""
    s = load(spark, sf_dir, "events").select(F.col("user_id").alias("station_id"), F.col("event_type").alias("source")).distinct()
    s = s.withColumn("provider", F.col("station_id") % 5).withColumn("data_height", F.when(F.col("station_id") % 7 == 0, 9.0))
    every = lambda k, h: s.where(F.col("station_id") % k == 0).select("station_id", "source", F.lit(h).alias("height"))
    providers = s.where("provider < 2").select("provider", "source").distinct().withColumn("height", F.lit(6.0))
    defaults = s.select("source").distinct().withColumn("default_height", F.lit(2.0))
    return stations.sensor_heights(s, every(4, 4.0), every(3, 3.0), providers, defaults).select("station_id", "source", "height", "height_source", "trust")


@query("SELECT vec_id, CAST(i AS INTEGER) AS pos, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value FROM embeddings, range(64) t(i)")
def e_array_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array payloads to long rows."""
    return load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("SELECT event_id, k AS key FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)")
def e_json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable keys of JSON objects to rows."""
    return load(spark, sf_dir, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))


@query("""SELECT o_orderkey, 'c' || o_custkey % 3 || ';' || CASE WHEN o_custkey % 3 <> o_orderkey % 3 THEN 'c' || o_orderkey % 3 || ';' ELSE '' END || 'x;' AS authors FROM orders""")
def x_merge_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string"), F.lit("; x;"))
    b = F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string"), F.lit(";"))
    return load(spark, sf_dir, "orders").select("o_orderkey", standard.merge_authors(a, b).alias("authors"))


def _catalog(df: DataFrame, file_id: str, shape, unit) -> DataFrame:
    path = F.concat(F.lit("/points/p"), F.col("p_partkey").cast("string"))
    return df.select(F.lit(file_id).alias("file_id"), path.alias("path"), F.when(F.col("p_size") == 1, "group").otherwise("dataset").alias("kind"), F.lit("float64").alias("dtype"), F.array(shape.cast("long")).alias("shape"), F.create_map(F.lit("units"), unit).alias("attrs"))


@query("""
SELECT '/points/p' || p_partkey AS path, 'dataset_mismatch' AS kind FROM part WHERE p_size % 5 = 0 AND p_size <> 1 AND p_partkey % 2 = 0
UNION ALL SELECT '/points/p' || p_partkey, 'attr_mismatch' FROM part WHERE p_size % 7 = 0 AND p_partkey % 2 = 0""")
def x_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of two catalogs that share every other node."""
    parts, size = load(spark, sf_dir, "part"), F.col("p_size")
    left = _catalog(parts, "a", size, F.lit("m"))
    right = _catalog(parts.where("p_partkey % 2 = 0"), "b", F.when(size % 5 == 0, size + 1).otherwise(size), F.when(size % 7 == 0, "ft").otherwise("m"))
    return standard.conflicts(left, right).select("path", "kind")


@query("SELECT '/points/p' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'm' ELSE 'ft' END AS units FROM part")
def x_tree_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two disjoint catalogs."""
    parts, size = load(spark, sf_dir, "part"), F.col("p_size")
    left, right = _catalog(parts.where("p_partkey % 2 = 0"), "a", size, F.lit("m")), _catalog(parts.where("p_partkey % 2 = 1"), "b", size, F.lit("ft"))
    return standard.merge_catalogs(left, right).select("path", F.element_at("attrs", "units").alias("units"))


@query("SELECT '/points/p' || p_partkey AS path FROM part WHERE p_size > 40")
def x_missing_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    catalog = _catalog(parts.where("p_size <= 40"), "a", F.col("p_size"), F.lit("m"))
    wanted = parts.select(F.col("p_partkey").alias("position"), F.concat(F.lit("/points/p"), F.col("p_partkey").cast("string")).alias("path"), F.lit(None).cast("string").alias("attribute"))
    return standard.missing_requirements(catalog, wanted, "a").select("path")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def v_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts as of files."""
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.length("text").alias("length"), F.col("text").cast("binary").alias("content"))
    return provenance.file_digests(texts).select(F.col("path").alias("doc_id"), "sha256")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'VL-C' WHEN doc_id % 3 > 0 THEN 'VL-B' WHEN doc_id % 5 > 0 THEN 'VL-A' ELSE 'VL-A+' END AS level FROM documents")
def v_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification levels of runs by the certificates they hold."""
    full = provenance.LEVELS[0][1]
    d = F.col("doc_id")
    held = F.array_compact(F.array(F.when(d % 2 == 0, full[0]), F.lit(full[1]), F.when(d % 3 == 0, full[2]), F.when(d % 5 == 0, full[3])))
    return load(spark, sf_dir, "documents").select("doc_id", provenance.verification_level(held).alias("level"))


@query("SELECT event_id, replace(replace(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '-', '_'), ':', '_') AS safe, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events")
def t_iso_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    iso = timefmt.iso_with_offset(ts, F.lit("UTC"))
    return load(spark, sf_dir, "events").select("event_id", timefmt.sanitize(F.substring(iso, 1, 19)).alias("safe"), iso.alias("iso"))


@query("""
SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, round(sqrt(avg((value - 100) * (value - 100))), 6) AS kpi, count(*) AS n FROM events GROUP BY 1, 2""")
def z_windowed_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed metric over the events as a batch; the same call takes a stream."""
    from emberframe.operators.metrics import rmse

    df = load(spark, sf_dir, "events").withColumn("ref", F.lit(100.0))
    out = windows.windowed_metric(df, rmse, "value", "ref", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.round("kpi", 6).alias("kpi"), "n")


@query("""
SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, round(sqrt(avg((value - 100) * (value - 100))), 6) AS kpi, count(*) AS n FROM events
GROUP BY 1, 2 HAVING time_bucket(INTERVAL '6 hours', min(ts)) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""")
def z_stream_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed metric as a stream over the events, run to its end; windows still open at the end stay out."""
    from emberframe.operators.metrics import rmse

    folder = scratch(spark, "stream")
    schema = load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = windows.windowed_metric(events.withColumn("ref", F.lit(100.0)), rmse, "value", "ref", "event_type")
    out = windows.run_available(spark, stream, f"{folder}/out", f"{folder}/state")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.round("kpi", 6).alias("kpi"), "n")
