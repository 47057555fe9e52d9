"""Queries of the metrics, norms and score cards, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import kpi
from emberframe.operators import metrics as M
from emberframe.operators import scorecard
from emberframe.session import load

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query with its SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in pairs: quantity against the discount on the same scale."""
    return load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("ref"))


_PAIRS = "(SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity AS x, l_discount * 500 AS ref FROM lineitem)"


def _metric(name: str, metric, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pairs(spark, sf_dir).groupBy("l_returnflag").agg(F.round(metric(F.col("x"), F.col("ref")), 6).alias("kpi"), F.count("*").alias("n"))

    Q[name] = run
    SQL[name] = f"SELECT l_returnflag, round({sql}, 6) AS kpi, count(*) AS n FROM {_PAIRS} GROUP BY 1"


_metric("m_rmse_by_group", M.rmse, "sqrt(avg((x - ref) * (x - ref)))")
_metric("m_mae", M.mae, "avg(abs(x - ref))")
_metric("m_bias", M.bias, "avg(x) - avg(ref)")
_metric("m_nmse_range", M.nmse_range, "sqrt(avg((x - ref) * (x - ref))) / (max(ref) - min(ref))")
_metric("m_nmse_power", M.nmse_power, "avg((x - ref) * (x - ref)) / (avg(x) * avg(ref))")
_metric("m_corr", M.correlation, "corr(x, ref)")


@query(f"""
SELECT l_returnflag, round(avg(x) FILTER (WHERE l_linenumber <> 3) - avg(ref) FILTER (WHERE l_linenumber <> 3), 6) AS bias,
       round(sqrt(avg((x - ref) * (x - ref)) FILTER (WHERE l_linenumber <> 3)), 6) AS rmse,
       round(avg((x - ref) * (x - ref)) FILTER (WHERE l_linenumber <> 3) / (avg(x) * avg(ref) FILTER (WHERE l_linenumber <> 3)), 6) AS nmse_power
FROM {_PAIRS} GROUP BY 1""")
def m_bias_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with references missing where l_linenumber is 3."""
    df = pairs(spark, sf_dir).withColumn("ref", F.when(F.col("l_linenumber") != 3, F.col("ref")))
    x, ref = F.col("x"), F.col("ref")
    return df.groupBy("l_returnflag").agg(F.round(M.bias(x, ref), 6).alias("bias"), F.round(M.rmse(x, ref), 6).alias("rmse"), F.round(M.nmse_power(x, ref), 6).alias("nmse_power"))


@query("""
WITH a AS (SELECT event_type, radians((value * 7) % 360) AS x, radians((value * 11) % 360) AS r FROM events WHERE value IS NOT NULL),
m AS (SELECT event_type, atan2(avg(sin(x)), avg(cos(x))) - atan2(avg(sin(r)), avg(cos(r))) + pi() AS d FROM a GROUP BY 1)
SELECT event_type, round(degrees(d - 2 * pi() * floor(d / (2 * pi())) - pi()), 6) AS kpi FROM m""")
def m_circular_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "events")
    return df.groupBy("event_type").agg(F.round(M.circular_bias(F.col("value") * 7 % 360, F.col("value") * 11 % 360), 6).alias("kpi"))


_CM = """(SELECT l_linestatus, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE NOT p AND NOT a) AS tn,
count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn
FROM (SELECT l_linestatus, l_returnflag = 'R' AS p, l_discount > 0.05 AS a FROM lineitem) GROUP BY 1)"""


@query(f"""
SELECT l_linestatus, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS prec, round(tp / (tp + fn), 6) AS recall,
       round(tn / (tn + fp), 6) AS specificity, round(fp / (fp + tn), 6) AS fpr, round(tn / (tn + fn), 6) AS npv, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM {_CM}""")
def m_confusion_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All binary rates in one pass."""
    c = M.Confusion(F.col("l_returnflag") == "R", F.col("l_discount") > 0.05)
    rates = {"accuracy": c.accuracy(), "prec": c.precision(), "recall": c.recall(), "specificity": c.specificity(), "fpr": c.false_positive_rate(), "npv": c.negative_predictive_value(), "f1": c.f_score()}
    return load(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(c.tn.alias("tn"), c.fp.alias("fp"), c.fn.alias("fn"), c.tp.alias("tp"), *[F.round(v, 6).alias(k) for k, v in rates.items()])


@query("""
SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fp,
       count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp FROM labels""")
def m_cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").agg(M.Confusion(F.col("quality"), F.col("toxic")).matrix().alias("m")).select("m.*")


@query("""
SELECT round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / count(*) FILTER (WHERE quality = 1 OR toxic = 1), 6) AS jaccard,
       round(2.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 1) / (sum(quality) + sum(toxic)), 6) AS dice FROM labels""")
def m_mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return load(spark, sf_dir, "labels").agg(F.round(M.jaccard(a, b), 6).alias("jaccard"), F.round(M.dice(F.col("quality"), F.col("toxic")), 6).alias("dice"))


_SEVERITY = "(SELECT p_size % 6 AS r, l_linenumber % 6 AS e FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6).alias("r"))
    return load(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_linenumber") % 6).alias("e")).join(part, F.col("l_partkey") == F.col("p_partkey"))


@query(f"SELECT r AS ref_class, e AS eval_class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY r), 6) AS row_percent FROM {_SEVERITY} GROUP BY 1, 2")
def m_severity_cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.severity_matrix(_severity(spark, sf_dir), "r", "e").withColumn("row_percent", F.round("row_percent", 6))


@query(f"""
WITH c AS (SELECT r, e, count(*) AS n FROM {_SEVERITY} GROUP BY 1, 2)
SELECT r AS class, round(coalesce(sum(n) FILTER (WHERE e = r) / sum(n) FILTER (WHERE e <> 0), 0), 6) AS accuracy_burnt,
       round(sum(n) FILTER (WHERE e = r) / (sum(n) + coalesce((SELECT d.n FROM c d WHERE d.r = 0 AND d.e = c.r), 0)), 6) AS accuracy_total FROM c WHERE r <> 0 GROUP BY r""")
def m_severity_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.severity_accuracy(_severity(spark, sf_dir), "r", "e").select("class", *[F.round(c, 6).alias(c) for c in ("accuracy_burnt", "accuracy_total")])


@query("""
SELECT o_orderkey, round(100 * o_totalprice / 1000000, 6) AS bounded, round(100 * greatest(0, 1 - o_totalprice / 300000), 6) AS half_linear,
       round(100 * exp(-ln(2) * o_totalprice / 300000), 6) AS half_exponential, round(100 * greatest(0, 1 - abs(o_totalprice - 200000) / 150000), 6) AS symmetric_linear,
       round(100 * exp(-ln(2) * abs(o_totalprice - 200000) / 150000), 6) AS symmetric_exponential FROM orders""")
def k_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five norms of an order's price."""
    p = F.col("o_totalprice")
    norms = {
        "bounded": kpi.bounded_linear(p, 0, 1e6), "half_linear": kpi.half_open_linear(p, 0, 3e5), "half_exponential": kpi.half_open_exponential(p, 0, 3e5),
        "symmetric_linear": kpi.symmetric_linear(p - 2e5, 1.5e5), "symmetric_exponential": kpi.symmetric_exponential(p - 2e5, 1.5e5),
    }
    return load(spark, sf_dir, "orders").select("o_orderkey", *[F.round(v, 6).alias(k) for k, v in norms.items()])


_GROUP_SCORES = f"""
SELECT l_returnflag AS grp, round(sqrt(avg((x - ref) * (x - ref))), 6) AS rmse, round(avg(x) - avg(ref), 6) AS bias,
       round(sqrt(avg((x - ref) * (x - ref))) / (max(ref) - min(ref)), 6) AS nmse_range, round(100 * exp(-ln(2) * sqrt(avg((x - ref) * (x - ref))) / 20), 6) AS score FROM {_PAIRS} GROUP BY 1"""


@query(_GROUP_SCORES)
def s_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and score of each validation group in one aggregate."""
    x, ref = F.col("x"), F.col("ref")
    out = pairs(spark, sf_dir).groupBy(F.col("l_returnflag").alias("grp")).agg(M.rmse(x, ref).alias("rmse"), M.bias(x, ref).alias("bias"), M.nmse_range(x, ref).alias("nmse_range"))
    return out.withColumn("score", kpi.symmetric_exponential(F.col("rmse"), 20)).select("grp", *[F.round(c, 6).alias(c) for c in ("rmse", "bias", "nmse_range", "score")])


@query("SELECT o_orderkey, CASE WHEN s < 33.33 THEN 'red' WHEN s < 66.66 THEN 'yellow' ELSE 'green' END AS color FROM (SELECT o_orderkey, o_orderkey % 101 AS s FROM orders)")
def s_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", kpi.color(F.col("o_orderkey") % 101).alias("color"))


def _nation_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scores of nations as benchmarks, and regions as groups."""
    customers = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("b"))
    nations = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    scores = nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("benchmark"), kpi.symmetric_exponential(F.col("b"), 5000).alias("score"))
    return scores, nations.select(F.col("r_name").alias("group"), F.col("n_name").alias("benchmark"))


_NATION = """(SELECT r_name AS g, n_name AS benchmark, 100 * exp(-ln(2) * abs(avg(c_acctbal)) / 5000) AS score,
CASE WHEN n_name LIKE '%1%' THEN 3.0 WHEN n_name LIKE '%A%' THEN 2.0 ELSE 1.0 END AS w
FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


@query(f"""
WITH b AS (SELECT * FROM {_NATION}), g AS (SELECT g, sum(w * score) / sum(w) AS s FROM b GROUP BY 1)
SELECT 'benchmark' AS level, benchmark AS name, round(score, 6) AS score FROM b UNION ALL SELECT 'group', g, round(s, 6) FROM g UNION ALL SELECT 'total', 'all', round(avg(s), 6) FROM g""")
def s_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark, group and total scores with group and scheme weight overrides."""
    scores, groups = _nation_scores(spark, sf_dir)
    by_group = groups.where("benchmark like '%A%'").withColumn("weight", F.lit(2.0))
    by_scheme = groups.where("benchmark like '%1%'").withColumn("weight", F.lit(3.0))
    weights = scorecard.with_weights(groups, by_group, by_scheme)
    scheme = groups.select(F.lit("all").alias("scheme"), "group", F.lit(1.0).alias("group_weight")).distinct()
    return scorecard.card(scores, weights, scheme).select("level", "name", F.round("score", 6).alias("score"))


@query(f"SELECT g AS grp, benchmark, round(avg(score), 6) AS score, count(*) AS n FROM {_NATION} GROUP BY ROLLUP (g, benchmark)")
def s_scorecard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, groups = _nation_scores(spark, sf_dir)
    return scores.join(groups, "benchmark").withColumnRenamed("group", "grp").rollup("grp", "benchmark").agg(F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("n"))


_GROUPS = """g AS (SELECT name || ' W' || k AS grp, n FROM (VALUES ('Air temperature', 18), ('Relative humidity 10h', 18), ('Wind speed', 18), ('Wind direction', 6), ('Fuel Moisture 10h', 18), ('Fire Perimeter', 8)) t(name, n), range(1, 5) r(k)
UNION ALL SELECT * FROM (VALUES ('Building Damage', 6), ('Burn Severity', 6), ('Canopy Cover Loss', 6)) u(a, b)),
k AS (SELECT grp, n, row_number() OVER (ORDER BY grp) - 1 AS i FROM g),
s AS (SELECT grp, CAST(n AS BIGINT) AS benchmarks, avg(o_totalprice / 5000) AS score FROM k JOIN orders ON o_orderkey % 27 = i GROUP BY 1, 2)"""


def _group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all groups of the benchmark table, where each benchmark of a group has the mean over the orders of the group's turn."""
    table = scorecard.benchmark_groups(spark)
    names = sorted(scorecard.GROUPS)
    turn = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    means = load(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % len(names)).alias("turn")).agg(F.avg(F.col("o_totalprice") / 5000).alias("score"))
    scores = table.select("benchmark", turn[F.col("group")].alias("turn")).join(means, "turn")
    return scorecard.group_scores(scores.select("benchmark", "score"), scorecard.with_weights(table))


@query(f"WITH {_GROUPS} SELECT grp, benchmarks, round(score, 6) AS score FROM s")
def s_benchmark_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and scores of all groups of the benchmark table."""
    return _group_scores(spark, sf_dir).select(F.col("group").alias("grp"), "benchmarks", F.round("group_score", 6).alias("score"))


_FIXED_GROUPS = "grp IN ('Building Damage', 'Burn Severity', 'Canopy Cover Loss')"
_SCHEMES = {
    "A": "true", "B": "grp = 'Building Damage'", "CC": "grp = 'Canopy Cover Loss'", "S": "grp = 'Burn Severity'", "FP": "grp LIKE 'Fire Perimeter%'", "short_all": f"{_FIXED_GROUPS} OR grp SIMILAR TO '.* W[234]'",
    "WX_short": f"{_FIXED_GROUPS} OR (grp SIMILAR TO '.* W[234]' AND grp NOT LIKE 'Fire%')", **{f"WX{k}": f"grp LIKE '% W{k}' AND grp NOT LIKE 'Fire%'" for k in range(1, 5)},
}


@query(f"WITH {_GROUPS} " + " UNION ALL ".join(f"SELECT '{n}' AS scheme, count(*) AS groups, round(avg(score), 6) AS score FROM s WHERE {c}" for n, c in _SCHEMES.items()))
def s_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total scores by each named scheme, and how many groups it counts."""
    groups, every = _group_scores(spark, sf_dir), None
    for name in scorecard.SCHEMES:
        one = scorecard.scheme_groups(spark, name)
        every = one if every is None else every.unionByName(one)
    sizes = every.groupBy("scheme").agg(F.count("*").alias("groups"))
    return scorecard.total_score(groups, every).join(sizes, "scheme").select("scheme", "groups", F.round("total_score", 6).alias("score"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def r_gate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement gating: customers without a large order."""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("requirement"))
    catalog = load(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").cast("string").alias("path")).distinct()
    requirements = c.select("requirement", F.col("requirement").alias("path"))
    met = scorecard.runnable(c, requirements, catalog)
    return c.join(met, "c_custkey", "left_anti").select("c_custkey")


@query("""
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), p AS (SELECT (hi - lo) / 20 AS w, 10 ** floor(log10((hi - lo) / 20)) AS b FROM r),
s AS (SELECT b * k AS width FROM p, (VALUES (1), (2), (5), (10)) t(k) ORDER BY abs(w - b * k), k LIMIT 1)
SELECT floor(o_totalprice / width) * width AS bin_start, count(*) AS n FROM orders, s GROUP BY 1""")
def h_auto_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.histogram(load(spark, sf_dir, "orders"), "o_totalprice", 20)


@query("""
WITH p AS (SELECT event_type, user_id, sqrt(avg((value - 100) * (value - 100))) AS k FROM events GROUP BY 1, 2)
SELECT event_type, round(min(k), 6) AS kpi_min, round(avg(k), 6) AS kpi_mean, round(max(k), 6) AS kpi_max, count(k) AS stations FROM p GROUP BY 1""")
def t_station_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric per station, and its minimum, mean and maximum over stations."""
    df = load(spark, sf_dir, "events").withColumn("ref", F.lit(100.0))
    out = M.station_summary(df, "user_id", M.rmse, "value", "ref", "event_type")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("kpi_min", "kpi_mean", "kpi_max")], "stations")


PERIODS = (("W1", "2024-01-01 00:00:00", "2024-01-08 00:00:00"), ("W2", "2024-01-06 00:00:00", "2024-01-15 00:00:00"), ("W3", "2024-01-15 00:00:00", "2024-01-22 00:00:00"), ("W4", "2024-01-22 00:00:00", "2024-02-01 00:00:00"))


@query(f"""
SELECT p AS period, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events
JOIN (VALUES {", ".join(f"('{p}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for p, a, b in PERIODS)}) t(p, a, b) ON ts >= a AND ts < b GROUP BY 1, 2""")
def t_period_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join with study periods that may overlap; the four rows are literals, so events are never shuffled for it."""
    hits = F.array_compact(F.array(*[F.when((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz")), p) for p, a, b in PERIODS]))
    return load(spark, sf_dir, "events").select("event_type", "value", F.explode(hits).alias("period")).groupBy("period", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
