"""Indicators to scores to a card: benchmark, group and total.

Dimensions are small tables (one row a benchmark or a group); weights follow one precedence: 1, then the
group's override, then the scheme's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators import provenance

# Benchmark ids of each group (prefix, first, last, step) and groups of each scheme.
_PERIODS = ("W1", "W2", "W3", "W4")
_WEATHER = (("Air temperature", 1, 18), ("Relative humidity 10h", 73, 18), ("Wind speed", 145, 18), ("Wind direction", 217, 6), ("Fuel Moisture 10h", 241, 18))
GROUPS: dict[str, list[str]] = {
    "Building Damage": [f"BD{i:02}" for i in range(1, 7)],
    "Burn Severity": [f"SV{i:02}" for i in range(1, 7)],
    **{f"Fire Perimeter {w}": [f"FP{i:02}" for i in range(k, 33, 4)] for k, w in enumerate(_PERIODS, 1)},
    "Canopy Cover Loss": [f"CC{i:02}" for i in range(1, 7)],
    **{f"{name} {w}": [f"WX{i:03}" for i in range(first + k * n, first + (k + 1) * n)] for name, first, n in _WEATHER for k, w in enumerate(_PERIODS)},
}


def _weather_groups(*periods: str) -> list[str]:
    return [f"{name} {w}" for w in periods for name, _, _ in _WEATHER]


_FIXED = ["Building Damage", "Burn Severity", "Canopy Cover Loss"]
SCHEMES: dict[str, list[str]] = {
    "0": [], "A": list(GROUPS), "B": ["Building Damage"], "CC": ["Canopy Cover Loss"], "FP": [f"Fire Perimeter {w}" for w in _PERIODS], "S": ["Burn Severity"],
    "short_all": [*_FIXED, *[f"Fire Perimeter {w}" for w in _PERIODS[1:]], *_weather_groups(*_PERIODS[1:])],
    **{f"WX{k}": _weather_groups(w) for k, w in enumerate(_PERIODS, 1)}, "WX_short": [*_FIXED, *_weather_groups(*_PERIODS[1:])],
}


def benchmark_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, b) for g, ids in GROUPS.items() for b in ids], "group string, benchmark string")


def scheme_groups(spark: SparkSession, scheme: str) -> DataFrame:
    return spark.createDataFrame([(scheme, g, 1.0) for g in SCHEMES[scheme]], "scheme string, group string, group_weight double")


def with_weights(groups: DataFrame, group_overrides: DataFrame | None = None, scheme_overrides: DataFrame | None = None) -> DataFrame:
    """groups (group, benchmark) with their weight: 1, or the group's override, or the scheme's (each: group, benchmark, weight)."""
    out = groups.withColumn("weight", F.lit(1.0))
    for over in (group_overrides, scheme_overrides):
        if over is not None:
            over = over.select("group", "benchmark", F.col("weight").alias("_w"))
            out = out.join(over, ["group", "benchmark"], "left").withColumn("weight", F.coalesce("_w", "weight")).drop("_w")
    return out


def group_scores(scores: DataFrame, weights: DataFrame, *model: str) -> DataFrame:
    """Weighted mean of the unit scores of each group; benchmarks without a score do not count."""
    known = scores.where("score is not null").join(weights, "benchmark")
    return known.groupBy(*model, "group").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("group_score"), F.count("*").alias("benchmarks"))


def total_score(groups: DataFrame, scheme: DataFrame, *model: str) -> DataFrame:
    """Weighted mean of the group scores that the scheme names."""
    return groups.join(scheme, "group").groupBy(*model, "scheme").agg((F.sum(F.col("group_weight") * F.col("group_score")) / F.sum("group_weight")).alias("total_score"))


def card(scores: DataFrame, weights: DataFrame, scheme: DataFrame, *model: str) -> DataFrame:
    """All levels in one table: level ('benchmark', 'group', 'total'), name, score, color."""
    from emberframe.functions.kpi import color

    groups = group_scores(scores, weights, *model).join(scheme.select("group"), "group", "left_semi")
    used = scores.join(weights.join(scheme, "group", "left_semi").select("benchmark").distinct(), "benchmark", "left_semi")
    parts = [
        used.select(*model, F.lit("benchmark").alias("level"), F.col("benchmark").alias("name"), "score"),
        groups.select(*model, F.lit("group").alias("level"), F.col("group").alias("name"), F.col("group_score").alias("score")),
        total_score(groups, scheme, *model).select(*model, F.lit("total").alias("level"), F.col("scheme").alias("name"), F.col("total_score").alias("score")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("color", color(F.col("score")))


def runnable(benchmarks: DataFrame, requirements: DataFrame, catalog: DataFrame) -> DataFrame:
    """Benchmarks (benchmark, requirement) whose requirement's paths (requirement, path) are all in the catalog (path)."""
    missing = requirements.join(catalog.select("path"), "path", "left_anti").select("requirement").distinct()
    return benchmarks.join(missing, "requirement", "left_anti")


def certified(card_rows: DataFrame, catalog: DataFrame, certificate: str, keys: DataFrame | None = None, payload_sha: str | None = None, strict: bool = False) -> DataFrame:
    """Rows of cards (file_id and a card's columns) of files whose ``certificate`` is valid, with ``verification``, the level that their valid certificates give.

    Files without the certificate, or with one that does not hold, have no rows; with ``strict`` they fail the query.
    """
    found = provenance.check_certificates(catalog, keys, payload_sha).where(F.col("certificate") == certificate).groupBy("file_id").agg(F.bool_and("valid").alias("_valid"))
    levels = provenance.file_levels(catalog, keys, payload_sha).withColumnRenamed("level", "verification")
    rows = card_rows.join(found, "file_id", "left").join(levels, "file_id", "left")
    valid = F.coalesce("_valid", F.lit(False))
    if strict:
        valid = F.when(valid, valid).otherwise(F.raise_error(F.concat(F.lit("no valid certificate: "), F.col("file_id"))).cast("boolean"))
    return rows.where(valid).drop("_valid")


def markdown(card_rows: DataFrame, limit: int = 500) -> str:
    """A card of one model as a Markdown table; a card holds at most ``limit`` rows."""
    order = F.when(F.col("level") == "total", 0).when(F.col("level") == "group", 1).otherwise(2)
    lines = [f"| {r['level']} | {r['name']} | {r['score']:.2f} | {r['color']} |" for r in card_rows.where("score is not null").orderBy(order, "name").limit(limit).collect()]
    return "\n".join(["| level | name | score | color |", "|---|---|---|---|", *lines])


class Context:
    """Named intermediate tables of an evaluation, each computed once and persisted; keys must be declared."""

    def __init__(self, *keys: tuple[str, str, str]):
        self.keys, self.tables = set(keys), {}

    def get(self, key: tuple[str, str, str], compute: Callable[..., DataFrame], *args) -> DataFrame:
        if key not in self.keys:
            raise KeyError(f"undeclared context key: {key}")
        if key not in self.tables:
            self.tables[key] = compute(*args).persist()
        return self.tables[key]

    def close(self) -> None:
        for df in self.tables.values():
            df.unpersist()
        self.tables.clear()
