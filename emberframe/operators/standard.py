"""Standard datasets: validation, conflicts and merging on a node catalog.

A dataset is described by a catalog of nodes: file_id, path, kind ('group' or 'dataset'), dtype,
shape and attrs (a map of text). Payloads are Parquet tables beside it. Checks are joins and filters
on the catalog, so they scale with the number of nodes and never open a payload.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.timefmt import is_iso8601

CATALOG = "file_id string, path string, kind string, dtype string, shape array<bigint>, attrs map<string,string>"
# Top groups and versions of the standard, mandatory root attributes, and root attributes that may differ.
TOP_GROUPS = ("points", "time_series", "spatial_1d", "spatial_2d", "spatial_3d", "unstructured", "polygons", "fuel_models", "miscellaneous", "certificates")
VERSION, COMPATIBLE = "1.0", {"1.0": ("0.2",), "0.2": ("0.1",), "0.1": ()}
ROOT_ATTRIBUTES = ("io_version", "created_on", "created_by")
FREE_AT_ROOT = ("created_on", "created_by", "io_version", "description")


def may_update(version: str | None) -> bool:
    """True for a new or current dataset, False for a compatible older one; ValueError otherwise."""
    if version is None or version == VERSION:
        return True
    if version in COMPATIBLE[VERSION]:
        return False
    raise ValueError(f"version {version} cannot be read as {VERSION}")


def root_problems(catalog: DataFrame) -> DataFrame:
    """file_id and problem of datasets whose root attributes are missing or malformed; valid ones have no row."""
    roots = catalog.where("path = '/'")
    files = catalog.select("file_id").distinct().join(roots.select("file_id", "attrs"), "file_id", "left")
    checks = [F.when(F.element_at("attrs", a).isNull(), F.lit(f"missing {a}")) for a in ROOT_ATTRIBUTES]
    checks += [F.when(F.element_at("attrs", "created_on").isNotNull() & ~is_iso8601(F.element_at("attrs", "created_on")), F.lit("created_on is not ISO-8601"))]
    return files.select("file_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def missing_requirements(catalog: DataFrame, requirements: DataFrame, file_id: str) -> DataFrame:
    """Requirements (position, path, attribute or NULL) that a file lacks: a dataset, or an attribute of a node."""
    nodes = catalog.where(F.col("file_id") == file_id)
    held = nodes.select("path", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.map_keys("attrs"), F.array().cast("array<string>")))).alias("attribute"))
    return requirements.join(held, (requirements["path"] == held["path"]) & requirements["attribute"].eqNullSafe(held["attribute"]), "left_anti")


def first_missing(catalog: DataFrame, requirements: DataFrame, file_id: str) -> str | None:
    """The first requirement that is not met, as 'path' or 'path@attribute'; None if all are."""
    row = missing_requirements(catalog, requirements, file_id).orderBy("position").first()
    return None if row is None else row["path"] if row["attribute"] is None else f"{row['path']}@{row['attribute']}"


def missing_station_series(catalog: DataFrame, reference: str, checked: str, variable: str) -> DataFrame:
    """Paths that the checked file lacks: time and the variable, for each reference station that has the variable."""
    stations = catalog.where((F.col("file_id") == reference) & F.col("path").rlike(f"^/time_series/[^/]+/{variable}$")).select(F.split("path", "/")[2].alias("station"))
    wanted = stations.select(F.explode(F.array(*[F.concat(F.lit("/time_series/"), "station", F.lit(f"/{v}")) for v in ("time", variable)])).alias("path"))
    return wanted.join(catalog.where(F.col("file_id") == checked).select("path"), "path", "left_anti")


def conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, kind and detail where two catalogs disagree: node_type, dataset_mismatch (shape or dtype), attr_mismatch."""
    a = left.select("path", *[F.col(c).alias(f"{c}_1") for c in ("kind", "dtype", "shape", "attrs")])
    b = right.select("path", *[F.col(c).alias(f"{c}_2") for c in ("kind", "dtype", "shape", "attrs")])
    both = a.join(b, "path")
    same = F.col("kind_1") == F.col("kind_2")
    node = F.when(~same, F.array(F.struct(F.lit("node_type").alias("kind"), F.concat_ws(" vs ", "kind_1", "kind_2").alias("detail"))))
    differs = ~(F.col("shape_1").eqNullSafe(F.col("shape_2")) & F.col("dtype_1").eqNullSafe(F.col("dtype_2")))
    data = F.when(
        same & (F.col("kind_1") == "dataset") & differs,
        F.array(F.struct(F.lit("dataset_mismatch").alias("kind"), F.concat_ws(" vs ", F.concat_ws(" ", F.to_json("shape_1"), "dtype_1"), F.concat_ws(" ", F.to_json("shape_2"), "dtype_2")).alias("detail"))),
    )
    keys = F.array_sort(F.array_intersect(F.map_keys("attrs_1"), F.map_keys("attrs_2")))
    ignored = F.array(*[F.lit(x) for x in FREE_AT_ROOT])
    keys = F.filter(keys, lambda k: (F.element_at("attrs_1", k) != F.element_at("attrs_2", k)) & ~((F.col("path") == "/") & F.array_contains(ignored, k)))
    attr = F.when(same, F.transform(keys, lambda k: F.struct(F.lit("attr_mismatch").alias("kind"), F.concat(k, F.lit(": "), F.element_at("attrs_1", k), F.lit(" vs "), F.element_at("attrs_2", k)).alias("detail"))))
    empty = F.array().cast("array<struct<kind:string,detail:string>>")
    found = F.concat(*[F.coalesce(x, empty) for x in (node, data, attr)])
    return both.select("path", F.explode(found).alias("c")).select("path", "c.kind", "c.detail")


def merge_authors(a: Column, b: Column) -> Column:
    """Authors ('x;y;') of both lists in turn, each once, with a closing semicolon."""
    names = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    turn = F.flatten(F.transform(F.arrays_zip(names(a).alias("x"), names(b).alias("y")), lambda z: F.array(z["x"], z["y"])))
    merged = F.array_distinct(F.array_compact(turn))
    return F.when(F.size(merged) == 0, F.lit("")).otherwise(F.concat(F.array_join(merged, ";"), F.lit(";")))


def merge_catalogs(left: DataFrame, right: DataFrame, file_id: str = "merged") -> DataFrame:
    """The union of two catalogs; attributes of the left win, new ones of the right are added.

    The same dataset on both sides fails the query even where the two agree, and so do different
    node types: payloads are never chosen between.
    """
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, "path", "full")
    both = F.col("a.kind").isNotNull() & F.col("b.kind").isNotNull()
    clash = both & ((F.col("a.kind") == "dataset") | (F.col("b.kind") == "dataset"))
    kind = F.when(clash, F.raise_error(F.concat(F.lit("both sides hold "), F.col("path"))).cast("string")).otherwise(F.coalesce("a.kind", "b.kind"))
    none = F.create_map().cast("map<string,string>")
    left_attrs = F.coalesce("a.attrs", none)
    fresh = F.map_filter(F.coalesce("b.attrs", none), lambda k, _: ~F.map_contains_key(left_attrs, k))
    attrs = F.map_concat(left_attrs, fresh)
    merged = F.when(F.col("path") == "/", F.map_concat(F.map_filter(attrs, lambda k, _: k != "created_by"), F.create_map(F.lit("created_by"), merge_authors(F.element_at("a.attrs", "created_by"), F.element_at("b.attrs", "created_by"))))).otherwise(attrs)
    return joined.select(F.lit(file_id).alias("file_id"), "path", kind.alias("kind"), F.coalesce("a.dtype", "b.dtype").alias("dtype"), F.coalesce("a.shape", "b.shape").alias("shape"), merged.alias("attrs"))


def merge_two(left: DataFrame, right: DataFrame) -> DataFrame:
    """Validates both catalogs, refuses conflicts, and merges; ValueError says why not."""
    problems = root_problems(left.unionByName(right)).take(5)
    if problems:
        raise ValueError(f"invalid datasets: {[tuple(p) for p in problems]}")
    found = conflicts(left, right).take(5)
    if found:
        raise ValueError(f"conflicts: {[tuple(c) for c in found]}")
    return merge_catalogs(left, right)


def merge_all(catalogs: list[DataFrame]) -> DataFrame:
    """What a left fold of merge_two gives, in two checks and one grouped pass over all catalogs; one is itself, none is a ValueError.

    The first catalog that has an attribute gives its value; authors are merged in turn.
    """
    if not catalogs:
        raise ValueError("nothing to merge")
    if len(catalogs) == 1:
        return catalogs[0]
    nodes = reduce(DataFrame.unionByName, [c.select(F.lit(i).alias("at"), "path", "kind", "dtype", "shape", "attrs", "file_id") for i, c in enumerate(catalogs)])
    return _merged(nodes)


def merge_files(catalog: DataFrame) -> DataFrame:
    """``merge_all`` of the files that one catalog table holds, in the order of their ids: any number of files in one pass, without a list on the driver."""
    return _merged(catalog.select(F.col("file_id").alias("at"), "path", "kind", "dtype", "shape", "attrs", "file_id"))


def _merged(nodes: DataFrame) -> DataFrame:
    problems = root_problems(nodes.withColumn("file_id", F.concat_ws(":", "at", "file_id"))).take(5)
    if problems:
        raise ValueError(f"invalid datasets: {[tuple(p) for p in problems]}")
    values = nodes.select("at", "path", F.explode("attrs").alias("key", "value")).groupBy("path", "key").agg(F.count_distinct("value").alias("values"), F.min_by("value", "at").alias("value"))
    free = (F.col("path") == "/") & F.col("key").isin(*FREE_AT_ROOT)
    kinds = nodes.groupBy("path").agg(F.count_distinct("kind").alias("kinds"), F.count_if(F.col("kind") == "dataset").alias("datasets"))
    found = values.where((F.col("values") > 1) & ~free).select("path", F.concat(F.lit("attr_mismatch "), "key").alias("why"))
    found = found.unionByName(kinds.where("kinds > 1").select("path", F.lit("node_type").alias("why"))).unionByName(kinds.where("kinds = 1 and datasets > 1").select("path", F.lit("both sides hold it").alias("why")))
    clashes = found.take(5)
    if clashes:
        raise ValueError(f"conflicts: {[tuple(c) for c in clashes]}")
    attrs = values.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.element_at("attrs", "created_by"), F.lit("")).alias("who")))), lambda s: s["who"])
    authors = F.aggregate(lists, F.lit(""), merge_authors)
    one = nodes.groupBy("path").agg(F.min_by("kind", "at").alias("kind"), F.min_by("dtype", "at").alias("dtype"), F.min_by("shape", "at").alias("shape"), F.when(F.col("path") == "/", authors).alias("authors"))
    none = F.create_map().cast("map<string,string>")
    merged = F.coalesce("attrs", none)
    merged = F.when(F.col("path") == "/", F.map_concat(F.map_filter(merged, lambda k, _: k != "created_by"), F.create_map(F.lit("created_by"), F.col("authors")))).otherwise(merged)
    return one.join(attrs, "path", "left").select(F.lit("merged").alias("file_id"), "path", "kind", "dtype", "shape", merged.alias("attrs"))


def numeric_attribute(attrs: Column, name: str) -> Column:
    """The attribute as a number; text that is none fails the query."""
    text = F.trim(F.element_at(attrs, name))
    number = text.try_cast("double")
    return F.when(text.isNull(), None).when(number.isNull(), F.raise_error(F.lit(f"{name} is not a number")).cast("double")).otherwise(number)


def text_attribute(attrs: Column, name: str) -> Column:
    """The attribute without outer blanks; an empty one fails the query."""
    text = F.trim(F.element_at(attrs, name))
    return F.when(text == "", F.raise_error(F.lit(f"{name} is empty"))).otherwise(text)
