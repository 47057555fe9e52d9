"""Shared scratch tables, shipping of the package, and helpers that several operators need."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.session import scratch

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Readies a session for Python tasks: Arrow batches of BATCH_BYTES at most, which bound what a task holds
    beside its own state, and the package on the path of workers started outside the repository folder."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT in known or os.getcwd() == _ROOT or getattr(spark.sparkContext, "_emberframe_shipped", False):
        return
    folder = tempfile.mkdtemp()  # on the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "emberframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "emberframe")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._emberframe_shipped = True


class Workspace:
    """Tables written under ``spark.checkpoint.dir``: they cut lineage and outlive lost executors.

    The folder is read from the session. Only where it is unset and the master is local (tests) a
    temporary folder takes its place; a cluster without it is an error. Tables are dropped by their users as soon as
    nothing reads them, and the rest when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch(spark, name)
        path, fs = self._path()
        fs.deleteOnExit(path)
        ship(spark)

    def _path(self, name: str = ""):
        """Hadoop path of a table (or of all), and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._path(name)
            fs.delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and columns by name), whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def row_key() -> Column:
    """Names a row by its id and text: rows that repeat an id stay apart unless they are the same."""
    return F.xxhash64("doc_id", "text")


def spare(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``taken`` has it (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def map_rows(docs: DataFrame, run, *more: T.StructField) -> DataFrame:
    """docs.mapInArrow(run) with the columns of docs and then those of ``more``, whatever their names: mapInArrow itself cannot take dotted ones."""
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    out = docs.toDF(*[f.name for f in fields]).mapInArrow(run, T.StructType([*fields, *more]))
    return out.toDF(*docs.columns, *[f.name for f in more])


def hashable(column: Column, kind: T.DataType) -> Column:
    """A column of any type in a form that Spark's hash functions take: maps as sorted entries (by hash), variants as JSON."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.xxhash64(hashable(e["key"], kind.keyType), hashable(e["value"], kind.valueType), e["value"].isNull())
        return F.array_sort(F.transform(F.map_entries(column), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: hashable(x, kind.elementType)) if _holds_map(kind) else column
    if isinstance(kind, T.StructType):
        return F.struct(*[hashable(column[f.name], f.dataType).alias(f"c{i}") for i, f in enumerate(kind.fields)]) if _holds_map(kind) else column
    return F.to_json(column) if isinstance(kind, T.VariantType) else column


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def components(ws: Workspace, edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)``: one row (node, root) for each node that is not its own root.

    Alternating large-star and small-star rounds: every round is two grouped minima and two
    joins on a node, so a hub's edges can be split between tasks. Each round is written to the
    workspace; nothing but two numbers a round reaches the driver.
    """
    e = ws.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )
    mark, last = None, f"{name}-0"
    for i in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = ws.save(small, f"{name}-{i}")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        ws.drop(last)
        last = f"{name}-{i}"
        if mark == now:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")
