"""Sessions, tables and the missing-value rule."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("emberframe")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def portable(module: str) -> None:
    """Functions of a module travel to workers by value: workers need not have the package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes NULL in the floating columns named (all by default): aggregates skip NULL only."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in names})


def require(condition: Column, message: str, value: Column) -> Column:
    """value where condition holds; the query fails with message where it is false."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which a cluster shares; only a local master gets one of this machine's when it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared scratch folder, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
