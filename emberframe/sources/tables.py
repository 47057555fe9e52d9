"""Tables described by a JSON sidecar, and the Parquet layout of standard datasets."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.operators import provenance, standard

_TYPES = {"float64": T.DoubleType(), "float32": T.DoubleType(), "float": T.DoubleType(), "int32": T.IntegerType(), "int64": T.LongType(), "int": T.IntegerType(), "object": T.StringType(), "str": T.StringType(), "string": T.StringType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "bool": T.BooleanType()}
DATA_PATH = "EMBERFRAME_DATA_PATH"


def sidecar_path(name: str, folder: str | None = None) -> str:
    """Path of a sidecar by name: in ``folder``, or in the folder that EMBERFRAME_DATA_PATH names."""
    base = folder or os.environ.get(DATA_PATH)
    if base is None:
        raise OSError(f"{DATA_PATH} is not set")
    path = os.path.join(base, name if name.endswith(".json") else f"{name}.json")
    return path


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """A sidecar by any path that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The CSV that a sidecar describes, with standard column names, types, and units as column metadata.

    Columns that the sidecar does not list are left out. ``no_data_value`` cells and NaN are NULL. The sidecar's ``data_path``
    is taken from the sidecar's folder.
    """
    info = read_sidecar(spark, path)
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    source = info["data_path"] if "://" in info["data_path"] or info["data_path"].startswith("/") else f"{folder}/{info['data_path']}"
    raw = spark.read.csv(source, header=True, inferSchema=False, nullValue=info.get("no_data_value"), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    out = []
    for csv_name, meta in info["metadata"].items():
        if csv_name not in raw.columns:
            continue
        kind, name = _TYPES[meta.get("type", "float64")], meta.get("variable_name", csv_name)
        value = F.col(f"`{csv_name}`").cast(kind)
        value = F.nanvl(value, F.lit(None)) if isinstance(kind, T.DoubleType) else value
        out.append(value.alias(name, metadata={"units": meta.get("unit", "1"), "std_name": name}))
    return raw.select(out)


def read_fuel_model(spark: SparkSession, path: str) -> DataFrame:
    """A fuel table with its class number from 1, in file order (fuel tables are one small file)."""
    rows = read_table(spark, path).coalesce(1).withColumn("_at", F.monotonically_increasing_id())
    return rows.withColumn("fuel_class", (F.col("_at") + 1).cast("int")).drop("_at")


def write_dataset(catalog: DataFrame, payloads: dict[str, DataFrame], folder: str) -> None:
    """A standard dataset: its catalog and one Parquet table a payload, zstd throughout."""
    catalog.write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/_catalog")
    for name, df in payloads.items():
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/{name.strip('/')}")


def _fs(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Puts a manifest in a folder by a rename, so that it is there whole or not at all."""
    part, fs = _fs(spark, f"{folder}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    last, _ = _fs(spark, f"{folder}/manifest.json")
    if fs.exists(last):
        raise FileExistsError(str(last))
    if not fs.rename(part, last):
        raise OSError(f"could not publish {last}")


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of a folder; None for a folder without one."""
    path, fs = _fs(spark, f"{folder}/manifest.json")
    return json.loads("".join(r[0] for r in spark.read.text(str(path)).collect())) if fs.exists(path) else None


def _data(spark: SparkSession, folder: str) -> str:
    """Where a dataset's tables lie: a plain dataset's in its own folder, those of a merged one where the manifest says."""
    found = manifest(spark, folder)
    return f"{folder}/{found['data']}" if found else folder


def merge_datasets(spark: SparkSession, folders: list[str], target: str) -> None:
    """Merges datasets with their payloads into a new one; ValueError for datasets that are not valid, or in conflict.

    Everything is written to a folder of its own below the target, copies are held to the digests of what was read, and a manifest that names the
    folder is put in place last, by a rename. A merge that stops before leaves no dataset at the target, and can be run again; what it had
    written is not looked at. Payloads are those of the catalogs' dataset nodes.
    """
    catalogs = [read_catalog(spark, f) for f in folders]
    merged = standard.merge_all(catalogs)
    data = f"data-{uuid.uuid4().hex}"
    names = [[r[0] for r in c.where("kind = 'dataset'").select("path").sort("path").toLocalIterator()] for c in catalogs]
    merged.write.option("compression", "zstd").parquet(f"{target}/{data}/_catalog")
    digests = {}
    for folder, own in zip(folders, names, strict=True):
        for name in own:
            payload = read_payload(spark, folder, name)
            payload.write.option("compression", "zstd").parquet(f"{target}/{data}/{name.strip('/')}")
            before, after = (provenance.payload_digest(p).first() for p in (payload, spark.read.parquet(f"{target}/{data}/{name.strip('/')}")))
            if before != after:
                raise OSError(f"{name} was not copied as it is")
            digests[name] = before["payload_sha"] if before else ""
    publish(spark, target, {"data": data, "payloads": digests})


def read_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{_data(spark, folder)}/_catalog")


def read_payload(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{_data(spark, folder)}/{name.strip('/')}")
