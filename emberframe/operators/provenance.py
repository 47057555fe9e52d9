"""Digests, certificates and verification levels."""

from __future__ import annotations

import hashlib
import json
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Certificates of a run, its observations, its model run and the model's inputs; and what each level needs, best first.
_RUN, _OBSERVED, _MODEL, _INPUTS = "benchmark-run-internal", "obs-verified-obs-dataset", "model-model-run-internal", "model-verified-input-requirements"
LEVELS = (("VL-A+", (_RUN, _OBSERVED, _MODEL, _INPUTS)), ("VL-A", (_RUN, _OBSERVED, _MODEL)), ("VL-B", (_RUN, _OBSERVED)))
DEFAULT_LEVEL = "VL-C"


def canonical_json(value) -> bytes:
    """JSON with sorted keys and no blanks, as UTF-8; the same bytes are signed and verified."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def short_hex(data: bytes, length: int = 12) -> str:
    return sha256_hex(data)[:length]


def file_digests(df: DataFrame) -> DataFrame:
    """path, bytes and sha256 of files read with the binaryFile source; files are hashed where they are read."""
    return df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def catalog_digest(catalog: DataFrame, payload_sha: str | None = None) -> DataFrame:
    """file_id and digest of a catalog's nodes in path order, certificates left out.

    Every node is hashed in its task (path, kind, type, shape, attributes by name, and the payload's own
    digest where ``payload_sha`` names a column); a file's node digests are joined in path order and hashed again.
    """
    attrs = F.transform(F.array_sort(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    text = F.to_json(F.struct("path", "kind", F.coalesce("dtype", F.lit("")).alias("dtype"), "shape", attrs.alias("attrs"), *([F.col(payload_sha).alias("data")] if payload_sha else [])))
    nodes = catalog.where("path <> '/certificates' and path not like '/certificates/%'").select("file_id", "path", F.sha2(text, 256).alias("node"))
    ordered = F.array_sort(F.collect_list(F.struct("path", "node")))
    return nodes.groupBy("file_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda s: s["node"]), "\n"), 256).alias("digest"))


def _row_text(df: DataFrame, names: list[str]) -> Column:
    """A row as text: columns by name, each value with its length in front, so that no two rows have the same text."""
    kinds = dict(df.dtypes)
    parts = []
    for n in sorted(names):
        c = F.hex(f"`{n}`") if kinds[n] == "binary" else F.col(f"`{n}`").cast("string")
        parts += [F.lit(f"{n}="), F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")), F.lit(";")]
    return F.concat(*parts)


def payload_slabs(payload: DataFrame, *by: str, position: str | None = None, rows: int = 4096) -> DataFrame:
    """Digests of slabs of a payload's rows: by, slab, n (rows) and digest; equal payloads have equal slabs, however they are stored.

    With ``position`` (a whole number; rows that share one are ordered by their hash) a slab is ``rows`` positions, in their order. Without one, the order of
    rows means nothing: rows are put in 65,536 slabs by their own hash, repeated ones once with their number. Rows are hashed where they are
    read; only hashes are shuffled.
    """
    return _slabs(payload, by, position, rows, 1024).select(*by, "slab", "n", "digest")


def _slabs(payload: DataFrame, by: tuple[str, ...], position: str | None, rows: int, fan: int) -> DataFrame:
    """``payload_slabs`` with the node above each and ``_deal``, the node's hash. Rows with positions are dealt out by it, as binary hashes: a sparse payload has
    about as many slabs as rows, and so joins them where they arise. (One hash, as Spark drops constant columns of ``by`` from what it groups by.)"""
    row = F.sha2(_row_text(payload, [c for c in payload.columns if c not in by]), 256)
    slab, node = F.floor(F.col("at") / rows), F.floor(F.col("slab") / fan)
    if position:
        deal = F.xxhash64(*by, F.floor(slab / fan))
        hashed = payload.select(*by, F.col(position).cast("long").alias("at"), F.unhex(row).alias("row")).repartition(deal)
        hashed = hashed.select("*", deal.alias("_deal"), slab.alias("slab"), F.lit(1).cast("long").alias("n")).withColumn("_node", node)
        return _joined(hashed.groupBy(*by, "_deal", "_node", "slab"), "at", "row", binary=True)
    hashed = payload.select(*by, row.alias("row")).groupBy(*by, "row").agg(F.count("*").alias("n"))
    hashed = hashed.select(*by, F.conv(F.substring("row", 1, 4), 16, 10).cast("long").alias("slab"), F.lit(0).cast("long").alias("at"), F.concat("row", F.lit("x"), F.col("n").cast("string")).alias("row"), "n").withColumn("_node", node)
    return _joined(hashed.groupBy(*by, F.xxhash64(*by, "_node").alias("_deal"), "_node", "slab"), "at", "row")


def _joined(groups, at: str, text: str, binary: bool = False) -> DataFrame:
    written = (lambda c: F.lower(F.hex(c))) if binary else lambda c: c
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("a"), F.col(text).alias("t")))), lambda s: F.concat(s["a"].cast("string"), F.lit(":"), written(s["t"])))
    return groups.agg(F.sum("n").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def payload_digest(payload: DataFrame, *by: str, position: str | None = None, rows: int = 4096, fan: int = 1024) -> DataFrame:
    """by, payload_rows and payload_sha: the root of a Merkle tree over ``payload_slabs``, three levels of ``fan`` high.

    Every level is one aggregate of at most ``fan`` hashes a node, so no task holds more of a payload at once than a slab's hashes; with positions the
    lowest two share one shuffle. The names of columns and their types count too. A payload without rows has no digest.
    """
    tree = _joined(_slabs(payload, by, position, rows, fan).withColumn("at", F.col("slab")).groupBy(*by, "_deal", "_node"), "at", "digest").withColumnRenamed("_node", "slab")
    for _ in range(2):
        tree = _joined(tree.withColumn("at", F.col("slab")).withColumn("slab", F.floor(F.col("slab") / fan)).groupBy(*by, "slab"), "at", "digest")
    kinds = ";".join(f"{n} {t}" for n, t in sorted(payload.dtypes) if n not in by)
    whole = _joined(tree.withColumn("at", F.col("slab")).groupBy(*by), "at", "digest")
    return whole.where("n > 0").select(*by, F.col("n").alias("payload_rows"), F.sha2(F.concat(F.col("n").cast("string"), F.lit(f"|{kinds}|"), F.col("digest")), 256).alias("payload_sha"))


def with_payloads(catalog: DataFrame, digests: DataFrame) -> DataFrame:
    """A catalog with the column payload_sha of ``payload_digest`` by file_id and path; nodes without rows have an empty one."""
    known = digests.select("file_id", "path", "payload_sha")
    return catalog.drop("payload_sha").join(known, ["file_id", "path"], "left").withColumn("payload_sha", F.coalesce("payload_sha", F.lit("")))


def add_certificate(catalog: DataFrame, name: str, key_id: str, signer: str, created_on: str, payload_sha: str | None = None) -> DataFrame:
    """The catalog with a node /certificates/name in every file that holds the digest of the file's other nodes."""
    fields = {"certificate": name, "key_id": key_id, "signer": signer, "created_on": created_on}
    wanted = catalog.select("file_id").distinct().select("file_id", *[F.lit(v).alias(k) for k, v in fields.items()])
    return add_certificates(catalog, wanted, payload_sha)


def add_certificates(catalog: DataFrame, wanted: DataFrame, payload_sha: str | None = None) -> DataFrame:
    """The catalog with a node for each row of ``wanted`` (file_id, certificate, key_id, signer, created_on). Each file is digested once, however many
    certificates it gets."""
    fields = ("key_id", "signer", "created_on")
    attrs = F.map_from_arrays(F.array(*[F.lit(k) for k in ("subject_sha256", *fields)]), F.array("digest", *fields))
    nodes = wanted.join(catalog_digest(catalog, payload_sha), "file_id")
    nodes = nodes.select("file_id", F.concat(F.lit("/certificates/"), "certificate").alias("path"), F.lit("group").alias("kind"), F.lit(None).cast("string").alias("dtype"), F.lit(None).cast("array<bigint>").alias("shape"), attrs.alias("attrs"))
    return catalog.unionByName(nodes, allowMissingColumns=True)


def check_certificates(catalog: DataFrame, keys: DataFrame | None = None, payload_sha: str | None = None) -> DataFrame:
    """file_id, certificate, key_id, valid and reason of every certificate in the catalogs.

    The digest must be that of the file as it is; with ``keys`` (a registry: key_id, signer, revoked) the key must be known, the signer's, and not revoked.
    """
    held = catalog.where("path like '/certificates/%'").select("file_id", F.substring_index("path", "/", -1).alias("certificate"), *[F.element_at("attrs", k).alias(k) for k in ("key_id", "signer", "subject_sha256")])
    known = held.join(catalog_digest(catalog, payload_sha), "file_id", "left")
    reason = F.when(~F.col("subject_sha256").eqNullSafe(F.col("digest")), "digest differs")
    if keys is not None:
        registry = keys.select("key_id", F.col("signer").alias("_signer"), F.coalesce("revoked", F.lit(False)).alias("_revoked"))
        known = known.join(registry, "key_id", "left")
        reason = reason.when(F.col("_signer").isNull(), "unknown key").when(F.col("_signer") != F.col("signer"), "not the signer's key").when(F.col("_revoked"), "revoked key")
    return known.select("file_id", "certificate", "key_id", reason.isNull().alias("valid"), F.coalesce(reason, F.lit("")).alias("reason"))


def file_levels(catalog: DataFrame, keys: DataFrame | None = None, payload_sha: str | None = None) -> DataFrame:
    """file_id and verification level by the valid certificates of each file."""
    good = check_certificates(catalog, keys, payload_sha).where("valid").groupBy("file_id").agg(F.collect_set("certificate").alias("held"))
    files = catalog.select("file_id").distinct().join(good, "file_id", "left")
    return files.select("file_id", verification_level(F.coalesce("held", F.array().cast("array<string>"))).alias("level"))


def verification_level(certificates: Column, levels=LEVELS) -> Column:
    """Level of an array of certificate names: the first rule whose names are all there. Validity is not looked at."""
    out = F.lit(DEFAULT_LEVEL)
    for level, names in reversed(levels):
        out = F.when(F.size(F.array_except(F.array(*[F.lit(n) for n in names]), certificates)) == 0, level).otherwise(out)
    return out


def certificate(value: dict, name: str, key_id: str, signer: str, created_on: str, sign=None) -> dict:
    """A certificate of a result without its certificates; ``sign`` turns its bytes into a detached signature."""
    subject = {k: v for k, v in value.items() if not k.startswith("certificate")}
    body = {"certificate": name, "key_id": key_id, "signer": signer, "created_on": created_on, "subject_sha256": sha256_hex(canonical_json(subject))}
    return body | ({"signature": sign(canonical_json(body))} if sign else {})


def verify(value: dict, cert: dict, check=None) -> dict:
    """valid and reason: the digest must match, and ``check(bytes, signature)`` must hold where a signature is there."""
    subject = {k: v for k, v in value.items() if not k.startswith("certificate")}
    if cert.get("subject_sha256") != sha256_hex(canonical_json(subject)):
        return {"valid": False, "reason": "digest differs"}
    body = {k: v for k, v in cert.items() if k != "signature"}
    if "signature" in cert and check and not check(canonical_json(body), cert["signature"]):
        return {"valid": False, "reason": "signature does not verify"}
    return {"valid": True, "reason": ""}


def gpg_sign(data: bytes, key_id: str) -> str:
    """Armoured detached signature by the gpg program, where it is installed."""
    return subprocess.run(["gpg", "--batch", "--armor", "--detach-sign", "--local-user", key_id], input=data, capture_output=True, check=True).stdout.decode()


def gpg_verify(data: bytes, signature: str, public_key: str) -> bool:
    """Whether a detached signature of data verifies with a public key, in a key ring of its own."""
    import tempfile

    with tempfile.TemporaryDirectory() as home:
        Path(home, "data").write_bytes(data)
        Path(home, "sig").write_text(signature, encoding="ascii")
        gpg = ["gpg", "--homedir", home, "--batch"]
        if subprocess.run([*gpg, "--import"], input=public_key.encode(), capture_output=True, check=False).returncode:
            return False
        return not subprocess.run([*gpg, "--verify", f"{home}/sig", f"{home}/data"], capture_output=True, check=False).returncode


def write_results(value: dict, path: str) -> None:
    Path(path).write_text(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False), encoding="utf-8")
