"""Payload digests and merging with payloads."""

import hashlib
import re

import pytest

from emberframe.operators import provenance
from emberframe.sources import tables

SCHEMA = "file_id string, path string, position long, x double, name string, b binary"


def rows(n):
    return [("f", "/a", i, i / 3, None if i % 7 == 0 else f"n{i % 5}", bytes([i % 256])) for i in range(n)]


def plain(data, slab, fan):
    """The same tree by hand over rows in order of position."""
    text = lambda v: "-" if v is None else f"{len(v)}:{v}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = {}
    for _, _, p, x, name, b in sorted(data, key=lambda r: r[2]):
        line = sha(f"b={text(b.hex().upper())};name={text(name)};position={text(str(p))};x={text(str(x))};")
        level.setdefault(p // slab, []).append(f"{p}:{line}")
    level = {k: sha("\n".join(v)) for k, v in level.items()}
    for _ in range(3):
        up = {}
        for k in sorted(level):
            up.setdefault(k // fan, []).append(f"{k}:{level[k]}")
        level = {k: sha("\n".join(v)) for k, v in up.items()}
    top = sha("\n".join(f"{k}:{level[k]}" for k in sorted(level)))
    return sha(f"{len(data)}|b binary;name string;position bigint;x double|{top}")


def test_the_tree_by_hand(spark):
    data = rows(100)
    want = plain(data, 8, 3)
    for parts in (1, 5):
        df = spark.createDataFrame(data, SCHEMA).repartition(parts, "x").select("name", "x", "b", "path", "file_id", "position")
        got = provenance.payload_digest(df, "file_id", "path", position="position", rows=8, fan=3).collect()
        assert [(r.file_id, r.path, r.payload_rows, r.payload_sha) for r in got] == [("f", "/a", 100, want)]


def test_a_sparse_payload_is_the_same_tree_and_its_rows_are_shuffled_once(spark):
    """Nearly every row is a slab of its own: the lowest two levels share one shuffle, of hashes as bytes."""
    data = [(f, path, p * 37, *rest) for f, path, p, *rest in rows(60)]
    digest = provenance.payload_digest(spark.createDataFrame(data, SCHEMA).repartition(4), "file_id", "path", position="position", rows=8, fan=3)
    assert [r.payload_sha for r in digest.collect()] == [plain(data, 8, 3)]
    sparse = spark.range(1000).selectExpr("'f' AS file_id", "'/a' AS path", "id * 5000 AS position", "id AS value")
    text = provenance.payload_digest(sparse, "file_id", "path", position="position")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 4 and "unhex(sha2(" in text


def test_rows_are_not_dealt_out_by_file(spark, sf_dir, monkeypatch):
    """v_certificates changes one value of a file without joining all rows of payloads by file, of which there are 25 however many rows there are."""
    from emberframe.plans import source_queries

    plans, save = {}, source_queries.saved
    monkeypatch.setattr(source_queries, "saved", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or save(df, name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = source_queries.v_certificates(spark, sf_dir).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r.reason for r in found} >= {"", "unknown key", "revoked key", "digest differs"}
    assert not re.search(r"SortMergeJoin \[file_id#\d+\], \[file_id#\d+\]", plans["changed"]) and "BroadcastHashJoin [l_suppkey" in plans["changed"]


@pytest.mark.parametrize("position", ["position", None])
def test_any_change_shows_and_is_found(spark, position):
    data = rows(60)
    digest = lambda d: provenance.payload_digest(spark.createDataFrame(d, SCHEMA), "file_id", "path", position=position, rows=10).first()["payload_sha"]
    first = digest(data)
    assert digest(data[::-1]) == first
    changed = [
        data[:-1], data[1:], [*data, data[0]],  # a row less, a row more
        [*data[:30], (*data[30][:3], 0.5, *data[30][4:]), *data[31:]],
        [*data[:30], (*data[30][:4], None, data[30][5]), *data[31:]],
        [*data[:30], (*data[30][:5], b""), *data[31:]],
        [*data[:1], (*data[1][:2], 2, *data[1][3:]), (*data[2][:2], 1, *data[2][3:]), *data[3:]],  # two rows change places
    ]
    assert len({first, *map(digest, changed)}) == len(changed) + 1
    slabs = lambda d: {r.slab: r.digest for r in provenance.payload_slabs(spark.createDataFrame(d, SCHEMA), "file_id", "path", position=position, rows=10).collect()}
    a, b = slabs(data), slabs(changed[3])
    differ = {k for k in a | b if a.get(k) != b.get(k)}
    assert differ == {3} if position else 1 <= len(differ) <= 2


def test_text_of_rows_is_unambiguous(spark):
    sha = lambda *v: provenance.payload_digest(spark.createDataFrame([v], "a string, b string")).first()["payload_sha"]
    assert len({sha("x;b=1:y", "z"), sha("x", "y"), sha("xy", ""), sha("", "xy"), sha(None, "xy"), sha("-", "xy")}) == 6
    assert provenance.payload_digest(spark.createDataFrame([], "a string")).count() == 0


def catalog(spark, k, **more):
    root = {"created_by": f"Author {k}", "created_on": "2024-01-01T00:00:00Z", "io_version": "1.0"} | more
    nodes = [(f"f{k}", "/", "group", None, None, root), (f"f{k}", "/points", "group", None, None, {}), (f"f{k}", f"/points/p{k}", "dataset", "float64", [3], {"units": "m"})]
    return spark.createDataFrame(nodes, "file_id string, path string, kind string, dtype string, shape array<long>, attrs map<string,string>")


def written(spark, tmp_path, k, **more):
    folder = f"file://{tmp_path}/d{k}"
    tables.write_dataset(catalog(spark, k, **more), {f"/points/p{k}": spark.createDataFrame([(i, i * k / 2) for i in range(3)], "position int, value double")}, folder)
    return folder


def test_merged_payloads_are_read_back(spark, tmp_path):
    folders, target = [written(spark, tmp_path, k) for k in (1, 2, 3)], f"file://{tmp_path}/merged"
    tables.merge_datasets(spark, folders, target)
    assert {r.path for r in tables.read_catalog(spark, target).collect()} == {"/", "/points", "/points/p1", "/points/p2", "/points/p3"}
    for k in (1, 2, 3):
        assert sorted(map(tuple, tables.read_payload(spark, target, f"/points/p{k}").collect())) == [(i, i * k / 2) for i in range(3)]
        digest = provenance.payload_digest(tables.read_payload(spark, folders[k - 1], f"/points/p{k}")).first()["payload_sha"]
        assert tables.manifest(spark, target)["payloads"][f"/points/p{k}"] == digest
    with pytest.raises(FileExistsError):
        tables.merge_datasets(spark, folders, target)
    assert tables.read_payload(spark, target, "/points/p2").count() == 3


@pytest.mark.parametrize("step", [1, 2, 3])
def test_a_merge_that_stops_leaves_nothing(spark, tmp_path, monkeypatch, step):
    """The merge is stopped before its first payload, between payloads, and before the manifest; then it is run again."""
    folders, target = [written(spark, tmp_path, k) for k in (1, 2)], f"file://{tmp_path}/merged"
    calls, read, publish = [], tables.read_payload, tables.publish

    def stop(f):
        def run(*args):
            calls.append(f)
            if len(calls) == step:
                raise KeyboardInterrupt
            return f(*args)

        return run

    with monkeypatch.context() as m:
        m.setattr(tables, "read_payload", stop(read))
        m.setattr(tables, "publish", stop(publish))
        with pytest.raises(KeyboardInterrupt):
            tables.merge_datasets(spark, folders, target)
    assert tables.manifest(spark, target) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_catalog(spark, target)
    tables.merge_datasets(spark, folders, target)
    assert tables.read_payload(spark, target, "/points/p1").count() == 3 and tables.read_catalog(spark, target).count() == 4


def test_conflicts_write_nothing(spark, tmp_path):
    a, target = written(spark, tmp_path, 1), f"file://{tmp_path}/merged"
    tables.write_dataset(catalog(spark, 1), {}, f"file://{tmp_path}/other")
    with pytest.raises(ValueError, match="both sides hold it"):
        tables.merge_datasets(spark, [a, f"file://{tmp_path}/other"], target)
    assert not (tmp_path / "merged").exists()


def test_a_changed_value_breaks_the_certificate(spark):
    payload = spark.range(1000).selectExpr("'f1' AS file_id", "'/points/p1' AS path", "id AS position", "id / 7 AS value")
    sign = lambda p: provenance.with_payloads(catalog(spark, 1), provenance.payload_digest(p, "file_id", "path", position="position"))
    held = provenance.add_certificate(sign(payload), "benchmark-run-internal", "k", "s", "2024-01-01T00:00:00Z", "payload_sha")
    for value, valid in (("value", True), ("CASE WHEN position = 700 THEN value + 1e-12 ELSE value END AS value", False)):
        now = provenance.payload_digest(payload.repartition(3).selectExpr("file_id", "path", "position", value), "file_id", "path", position="position")
        assert [r.valid for r in provenance.check_certificates(provenance.with_payloads(held, now), payload_sha="payload_sha").collect()] == [valid]


def test_cards_need_a_valid_certificate(spark):
    from emberframe.operators import scorecard

    held = provenance.add_certificate(catalog(spark, 1).unionByName(catalog(spark, 2)), "benchmark-run-internal", "k", "s", "2024-01-01T00:00:00Z")
    broken = held.where("not (file_id = 'f2' and path = '/points')")
    card = spark.createDataFrame([("f1", "total", "all", 50.0), ("f2", "total", "all", 60.0), ("f3", "total", "all", 70.0)], "file_id string, level string, name string, score double")
    assert sorted((r.file_id, r.verification) for r in scorecard.certified(card, held, "benchmark-run-internal").collect()) == [("f1", "VL-C"), ("f2", "VL-C")]
    assert [r.file_id for r in scorecard.certified(card, broken, "benchmark-run-internal").collect()] == ["f1"]
    with pytest.raises(Exception, match="no valid certificate: f"):
        scorecard.certified(card, broken, "benchmark-run-internal", strict=True).collect()
