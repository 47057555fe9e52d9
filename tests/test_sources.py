import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators.metrics import rmse
from emberframe.sources import rasters, records, stations, tables
from emberframe.streaming import windows


def test_sidecar(spark, tmp_path, monkeypatch):
    (tmp_path / "fuel.csv").write_text("h,load,code,other\n1,2,a,x\n2,4.9,b,x\n4,-9999,c,x\n")
    meta = {"h": {"variable_name": "fuel_height", "unit": "ft", "type": "float64"}, "load": {"variable_name": "fuel_load_dry_total", "unit": "kg m-2", "type": "float64"}, "code": {"variable_name": "fuel_model_code", "unit": "", "type": "object"}}
    (tmp_path / "fuel.json").write_text(json.dumps({"data_path": "fuel.csv", "no_data_value": "-9999", "metadata": meta}))
    monkeypatch.setenv(tables.DATA_PATH, str(tmp_path))
    df = tables.read_fuel_model(spark, tables.sidecar_path("fuel"))
    assert [tuple(r) for r in df.collect()] == [(1.0, 2.0, "a", 1), (2.0, 4.9, "b", 2), (4.0, None, "c", 3)]
    assert df.schema["fuel_height"].metadata["units"] == "ft"


def test_dataset_round_trip(spark, tmp_path):
    from emberframe.operators import standard

    catalog = spark.createDataFrame([("a", "/points/x", "dataset", "float64", [2], {"units": "m"})], standard.CATALOG)
    tables.write_dataset(catalog, {"/points/x": spark.range(2)}, str(tmp_path / "d"))
    assert tables.read_catalog(spark, str(tmp_path / "d")).first().shape == [2]
    assert tables.read_payload(spark, str(tmp_path / "d"), "/points/x").count() == 2


def test_stations(spark, tmp_path):
    station = {
        "STID": "S1", "NAME": "one", "TIMEZONE": "America/Los_Angeles", "LATITUDE": "38", "LONGITUDE": "-120", "ELEVATION": "1000", "PROVIDERS": [{"name": "Bureau of Land Management"}],
        "OBSERVATIONS": {"date_time": ["20240310013000", "20240310033000"], "air_temp_set_1": [10.5, None], "wind_speed_set_1": [1, 2], "odd_set_1": [1, 2]},
        "SENSOR_VARIABLES": {"air_temp": {"air_temp_set_1": {"position": "3.0"}}, "wind_speed": {"wind_speed_set_1": {"position": None}}},
    }
    (tmp_path / "s.json").write_text(json.dumps({"STATION": [station, {"STID": "S2", "TIMEZONE": "UTC", "OBSERVATIONS": {"date_time": []}}]}))
    df = stations.read_stations(spark, str(tmp_path / "s.json"))
    series = sorted((r.variable, r.minutes, r.value) for r in stations.time_series(df).collect())
    assert series == [("air_temperature", 0.0, 10.5), ("air_temperature", 60.0, None), ("wind_speed", 0.0, 1.0), ("wind_speed", 60.0, 2.0)]
    assert stations.time_series(df, ["S1"]).count() == 0
    none = spark.createDataFrame([], "station_id string, source string, height double")
    heights = stations.sensor_heights(stations.sensors_of(df), none, none, stations.provider_table(spark), stations.variable_table(spark))
    assert sorted((r.source, r.height, r.height_source, r.trust) for r in heights.collect()) == [("air_temp_set_1", 3.0, "from_data", 2), ("wind_speed_set_1", 6.1, "provider_default", 1)]


def test_height_tables(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"S1": {"air_temp_set_1": "2.0", "provider": "P"}, "S2": {"provider": "Q", "wind_speed_set_1": "6.1", "wind_gust_set_1": "6.1"}}))
    history = stations.read_heights(spark, str(tmp_path / "h.json"))
    assert sorted(map(tuple, history.collect())) == [("S1", "P", "air_temp_set_1", 2.0), ("S2", "Q", "wind_gust_set_1", 6.1), ("S2", "Q", "wind_speed_set_1", 6.1)]
    sensors = spark.createDataFrame([("S1", "P", "air_temp_set_1", None), ("S3", "P", "air_temp_set_1", 3.0)], "station_id string, provider string, source string, data_height double")
    none = history.limit(0)
    heights = stations.sensor_heights(sensors, none, history, stations.provider_table(spark), stations.variable_table(spark))
    assert {r.height_source: (r.variables, r.trusted) for r in stations.height_statistics(heights).collect()} == {"trusted_history": (1, 1), "from_data": (1, 1)}
    assert [tuple(r) for r in stations.trusted_heights(heights).collect()] == [("S3", "P", "air_temp_set_1", 3.0)]


def test_rasters(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[0, 1, 2], [3, 4, 0]], np.uint8))
    grid = rasters.standardize(rasters.read_npy(spark, str(tmp_path / "a.npy")), "mtbs", (10.0, 50.0), (1.0, -1.0))
    rows = {(r.row, r["col"]): (r.x, r.y, r.fire_burn_severity) for r in grid.collect()}
    assert rows[0, 0] == (10.0, 50.0, None) and rows[1, 1] == (11.0, 49.0, 4.0) and len(rows) == 6
    assert rasters.window(grid, 10.5, 48, 12, 49.5).count() == 2
    near = rasters.nearest_cell(spark.createDataFrame([(1, 10.2, 49.9), (2, 90.0, 0.0)], "point_id int, x double, y double"), grid.withColumnRenamed("fire_burn_severity", "value").where("value is not null"), 1.5)
    assert {r.point_id: r.value for r in near.collect()} == {1: 1.0, 2: None}


def test_masks(value):
    assert value(*[rasters.canopy_loss(F.lit(s), F.lit(a), F.lit(1)) for s, a in ((5, 1), (3, 1), (0, 1), (5, 0))]) == (1, 0, None, None)
    assert value(*[rasters.damage_burnt(F.lit(d)) for d in ("Destroyed (>50%)", "Minor (1-9%)", "Inaccessible", "Major (26-50%)")]) == (True, False, None, True)


def test_records(tmp_path, monkeypatch):
    monkeypatch.setenv(records.RECORDS, str(tmp_path))
    (tmp_path / "f.txt").write_text("x")
    with pytest.raises(OSError):
        records.record_folder("r")
    records.record_folder("r", create=True)
    digest = records.copy_to_record(tmp_path / "f.txt", "r")
    assert digest == records.file_sha256(tmp_path / "r" / "f.txt") and records.file_sha256(tmp_path / "none") == ""
    with pytest.raises(OSError):
        records.copy_to_record(tmp_path / "f.txt", "r")
    page = tmp_path / "p.md"
    page.write_text("Date: old\n**f.txt**: none\n")
    records.update_markdown(page, {"f.txt": digest}, "2024-01-01")
    assert page.read_text() == f"Date: 2024-01-01\n**f.txt**: {digest}\n"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    base = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(base.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    call = lambda df: windows.windowed_metric(df.withColumn("ref", F.lit(100.0)), rmse, "value", "ref", "event_type", size="1 day")
    out = windows.run_available(spark, call(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    want = {(r.window_start, r.event_type): (round(r.kpi, 9), r.n) for r in call(base).collect()}
    got = {(r.window_start, r.event_type): (round(r.kpi, 9), r.n) for r in out.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_nearest_cell_groups_points_not_pairs(spark, monkeypatch):
    """One row for each point and bundle is grouped, whatever a box holds; ties go to the least place, repeated ids share what is nearest."""
    import random

    r = random.Random(5)
    grid = [(float(r.randrange(9)), float(r.randrange(9)), float(r.randrange(4))) for _ in range(150)] + [(-0.5, -0.5, None)]
    points = [(i % 60, r.uniform(-3, 11), r.uniform(-3, 11)) for i in range(70)] + [(60, 4.5, 4.5), (61, 50.0, 0.0), (62, None, 1.0)]
    g, p = spark.createDataFrame(grid, "x double, y double, value double"), spark.createDataFrame(points, "point_id int, x double, y double")
    want = {}
    for i in {i for i, *_ in points}:
        near = [((x - px) ** 2 + (y - py) ** 2, x, y, (v is not None, v or 0)) for k, px, py in points if k == i and px is not None for x, y, v in grid]
        near = min((n for n in near if n[0] <= 2.25), default=None)
        want[i] = (near[3][1] if near and near[3][0] else None, round(near[0] ** 0.5, 9) if near else None)
    for bundle in (256, 3):
        monkeypatch.setattr(rasters, "_BUNDLE", bundle)
        out = rasters.nearest_cell(p, g, 1.5)
        got = out.collect()
        assert len(got) == len(points) and {(x.point_id, x.value, x.distance and round(x.distance, 9)) for x in got} == {(i, *v) for i, v in want.items()}
    assert "array_min" in out._jdf.queryExecution().toString()
