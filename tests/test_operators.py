import pytest
from pyspark.sql import functions as F

from emberframe.functions import timefmt, vocab
from emberframe.operators import fuels, geometry, models, provenance, scorecard, sensitivity, standard


def test_model_inputs(spark):
    df = spark.createDataFrame([(2.0, 1.0, 5.0, 10.0, 10.0, 0.5)], "fuel_load_dry_total double, fuel_height double, wind_speed double, slope_angle double, fuel_moisture_content double, fuel_load_dead_ratio double")
    df = df.withColumns({"fuel_density": F.lit(300.0), "fuel_surface_area_volume_ratio": F.lit(4500.0)}).withMetadata("wind_speed", {"units": "km h-1"}).withMetadata("fuel_load_dry_total", {"units": "kg m-2"})
    for name, unit in (("fuel_height", "m"), ("slope_angle", "degree"), ("fuel_moisture_content", "percent"), ("fuel_density", "kg m-3"), ("fuel_surface_area_volume_ratio", "m-1")):
        df = df.withMetadata(name, {"units": unit})
    balbi = models.REGISTRY["balbi"]
    ready = models.checked(df, balbi)
    assert ready.first().wind_speed == pytest.approx(5 / 3.6)
    out = balbi.apply(ready)
    assert 0 < out.first().rate_of_spread <= 6 and out.schema["rate_of_spread"].metadata["units"] == "m s-1"
    with pytest.raises(ValueError, match="missing"):
        models.check_completeness(df.drop("wind_speed"), balbi)
    with pytest.raises(ValueError, match="range"):
        models.check_ranges(ready.withColumn("slope_angle", F.lit(95.0)), balbi)
    assert not vocab.check_names([p.std_name for m in models.REGISTRY.values() for p in m.params])


def test_closest_class(spark):
    classes = spark.createDataFrame([(1, 100.0, 10.0), (2, 150.0, 15.0), (3, 200.0, 20.0)], "fuel_class int, d double, m double")
    obs = spark.createDataFrame([(160.0, 14.0), (0.0, 0.0), (500.0, 50.0)], "d double, m double")
    assert [r.closest_class for r in fuels.closest_class(obs, classes, ["d", "m"]).collect()] == [2, 1, 3]
    two = spark.createDataFrame([(1, 100.0, 5.0), (2, 200.0, 25.0)], "fuel_class int, d double, m double")
    target = spark.createDataFrame([(125.0, 20.0)], "d double, m double")
    assert fuels.closest_class(target, two, ["d", "m"]).first().closest_class == 2
    assert fuels.closest_class(target, two, ["d", "m"], weights={"d": 2, "m": 1}).first().closest_class == 1


def test_fuel_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)], "fuel_load_dry_1h double, fuel_load_dry_10h double, fuel_load_dry_100h double, fuel_load_dry_live_herb double, fuel_load_dry_live_woody double")
    done = fuels.dead_ratio(fuels.total_load(df)).first()
    assert (done.fuel_load_dry_total, done.fuel_load_dead_ratio) == (15, pytest.approx(6 / 15))
    savr = df.selectExpr("0.1D fuel_load_dry_1h", "0.2D fuel_load_dry_live_herb", "0.3D fuel_load_dry_live_woody", "2000D fuel_surface_area_volume_ratio_dead_1h", "1500D fuel_surface_area_volume_ratio_live_herb", "1800D fuel_surface_area_volume_ratio_live_woody")
    assert fuels.total_savr(savr).first().fuel_surface_area_volume_ratio == pytest.approx(1040 / 0.6)
    with pytest.raises(ValueError, match="overwrite"):
        fuels.total_load(fuels.total_load(df))
    with pytest.raises(KeyError):
        fuels.total_savr(df)
    with pytest.raises(Exception, match="zero"):
        fuels.total_savr(savr.withColumns({c: F.lit(0.0) for c in savr.columns[:3]})).collect()


def test_category_and_merge(spark, value):
    a = F.array(F.lit(1.0), F.lit(2.0))
    assert value(fuels.value_by_category(a, F.lit(2))) == 2
    for bad in (0, 3, -1):
        with pytest.raises(Exception, match="category"):
            value(fuels.value_by_category(a, F.lit(bad)))
    left, right = spark.createDataFrame([(1, 10)], "k int, v int"), spark.createDataFrame([(1, 20), (2, 30)], "k int, v int")
    with pytest.raises(ValueError):
        fuels.merge_columns(left, right, ["k"])
    assert sorted(map(tuple, fuels.merge_columns(left, right, ["k"], 1).collect())) == [(1, 10), (2, 30)]
    assert sorted(map(tuple, fuels.merge_columns(left, right, ["k"], 2).collect())) == [(1, 20), (2, 30)]


def test_sobol(spark):
    assert sensitivity.saltelli(spark, 8, {"a": (0, 1), "b": (0, 1)}).count() == 48
    pts = spark.range(8).select(*[sensitivity.sobol_point(F.col("id"), d) for d in range(2)]).collect()
    assert [p[0] for p in pts] == [0, 0.5, 0.75, 0.25, 0.375, 0.875, 0.625, 0.125]
    assert [p[1] for p in pts] == [0, 0.5, 0.25, 0.75, 0.375, 0.875, 0.125, 0.625]
    many = spark.range(1024).select(*[sensitivity.sobol_point(F.col("id"), d).alias(f"d{d}") for d in range(16)])
    for d in range(16):  # every dimension fills each of 1024 cells once
        assert many.select(F.floor(F.col(f"d{d}") * 1024)).distinct().count() == 1024
    design = sensitivity.saltelli(spark, 4096, {"a": (0, 1), "b": (0, 1), "c": (0, 1)})
    got = {r.variable: r for r in sensitivity.sobol_indices(design.withColumn("y", F.col("a") + 2 * F.col("b")), ["a", "b", "c"], "y", resamples=10).collect()}
    assert got["a"].s1 == pytest.approx(0.2, abs=0.02) and got["b"].st == pytest.approx(0.8, abs=0.02) and got["c"].st == pytest.approx(0, abs=1e-6)
    assert got["b"].s1_conf > 0


def test_designs_of_any_dimension():
    polynomials = sensitivity.primitive_polynomials(60)
    assert polynomials[: len(sensitivity.JOE_KUO)] == [p[:2] for p in sensitivity.JOE_KUO]
    counts = {d: sum(p[0] == d for p in polynomials) for d in range(1, 8)}
    assert counts == {1: 1, 2: 1, 3: 2, 4: 2, 5: 6, 6: 6, 7: 18}  # Euler's function of 2**d - 1, over d
    for d in (0, 5, 15, 16, 17, 30, 39):
        v, at, seen = sensitivity.directions(d), 0, set()
        for i in range(1024):
            seen.add(at >> (sensitivity.BITS - 10))
            at ^= v[((i + 1) & -(i + 1)).bit_length() - 1]
        assert len(seen) == 1024  # every dimension fills each of 1024 cells once


def test_indices_of_twenty_variables_without_a_shuffle(spark):
    names = [f"v{i}" for i in range(20)]
    design = sensitivity.saltelli(spark, 512, dict.fromkeys(names, (0.0, 1.0)))
    y = sum((i + 1) * F.col(v) for i, v in enumerate(names))
    runs = design.select("point_id", "block", F.explode(F.array(F.lit("x"), F.lit("z"))).alias("g"), y.alias("y"))
    one = sensitivity.sobol_indices(runs, names, "y", "g", ordered=True)
    text = one._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "partial_sum" in text
    got = {(r.g, r.variable): (r.s1, r.st) for r in one.collect()}
    total = sum((i + 1) ** 2 for i in range(20))
    assert len(got) == 40 and all(got[g, v][1] == pytest.approx((i + 1) ** 2 / total, abs=0.03) for g in "xz" for i, v in enumerate(names))
    some = sensitivity.saltelli(spark, 64, dict.fromkeys(names[:3], (0.0, 1.0))).select("point_id", "block", (F.col("v0") * F.col("v1") + F.col("v2")).alias("y"))
    plain, ordered = ({r.variable: tuple(r)[1:] for r in sensitivity.sobol_indices(some, names[:3], "y", resamples=5, ordered=o).collect()} for o in (False, True))
    assert {k: pytest.approx(v, abs=1e-12) for k, v in plain.items()} == ordered
    with pytest.raises(Exception, match="not together"):
        sensitivity.sobol_indices(some.repartition(7, "block"), names[:3], "y", ordered=True).collect()


def test_scores(spark):
    assert sum(map(len, scorecard.GROUPS.values())) == 362 and len(scorecard.GROUPS) == 27
    assert len(scorecard.SCHEMES["short_all"]) == 21 and len(scorecard.SCHEMES["WX_short"]) == 18
    groups = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "group string, benchmark string")
    scores = spark.createDataFrame([("a", 0.0), ("b", 100.0), ("c", 50.0), ("d", None)], "benchmark string, score double")
    over = spark.createDataFrame([("g", "b", 3.0)], "group string, benchmark string, weight double")
    scheme = spark.createDataFrame([("s", "g", 1.0), ("s", "h", 3.0)], "scheme string, group string, group_weight double")
    card = scorecard.card(scores, scorecard.with_weights(groups, over), scheme)
    got = {(r.level, r["name"]): (r.score, r.color) for r in card.collect()}
    assert got["group", "g"] == (75.0, "green") and got["total", "s"] == (56.25, "yellow")
    assert "| total | s | 56.25 | yellow |" in scorecard.markdown(card)
    ctx = scorecard.Context(("a", "b", "c"))
    assert ctx.get(("a", "b", "c"), lambda: scores) is ctx.get(("a", "b", "c"), lambda: None)
    with pytest.raises(KeyError):
        ctx.get(("x", "b", "c"), lambda: scores)
    ctx.close()


def _catalog(spark, file_id, *nodes):
    root = ("/", "group", None, None, {"io_version": "1.0", "created_on": "2024-01-01T00:00:00Z", "created_by": f"{file_id};"})
    return spark.createDataFrame([(file_id, *n) for n in (root, *nodes)], standard.CATALOG)


def test_standard(spark, value):
    a = _catalog(spark, "a", ("/points", "group", None, None, {}), ("/points/x", "dataset", "float64", [3], {"units": "m"}))
    b = _catalog(spark, "b", ("/points", "group", None, None, {"n": "1"}), ("/points/y", "dataset", "float64", [4], {"units": "m"}))
    merged = {r.path: r for r in standard.merge_all([a, b]).collect()}
    assert sorted(merged) == ["/", "/points", "/points/x", "/points/y"]
    assert merged["/"].attrs["created_by"] == "a;b;" and merged["/points"].attrs == {"n": "1"}
    clash = _catalog(spark, "c", ("/points/x", "dataset", "float64", [4], {"units": "ft"}), ("/points", "dataset", "int32", [1], {}))
    assert sorted((r.path, r.kind) for r in standard.conflicts(a, clash).collect()) == [("/points", "node_type"), ("/points/x", "attr_mismatch"), ("/points/x", "dataset_mismatch")]
    with pytest.raises(ValueError, match="conflicts"):
        standard.merge_two(a, clash)
    same = _catalog(spark, "d", ("/points/x", "dataset", "float64", [3], {"units": "m"}))
    with pytest.raises(Exception, match="both sides"):
        standard.merge_two(a, same).collect()
    with pytest.raises(ValueError):
        standard.merge_all([])
    need = spark.createDataFrame([(1, "/points/x", "units"), (2, "/points/x", "height"), (3, "/points/z", None)], "position int, path string, attribute string")
    assert standard.first_missing(a, need, "a") == "/points/x@height"
    assert standard.root_problems(a.where("path <> '/'")).count() == 3
    assert value(standard.merge_authors(F.lit("alice;bob;"), F.lit("carol;dan;"))) == "alice;carol;bob;dan;"
    assert standard.may_update(None) and standard.may_update("1.0") and not standard.may_update("0.2")
    with pytest.raises(ValueError):
        standard.may_update("0.1")
    attrs = F.create_map(F.lit("h"), F.lit(" 2.5 "), F.lit("e"), F.lit(" "))
    assert value(standard.numeric_attribute(attrs, "h"), standard.text_attribute(attrs, "h")) == (2.5, "2.5")
    with pytest.raises(Exception, match="empty"):
        value(standard.text_attribute(attrs, "e"))
    ref = _catalog(spark, "r", ("/time_series/s1/wind", "dataset", "float64", [1], {}), ("/time_series/s2/rain", "dataset", "float64", [1], {}))
    assert [r.path for r in standard.missing_station_series(ref, "r", "r", "wind").collect()] == ["/time_series/s1/time"]


def test_provenance(spark, value):
    names = lambda *x: F.array(*[F.lit(n) for n in x])
    _, full = provenance.LEVELS[0]
    assert value(*[provenance.verification_level(names(*full[:k])) for k in (4, 3, 2, 1)]) == ("VL-A+", "VL-A", "VL-B", "VL-C")
    result = {"score": 1.5, "name": "é"}
    cert = provenance.certificate(result, "run", "k", "me", "2024-01-01T00:00:00Z", sign=lambda b: provenance.sha256_hex(b))
    assert provenance.verify(result | {"certificate": cert}, cert, lambda b, s: provenance.sha256_hex(b) == s)["valid"]
    assert not provenance.verify({"score": 2}, cert)["valid"]
    a = _catalog(spark, "a", ("/points/x", "dataset", "float64", [3], {"units": "m"}), ("/certificates/c", "dataset", "s", [1], {}))
    digest = provenance.catalog_digest(a).first().digest
    assert provenance.catalog_digest(a.repartition(3).where("path not like '/cert%'")).first().digest == digest
    assert provenance.catalog_digest(a.withColumn("dtype", F.lit("f"))).first().digest != digest


def test_time(value):
    at = lambda s: F.lit(s)
    assert value(*[timefmt.is_iso8601(at(s)) for s in ("2024-01-01T00:00", "2024-01-01T00:00:00.5+02:00", "2024-01-01 00:00", "2024-01-01T00:00Z")]) == (True, True, False, True)
    before, after = timefmt.instant(at("20240310013000"), at("America/Los_Angeles")), timefmt.instant(at("20240310033000"), at("America/Los_Angeles"))
    assert value((F.unix_timestamp(after) - F.unix_timestamp(before)) / 60) == 60
    assert value(timefmt.iso_with_offset(before, at("America/Los_Angeles"))) == "2024-03-10T01:30:00-08:00"
    from datetime import datetime

    assert timefmt.to_iso(datetime(2024, 7, 1, 12), "America/Los_Angeles") == "2024-07-01T12:00:00-07:00"
    with pytest.raises(ValueError):
        timefmt.to_iso(datetime(2024, 7, 1))


def test_polygons(spark):
    ring = lambda x: [(x, 40.0), (x + 1, 40.0), (x + 1, 41.0), (x, 41.0)]
    rows = [(k, ring(-100.0), ring(-100.0 + s)) for k, s in enumerate((0, 3, 0.5))]
    df = spark.createDataFrame(rows, "id int, ring_a array<struct<x:double,y:double>>, ring_b array<struct<x:double,y:double>>")
    for projection in geometry.PROJECTIONS:
        got = {r.id: (r.jaccard, r.dice) for r in geometry.polygon_overlap(df, projection=projection).collect()}
        assert got[0] == pytest.approx((1, 1)) and got[1] == (0, 0) and got[2] == pytest.approx((0.333, 0.4997), abs=2e-3)
    with pytest.raises(ValueError):
        geometry.project(F.lit(0.0), F.lit(0.0), "EPSG:4326")
    star = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    assert geometry.overlap_area(star, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]) == pytest.approx(10)
    assert geometry.overlap_area(star, star[::-1]) == pytest.approx(10)


def test_contour(spark):
    import math

    n = 121
    cells = spark.range(n * n).select(F.lit("g").alias("grid_id"), F.floor(F.col("id") / n).alias("row"), (F.col("id") % n).alias("col"))
    grid = cells.withColumns({"lon": F.col("col") / 6 - 10, "lat": F.col("row") / 6 - 10})
    r = F.hypot("lon", "lat")
    # inside at most 1, a hole up to 3, a ring up to 8
    value = F.when(r < 2, r - 1).otherwise(F.when(r < 5, 3 - r).otherwise(r - 8))
    area = geometry.filled_area(grid.withColumn("value", value), 0.0).first().area
    assert area == pytest.approx(math.pi * (8**2 - 3**2 + 1), rel=5e-3)
    hole = grid.withColumn("value", F.when((F.col("row") == 60) & (F.col("col") == 60), None).otherwise(F.lit(-1.0)))
    assert geometry.filled_area(hole, 0.0).first().area == pytest.approx(400 - 4 / 36)


def test_shapes_with_holes(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rows = [(1, "a", False, square(0.0, 0.0, 4.0)), (1, "a", True, square(1.0, 1.0, 1.0)), (1, "b", False, square(0.0, 0.0, 2.0)), (1, "b", False, square(3.0, 3.0, 2.0)), (2, "a", False, square(0.0, 0.0, 1.0))]
    df = spark.createDataFrame(rows, "id int, side string, hole boolean, ring array<struct<x:double,y:double>>")
    got = {r.id: r for r in geometry.shape_overlap(df, "id", projection="EPSG:6933").collect()}
    assert got[1].area_a / got[1].area_both == pytest.approx(15 / 4, rel=2e-2) and got[2].jaccard == 0 and got[2].area_b == 0


def test_smooth(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.normal(size=(9, 7))
    df = spark.createDataFrame([(1, r, c, float(z[r, c])) for r in range(9) for c in range(7)], "grid_id int, row int, col int, value double")
    sigma, radius = 0.8, 3
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    want = z
    for axis in (0, 1):
        padded = np.pad(want, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        want = sum(x * np.take(padded, range(i, i + want.shape[axis]), axis) for i, x in enumerate(w))
    for r in geometry.smooth(df, sigma).collect():
        assert r.value == pytest.approx(want[r.row, r["col"]])
    hole = geometry.smooth(df.withColumn("value", F.when((F.col("row") != 0) | (F.col("col") != 0), F.col("value"))), sigma)
    assert hole.where("value is null").count() == 16


def test_overlap_of_contours(spark):
    import math

    n = 81
    cells = spark.range(n * n).select(F.lit("g").alias("grid_id"), F.floor(F.col("id") / n).alias("row"), (F.col("id") % n).alias("col"))
    grid = cells.withColumns({"lon": F.col("col") / 10 - 4, "lat": F.col("row") / 10 - 4})
    disk = lambda x: grid.withColumn("value", F.hypot(F.col("lon") - x, "lat"))
    got = geometry.filled_overlap(disk(-0.5), disk(0.5), 2.0).first()
    lens = 2 * 4 * math.acos(1 / 4) - 0.5 * math.sqrt(16 - 1)
    assert got.area_a == pytest.approx(4 * math.pi, rel=2e-3) and got.area_both == pytest.approx(lens, rel=3e-3)
    same = geometry.filled_overlap(disk(0), disk(0), 2.0).first()
    assert (same.jaccard, same.dice) == pytest.approx((1, 1))
