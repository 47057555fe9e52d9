"""Plans: what is read, what is shuffled, and that no Python runs where built-in columns do the work."""

import re

import pytest

from emberframe.plans import catalogue

PYTHON = re.compile("Python|Pandas|Arrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["k_rothermel", "k_santoni", "k_hamada1", "k_hamada2", "k_norms", "n_sensors", "w_wind_profiles", "p_fuel_derivations", "p_closest_class", "p_units"])
def test_row_queries_neither_shuffle_nor_leave_the_jvm(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    body = text.split("Subquery")[0]
    assert "Exchange" not in body and not PYTHON.search(text)


def test_the_fixed_point_is_one_arrow_function(spark, sf_dir):
    text = plan(catalogue.QUERIES["k_balbi"](spark, sf_dir))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in text


def test_metrics_shuffle_partial_sums_only(spark, sf_dir):
    text = plan(catalogue.QUERIES["m_confusion_family"](spark, sf_dir))
    assert text.count("Exchange") == 1 and "partial_" in text and not PYTHON.search(text)


def test_scans_read_what_they_need(spark, sf_dir):
    text = plan(catalogue.QUERIES["m_rmse_by_group"](spark, sf_dir))
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_discount:double,l_returnflag:string>", text)


def test_windows_of_rasters_reach_the_scan(spark, tmp_path):
    from emberframe.sources import rasters

    path = str(tmp_path / "g")
    spark.range(10).selectExpr("cast(id as double) x", "cast(id as double) y", "cast(id as double) value").write.parquet(path)
    text = plan(rasters.window(spark.read.parquet(path), 2, 2, 4, 4))
    assert "GreaterThanOrEqual(x,2" in text and "LessThanOrEqual(x,4" in text


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_cartesian_products(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_workers_need_no_package_on_their_path(tmp_path):
    """A query with an array function, from a session whose working folder is not the repository."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r}); from emberframe.session import local_session; from emberframe.plans import catalogue; s = local_session('1', 1, '1g'); print('rows', catalogue.QUERIES['k_balbi'](s, '/root/testdata/sf0.001').count(), catalogue.QUERIES['k_balbi'](s, '/root/testdata/sf0.001').agg({{'ros': 'max'}}).first()[0] > 0)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240, check=False)
    assert "rows" in out.stdout and out.stdout.strip().endswith("True"), out.stderr[-2000:]
