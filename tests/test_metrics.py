import math

import pytest
from pyspark.sql import functions as F

from emberframe.operators import metrics as M
from emberframe.session import nan_to_null


NAN = float("nan")


@pytest.fixture
def pair(spark):
    def make(x, r, parts=1):
        df = spark.createDataFrame(list(zip(x, r, strict=True)), "x double, r double").repartition(parts)
        return nan_to_null(df)

    return make


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize(
    ("metric", "x", "r", "expected"),
    [
        (M.rmse, (0.0, 1.0, 2.0), (0.0, 0.0, 2.0), math.sqrt(1 / 3)), (M.rmse, (0.0, 1.0, 2.0), (0.0, NAN, 2.0), 0), (M.nmse_range, (0.0, 1.0, 2.0), (0.0, 0.0, 2.0), math.sqrt(1 / 3) / 2),
        (M.nmse_power, (0.0, 1.0, 2.0), (0.0, 0.0, 3.0), 2 / 3), (M.nmse_power, (0.0, 1.0, 2.0, 3.0), (1.0, 2.0, 3.0, 4.0), 4 / 15), (M.bias, (0.0, 1.0, 2.0), (0.0, 0.0, 6.0), -1),
        (M.bias, (0.0, 1.0, 2.0), (0.0, NAN, 2.0), 0), (M.bias, (NAN, 1.0, 2.0), (5.0, 1.0, 3.0), -1.5), (M.mae, (0.0, 1.0, 2.0), (0.0, NAN, 4.0), 1), (M.correlation, (1.0, 2.0, 3.0), (2.0, 4.0, 6.0), 1),
        (M.circular_bias, (10.0,), (350.0,), 20), (M.circular_bias, (350.0,), (10.0,), -20), (M.circular_bias, (0.0, 10.0), (350.0, 0.0), 10), (M.circular_bias, (0.0, NAN, 20.0), (10.0, 30.0, 10.0), 0),
    ],
)
def test_errors(pair, metric, x, r, expected, parts):
    assert pair(x, r, parts).agg(metric(F.col("x"), F.col("r"))).first()[0] == pytest.approx(expected, abs=1e-9)


def test_errors_without_spread_fail(pair):
    for metric in (M.nmse_range, M.nmse_power):
        with pytest.raises(Exception, match="zero"):
            pair((0.0, 1.0, -1.0), (1.0, 1.0, 1.0)).agg(metric(F.col("x"), F.col("r"))).collect()


def test_errors_without_rows(pair):
    df = pair((NAN,), (1.0,)).where("x is not null")
    assert df.agg(M.rmse(F.col("x"), F.col("r")), M.bias(F.col("x"), F.col("r")), M.nmse_range(F.col("x"), F.col("r")), M.circular_bias(F.col("x"), F.col("r"))).first() == (None, None, None, None)


def test_confusion(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(True, False)] * 2 + [(False, True)] + [(False, False)] * 4 + [(None, True)], "p boolean, a boolean")
    c = M.Confusion(F.col("p"), F.col("a"))
    row = df.agg(c.matrix(), c.accuracy(), c.precision(), c.recall(), c.specificity(), c.false_positive_rate(), c.negative_predictive_value(), c.f_score()).first()
    assert tuple(row[0]) == (4, 2, 1, 3)
    assert tuple(row)[1:] == pytest.approx((0.7, 0.6, 0.75, 4 / 6, 2 / 6, 0.8, 2 * 0.6 * 0.75 / 1.35))
    none = df.where("p is null").agg(c.accuracy(), c.precision(), c.f_score()).first()
    assert tuple(none) == (None, 0.0, 0.0)


def test_overlap(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "a int, b int")
    a, b = F.col("a") == 1, F.col("b") == 1
    assert tuple(df.agg(M.jaccard(a, b), M.dice(F.col("a"), F.col("b"))).first()) == pytest.approx((1 / 3, 0.5))
    assert tuple(df.where("a + b = 0").agg(M.jaccard(a, b), M.dice(F.col("a"), F.col("b"))).first()) == (1.0, 1.0)


def test_severity(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (1, 1), (1, 0), (1, 2), (2, 0)], "r int, e int")
    got = {r["class"]: (r.accuracy_burnt, r.accuracy_total) for r in M.severity_accuracy(df, "r", "e").collect()}
    assert got == {1: pytest.approx((2 / 3, 2 / 5)), 2: pytest.approx((0.0, 0.0))}
    assert {(r.ref_class, r.eval_class): r.row_percent for r in M.severity_matrix(df, "r", "e").collect()}[1, 1] == 50


def test_bins(spark):
    assert M.nice_bins(5, 5) == (5, 1.0)
    assert M.nice_bins(0, 100, 20) == (0.0, 5.0)
    df = spark.createDataFrame([(-1.0,), (0.0,), (4.0,), (5.0,), (99.0,)], "v double")
    assert {r.bin_start: r.n for r in M.histogram(df, "v", 20).collect()} == {0.0: 2, 5.0: 1, 95.0: 1}
    assert M.histogram(df.where("v > 1000"), "v").count() == 0
