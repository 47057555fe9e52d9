import pytest
from pyspark.sql import functions as F

from emberframe.functions import kpi, physics, sensors, units, wind

FUEL = (0.8, 0.3, 32.0, 1500.0, 0.3, 0.01, 0.055)


@pytest.mark.parametrize(
    ("chaparral", "speed", "slope", "moisture", "expected"),
    [
        (0, 0, 0, 0.1, 0.020630697262906682), (1, 0, 0, 0.1, 0.03333), (0, 2, 0, 0.1, 0.30339676498092233),
        (0, 2, 10, 0.1, 0.31978349285057384), (0, 2, 0, 0.5, 0.28811909268223007), (0, 25, 20, 0.1, 6.0),
    ],
)
def test_rothermel(value, chaparral, speed, slope, moisture, expected):
    assert value(physics.rothermel(*FUEL, chaparral, speed, slope, moisture)) == pytest.approx(expected, abs=1e-6)


def test_rothermel_percent_extinction(value):
    assert value(physics.rothermel(0.5, 1, 32, 1500, 20, 0.0555, 0.01, 0, 1, 0, 10)) == pytest.approx(0.436663860541543, rel=1e-6)


@pytest.mark.parametrize(
    ("width", "speed", "slope", "expected"),
    [(50, 1, 0, 0.4643753930790799), (30, 1, 0, 0.3881006880449338), (50, 0, 0, 0.3455042235417564), (50, -1, 0, 0.3455042235417564), (50, 0, 10, 0.3387330641766883)],
)
def test_balbi(value, width, speed, slope, expected):
    got = value(physics.balbi(0.8, 0.7, 1, 300, 4500, speed, slope, 10, width, 600, 300, 1.125))
    assert got == pytest.approx(expected, abs=1e-4)


def test_balbi_without_convergence_is_zero(value):
    assert value(physics.balbi(0.8, 0.7, 1, 300, 4500, 1, 0, 10, max_iterations=1)) == 0


@pytest.mark.parametrize(("speed", "air", "expected"), [(1, 300, 0.5086438204142792), (1, 330, 0.5972921793806639), (-1, 330, 0.34929049626422026)])
def test_santoni(value, speed, air, expected):
    got = value(physics.santoni(1, 0.8, 1, 300, 300, 4500, 4500, speed, 0, 10, 100, 600, air, 1.125))
    assert got == pytest.approx(expected, rel=1e-4)


def test_hamada(value):
    one, two = physics.hamada_1, physics.hamada_2
    assert value(one(20, 5, 1, 0, 1, 0)) == pytest.approx(0.04063334223171382, rel=1e-2)
    assert value(one(20, 5, 1, 0, 1, 0, 0.7)) == pytest.approx(0.038711215666327584, rel=1e-2)
    assert value(one(20, 5, -1, 0, 1, 0)) == pytest.approx(0.015458558815152377, rel=1e-2)
    assert value(two(20, 5, 1, 0, 1, 0)) == pytest.approx(0.011761758777087185, rel=1e-2)
    assert value(two(20, 5, 1, 0, 1, 0, 0.7, 0.15, 0.15)) == pytest.approx(0.008821319082815388, rel=1e-2)
    assert value(two(20, 5, -1, 0, 1, 0)) == pytest.approx(0.005445817028744205, rel=1e-2)
    assert value(one(20, 5, 0, 0, 1, 0)) > 0


def test_wind(value):
    assert value(wind.reduction_20ft(6, 2)) == pytest.approx(0.5761355663987836, rel=1e-9)
    assert value(wind.reduction_general(20, 6, 2, False)) == pytest.approx(0.5892891329244908, rel=1e-9)
    assert value(wind.reduction_general(15, 5, 1.5, True)) == pytest.approx(0.5934424454061547, rel=1e-9)
    assert value(wind.urban_canyon(10, 100, 20, 3)) == pytest.approx(0.38410989518782196, rel=1e-9)


def test_sensors(value):
    assert sensors.z_score(0.683) == pytest.approx(1.0006418287624494, rel=1e-12)
    for sensor, rows in {"CS506": ((0, 68, 0.7557879912394126), (10, 95, 2.3911560611388682), (50, 95, 4.89990996135014)), "CS505": ((0, 68, 1.2132386175158991), (10, 95, 3.567134451862902), (50, 95, 7.153868543571204))}.items():
        for moisture, level, expected in rows:
            assert value(sensors.half_width(sensor, F.lit(float(moisture)), level)) == pytest.approx(expected, rel=1e-9)
    with pytest.raises(Exception, match="outside"):
        value(sensors.half_width("CS505", F.lit(51.0), 95))
    with pytest.raises(ValueError):
        sensors.z_score(1)


def test_kpi(value):
    assert value(kpi.bounded_linear(F.lit(2.5), 0, 10)) == 25
    assert value(kpi.half_open_linear(F.lit(15.0), 0, 10)) == 0
    assert value(kpi.half_open_exponential(F.lit(10.0), 0, 10)) == pytest.approx(50)
    assert value(kpi.symmetric_linear(F.lit(-5.0), 10)) == 50
    assert value(kpi.symmetric_exponential(F.lit(-20.0), 10)) == pytest.approx(25)
    assert value(*[kpi.color(F.lit(x)) for x in (33.32, 33.33, 66.65, 66.66)]) == ("red", "yellow", "yellow", "green")
    for bad in (kpi.bounded_linear(F.lit(11.0), 0, 10), kpi.half_open_linear(F.lit(-1.0), 0, 10)):
        with pytest.raises(Exception, match="norm"):
            value(bad)
    with pytest.raises(ValueError):
        kpi.symmetric_linear(F.lit(1.0), 0)


def test_units(value):
    assert value(units.convert(F.lit(10.0), "ft", "m")) == pytest.approx(3.048)
    assert value(units.convert(F.lit(25.0), "degC", "K")) == pytest.approx(298.15)
    assert value(units.convert(F.lit(36.0), "km/h", "m/s")) == pytest.approx(10)
    assert value(units.convert(F.lit(1.0), "short ton acre-1", "kg m-2")) == pytest.approx(0.22417, rel=1e-4)
    with pytest.raises(ValueError):
        units.convert(F.lit(1.0), "m", "s")
