"""Rate-of-spread kernels as columns, in m/s. All arguments are columns or numbers.

``let`` names intermediate values; Catalyst computes equal parts of a projection once, as long as they stand
outside conditional branches, so kernels choose between finished values with ``either``. Only the fixed point of
``balbi`` runs as an array function.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe.session import portable

portable(__name__)
ROS_CAP = 6.0
Value = Column | float | int


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def let(values: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    return body({k: v.cast("double") for k, v in values.items()})


def either(condition: Column, yes: Column, no: Column) -> Column:
    """yes or no, both computed; NULL where the condition is."""
    return F.get(F.array(no, yes), condition.cast("int"))


def clamp(x: Column, low: float, high: float | None = None) -> Column:
    out = F.greatest(x, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def rothermel(fuel_load, height, density, savr, extinction, mineral_total, mineral_effective, chaparral, wind, slope, moisture) -> Column:
    """Surface spread after Rothermel: load kg/m2, height m, density lb/ft3, savr 1/ft, wind m/s, slope degrees, moisture %.

    Damping divides the moisture fraction by ``extinction`` as given, and the net load by
    1 + the total mineral content. Chaparral takes the wind power law.
    """
    fuel_load, height, density, savr, extinction, mineral_total, mineral_effective, chaparral, wind, slope, moisture = map(
        col, (fuel_load, height, density, savr, extinction, mineral_total, mineral_effective, chaparral, wind, slope, moisture)
    )
    first = {
        "w": fuel_load * (0.3048**2 * 2.205), "d": height / 0.3048, "rho": density, "s": savr, "m": moisture * 0.01, "mx": extinction,
        "st": mineral_total, "se": mineral_effective, "ch": chaparral, "u": wind, "tan": F.tan(F.radians(slope)),
    }

    def surface(v: Column) -> Column:
        beta = v["w"] / (v["d"] * v["rho"])
        second = {"beta": beta, "r": beta / (F.pow(v["s"], F.lit(-0.8189)) * 3.348), "s15": F.pow(v["s"], F.lit(1.5)), "x": v["m"] / v["mx"]}

        def spread(p: Column) -> Column:
            x, ratio = p["x"], p["r"]
            damp_m = clamp(1 - 2.59 * x + 5.11 * x * x - 3.52 * x * x * x, 0.0, 1.0)
            damp_s = F.pow(v["se"], F.lit(-0.19)) * 0.174
            a = 1 / (F.pow(v["s"], F.lit(0.1)) * 4.774 - 7.27)
            gamma = p["s15"] / (495 + 0.0594 * p["s15"]) * F.pow(ratio, a) * F.exp(a * (1 - ratio))
            intensity = gamma * v["w"] / (1 + v["st"]) * (17.433e6 * 4.3e-4) * damp_m * damp_s
            flux = F.exp((0.792 + 0.681 * F.sqrt(v["s"])) * (p["beta"] + 0.1)) / (192 + 0.2595 * v["s"])
            still = intensity * flux / (v["w"] / v["d"] * F.exp(-138 / v["s"]) * (250 + 1116 * v["m"]))
            c = F.exp(F.pow(v["s"], F.lit(0.55)) * -0.133) * 7.47
            e = F.exp(v["s"] * -3.59e-4) * 0.715
            by_wind = F.pow(clamp(v["u"], 0.0, 30.0) * 196.85, F.pow(v["s"], F.lit(0.54)) * 0.02526) * c * F.pow(ratio, -e)
            by_slope = 5.275 * F.pow(p["beta"], F.lit(-0.3)) * F.pow(clamp(v["tan"], 0.0), F.lit(2.0))
            return still * (1 + by_wind + by_slope) * 0.00508

        brush = clamp(F.pow(clamp(v["u"], 0.0), F.lit(1.41)) * 1.2974, 0.03333)
        return F.least(either(v["ch"] == 0, let(second, spread), brush), F.lit(ROS_CAP))

    return let(first, surface)


# Physical constants of the flame-front models.
HEAT_YIELD, RESIDENCE, STEFAN_BOLTZMANN, R00 = 1.7433e7, 75591.0, 5.670373e-8, 2.5e-5


def balbi(dead_ratio, fuel_load, height, density, savr, wind, slope, moisture, ignition_length=50.0, ignition_temperature=600.0, air_temperature=300.0, air_density=1.125, max_iterations: int = 20, tolerance: float = 1e-4) -> Column:
    """Balbi 2022 front speed: a fixed point from the base radiation term; 0 if it does not settle in max_iterations.

    Load kg/m2, height m, density kg/m3, savr 1/m, wind m/s, slope degrees, moisture %, length m, temperatures K. NULL where an
    argument is. The iteration is one array function over Arrow batches: as a lambda of built-in functions it is interpreted row by
    row, as twenty projections it outgrows what the JVM compiles.
    """
    names = ("dead_ratio", "fuel_load", "height", "density", "savr", "wind", "slope", "moisture", "ignition_length", "ignition_temperature", "air_temperature", "air_density")
    given = dict(zip(names, (dead_ratio, fuel_load, height, density, savr, wind, slope, moisture, ignition_length, ignition_temperature, air_temperature, air_density), strict=True))
    columns = {k: v for k, v in given.items() if isinstance(v, Column)}
    numbers = {k: float(v) for k, v in given.items() if k not in columns}
    if not columns:
        columns = {"wind": F.lit(numbers.pop("wind"))}
    order = list(columns)

    @F.pandas_udf("double")
    def speed(*series: pd.Series) -> pd.Series:
        values = dict(zip(order, (s.to_numpy(np.float64, na_value=np.nan) for s in series), strict=True))
        return pd.Series(balbi_arrays(**values, **numbers, max_iterations=max_iterations, tolerance=tolerance))

    return speed(*(c.cast("double") for c in columns.values()))


def balbi_arrays(dead_ratio, fuel_load, height, density, savr, wind, slope, moisture, ignition_length, ignition_temperature, air_temperature, air_density, max_iterations: int, tolerance: float) -> np.ndarray:
    """Balbi speeds of arrays (or numbers); rows leave the iteration as they settle."""
    with np.errstate(all="ignore"):
        st, m = 17.0, moisture * 0.01
        total = fuel_load * (1 + m)
        beta, beta_all = total * dead_ratio / (height * density), total / (height * density)
        lai, lai_all = savr * height * beta, savr * height * beta_all
        front = np.minimum(ignition_length / 50, 1.0)
        q = 1200 * (ignition_temperature - air_temperature) + m * (2.3e6 + 4180 * (373.15 - air_temperature))
        flame = air_temperature + HEAT_YIELD * (1 - 0.3) / (1150 * (1 + st))
        leaves = np.minimum(lai, 2 * np.pi * lai / lai_all)
        rise = (1 + st) * density * flame * leaves / (RESIDENCE * air_density * air_temperature)
        angle = np.maximum(0.0, np.arctan(np.tan(np.radians(slope)) + wind / (2 * rise)))
        base = np.minimum(lai_all / (2 * np.pi), 1.0) * (lai / lai_all) ** 2 * STEFAN_BOLTZMANN * flame**4 / (beta * density * q)
        lean = np.minimum(lai / (2 * np.pi), lai / lai_all) * 0.3 * HEAT_YIELD / (4 * q) * (1 - np.sin(angle) + np.cos(angle))
        draft = 0.025 * front * HEAT_YIELD * air_density * air_temperature * savr * np.sqrt(height) / (2 * q * (1 + st) * density * flame)
        constants = (base, draft * rise * np.tan(angle), draft * wind, -beta_all / front, lean, np.cos(angle) / (savr * R00))
        constants = [c.copy() for c in np.broadcast_arrays(*constants)]
        r, last = constants[0].copy(), np.full_like(constants[0], np.inf)
        left = np.arange(len(r))
        for _ in range(max_iterations):
            at, (rb, kt, ku, decay, pull, den) = r[left], constants
            after = rb + np.maximum(0.0, kt + ku * np.exp(decay * at)) + pull * at / (1 + at * den)
            last[left], r[left] = at, after
            moving = ~(np.abs(after - at) < tolerance)
            left, constants = left[moving], [c[moving] for c in constants]
            if not len(left):
                break
        return np.where(np.abs(r - last) < tolerance, np.minimum(r, ROS_CAP), np.where(np.isnan(r), np.nan, 0.0))


def santoni(fuel_load, dead_ratio, height, density_dead, density_live, savr_dead, savr_live, wind, slope, moisture_dead, moisture_live, ignition_temperature=600.0, air_temperature=300.0, air_density=1.125) -> Column:
    """Santoni 2011 front speed: loads kg/m2, densities kg/m3, savr 1/m, moistures %, slope degrees, temperatures K."""
    fuel_load, dead_ratio, height, density_dead, density_live, savr_dead, savr_live, wind, slope, moisture_dead, moisture_live, ignition_temperature, air_temperature, air_density = map(
        col, (fuel_load, dead_ratio, height, density_dead, density_live, savr_dead, savr_live, wind, slope, moisture_dead, moisture_live, ignition_temperature, air_temperature, air_density)
    )
    md, ml, latent = moisture_dead * 0.01, moisture_live * 0.01, 2.3e6
    dead = fuel_load * dead_ratio
    first = {
        "sl": savr_live * fuel_load * (1 - dead_ratio) / density_live, "sd": savr_dead * dead / density_dead, "dead": dead, "md": md, "ml": ml, "h": height,
        "rd": density_dead, "ta": air_temperature, "ra": air_density, "heat": 1200 * (ignition_temperature - air_temperature), "u": wind, "tan": F.tan(F.radians(slope)), "s": savr_dead,
    }

    def front(v: Column) -> Column:
        xi = (v["ml"] - v["md"]) * v["sl"] * latent / (v["sd"] * HEAT_YIELD)
        second = {"xi": xi, "tn": v["ta"] + HEAT_YIELD * (1 - 0.3) * (1 - xi) / (1150 * 9.3), "nu": F.least(v["sd"] / 4, F.lit(1.0)), "am": latent / v["heat"]}

        def speed(p: Column) -> Column:
            rise = 2 * p["nu"] * 4 * 9.3 * p["tn"] * v["rd"] / (v["ra"] * v["ta"] * RESIDENCE)
            third = {
                "g": F.atan(v["tan"] + v["u"] / rise),
                "r0": v["h"] * STEFAN_BOLTZMANN * F.pow(p["tn"], F.lit(4.0)) / v["heat"] / (v["dead"] * (1 + p["am"] * v["md"])) * F.pow(v["sd"] / (v["sd"] + v["sl"]), F.lit(2.0)),
                "a": p["nu"] * 0.25 * 0.3 * HEAT_YIELD / v["heat"] * (1 - p["xi"]) / (1 + p["am"] * v["md"]), "rs": v["s"] * R00,
            }

            def tilted(c: Column) -> Column:
                lean = c["rs"] / F.cos(c["g"])
                rt = c["r0"] + c["a"] * lean * (1 + F.sin(c["g"]) - F.cos(c["g"])) - lean
                return F.least(either(c["g"] > 0, 0.5 * (rt + F.sqrt(rt * rt + 4 * lean * c["r0"])), c["r0"]), F.lit(ROS_CAP))

            return let(third, tilted)

        return let(second, speed)

    return let(first, front)


def _wind_frame(u: Column, v: Column, nx: Column, ny: Column) -> tuple[Column, Column]:
    """Wind speed, and the cosine between wind and front normal (0 when calm is left to the caller)."""
    speed = F.hypot(u, v)
    return speed, (nx * u + ny * v) / F.nullif(speed, F.lit(0.0))


def hamada_1(side, separation, wind_u, wind_v, normal_x, normal_y, resistant=0.6) -> Column:
    """Hamada urban spread from three travel times (down wind, across, up wind); no cap. Lengths m, wind m/s."""
    side, separation, wind_u, wind_v, normal_x, normal_y, resistant = map(col, (side, separation, wind_u, wind_v, normal_x, normal_y, resistant))
    speed, k = _wind_frame(wind_u, wind_v, normal_x, normal_y)

    def front(p: Column) -> Column:
        w, a, d, f = p["w"], p["a"], p["d"], p["f"]

        def rate(reach: Column, faster: Column) -> Column:
            return (a + d) * faster / ((1 - f) * (3 + 0.375 * a + 8 * d / reach) + f * (5 + 0.625 * a + 16 * d / reach))

        second = {
            "down": rate(25 + 2.5 * w, 1.5 * (1 + 0.1 * w + 0.007 * w * w)), "across": rate(5 + 0.25 * w, 1 + 0.005 * w * w), "up": rate(5 + 0.2 * w, 1 + 0.002 * w * w),
            "k": p["k"],
        }

        def ellipse(r: Column) -> Column:
            e = (r["down"] - r["across"]) / r["down"]
            ahead = r["down"] * r["down"] / (2 * r["down"] - r["across"]) * (1 - e * e) / (1 - e * r["k"])
            behind = r["across"] * r["up"] / F.sqrt(r["up"] * r["up"] * (1 - r["k"] * r["k"]) + F.pow(r["across"] * r["k"], F.lit(2.0)))
            return either(r["k"] >= 0, ahead, behind) / 60

        return let(second, ellipse)

    return let({"w": speed, "k": F.coalesce(k, F.lit(1.0)), "a": side, "d": separation, "f": resistant}, front)


def hamada_2(side, separation, wind_u, wind_v, normal_x, normal_y, resistant=0.6, bare=0.2, mortar=0.2, beta=5.0) -> Column:
    """Hamada urban spread with structure ratios; no cap."""
    side, separation, wind_u, wind_v, normal_x, normal_y, resistant, bare, mortar, beta = map(col, (side, separation, wind_u, wind_v, normal_x, normal_y, resistant, bare, mortar, beta))
    speed, k = _wind_frame(wind_u, wind_v, normal_x, normal_y)

    def front(p: Column) -> Column:
        w, d = p["w"], p["d"]
        common = p["mix"] * (p["a"] + d)
        gap = lambda scale: 3 + 0.375 * p["a"] + 8 * d / (1.15 * scale * (5 + 0.5 * w))
        second = {"down": common * (1 + 0.1 * w + 0.007 * w * w) / gap(p["b"]), "across": common * (1 + 0.002 * w * w) / gap(F.lit(1.0)), "k": p["k"]}

        def ellipse(r: Column) -> Column:
            e = (r["down"] - r["across"]) / r["down"]
            return r["down"] * r["down"] / (2 * r["down"] - r["across"]) * (1 - e * e) / (1 - e * r["k"]) / 60

        return let(second, ellipse)

    mix = (bare + mortar) * (1 - resistant) / (bare + 5 * mortar / 3)
    return let({"w": speed, "k": F.coalesce(k, F.lit(0.0)), "a": side, "d": separation, "mix": mix, "b": beta}, front)
