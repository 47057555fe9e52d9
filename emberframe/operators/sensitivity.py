"""Sampling designs and Sobol indices.

Base points are generated in tasks: a point is the exclusive-or of direction numbers at the set bits
of its Gray-coded index, which a column expression gives for any index, so a design of any size
needs no driver-side array.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.session import portable

portable(__name__)
BITS = 31
# Joe and Kuo's primitive polynomials (degree, coefficients) and first direction numbers, dimensions 2 to 16.
JOE_KUO = (
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)),
    (5, 7, (1, 1, 7, 11, 19)), (5, 11, (1, 1, 5, 1, 1)), (5, 13, (1, 1, 1, 3, 11)), (5, 14, (1, 3, 5, 5, 31)), (6, 1, (1, 3, 3, 9, 7, 49)), (6, 13, (1, 1, 1, 15, 21, 21)), (6, 16, (1, 3, 1, 13, 27, 49)),
)


def _power_of_x(e: int, polynomial: int, degree: int) -> int:
    """x to the power e modulo a polynomial over GF(2); bit k is the coefficient of x to the power k."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = a << 1, b >> 1
            a ^= polynomial if a >> degree & 1 else 0
        return out

    out, base = 1, 2 if degree > 1 else 2 ^ polynomial
    while e:
        out, base, e = times(out, base) if e & 1 else out, times(base, base), e >> 1
    return out


@functools.cache
def primitive_polynomials(n: int) -> list[tuple[int, int]]:
    """The first n primitive polynomials over GF(2) as (degree, inner coefficients), by degree and coefficients: x has the full order modulo each."""
    out: list[tuple[int, int]] = []
    degree = 0
    while len(out) < n:
        degree += 1
        order = (1 << degree) - 1
        factors, rest, p = set(), order, 2
        while rest > 1:
            if p * p > rest:
                p = rest
            while rest % p == 0:
                factors.add(p)
                rest //= p
            p += 1
        for inner in range(1 << (degree - 1)):
            polynomial = 1 << degree | inner << 1 | 1
            if _power_of_x(order, polynomial, degree) == 1 and all(_power_of_x(order // q, polynomial, degree) != 1 for q in factors if q > 1 and order > 1):
                out.append((degree, inner))
                if len(out) == n:
                    break
    return out


def directions(dimension: int) -> list[int]:
    """Direction numbers of a dimension, counted from 0. Beyond Joe and Kuo's, the next primitive polynomials have first
    numbers that are odd, below 2 to the power of their place, and drawn from a seed: points fill every dimension evenly all the same, pairs of
    high dimensions less so than with searched numbers."""
    if dimension == 0:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    if dimension <= len(JOE_KUO):
        degree, coefficients, start = JOE_KUO[dimension - 1]
    else:
        degree, coefficients = primitive_polynomials(dimension)[-1]
        rng = np.random.default_rng(dimension)
        start = tuple(int(rng.integers(0, 1 << k)) * 2 + 1 for k in range(degree))
    v = [m << (BITS - 1 - k) for k, m in enumerate(start)]
    for k in range(degree, BITS):
        x = v[k - degree] ^ (v[k - degree] >> degree)
        for j in range(1, degree):
            if coefficients >> (degree - 1 - j) & 1:
                x ^= v[k - j]
        v.append(x)
    return v


def scrambled(dimensions: int, seed: int) -> tuple[list[list[int]], list[int]]:
    """Direction numbers of every dimension under random lower triangular bit matrices (Matousek 1998), and random digital shifts."""
    rng = np.random.default_rng(seed)
    shifts = [int(x) for x in rng.integers(0, 1 << BITS, dimensions)]
    out = []
    for dimension in range(dimensions):
        lower = rng.integers(0, 2, (BITS, BITS))
        masks = [sum(int(lower[p, q]) << (BITS - 1 - q) for q in range(p)) | 1 << (BITS - 1 - p) for p in range(BITS)]  # of output bit p, the highest first
        out.append([sum(((v & m).bit_count() & 1) << (BITS - 1 - p) for p, m in enumerate(masks)) for v in directions(dimension)])
    return out, shifts


def sobol_point(index: Column, dimension: int, numbers: list[int] | None = None, shift: int = 0) -> Column:
    """Coordinate in [0, 1) of the index-th point (from 0): unscrambled, or by the numbers and shift of ``scrambled``."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    total = F.lit(shift).cast("long")
    for k, v in enumerate(numbers or directions(dimension)):
        total = total.bitwiseXOR(F.shiftright(gray, k).bitwiseAND(F.lit(1).cast("long")) * F.lit(v))
    return total / float(1 << BITS)


def saltelli(spark: SparkSession, n: int, bounds: dict[str, tuple[float, float]], skip: int = 1, seed: int | None = None) -> DataFrame:
    """N (2 D + 2) rows: point_id, block ('A', 'B', 'AB_j', 'BA_j') and the scaled variables.

    AB_j is A with variable j from B, BA_j the other way. With a ``seed`` the sequence is scrambled (another seed,
    another design of the same kind; scrambles of other libraries are not reproduced), and ``skip`` may be 0.
    """
    names = list(bounds)
    d = len(names)
    base = spark.range(n).withColumnRenamed("id", "point_id")
    at = F.col("point_id") + skip
    numbers, shifts = scrambled(2 * d, seed) if seed is not None else ([None] * 2 * d, [0] * 2 * d)
    base = base.select("point_id", *[sobol_point(at, i, numbers[i], shifts[i]).alias(f"_{i}") for i in range(2 * d)])
    kinds = ["A", "B", *[f"AB_{v}" for v in names], *[f"BA_{v}" for v in names]]
    rows = base.withColumn("block", F.explode(F.array(*[F.lit(k) for k in kinds])))
    out = []
    for i, v in enumerate(names):
        low, high = bounds[v]
        from_b = (F.col("block") == "B") | (F.col("block") == f"AB_{v}") | (F.col("block").startswith("BA_") & (F.col("block") != f"BA_{v}"))
        out.append((F.when(from_b, F.col(f"_{d + i}")).otherwise(F.col(f"_{i}")) * (high - low) + low).alias(v))
    return rows.select("point_id", "block", *out)


def together(results: DataFrame, names: list[str], output: str, *group: str, point: str = "point_id", block: str = "block") -> DataFrame:
    """group, point, A, B, variable and ab for each point, without a shuffle: rows of a point must follow each other in one partition, as ``saltelli`` and
    row-wise steps after it leave them. A point whose blocks are not all there, or there twice, fails the query.
    """
    keys, kinds = [*group, point], ["A", "B", *[f"AB_{v}" for v in names]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def paired(t: pa.Table) -> pa.RecordBatch:
            place = pc.index_in(t.column(len(keys)), pa.array(kinds)).to_numpy(zero_copy_only=False)
            own = np.flatnonzero(~np.isnan(place.astype(float)))
            codes = np.zeros(t.num_rows, np.int64)
            for i in range(len(keys)):
                c = pc.dictionary_encode(t.column(i).combine_chunks(), null_encoding="encode")
                codes = codes * (len(c.dictionary) + 1) + c.indices.to_numpy()
            _, first, which = np.unique(codes[own], return_index=True, return_inverse=True)
            at = which * len(kinds) + place[own].astype(np.int64)
            if len(np.unique(at)) != len(at) or len(at) != len(first) * len(kinds):
                raise ValueError("blocks of a point are not together, or not once each")
            wide = np.empty(len(first) * len(kinds))
            wide[at] = pc.fill_null(t.column(len(keys) + 1), float("nan")).to_numpy()[own]
            wide = wide.reshape(-1, len(kinds))
            number = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
            n = len(names)
            rows = t.select(range(len(keys))).take(pa.array(np.repeat(own[first], n)))
            columns = [*rows.columns, number(np.repeat(wide[:, 0], n)), number(np.repeat(wide[:, 1], n)), pa.array(np.tile(np.array(names, object), len(first)), pa.string()), number(wide[:, 2:].ravel())]
            return pa.Table.from_arrays(columns, names=[*keys, "A", "B", "variable", "ab"]).combine_chunks().to_batches()[0]

        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            ids = t.column(len(keys) - 1).to_numpy()
            whole = int(np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[-1]) if len(ids) else 0
            if whole:
                yield paired(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None and held.num_rows:
            yield paired(held)

    types = dict(results.dtypes)
    rows = results.select(*keys, block, F.col(output).cast("double").alias(output))
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "A double, B double, variable string, ab double"]))


def sobol_indices(results: DataFrame, names: list[str], output: str, *group: str, point: str = "point_id", block: str = "block", resamples: int = 0, z: float = 1.959963984540054, ordered: bool = False) -> DataFrame:
    """First-order (Saltelli 2010) and total (Jansen) indices: group, variable, s1, st.

    One grouped pivot brings the blocks of a point together, or, where a point's rows follow each other (``ordered``), a map without
    a shuffle; one aggregate makes the indices. With
    ``resamples``, s1_conf and st_conf are z times the spread of the indices over that many
    resamplings of the points; weights are drawn per point (Poisson), so points are read once.
    """
    if ordered:
        long = together(results, names, output, *group, point=point, block=block)
    else:
        kinds = ["A", "B", *[f"AB_{v}" for v in names]]
        wide = results.where(F.col(block).isin(kinds)).groupBy(*group, point).pivot(block, kinds).agg(F.first(output))
        long = wide.select(*group, point, "A", "B", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"AB_{v}").alias("ab")) for v in names])).alias("x")).select(*group, point, "A", "B", "x.variable", "x.ab")

    def estimate(df: DataFrame, *keys: str, w: Column) -> DataFrame:
        n = F.sum(w)
        mean = F.sum(w * (F.col("A") + F.col("B"))) / (2 * n)
        variance = F.sum(w * (F.col("A") * F.col("A") + F.col("B") * F.col("B"))) / (2 * n) - mean * mean
        return df.groupBy(*keys).agg(
            F.try_divide(F.sum(w * F.col("B") * (F.col("ab") - F.col("A"))) / n, variance).alias("s1"),
            F.try_divide(F.sum(w * (F.col("A") - F.col("ab")) * (F.col("A") - F.col("ab"))) / (2 * n), variance).alias("st"),
        )

    keys = [*group, "variable"]
    out = estimate(long, *keys, w=F.lit(1.0))
    if not resamples:
        return out
    u = F.pmod(F.xxhash64(point, "resample"), F.lit(1 << 30)) / float(1 << 30)
    poisson, edge, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        edge += p
        p /= k
        poisson = poisson + F.when(u >= edge, 1).otherwise(0)
    drawn = long.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", poisson.cast("double"))
    spread = estimate(drawn, *keys, "resample", w=F.col("w")).groupBy(*keys).agg((F.stddev_samp("s1") * z).alias("s1_conf"), (F.stddev_samp("st") * z).alias("st_conf"))
    return out.join(spread, keys)


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """u and v of a speed and a direction in degrees."""
    return speed * F.cos(F.radians(direction)), speed * F.sin(F.radians(direction))
