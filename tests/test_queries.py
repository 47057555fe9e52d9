"""Every query with SQL against DuckDB on the small tables."""

import duckdb
import pytest

from emberframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()  # noqa: SIM905


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(rows):
    plain = lambda v: float(v) if hasattr(v, "as_integer_ratio") and not isinstance(v, bool) else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = _rows(df.select(columns).collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})")
    want = _rows(want.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, rel=1e-6, abs=2e-6) if isinstance(y, float) else y)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
