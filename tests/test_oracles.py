"""Every registered query of the library beside its SQL oracle on the smallest tables."""

from pathlib import Path

import pytest

import oracle_check
from fieldlight.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in oracle_check.TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(oracle_check.plain(r[c]) for c in columns) for r in df.collect()]
    rel = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = [tuple(oracle_check.plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
