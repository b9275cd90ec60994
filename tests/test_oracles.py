"""Every query of the library proper against its SQL oracle in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from tesserae import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(frame):
    def value(x):
        if x is None or type(x).__name__ in ("NAType", "NaTType") or x != x:
            return None
        x = x.item() if hasattr(x, "item") else x
        if isinstance(x, bool | str):
            return x
        return round(float(x), 6) + 0.0 if isinstance(x, int | float) and not math.isnan(x) else str(x)

    frame = frame[sorted(frame.columns)]
    rows = [tuple(map(value, r)) for r in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, small, con, name):
    got = registry.QUERIES[name](spark, small).toPandas()
    want = con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got) > 0


def test_each_oracle_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
