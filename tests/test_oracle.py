"""Every core query against its SQL counterpart in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from siltworks.plans import catalogue

DATA = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def _rows(frame):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(int(v)) if not isinstance(v, str) and hasattr(v, "__int__") else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    g, w = _rows(got), _rows(want)
    assert len(g) == len(w)
    diff = [(a, b) for a, b in zip(g, w) if a != b]
    assert not diff, diff[:2]
