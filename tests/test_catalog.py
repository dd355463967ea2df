"""Every query of the catalog that has SQL equals it."""

import math
import os

import duckdb
import notelake.catalog_serving  # noqa: F401
import pytest
from notelake import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_value(r[c]) for c in cols) for r in df.collect())
    r = duck.sql(catalog.ORACLE[name])
    names = r.columns
    assert sorted(names) == cols
    want = sorted(tuple(_value(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want and (got or name in ("label_counts",))
