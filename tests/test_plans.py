"""Each query against its SQL, on the smallest tables."""

import math

import pytest

from tessera.plans import claim_queries, code_queries, mixed, queries, store_queries  # noqa: F401


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x)


def rows(df, cols):
    return sorted(tuple(map(norm, r)) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    df = got.toPandas()
    assert list(df.columns)
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name]).df()
        assert sorted(want.columns) == sorted(df.columns)
        assert rows(df, sorted(df.columns)) == rows(want, sorted(df.columns))
