"""The queries of models, backfills and batches on the smallest tables, against their SQL."""

import glob
import os

import duckdb
import pytest
from tidewire import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    """Floats to nine digits, so sums in another order are equal."""
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", [*sorted(k for k, f in catalogue.queries().items() if f.__module__.endswith(".models") and k in catalogue.oracle_sql()), "snk_19_delta", "str_10_unfenced"])
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    rows = got.collect()
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in got.columns]
    key = lambda rs: sorted(str(tuple(plain(v) for v in r)) for r in rs)
    expected = [tuple(r[i] for i in order) for r in want.fetchall()]
    assert len(rows) == len(expected)
    simple = all(t in ("string", "int", "bigint", "boolean") for _, t in got.dtypes)
    if simple:  # decimals, times and nested values have forms of their own, which the driver's comparison knows
        assert key(map(tuple, rows)) == key(expected)
