"""Strata get their whole shares."""

import math

from tidewire.operators.sampling import stratified_sample


def test_shares_rounded_up_and_a_null_stratum(spark):
    sizes = {"a": 7, "b": 7, "c": 7, None: 5}
    rows = spark.createDataFrame([(1000 * k + i, name) for k, (name, n) in enumerate(sizes.items()) for i in range(n)], "id long, source string")
    got = {r.source: r["count"] for r in stratified_sample(rows, "source", "id", 10, cut=False).groupBy("source").count().collect()}
    assert got == {name: max(1, math.ceil(n * 10 / 26)) for name, n in sizes.items()} and sum(got.values()) == 11
    cut = stratified_sample(rows, "source", "id", 10)
    assert cut.count() == 10 and cut.columns == rows.columns
