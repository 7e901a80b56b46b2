"""Columns of the caller that are named as internal ones pass through every operator."""

from pyspark.sql import functions as F
from tidewire.llm.decontaminate import contamination
from tidewire.llm.langid import Model, identify
from tidewire.llm.mixing import poisson_mix

NAMES = ["_letters", "_item", "_score", "_first", "_last", "_n", "_source", "_rate", "_b", "n", "w", "_p", "seed"]


def test_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a", "alpha beta gamma delta epsilon zeta"), (2, None, None), (None, "b", "")], "doc_id long, source string, text string").withColumns({c: F.lit(f"own {c}") for c in NAMES})
    bench = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta"), (None, "x"), (8, None)], "item_id long, text string")
    for rows in (identify(docs, Model.of({})), contamination(docs, bench), poisson_mix(docs, size=9.0)):
        assert rows.columns[: len(docs.columns)] == docs.columns
        found = rows.collect()
        assert found and all(r[c] == f"own {c}" for r in found for c in NAMES)
    hit = {r.doc_id: (r.item_id, r.contaminated) for r in contamination(docs, bench).collect()}
    assert hit == {1: (7, True), 2: (None, False), None: (None, False)}
