"""Every stage of the pipeline on nulls, empty texts and tables, repeated rows, ties and columns of clashing names."""

import pytest
from corpus_pipeline import STAGES, run
from pyspark.sql import functions as F

WORDS = [f"word{k}" for k in range(60)]
TEXT = " ".join(WORDS[:30])
ITEM = " ".join(f"item{k}" for k in range(25))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
ROWS = [
    (1, TEXT, "en", "a", 1), (2, TEXT, "en", "b", 1), (2, TEXT, "en", "b", 1), (3, " ".join(WORDS[20:]), None, "a", 2), (4, None, "en", None, None), (5, "", None, "a", 0),
    (None, TEXT, "en", "a", 1), (None, None, None, None, None), (6, f"{TEXT} {ITEM}", "de", "c", 3), (7, " \n\t", "en", "a", 3), (8, "long " * 30000, "en", "a", 9),
]
CLASHES = ["n_shingles", "component", "g", "toxicity", "contaminated", "item_id", "rate", "replica", "shuffle_key", "h", "tie", "s", "k", "slot", "shard", "node", "row"]


@pytest.fixture
def sf(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, None, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "x"), (1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name,stage", STAGES)
def test_stage_on_odd_rows(spark, sf, name, stage):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("own") for c in CLASHES})
    # A written table, as every stage gets one.
    docs.write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = stage(spark, docs, sf)
    rows = out.collect()
    if name != "sharding":
        assert out.columns == docs.columns and all(r[c] == "own" for r in rows for c in CLASHES)
        assert {(r.doc_id, r.text) for r in rows} <= {(r[0], r[1]) for r in ROWS}
    if name == "near_duplicates":
        assert sorted(r.doc_id for r in rows if r.text == TEXT and r.doc_id is not None) == [1]
        assert {r.doc_id for r in rows if not (r.text or "").strip()} >= {4, 5, 7}
    if name == "decontamination":
        assert {r.doc_id for r in rows} == {r[0] for r in ROWS} - {6} and len(rows) == len(ROWS) - 1
    if name == "toxicity":
        assert len(rows) == len(ROWS)  # no row is toxic by these labels
    if name == "sharding":
        assert len(rows) == len(ROWS) and len({(r.shard, r.slot) for r in rows}) == len(ROWS)


@pytest.mark.parametrize("name,stage", STAGES)
def test_stage_on_no_rows(spark, sf, name, stage):
    docs = spark.createDataFrame([], SCHEMA)
    assert stage(spark, docs, sf).count() == 0


def test_the_whole_on_odd_rows(spark, sf):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    rows = run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= {1, 3, 4, 5, 7, 8, None} and len({(r.shard, r.slot) for r in rows}) == len(rows)
