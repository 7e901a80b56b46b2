from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_decontaminate import words
from test_minhash import brute
from tidewire.llm.decontaminate import smith_waterman
from tidewire.llm.scratch import written


def test_stages_against_brute_force(spark, sf):
    """Each stage's rows follow from its own input; all but the last keep the columns of documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, sf))
        seen[name] = (before, docs.collect())
        if name != "sharding":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone - toxic) <= 0.1 * len(before) and set(after) <= set(before)

    before, after = seen["near_duplicates"]
    component = brute([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in component.items() if i == c) and set(after) <= set(before)

    before, after = seen["decontamination"]
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    code: dict[str, int] = {}
    numbers = lambda w: np.array([code.setdefault(x, len(code) + 2) for x in w], np.uint64)
    kept = {r.doc_id for r in after}
    for r in before:
        if len(w := words(r.text)) < 500:
            score, _ = smith_waterman([(numbers(x), numbers(w)) for x in items])
            assert (r.doc_id in kept) == (max(s / (2 * len(x)) for s, x in zip(score, items, strict=True)) < 0.5)

    before, after = seen["mixing"]
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before} and 0.6 * len(before) < len(after) < 1.4 * len(before)

    before, after = seen["sharding"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    sizes = Counter(r.shard for r in after)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(40)) <= 1


def test_run_and_registration(spark, sf):
    import __spark_entry__

    out = __spark_entry__.queries()["pipeline"](spark, sf)
    assert out.columns == ["doc_id", "source", "size", "text_crc32", "shard", "slot"] and out.count() > 50
    assert out.groupBy("shard", "slot").count().where(F.col("count") > 1).count() == 0
