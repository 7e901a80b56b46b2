import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewire.operators import backfill as B
from tidewire.operators import minhash as M
from tidewire.operators.clustering import checkpointed, exact_jaccard


def titles(seed, n=120):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 8, 14]))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
        out.append((i, " ".join(w)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "!! --")]


def plain(ids, near):
    """Rows in order; one without label takes all its neighbours without."""
    label = dict.fromkeys(ids, -1)
    for i in sorted(ids):
        if label[i] == -1 and near[i]:
            for j in [i, *near[i]]:
                if label[j] == -1:
                    label[j] = i
    return label


def test_clusters_against_one_pass(spark):
    for seed in range(2):
        rows = spark.createDataFrame(titles(seed), "id long, text string")
        placed = M.buckets(rows, 0.7).collect()
        by = {}
        for r in placed:
            by.setdefault(r.bucket, set()).add(r.id)
        near = {i: set() for i, _ in titles(seed)}
        for b in by.values():
            for i in b:
                near[i] |= b - {i}
        got = {r.id: r.label for r in M.clusters(rows, 0.7, checkpointed).collect()}
        assert got == plain(list(near), near) and len(set(got.values())) > 5
        assert {(r.i, r.j) for r in M.pairs(M.buckets(rows, 0.7)).collect()} == {(i, j) for i in near for j in near[i] if i < j}


def test_recall_and_bands(spark):
    for t in (0.5, 0.7, 0.75, 0.9):
        b, r = M.bands_for(t)
        s = np.array([t - 0.2, t + 0.15 if t < 0.8 else 0.99])
        low, high = 1 - (1 - s**r) ** b
        assert b * r <= 128 and low < 0.4 and high > 0.85
    rows = spark.createDataFrame(titles(7, 300), "id long, text string").where("text is not null")
    want = {(r.i, r.j) for r in exact_jaccard(rows, 0.7).collect()}
    got = {(r.i, r.j) for r in M.pairs(M.buckets(rows, 0.7)).collect()}
    assert len(want) > 100 and len(want & got) >= 0.9 * len(want)


def test_buckets_equal_their_sql(spark):
    rows = titles(3, 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = con.execute(f"WITH words AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM t), {M.buckets_sql('words', 0.7)} SELECT id, bucket FROM buckets").fetchall()
    assert sorted(want) == sorted((r.id, r.bucket) for r in M.buckets(spark.createDataFrame(rows, "id long, text string"), 0.7).collect())


def test_one_bucket_of_most_rows(spark):
    rows = spark.range(3000).select("id", F.when(F.expr("id % 3 < 2"), F.lit("one two three four five")).otherwise(F.concat_ws(" ", F.lit("x"), "id", F.expr("id + 1"), F.expr("id * 7"))).alias("text"))
    got = M.clusters(rows, 0.7, checkpointed).groupBy("label").count().collect()
    assert max((r["count"], r.label) for r in got)[1] == 0 and sum(r["count"] for r in got) == 3000


def articles(spark):
    return spark.range(1000).select(F.col("id"), F.when(F.expr("id % 10 = 0"), "SEC EDGAR (X)").when(F.expr("id % 7 = 0"), F.lit(None)).otherwise("wire").alias("source"))


def test_a_cut_run_equals_a_whole_one(spark, tmp_path):
    rows, calls = articles(spark), []
    work = lambda part: part.select("id", (F.col("id") * 2).alias("twice"))
    whole = B.backfill(rows, "id", work, str(tmp_path / "whole"), size=150)
    assert whole["processed"] == whole["results"] == 900 and 5 <= whole["ranges"] <= 8

    def broken(part):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("cut")
        return work(part)

    with pytest.raises(RuntimeError):
        B.backfill(rows, "id", broken, str(tmp_path / "cut"), size=150)
    assert B.progress(spark, str(tmp_path / "cut")).count() == 2
    one = B.backfill(rows, "id", work, str(tmp_path / "cut"), size=150, limit=1)
    rest = B.backfill(rows, "id", work, str(tmp_path / "cut"), size=150)
    assert one["ranges"] == 1 and rest["ranges"] == whole["ranges"] - 3
    key = lambda p: sorted(map(tuple, B.results(spark, str(tmp_path / p)).collect()))
    assert key("cut") == key("whole") == [(i, 2 * i) for i in range(1000) if i % 10]
    assert B.backfill(rows, "id", work, str(tmp_path / "cut"), size=150) == {"ranges": 0, "processed": 0, "results": 0}
    total = B.progress(spark, str(tmp_path / "cut")).agg(F.sum("processed")).first()[0]
    assert total == 900


def test_ranges_of_odd_tables(spark):
    assert B.ranges(articles(spark).limit(0), "id", 10) == []
    same = spark.range(100).select(F.lit(5).cast("long").alias("id"))
    assert B.ranges(same, "id", 10) == [(5, 6)]
