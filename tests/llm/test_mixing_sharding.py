import zlib
from collections import Counter

from pyspark.sql import functions as F
from tidewire.llm.mixing import poisson_mix
from tidewire.llm.queries import op3_proportional_shards, op5_poisson_mix
from tidewire.llm.sharding import shard_table


def test_shards_match_the_mixture(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_proportional_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.text_crc32 == zlib.crc32(docs[r.doc_id].text.encode()) and r.size == len(docs[r.doc_id].text.encode()) + 16 and r.law == "rows" and r.grown_shard is None for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    whole = Counter(r.source for r in rows)
    for s in by.values():
        got = Counter(r.source for r in s)
        assert all(abs(got[k] - n * len(s) / len(rows)) <= 8 for k, n in whole.items())
    texts = Counter(d.text for d in docs.values())
    homes = {}
    for r in rows:
        homes.setdefault(docs[r.doc_id].text, set()).add(r.shard)
    print("DEVIATION", max(abs(Counter(r.source for r in s)[k] - n * len(s) / len(rows)) for s in by.values() for k, n in whole.items()), "groups", sum(n > 1 for n in texts.values()), "split", sum(len(h) > 1 for h in homes.values()), texts.most_common(1)[0][1])
    assert all(len(h) == 1 for t, h in homes.items() if texts[t] <= 250)


def test_groups_stay_together(spark):
    """Random groups, one larger than a shard, few rows without copies."""
    import random

    for seed, (shards, kinds) in enumerate([(4, 60), (7, 25), (3, 9)]):
        rng = random.Random(seed)
        texts = [f"t{k}" for k in range(kinds) for _ in range(rng.choice([1, 1, 2, 3, 9]))] + ["hot"] * 70 + [None, "", ""]
        rows = [(i, t, rng.choice("abc")) for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("h", "s", "n", "k", "base", "nth", "tie", "id", "slot")})
        got = {r.doc_id: r for r in shard_table(docs, shards).collect()}
        sizes = Counter(r.shard for r in got.values())
        assert len(got) == len(rows) and max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
        assert all(sorted(r.slot for r in got.values() if r.shard == s) == list(range(sizes[s])) for s in range(shards))
        homes = {}
        for i, t, _ in rows:
            homes.setdefault(t, set()).add(got[i].shard)
        split = [t for t, h in homes.items() if len(h) > 1 and t != "hot" and t is not None]
        assert (len(homes["hot"]) > 1) == (max(sizes.values()) < 70) and not split


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None)] * 3 + [(1, "a", "s")] * 5 + [(2, "", None), (3, "é" * 9000, "t")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, shard int")
    got = shard_table(docs, 4).collect()
    assert len(got) == 10 and sorted(Counter(r.shard for r in got).values()) == [2, 2, 3, 3]
    assert {r.size for r in got if r.text_crc32 is None} == {16} and max(r.size for r in got) == 18016
    assert shard_table(docs.where("false")).count() == 0
    assert Counter((r.shard, r.slot) for r in shard_table(docs.limit(2), 40).collect()).most_common(1)[0][1] == 1


def test_mixing_comes_to_the_weights(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "if(id < 15000, 'big', 'small') as source", "'t' as text")
    n = Counter(r.source for r in poisson_mix(docs, {"big": 1.0, "small": 1.0}).select("source").collect())
    assert abs(n["big"] - 10000) < 400 and abs(n["small"] - 10000) < 400
    n = Counter(r.doc_id for r in poisson_mix(docs.limit(100), {"big": 1.0}, size=25.0).collect())  # means over a piece
    assert abs(sum(n.values()) - 2500) < 250 and min(n.values()) > 5


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, None, None), (1, None, None), (2, "a", "")], "doc_id long, source string, text string").withColumn("replica", F.lit("clash"))
    a, b = (sorted(map(str, poisson_mix(docs, size=9.0).collect())) for _ in range(2))
    assert a == b and {r.source for r in poisson_mix(docs, size=9.0).collect()} == {None, "a"}
    assert poisson_mix(docs.where("false")).count() == 0
    assert op5_poisson_mix(spark, "/root/testdata/sf0.001").count() > 100
