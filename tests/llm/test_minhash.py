import re

import pytest
from pyspark.sql import functions as F
from tidewire.llm.minhash import near_duplicates, one_of_each
from tidewire.llm.queries import op8_minmax_near_duplicates


def brute(rows, n, percent):
    """rows: (doc_id, text). -> {doc_id: (n_shingles, component_id)}"""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 2, 80)
    got = op8_minmax_near_duplicates(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_nulls_and_repeats(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join(base[k : k + 40]) for k in range(0, 12, 3)]
    rows = [(i, t) for i, t in enumerate(chain)] + [(20, None), (21, ""), (22, " \n\t"), (23, "One"), (24, "one"), (25, "x " * 30000)]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, kept string, p int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 2, 80).collect()}
    assert got == brute(rows, 2, 80)
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "one", "en", 1)], docs.schema))
    kept = one_of_each(twice, 2, 80).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == sorted((r.doc_id is None, r.doc_id) for r in kept if r.doc_id is None or got[r.doc_id][1] == r.doc_id)
    assert len(kept) == 1 + sum(c == i for i, (_, c) in got.items())


@pytest.mark.parametrize("column", ["doc_id", "text"])
def test_empty_and_all_null(spark, column):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert near_duplicates(docs.where("false")).count() == 0
    null = docs.withColumn(column, F.lit(None).cast(docs.schema[column].dataType))
    assert [r.kept for r in near_duplicates(null).collect()] == [True]


def rows_brute(rows, n, percent):
    """Components of rows (doc_id, text) that are linked by their texts or their ids, and the class of each row by texts alone."""
    texts = brute(list(enumerate(t for _, t in rows)), n, percent)
    cls = [texts[k][1] for k in range(len(rows))]
    group = list(cls)
    for _ in rows:
        for a, (i, _) in enumerate(rows):
            for b, (j, _) in enumerate(rows):
                if i is not None and j is not None and (i == j or cls[a] == cls[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return [(i, i if i is None else min(j for b, (j, _) in enumerate(rows) if j is not None and group[b] == group[a])) for a, (i, _) in enumerate(rows)], cls


def test_ids_with_different_texts(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(50)) for c in "xyz")
    rows = [(3, x), (5, x), (5, y), (7, y + " tail"), (8, z), (8, ""), (9, z), (9, None), (2, "only"), (None, x)]
    docs = spark.createDataFrame([(*r, {"k": k}, "w") for k, r in enumerate(rows)], "doc_id long, text string, m map<string,int>, `_p` string").withColumns({c: F.lit(1) for c in ("_word", "_bits", "_stays", "g", "node", "_row", "p", "bands", "row", "many")})
    want, _ = rows_brute(rows, 2, 80)
    got = near_duplicates(docs, 2, 80).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.component_id == 3 for r in got if r.doc_id in (5, 7))
    kept = one_of_each(docs, 2, 80)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.m["k"]) for r in kept.collect()), key=str) == sorted([(3, x, 0), (5, y, 2), (8, z, 4), (8, "", 5), (9, None, 7), (2, "only", 8), (None, x, 9)], key=str)


def test_random_repeats_of_ids(spark):
    import random

    rng = random.Random(1)
    pool = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 2, 40]))) for _ in range(12)]
    rows = [(rng.randrange(25), rng.choice(pool) + rng.choice(["", " w1"])) for _ in range(45)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    want, cls = rows_brute(rows, 2, 80)
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs, 2, 80).collect()) == sorted(want)
    kept = one_of_each(docs, 2, 80).collect()
    groups = {}
    for (i, t), c in zip(rows, cls):
        groups.setdefault(c, []).append((i, t))
    assert len(kept) == len(groups)
    assert sorted(r.doc_id for r in kept) == sorted(min(i for i, _ in g) for g in groups.values())
    assert all(any((r.doc_id, r.text) in g for g in groups.values()) for r in kept)
