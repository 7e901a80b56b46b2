import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tidewire.llm.multiindex import MultiIndex, build, calibrated, centroids_for, kmeans, matrix, neighbours, rerank


def exact(ids, x, q, k):
    s = (x * x[ids == q][0]).sum(1)
    s[ids == q] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]].tolist()


def test_radius_takes_the_best_cells():
    rng = np.random.default_rng(0)
    index = MultiIndex((rng.normal(size=(13, 3)), rng.normal(size=(9, 4))), rng.integers(0, 4, 13 * 9))
    for q in rng.normal(size=(30, 7)):
        a, b = (p[0] for p in index.products(q[None]))
        score = (a[:, None] + b[None, :]).ravel()
        order = np.argsort(-score)
        held = np.cumsum(index.counts[order])
        for rows in (1, 7, 60, int(held[-1])):
            want = score[order[np.searchsorted(held, rows)]]
            assert index.radius(a, b, rows) == want
        assert index.radius(a, b, int(held[-1]) + 1) == -np.inf


def test_products_follow_the_visited_rows():
    rng = np.random.default_rng(1)
    x, ids = rng.normal(size=(3000, 16)), np.arange(3000)
    index = MultiIndex((kmeans(x[:, :8], 32), kmeans(x[:, 8:], 32)), np.zeros(0, np.int64))
    cell = index.cells(x)
    index = MultiIndex(index.halves, np.bincount(cell, minlength=len(index.halves[0]) * len(index.halves[1])))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x)), pa.array(cell)], names=["vec_id", "embedding", "cell"])
    asked = ids[:64]
    for rows in (150, 600, 3000):
        a, b = index.products(x[asked])
        radius = np.array([index.radius(p, q, rows) for p, q in zip(a, b, strict=True)])
        best, done = rerank(index, asked, x[asked], radius, iter([batch]), 10)
        most = index.counts.max()
        assert rows * 64 <= done <= (rows + most) * 64
        if rows == 3000:
            got = [best.vec[best.query == j].tolist() for j in range(64)]
            assert got == [exact(ids, x, q, 10) for q in asked]


def test_whole_share_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 6)), 1)
    x[50:150] = x[7]  # a hot vector
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    got = {}
    for r in sorted(neighbours(v, v.where("vec_id % 20 = 0"), k=20, share=1.0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: exact(np.arange(400), x, q, 20) for q in range(0, 400, 20)}


def test_recall_on_vectors_of_unequal_norms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32)) * np.exp(rng.normal(size=(6000, 1)) * 0.7)
    ids = np.arange(6000)
    v = spark.createDataFrame([(int(i), r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours(v, v.where("vec_id % 60 = 0"), k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & set(exact(ids, x, q, 20))) for q in range(0, 6000, 60))
    assert hits >= 0.9 * 20 * 100
    index, _ = build(v)
    assert index.share < 0.7  # long vectors are found without visiting all rows


def test_share_follows_the_data():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 32))
    clustered = (centre[:, None] + 0.1 * rng.normal(size=(40, 100, 32))).reshape(-1, 32)
    noise = rng.normal(size=(4000, 32))
    share = []
    for x in (clustered, noise):
        index = MultiIndex((kmeans(x[:, :16], centroids_for(len(x))), kmeans(x[:, 16:], centroids_for(len(x)))), np.zeros(0, np.int64))
        share.append(calibrated(index, x, 20, 0.95))
    assert share[0] < 0.1 < share[1] < 1


def test_columns_of_other_names_do_no_harm(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], 1.0, "x"), (1, [0.5, 1.0], 2.0, "y")], "vec_id long, embedding array<double>, score double, cell string").withColumns({"radius": F.lit(1), "query_id": F.lit(2), "d": F.lit(3)})
    assert [(r.query_id, r.vec_id) for r in neighbours(v, v.where("vec_id = 0")).collect()] == [(0, 1)]
