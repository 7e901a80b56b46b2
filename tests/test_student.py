import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidewire.operators import student as K


@pytest.fixture(scope="module")
def rows(spark):
    """Three labels around three corners, one rare."""
    rng = random.Random(2)
    out = []
    for i in range(900):
        c = 2 if i % 15 == 0 else i % 2
        out.append((i, ["FACTUAL", "OPINION", "SLOP"][c], [float(c == k) + rng.gauss(0, 0.25) for k in range(3)]))
    return spark.createDataFrame(out, "id long, label string, embedding array<float>").repartition(3).cache()


def test_folds_are_stratified(rows):
    found = K.with_fold(rows, "id", "label", 5)
    n = Counter((r.label, r.fold) for r in found.collect())
    sizes = Counter(r.label for r in found.collect())
    for label, total in sizes.items():
        share = [n[label, f] for f in range(5)]
        assert sum(share) == total and max(share) - min(share) <= 0.5 * total / 5 + 4
    again = {r.id: r.fold for r in K.with_fold(rows.repartition(7), "id", "label", 5).collect()}
    assert again == {r.id: r.fold for r in found.collect()}


@pytest.mark.parametrize("kind", ["logistic", "mlp"])
def test_train_measure_save_and_load(spark, rows, kind, tmp_path):
    options = {"hidden": (8,), "max_iter": 60} if kind == "mlp" else {}
    model, report = K.train(rows, kind=kind, **options)
    assert report.classes == ["FACTUAL", "OPINION", "SLOP"] and report.train_size + report.test_size == 900
    assert 140 <= report.test_size <= 220 and report.test_accuracy > 0.9
    assert report.cv_mean > 0.9 and 0 <= report.cv_std < 0.1
    cells = {r.truth: r for r in report.confusion.collect()}
    assert sum(cells[t][p] for t in cells for p in report.classes) == report.test_size
    right = sum(cells[c][c] for c in report.classes)
    assert round(right / report.test_size, 4) == report.test_accuracy
    by = {r.label: r for r in report.by_label.collect()}
    assert all(by[c].correct == cells[c][c] and by[c].support == sum(cells[c][p] for p in report.classes) for c in report.classes)
    K.save(model, str(tmp_path / "m"))
    K.save(model, str(tmp_path / "m"))  # replaces
    other = spark.newSession()
    fresh = other.createDataFrame(rows.select("id", "embedding").collect(), "id long, embedding array<float>")
    a = {r.id: (r.predicted, r.confidence, r.probabilities) for r in K.predict(K.load(str(tmp_path / "m")), fresh).collect()}
    b = {r.id: (r.predicted, r.confidence, r.probabilities) for r in K.predict(model, rows.select("id", "embedding")).collect()}
    assert a == b and all(abs(sum(p) - 1) < 1e-9 and c == round(max(p), 4) for _, c, p in a.values())


def test_rows_without_features_or_label(spark, rows):
    odd = rows.limit(300).unionByName(spark.createDataFrame([(-1, None, [1.0, 0.0, 0.0]), (-2, "SLOP", None)], "id long, label string, embedding array<float>"))
    model, report = K.train(odd, cross_validate=False)
    assert report.train_size + report.test_size == 300 and report.cv_mean is None
    got = {r.id: r.predicted for r in K.predict(model, odd).where("id < 0").collect()}
    assert got == {-1: "FACTUAL", -2: None}
    with pytest.raises(ValueError):
        K.head("forest", "embedding", "label", 3, ["a"])


def test_confusion_of_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None)], "t string, p string")
    cells = {r.truth: (r.a, r.b, r.c) for r in K.confusion(df, "t", "p", ["a", "b", "c"]).collect()}
    assert cells == {"a": (1, 1, 0), "b": (0, 0, 0), "c": (0, 0, 0)}
    assert tuple(K.accuracy(df, "t", "p").first()) == (3, 1, 0.3333) and tuple(K.accuracy(df.limit(0), "t", "p").first()) == (0, 0, 0.0)


def test_nearest_mean(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.8, 0.2]), (3, 1, [0.0, 1.0]), (4, None, [0.1, 0.9]), (5, None, [0.5, 0.5])], "id long, label int, embedding array<float>")
    got = {r.id: r.predicted for r in K.nearest_mean(df, K.class_means(df, "label", "embedding"), "label", "embedding").collect()}
    assert got[1] == got[2] == 0 and got[3] == got[4] == 1
