import random

import numpy as np
import pandas as pd
import pytest
from tidewire.operators import finetune as N


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = [(i, "abc"[i % 3 if i % 10 else 0], [float(k == (i % 3 if i % 10 else 0)) + rng.gauss(0, 0.3) for k in range(3)]) for i in range(600)]
    return spark.createDataFrame(out, "id long, label string, embedding array<float>").repartition(3)


def test_learns_and_stops_at_the_best_epoch(rows):
    head = N.fine_tune(rows, epochs=12, patience=2)
    losses = [h["loss"] for h in head.history]
    assert losses[head.best_epoch] == min(losses) and head.classes == ["a", "b", "c"]
    assert len(losses) == 12 or len(losses) == head.best_epoch + 3
    got = head.predict(rows).collect()
    assert sum(r.predicted == r.label for r in got) > 0.9 * len(got)
    none = head.predict(rows.limit(1).selectExpr("id", "cast(null as array<float>) as embedding")).first()
    assert none.predicted is None and none.confidence is None


def test_ends_after_patience(rows):
    """With far too long steps the loss rises, and the first epochs' best weights come back."""
    head = N.fine_tune(rows, epochs=20, patience=2, rate=60.0, batch=4)
    assert len(head.history) < 20 and len(head.history) == head.best_epoch + 3
    assert head.history[head.best_epoch]["loss"] == min(h["loss"] for h in head.history)


def test_gradient():
    """One step on one batch is the gradient of the weighted loss."""
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(8, 2)), rng.integers(0, 3, 8), rng.random(8) + 0.5
    start = rng.normal(size=(3, 3))

    def loss(v):
        p = N._softmax(x @ v[:-1] + v[-1])
        return -(w * np.log(p[np.arange(8), y])).sum() / w.sum()

    after, seen = N.descended(start, iter([pd.DataFrame({"x": list(x), "y": y, "w": w})]), 1.0, 8, 0.0)
    eps = 1e-6
    for i in range(3):
        for j in range(3):
            step = np.zeros((3, 3))
            step[i, j] = eps
            assert abs((loss(start + step) - loss(start - step)) / (2 * eps) - (start - after)[i, j]) < 1e-6
    assert abs(seen - w.sum()) < 1e-12


def test_without_torch():
    with pytest.raises(RuntimeError, match="torch"):
        N.distributed(print)
