import numpy as np
from pyspark.sql import functions as F
from tidewire.operators import inference as I

CLASSES = ("FACTUAL", "OPINION", "SLOP")


class Flaky:
    """Fails the first time, and always for rows that hold bucket 7."""

    def __init__(self):
        self.calls = 0

    def __call__(self, tokens):
        self.calls += 1
        if self.calls == 1 or (tokens == 7).any():
            raise RuntimeError("busy")
        return np.tile([0.2, 0.5, 0.3], (len(tokens), 1))


def test_three_tries_then_unknown():
    tokens = np.zeros((4, I.TOKENS), np.int64)
    model = Flaky()
    label, confidence = I.tried(model, tokens, CLASSES)
    assert list(label) == ["OPINION"] * 4 and list(confidence) == [0.5] * 4 and model.calls == 2
    tokens[2, 5] = 7
    label, confidence = I.tried(Flaky(), tokens, CLASSES)
    assert list(label) == ["OPINION", "OPINION", "UNKNOWN", "OPINION"] and list(confidence) == [0.5, 0.5, 0.0, 0.5]


def test_linear_head_over_rows(spark):
    weights = np.random.default_rng(3).integers(-1000, 1000, (3, I.BUCKETS))
    texts = ["alpha beta gamma", "", None, "delta " * 400, "alpha beta gamma", "!!"]
    rows = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id long, text string, label string")
    got = {r.id: r for r in I.classified(rows, F.col("text"), lambda: I.LinearHead(CLASSES, weights), CLASSES, batch_size=2).collect()}
    assert set(got[0].asDict()) == {"id", "text", "label", "confidence"}
    tokens = {r.id: np.array(r.t) for r in rows.select("id", I.hashed_tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    assert all(len(t) == I.TOKENS for t in tokens.values()) and (tokens[3] > 0).all() and (tokens[0] > 0).sum() == 3
    for i in (1, 2, 5):
        assert (got[i].label, got[i].confidence) == ("UNKNOWN", 0.0)
    for i in (0, 3, 4):
        score = np.array([weights[k][tokens[i][tokens[i] > 0] - 1].sum() for k in range(3)]) / 1000
        p = np.exp(score - score.max())
        assert got[i].label == CLASSES[int(score.argmax())] and abs(got[i].confidence - round(float((p / p.sum()).max()), 4)) < 1e-9
    assert I.classified(rows.limit(0), F.col("text"), lambda: I.LinearHead(CLASSES, weights), CLASSES).count() == 0


def test_histogram(spark):
    rows = spark.createDataFrame([("a", "X"), ("a", "Y"), ("a", "X"), (None, "X")], "source string, label string")
    assert {(r.source, r.label, r.n, r.share) for r in I.histogram(rows).collect()} == {("a", "X", 2, 0.666667), ("a", "Y", 1, 0.333333), (None, "X", 1, 1.0)}
