"""Training by mini-batches with early stopping, as Spark jobs: tasks descend on their own rows, and their weights are averaged after each epoch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import checkpointed
from .student import with_fold

#: Weights of tasks are added up in so many groups, so the driver gets that many rows however many tasks there are.
GROUPS = 32


def _softmax(x: np.ndarray) -> np.ndarray:
    up = np.exp(x - x.max(1, keepdims=True))
    return up / up.sum(1, keepdims=True)


@dataclass
class Head:
    """A softmax layer on features: ``weights`` has a row for each feature and one for the constant."""

    classes: list[str]
    weights: np.ndarray
    history: list[dict] = field(default_factory=list)
    best_epoch: int = -1

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(x @ self.weights[:-1] + self.weights[-1])

    def predict(self, rows: DataFrame, features: str = "embedding") -> DataFrame:
        """``rows`` with predicted and confidence; rows without features have neither."""

        @F.pandas_udf("predicted string, confidence double")
        def run(x: pd.Series) -> pd.DataFrame:
            p = self.probabilities(np.array(x.tolist(), np.float64).reshape(len(x), -1))
            return pd.DataFrame({"predicted": np.array(self.classes, object)[p.argmax(1)], "confidence": p.max(1).round(4)})

        known = rows.where(F.col(features).isNotNull()).withColumn("_r", run(features)).select(*rows.columns, "_r.*")
        return known.unionByName(rows.where(F.col(features).isNull()).select("*", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("confidence")))


def _arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(part["x"].tolist(), np.float64).reshape(len(part), -1), part["y"].to_numpy(), part["w"].to_numpy()


def descended(start: np.ndarray, parts: Iterator[pd.DataFrame], rate: float, batch: int, decay: float) -> tuple[np.ndarray, float]:
    """Weights after one pass of mini-batches over a task's rows, and the rows' total weight."""
    weights, seen = start.copy(), 0.0
    for part in parts:
        x, y, w = _arrays(part)
        for lo in range(0, len(x), batch):
            a, b, c = x[lo : lo + batch], y[lo : lo + batch], w[lo : lo + batch, None]
            off = (_softmax(a @ weights[:-1] + weights[-1]) - np.eye(weights.shape[1])[b]) * c
            grad = np.vstack([a.T @ off, off.sum(0)]) / c.sum()
            grad[:-1] += decay * weights[:-1]
            weights -= rate * grad
        seen += float(w.sum())
    return weights, seen


def _epoch(train: DataFrame, weights: np.ndarray, rate: float, batch: int, decay: float) -> np.ndarray:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = descended(weights, parts, rate, batch, decay)
        if seen:
            yield pd.DataFrame({"seen": [seen], "weights": [(own * seen).ravel()]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"seen": [rows["seen"].sum()], "weights": [np.sum(rows["weights"].tolist(), axis=0)]})

    schema = "seen double, weights array<double>"
    tasks = train.mapInPandas(run, schema).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    sums = tasks.groupBy("g").applyInPandas(lambda rows: added(rows), schema).collect()
    return np.sum([r.weights for r in sums], axis=0).reshape(weights.shape) / sum(r.seen for r in sums)


def _judged(held: DataFrame, weights: np.ndarray) -> tuple[float, float]:
    """Mean loss and accuracy."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, y, _ = _arrays(part)
            p = _softmax(x @ weights[:-1] + weights[-1])
            yield pd.DataFrame({"n": [len(y)], "loss": [-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()], "right": [(p.argmax(1) == y).sum()]})

    n, loss, right = held.mapInPandas(run, "n long, loss double, right long").agg(F.sum("n"), F.sum("loss"), F.sum("right")).first()
    return (float(loss) / n, right / n) if n else (0.0, 0.0)


def fine_tune(rows: DataFrame, key: str = "id", label: str = "label", features: str = "embedding", epochs: int = 50, patience: int = 3, rate: float = 0.5, batch: int = 32, decay: float = 1e-4, folds: int = 10, seed: int = 42) -> Head:
    """The head of the epoch with the least loss on a held-out, stratified fold; training ends ``patience`` epochs after it.

    Labels weigh the same. Rows without label or features are left out. An epoch
    is a job over written rows, so a lost executor costs its tasks of that epoch;
    the driver holds only the weights.
    """
    ready = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(key, F.col(label).cast("string").alias(label), F.col(features).cast("array<double>").alias("x"))
    counts = {r[0]: r[1] for r in ready.groupBy(label).count().collect()}  # a row for each label
    classes = sorted(counts)
    total = sum(counts.values())
    of = lambda f: F.create_map(*[F.lit(v) for c in classes for v in (c, f(c))])[F.col(label)]
    ready = with_fold(ready, key, label, folds, seed).select("fold", "x", of(classes.index).alias("y"), of(lambda c: total / (len(classes) * counts[c])).alias("w"))
    ready = checkpointed(ready)
    train, held = ready.where("fold <> 0"), ready.where("fold = 0")
    size = len(ready.select("x").first().x)
    weights = np.zeros((size + 1, len(classes)))
    head, least = Head(classes, weights), np.inf
    for epoch in range(epochs):
        weights = _epoch(train, weights, rate, batch, decay)
        loss, right = _judged(held, weights)
        head.history.append({"epoch": epoch, "loss": loss, "accuracy": right})
        if loss < least:
            least, head.weights, head.best_epoch = loss, weights, epoch
        elif epoch - head.best_epoch >= patience:
            break
    return head


def distributed(train: Callable, *args, processes: int = 2, gpu: bool = False):
    """``train(*args)`` in ``processes`` that see one another, for a transformer where torch is installed; an error says so where it is not."""
    try:
        import torch  # noqa: F401
        from pyspark.ml.torch.distributor import TorchDistributor
    except ImportError as e:
        raise RuntimeError("fine-tuning a transformer needs torch; fine_tune trains a head without it") from e
    return TorchDistributor(num_processes=processes, local_mode=False, use_gpu=gpu).run(train, *args)
