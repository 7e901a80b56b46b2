"""Batch inference over articles: a model loaded once a worker, texts as hashed tokens, failures retried and then marked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import text as T

#: Tokens of a text that count, and buckets they are hashed to.
TOKENS, BUCKETS = 256, 512
#: A row that no try could classify.
UNKNOWN = "UNKNOWN"
RESULT = StructType([StructField("label", StringType()), StructField("confidence", DoubleType())])

#: From tokens (rows of TOKENS buckets, 0 for none) to probabilities (a column for each class).
Predict = Callable[[np.ndarray], np.ndarray]


def hashed_tokens(text: Column) -> Column:
    """The first TOKENS words of a text as buckets from 1 on, filled up with 0: a bucket is the first 32 bits of MD5 modulo BUCKETS."""
    of = F.transform(F.slice(T.tokens(text), 1, TOKENS), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % BUCKETS + 1).cast("int"))
    return T.let(of, lambda x: F.concat(x, F.array_repeat(F.lit(0), F.lit(TOKENS) - F.size(x))))


@dataclass(frozen=True)
class LinearHead:
    """Scores are sums of a weight for each class and bucket; probabilities their softmax over ``scale``. ``weights`` has BUCKETS columns."""

    classes: tuple[str, ...]
    weights: np.ndarray
    scale: float = 1000.0

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        padded = np.concatenate([np.zeros((len(self.classes), 1), self.weights.dtype), self.weights], axis=1)
        score = padded[:, tokens].sum(2).T / self.scale
        up = np.exp(score - score.max(1, keepdims=True))
        return up / up.sum(1, keepdims=True)


def tried(predict: Predict, tokens: np.ndarray, classes: tuple[str, ...], tries: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Labels and confidences of a batch: tried as a whole, then row by row, each ``tries`` times; what still fails is UNKNOWN with 0."""

    def attempt(part: np.ndarray) -> np.ndarray | None:
        for _ in range(tries):
            try:
                return np.asarray(predict(part), np.float64)
            except Exception:  # whatever a model raises
                continue
        return None

    found = attempt(tokens)
    rows = found if found is not None else [None if (one := attempt(tokens[i : i + 1])) is None else one[0] for i in range(len(tokens))]
    label = np.array([UNKNOWN if p is None else classes[int(np.argmax(p))] for p in rows], object)
    return label, np.array([0.0 if p is None else round(float(np.max(p)), 4) for p in rows])


def classified(rows: DataFrame, text: Column, load: Callable[[], Predict], classes: tuple[str, ...], batch_size: int = 500, tries: int = 3) -> DataFrame:
    """``rows`` with label and confidence, the greatest probability (the first class of equals).

    ``load`` runs once in a worker and may read a model from a store that all
    share; it runs in tasks, so it must not need the session. Texts without
    words, null ones included, are UNKNOWN with 0. Own columns of these names are replaced.
    """

    def make() -> Callable[[np.ndarray], dict[str, np.ndarray]]:
        predict = load()

        def run(tokens: np.ndarray) -> dict[str, np.ndarray]:
            label, confidence = tried(predict, tokens.astype(np.int64).reshape(-1, TOKENS), classes, tries)
            return {"label": label, "confidence": confidence}

        return run

    model = predict_batch_udf(make, return_type=RESULT, batch_size=batch_size, input_tensor_shapes=[[TOKENS]])
    ready = rows.drop("label", "confidence").withColumn("_tokens", hashed_tokens(F.coalesce(text, F.lit("")))).withColumn("_empty", F.get("_tokens", F.lit(0)) == 0)
    out = ready.withColumn("_r", model("_tokens"))
    return out.select(*[c for c in ready.columns if c not in ("_tokens", "_empty")], F.when(F.col("_empty"), UNKNOWN).otherwise(F.col("_r.label")).alias("label"), F.when(F.col("_empty"), 0.0).otherwise(F.col("_r.confidence")).alias("confidence"))


def histogram(rows: DataFrame, by: str = "source") -> DataFrame:
    """(by, label, n, share): labels of each source, and their share of it."""
    n = rows.groupBy(by, "label").agg(F.count("*").alias("n"))
    total = rows.groupBy(by).agg(F.count("*").alias("total"))
    return n.join(total, n[by].eqNullSafe(total[by])).select(n[by], "label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
