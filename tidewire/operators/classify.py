"""Classification of articles: rules as teacher, a logistic student on embeddings, and their measures."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .entities import KEEP_VERBS, KILL_VERBS

LABELS = ["FACTUAL", "OPINION", "SLOP"]


def rule_labels(articles: DataFrame) -> DataFrame:
    """(article_id, label, confidence): an offline teacher. Empty text is UNKNOWN with confidence 0."""
    words = T.tokens(T.full_text(F.coalesce("title", F.lit("")), "summary"))
    share = lambda verbs: F.size(F.filter("_w", lambda w: w.isin(verbs)))
    rows = articles.select(F.col("id").alias("article_id"), words.alias("_w")).withColumn("_k", share(KEEP_VERBS)).withColumn("_x", share(KILL_VERBS))
    label = F.when(F.size("_w") == 0, "UNKNOWN").when(F.size(F.array_distinct("_w")) * 3 < F.size("_w"), "SLOP").when(F.col("_x") > F.col("_k"), "OPINION").otherwise("FACTUAL")
    return rows.select("article_id", label.alias("label"), F.when(F.size("_w") == 0, 0.0).otherwise(F.round(0.5 + 0.5 * F.abs(F.col("_k") - F.col("_x")) / (F.col("_k") + F.col("_x") + 1), 4)).alias("confidence"))


def split(rows: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key, so strata keep their shares."""
    held = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(test * 10_000)
    return rows.where(~held), rows.where(held)


def train_student(rows: DataFrame, features: str = "embedding", label: str = "label") -> LogisticRegressionModel:
    """Logistic regression in which every label weighs the same; labels are small integers."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row for each label
    weight = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, sum(counts.values()) / (len(counts) * n))])
    ready = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), weight[F.col(label)].alias("weight"))
    return LogisticRegression(weightCol="weight", maxIter=50, regParam=0.01).fit(ready)


def predict(model: LogisticRegressionModel, rows: DataFrame, features: str = "embedding") -> DataFrame:
    """``rows`` with predicted and confidence, the greatest probability."""
    out = model.transform(rows.withColumn("features", array_to_vector(F.col(features).cast("array<double>"))))
    return out.withColumn("predicted", F.col("prediction").cast("int")).withColumn("confidence", F.round(F.array_max(vector_to_array("probability")), 4)).drop("features", "rawPrediction", "probability", "prediction")


def passing(rows: DataFrame, label: str, classes: list[str]) -> DataFrame:
    return rows.withColumn("passed", F.col(label).isin(classes))


def measures(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, predicted_n, correct, precision, recall, f1) by label, from one confusion table."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("is_t"), (F.col("t") == F.col("p")).alias("same"), "n"), F.struct(F.col("p").alias("label"), F.lit(False).alias("is_t"), F.lit(False).alias("same"), "n"))).alias("x")).select("x.*")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    by = rows.groupBy("label").agg(n(F.col("is_t")).alias("support"), n(~F.col("is_t")).alias("predicted_n"), n(F.col("same")).alias("correct"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return by.select("label", "support", "predicted_n", "correct", ratio(F.col("correct"), F.col("predicted_n")).alias("precision"), ratio(F.col("correct"), F.col("support")).alias("recall"), ratio(2 * F.col("correct"), F.col("support") + F.col("predicted_n")).alias("f1"))


def cost(rows: Column, tokens_in: int = 350, tokens_out: int = 50, price_in: float = 0.0, price_out: float = 0.0) -> Column:
    """Of labelling rows by a paid teacher, with prices for a million tokens."""
    return F.round(rows * (tokens_in * price_in + tokens_out * price_out) / 1e6, 6)
