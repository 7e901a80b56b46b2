"""The student classifier: a head on embeddings, trained on a stratified share, measured by cross-validation, saved and loaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a label are dealt to folds inside so many parts of it, so no task numbers a whole label.
PARTS = 256


class ArrayToVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """An array column as a vector, as a stage that is saved with its pipeline."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.col(self.getInputCol()).cast("array<double>")))


def with_fold(rows: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with fold, from 0: each label is dealt evenly, to within one for each of PARTS parts, in the order of a hash of the key.

    The same key, label and seed give the same fold while the rows stay the same.
    """
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(PARTS)))
    place = F.row_number().over(Window.partitionBy(label, "_part").orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), key)) - 1
    # Parts begin at different folds, so small labels spread too.
    begin = F.pmod(F.xxhash64(F.col(label), F.col("_part")), F.lit(folds))
    return rows.withColumn("fold", ((place + begin) % folds).cast("int")).drop("_part")


def balanced(rows: DataFrame, label: str) -> Column:
    """The weight that makes every label count the same."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row for each label
    total = sum(counts.values())
    return F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, total / (len(counts) * n))])[F.col(label)]


def head(kind: str, features: str, label: str, size: int, classes: list, hidden: tuple[int, ...] = (256, 128), max_iter: int = 100) -> Pipeline:
    """The untrained pipeline: vector, indexed label, ``logistic`` (labels weigh the same) or ``mlp``, and the label's name."""
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep")
    if kind == "logistic":
        model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_weight", maxIter=max_iter, regParam=0.01, predictionCol="_p", probabilityCol="_probability", rawPredictionCol="_raw")
    elif kind == "mlp":
        model = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", layers=[size, *hidden, len(classes)], maxIter=max_iter, seed=42, predictionCol="_p", probabilityCol="_probability", rawPredictionCol="_raw")
    else:
        raise ValueError(f"unknown kind of student: {kind}")
    return Pipeline(stages=[ArrayToVector(inputCol=features, outputCol="_x"), indexer, model, IndexToString(inputCol="_p", outputCol="predicted", labels=[str(c) for c in classes])])


@dataclass
class Report:
    """What training measured; ``confusion`` and ``by_label`` are frames over the held-out predictions."""

    kind: str
    classes: list[str]
    train_size: int
    test_size: int
    test_accuracy: float
    cv_mean: float | None
    cv_std: float | None
    confusion: DataFrame
    by_label: DataFrame


def confusion(rows: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """(truth, one column for each of ``classes``): how often each truth was predicted as what; classes that do not occur have rows of 0."""
    every = rows.sparkSession.createDataFrame([(str(c),) for c in classes], "truth string")
    found = rows.groupBy(F.col(truth).cast("string").alias("truth")).pivot(predicted, [str(c) for c in classes]).agg(F.count(F.lit(1)))
    return every.join(found, "truth", "left").fillna(0, [str(c) for c in classes])


def accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(n, correct, accuracy) in one row; null predictions are wrong, an empty table has 0."""
    right = F.count_if(F.col(truth).cast("string") == F.col(predicted).cast("string"))
    return rows.agg(F.count("*").alias("n"), right.alias("correct"), F.round(right / F.greatest(F.count("*"), F.lit(1)), 4).alias("accuracy"))


def train(rows: DataFrame, key: str = "id", label: str = "label", features: str = "embedding", kind: str = "logistic", folds: int = 5, cross_validate: bool = True, **options) -> tuple[PipelineModel, Report]:
    """A student of ``rows``, and its report: one fold of ``folds`` is held out, the rest trains; cross-validation uses all rows.

    Rows without label or features are left out. There must be two labels at least.
    """
    from .classify import measures
    from .clustering import checkpointed

    ready = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    ready = with_fold(ready.select(key, F.col(label).cast("string").alias(label), features), key, label, folds)
    weight = balanced(ready, label)
    ready = checkpointed(ready.withColumn("_weight", weight))  # every fold reads it
    classes = sorted(r[0] for r in ready.select(label).distinct().collect())  # a row for each label
    size = len(ready.select(features).first()[0])
    pipeline = head(kind, features, label, size, classes, **options)
    train_rows, test_rows = ready.where("fold <> 0"), ready.where("fold = 0")
    model = pipeline.fit(train_rows)
    stored = predict(model, test_rows, features)
    result = accuracy(stored, label, "predicted").first()
    mean = std = None
    if cross_validate:
        judge = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="_p", metricName="accuracy")
        found = CrossValidator(estimator=pipeline, estimatorParamMaps=[{}], evaluator=judge, numFolds=folds, foldCol="fold", parallelism=2).fit(ready)
        mean, std = round(float(found.avgMetrics[0]), 4), round(float(found.stdMetrics[0]), 4)
    report = Report(kind, classes, train_rows.count(), result.n, result.accuracy, mean, std, confusion(stored, label, "predicted", classes), measures(stored, label, "predicted"))
    return model, report


def predict(model: PipelineModel, rows: DataFrame, features: str = "embedding") -> DataFrame:
    """``rows`` with predicted, confidence (the greatest probability) and probabilities, in the order of the classes; null features have none of the three."""
    label = model.stages[1].getInputCol()
    inner = rows if label in rows.columns else rows.withColumn(label, F.lit(None).cast("string"))
    known = model.transform(inner.where(F.col(features).isNotNull()))
    known = known.select(*rows.columns, "predicted", F.round(F.array_max(vector_to_array("_probability")), 4).alias("confidence"), vector_to_array("_probability").alias("probabilities"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("predicted", "string"), ("confidence", "double"), ("probabilities", "array<double>"))]
    return known.unionByName(rows.where(F.col(features).isNull()).select("*", *none))


def save(model: PipelineModel, path: str) -> None:
    """The whole pipeline, into a store that all executors share; an older one at ``path`` is replaced."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def class_means(rows: DataFrame, label: str, features: str) -> DataFrame:
    """(label, mean): the mean vector of each label, summed by position before it is put together."""
    cells = rows.where(F.col(label).isNotNull()).select(label, F.posexplode(F.col(features).cast("array<double>")).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"))
    return cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("mean"))


def nearest_mean(rows: DataFrame, means: DataFrame, label: str, features: str) -> DataFrame:
    """``rows`` with predicted: the label whose mean has the largest inner product, the smaller one if equal. A student without training; ``means`` has a row for each label."""
    listed = means.agg(F.collect_list(F.struct(F.col(label).alias("label"), "mean")).alias("_means"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = F.transform("_means", lambda m: F.struct((-dot(F.col(features).cast("array<double>"), m["mean"])).alias("d"), m["label"].alias("label")))
    return rows.crossJoin(F.broadcast(listed)).withColumn("predicted", F.array_min(scored)["label"]).drop("_means")
