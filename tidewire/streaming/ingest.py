"""Ingestion and incremental clustering as structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import clustering as C
from ..operators import store as S


def article_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Parquet files as they arrive; the number of files a batch takes is the rate limit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """One row for each url; the watermark is on arrival, since late news is still news."""
    typed = stream.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return typed.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url"])


def append_new(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows whose url the table has not seen; a batch run again writes the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = S.insert_if_absent(batch, batch.limit(0).select("url"), "url", "fetched_at")
        if S.exists(spark, path):
            history = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != number)
            new = new.join(history.select("url"), "url", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def ingest(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = deduplicated(stream).writeStream.foreachBatch(append_new(table)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 minutes")).start()


def match_stream(vectors: DataFrame, centroids: str, out: str, checkpoint: str, threshold: float) -> StreamingQuery:
    """New vectors (id, vector, block) matched to the centroid table; those without become clusters of their own.

    The centroid table grows by the new clusters' centroids, so a later batch
    finds them; a batch run again replaces its own part.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.option("basePath", centroids).parquet(centroids).where(F.col("batch") != number).drop("batch")
        matched, fresh = C.incremental(batch, known, threshold)
        matched.select("id", "centroid_id", (1 - F.col("sim")).alias("distance")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        heads = fresh.where("is_centroid and cluster_label >= 0").select("id")
        batch.join(heads, "id").select("id", "vector", "block").write.mode("overwrite").parquet(f"{centroids}/batch={number}")

    return vectors.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, hours: int, slide: int | None = None, delay: str = "2 hours") -> DataFrame:
    """Counts by source in tumbling (or sliding) event-time windows."""
    typed = stream.withColumn("published_at", F.col("published_at").cast("timestamp")).withWatermark("published_at", delay)
    w = F.window("published_at", f"{hours} hours", f"{slide} hours") if slide else F.window("published_at", f"{hours} hours")
    return typed.groupBy(w, "source").agg(F.count("*").alias("n"))


class Heartbeat(StreamingQueryListener):
    """Keeps the progress of queries, and counts failures in a row."""

    def __init__(self, warn: int = 3) -> None:
        self.rows: dict[str, int] = {}
        self.failures: dict[str, int] = {}
        self.warn = warn

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        self.rows[str(event.progress.id)] = self.rows.get(str(event.progress.id), 0) + event.progress.numInputRows
        self.failures[str(event.progress.id)] = 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures[str(event.id)] = self.failures.get(str(event.id), 0) + 1

    def failing(self) -> list[str]:
        return [k for k, n in self.failures.items() if n >= self.warn]
