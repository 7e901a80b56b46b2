"""Hourly slots: stages in a fixed order over the articles that none of them has claimed yet.

Every stage looks back over an overlap of arrival times, so an article that came
late is still found, and claims what it takes, so none is taken twice. Results
and claims of a slot lie in folders of its own, results first: a slot that
failed anywhere and runs again replaces its own rows and ends as if it had not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import exists

#: From claimed articles (all their columns) to a stage's result.
Stage = Callable[[DataFrame], DataFrame]


def _others(spark: SparkSession, path: str, slot: str) -> DataFrame | None:
    """Rows that other slots wrote."""
    if not exists(spark, path):
        return None
    return spark.read.option("basePath", path).parquet(path).where(F.col("slot") != slot)


@dataclass
class Slots:
    """``stages`` by name, in their order, under the folder ``root``; rows need id and fetched_at.

    A stage takes unclaimed rows with fetched_at in [start - overlap, end) of its
    slot; of a stage with ``after``, only rows that the named stage has claimed too.
    """

    root: str
    stages: dict[str, Stage]
    overlap: timedelta = timedelta(hours=2)
    length: timedelta = timedelta(hours=1)
    after: dict[str, str] = field(default_factory=dict)

    def claims(self, spark: SparkSession, stage: str) -> DataFrame | None:
        path = f"{self.root}/claims/{stage}"
        return spark.read.option("basePath", path).parquet(path) if exists(spark, path) else None

    def results(self, spark: SparkSession, stage: str) -> DataFrame:
        path = f"{self.root}/results/{stage}"
        return spark.read.option("basePath", path).parquet(path)

    def run(self, articles: DataFrame, start: datetime) -> None:
        """All stages of the slot that begins at ``start`` (UTC)."""
        spark, slot = articles.sparkSession, start.strftime("%Y%m%dT%H%M%S")
        at = F.col("fetched_at").cast("timestamp")
        lo, hi = (F.to_timestamp(F.lit((t).strftime("%Y-%m-%d %H:%M:%S"))) for t in (start - self.overlap, start + self.length))
        window = articles.where((at >= lo) & (at < hi))
        for name, stage in self.stages.items():
            rows = window
            done = _others(spark, f"{self.root}/claims/{name}", f"s{slot}")
            if done is not None:
                rows = rows.join(done.select("id"), "id", "left_anti")
            if name in self.after:
                rows = rows.join(self.claims(spark, self.after[name]).select("id").distinct(), "id", "left_semi")
            claim = f"{self.root}/claims/{name}/slot=s{slot}"
            stage(rows).write.mode("overwrite").parquet(f"{self.root}/results/{name}/slot=s{slot}")
            rows.select("id").distinct().write.mode("overwrite").parquet(claim)

    def hours(self, first: datetime, last: datetime) -> list[datetime]:
        """The starts of the slots that [first, last] touches, in order."""
        begin = datetime(first.year, first.month, first.day)
        at, out = begin + (first - begin) // self.length * self.length, []
        while at <= last:
            out.append(at)
            at += self.length
        return out

    def stream(self, arrivals: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
        """Articles as they arrive (id, fetched_at, ...) kept in ``table``; each batch runs the slots its arrivals fall into.

        A batch that runs again writes its own folder again; its slots find the
        same rows unclaimed by others, so they come out the same.
        """

        def batch(rows: DataFrame, number: int) -> None:
            spark = rows.sparkSession
            rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
            first, last = spark.read.parquet(f"{table}/batch={number}").agg(F.min(F.col("fetched_at").cast("timestamp")), F.max(F.col("fetched_at").cast("timestamp"))).first()
            if first is None:
                return
            articles = spark.read.option("basePath", table).parquet(table).drop("batch")
            for start in self.hours(first, last):
                self.run(articles, start)

        return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standard_stages(gazetteer: DataFrame, minimum: int = 1) -> dict[str, Stage]:
    """Entity mapping at the hour, then classification, then the filters that precede clustering, as the scheduler orders them."""
    from ..operators import classify as K
    from ..operators import entities as E

    return {"map": lambda rows: E.map_articles(rows, gazetteer), "classify": K.rule_labels, "density": lambda rows: E.entity_density(rows, minimum).withColumn("counts", F.to_json("counts"))}
