"""Feeds taken in: what was new, known or faulty is counted by feed while it is written, and faulty records are put aside.

``rows`` are those of a connector with ``faults``. A bad record never stops its
feed. The table has a folder for articles and one for quarantine in each batch's
folder, so a batch that runs again replaces its own rows and nothing else.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Rows of feeds that are not listed are counted under this name.
OTHER = "(other)"


def _by_feed(feeds: list[str], rows: dict[str, Column]) -> list[Column]:
    """A count for each feed and kind of row, to be observed in passing; ``feeds`` are as many as are configured."""
    listed = F.coalesce(F.col("feed").isin(feeds), F.lit(False))
    of = {**{f: F.col("feed").eqNullSafe(f) for f in feeds}, OTHER: ~listed}
    return [F.count_if(here & is_kind).alias(f"{kind}:{feed}") for feed, here in of.items() for kind, is_kind in rows.items()]


def _keyed(rows: DataFrame) -> DataFrame:
    """Good rows by url, faulty ones by their record; kind is the folder."""
    good = F.col("fault").isNull()
    key = F.when(good, F.concat(F.lit("u"), "url")).otherwise(F.concat(F.lit("r"), F.sha2(F.coalesce("record", F.lit("")), 256)))
    return rows.withColumn("key", key).withColumn("kind", F.when(good, "article").otherwise("quarantine"))


def _read(rows: DataFrame, feeds: list[str]) -> list[Column]:
    return _by_feed(feeds, {"good": F.col("fault").isNull(), "err": F.col("fault").isNotNull()})


def _kept(feeds: list[str]) -> list[Column]:
    return _by_feed(feeds, {"new": F.col("kind") == "article"})


def tallied(observed: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """(new, dup, err) by feed from what was observed: a good row that did not become new was known."""
    by: dict[str, dict[str, int]] = defaultdict(dict)
    for name, n in observed.items():
        kind, feed = name.split(":", 1)
        by[feed][kind] = n or 0
    out = {f: (x.get("new", 0), x.get("good", 0) - x.get("new", 0), x.get("err", 0)) for f, x in by.items()}
    return {f: n for f, n in out.items() if f != OTHER or any(n)}


def take_in(rows: DataFrame, seen: DataFrame | None, path: str, feeds: list[str], batch: int = 0) -> dict[str, tuple[int, int, int]]:
    """Write the new articles and the faulty records of ``rows``, and return (new, dup, err) by feed, all in one pass.

    Of rows with the same url the first is new (by published_at, feed, title), unless
    ``seen`` (url) has it; the others are dup. A record that came broken more
    than once is put aside once, and counts each time. A url or record that most
    rows share is combined before it is shuffled.
    """
    read, kept = Observation(), Observation()
    rows = _keyed(rows.observe(read, *_read(rows, feeds)))
    own = [c for c in rows.columns if c not in ("key", "kind")]
    order = F.struct(F.col("published_at").isNull(), "published_at", "feed", "title", "summary", "raw_json")
    first = rows.groupBy("key", "kind").agg(F.min_by(F.struct(*own), order).alias("r")).select("key", "kind", "r.*")
    if seen is not None:
        first = first.join(seen.select(F.concat(F.lit("u"), "url").alias("key")), "key", "left_anti")
    first.observe(kept, *_kept(feeds)).drop("key").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch}")
    return tallied({**read.get, **kept.get})


def _table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).where(F.col("kind") == kind)


def articles_of(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "article").drop("kind", "fault", "record")


def quarantine_of(spark: SparkSession, path: str) -> DataFrame:
    """(feed, fault, record, batch) of what was put aside."""
    return _table(spark, path, "quarantine").select("feed", "fault", "record", "batch")


class Tally(StreamingQueryListener):
    """(new, dup, err) by feed of streams of ``take_in_stream``, from their observed metrics; a batch that ran again counts once."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics
        found = {k: v for name in ("intake_read", "intake_new") if name in seen for k, v in seen[name].asDict().items()}
        if found:
            self.batches[str(event.progress.id), event.progress.batchId] = found

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self) -> dict[str, tuple[int, int, int]]:
        sums: dict[str, int] = defaultdict(int)
        for found in self.batches.values():
            for k, n in found.items():
                sums[k] += n or 0
        return tallied(sums)


def take_in_stream(rows: DataFrame, path: str, checkpoint: str, feeds: list[str], available_now: bool = True) -> StreamingQuery:
    """``take_in`` as a stream over ``rows``: which urls are known is the query's state, so no batch reads the table again.

    Add a ``Tally`` to the session for the counts. State is by url for ever, as a
    url is unique for ever; set the RocksDB state store where it outgrows memory.
    """
    marked = _keyed(rows.observe("intake_read", *_read(rows, feeds))).dropDuplicates(["key"]).observe("intake_new", *_kept(feeds))

    def write(batch: DataFrame, number: int) -> None:
        batch.drop("key").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")

    writer = marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 minutes")).start()


def in_requests(tickers: DataFrame, size: int = 50) -> DataFrame:
    """(ticker, request): tickers dealt in alphabetical order to requests of ``size``. The list is that of the configured companies."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("ticker")) - 1
    return tickers.select("ticker").where("ticker is not null").distinct().select("ticker", F.floor(place / size).cast("int").alias("request"))


def companies_in_turn(companies: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Companies that can be asked for (ticker and cik), and {'ready', 'err'}: those without are counted, not fatal; one pass when the frame is used."""
    lacking = F.col("ticker").isNull() | F.col("cik").isNull()
    n = companies.agg(F.count_if(~lacking).alias("ready"), F.count_if(lacking).alias("err")).first()
    return companies.where(~lacking), n.asDict()
