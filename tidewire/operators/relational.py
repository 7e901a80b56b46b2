"""Relational building blocks of the query service."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def similarity(distance: str | Column) -> Column:
    """1 - distance; an unknown distance counts as similarity 1."""
    return F.coalesce(F.lit(1.0) - (F.col(distance) if isinstance(distance, str) else distance), F.lit(1.0))


def bucketed(column: str, rules: list[tuple[str, str]]) -> Column:
    """The name of the first LIKE pattern that fits, else the value."""
    chain = None
    for pattern, name in rules:
        chain = F.when(F.col(column).like(pattern), name) if chain is None else chain.when(F.col(column).like(pattern), name)
    return F.col(column) if chain is None else chain.otherwise(F.col(column))


def size_bucket(column: str) -> Column:
    c = F.col(column)
    return F.when(c >= 100, "100+").when(c >= 20, "20-99").when(c >= 5, "5-19").when(c >= 2, "2-4").otherwise("1 (noise)")


def ellipsis(column: str, width: int = 200) -> Column:
    return F.when(F.length(column) > width, F.concat(F.substring(column, 1, width), F.lit("..."))).otherwise(F.col(column))


def by_flags(rows: DataFrame, classified: bool | None = None, clustered: bool | None = None, mapped: bool | None = None, ready: bool | None = None) -> DataFrame:
    """Rows that meet every flag that is given; None asks nothing."""
    known = {"classified": (classified, F.col("classification_label").isNotNull()), "clustered": (clustered, None), "mapped": (mapped, None), "ready": (ready, F.col("ready_for_kg"))}
    if clustered is not None:
        known["clustered"] = (clustered, F.col("cluster_label").isNotNull())
    if mapped is not None:
        known["mapped"] = (mapped, F.col("entity_mapped_at").isNotNull())
    wanted = [c if flag else ~c for flag, c in known.values() if flag is not None]
    return rows.where(reduce(lambda a, b: a & b, wanted, F.lit(True)))


def search(rows: DataFrame, sources: list[str] | None = None, keyword: str | None = None, days: int | None = None) -> DataFrame:
    """Any of the sources, the keyword in title or summary (% and _ are wildcards), the last days up to the newest row."""
    newest = rows.agg(F.max("published_at")).first()[0] if days else None
    if sources:
        rows = rows.where(F.col("source").isin(sources))
    if keyword:
        rows = rows.where(F.col("title").ilike(f"%{keyword}%") | F.col("summary").ilike(f"%{keyword}%"))
    if days:
        rows = rows.where(F.col("published_at") >= F.lit(newest) - F.make_dt_interval(F.lit(days)))
    return rows


def page_meta(page: DataFrame, cursor: str, limit: int) -> DataFrame:
    return page.agg(F.count("*").alias("returned"), (F.count("*") == limit).alias("has_more"), F.max(cursor).alias("latest_timestamp"))


def health(rows: DataFrame, source: str, at: str, minutes: int) -> DataFrame:
    """How many sources were active in the last minutes, and what that says."""
    newest = rows.agg(F.max(at)).first()[0]
    live = rows.groupBy(source).agg(F.max(at).alias("_at")).where(F.col("_at") >= F.lit(newest) - F.make_dt_interval(mins=F.lit(minutes)))
    n = F.count("*")
    return live.agg(n.alias("active"), F.when(n >= 7, "healthy").when(n >= 4, "degraded").otherwise("unhealthy").alias("status"))


def distribution(rows: DataFrame, key: Column) -> DataFrame:
    """Counts by key, and their share of all in per cent."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def cluster_report(clusters: DataFrame, articles: DataFrame, headlines: int) -> DataFrame:
    """Clusters of two and more of the latest batch, with their first headlines."""
    newest = clusters.orderBy(F.desc("created_at"), F.desc("cluster_batch_id")).select("cluster_batch_id").limit(1)
    rows = clusters.where("cluster_label <> -1").join(F.broadcast(newest), "cluster_batch_id", "left_semi")
    rows = rows.join(articles.select(F.col("id").alias("article_id"), "title", "published_at"), "article_id")
    seconds = F.unix_micros(F.col("published_at").cast("timestamp"))
    order = F.struct((~F.col("is_centroid")).alias("a"), (-seconds).alias("b"), F.col("article_id").alias("c"), "title")
    grouped = rows.groupBy("cluster_label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(order)).alias("t")).where("n >= 2")
    return grouped.select("cluster_label", "n", F.array_join(F.transform(F.slice("t", 1, headlines), lambda x: x["title"]), " | ").alias("headlines"))


def range_join(days: DataFrame, rows: DataFrame, day: str, at: str, span: int) -> DataFrame:
    """Rows in [day, day + span days) for each day: rows are exploded to the days that see them, then joined by equality."""
    seen = rows.withColumn(day, F.explode(F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.date_sub(F.to_date(at), k))))
    return days.join(seen, day)


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def clamped(limit: int | None, default: int = 100, most: int = 500) -> int:
    """A page size in 1..most."""
    return min(most, max(1, default if limit is None else limit))


def pages(page: int, per_page: int, most: int = 100) -> tuple[int, int]:
    """Offset and limit of a page; pages count from 1."""
    size = min(most, max(1, per_page))
    return (max(1, page) - 1) * size, size
