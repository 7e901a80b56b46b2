"""All stages: clusters, verbs and entities annotate articles; nothing is deleted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import entities as E


@dataclass
class Refined:
    """Annotation tables, what became of each article (id, passes_all_filters and why not), and one row of statistics."""

    clusters: DataFrame
    verbs: DataFrame
    entities: DataFrame
    stats: DataFrame
    status: DataFrame


def unprocessed(articles: DataFrame, done: DataFrame, batch_size: int | None = 5000, hours: int | None = 36, exclude: str | None = "SEC EDGAR%") -> DataFrame:
    """The next batch: articles not in ``done`` (id), published in the last ``hours`` before the newest, whose source is not like ``exclude``; the newest ``batch_size``, then by id.

    Rows without a time are in no window; null sources are excluded, as by SQL's NOT LIKE.
    """
    rows = articles
    if hours is not None:
        newest = F.lit(articles.agg(F.max("published_at")).first()[0])
        rows = rows.where(F.col("published_at") >= newest - F.expr(f"INTERVAL {hours} HOURS"))
    if exclude is not None:
        rows = rows.where(~F.col("source").like(exclude))
    rows = rows.join(done.select("id").distinct(), "id", "left_anti")
    return rows.orderBy(F.desc("published_at"), F.desc("id")).limit(batch_size) if batch_size is not None else rows


def process_batch(articles: DataFrame, vectors: DataFrame, done: DataFrame, batch_size: int | None = 5000, hours: int | None = 36, exclude: str | None = "SEC EDGAR%", threshold: float = 0.78, minimum: int = 1) -> Refined:
    """``process`` of the next batch of ``unprocessed`` articles; an empty batch gives empty tables and a row of zeros."""
    taken = C.checkpointed(unprocessed(articles, done, batch_size, hours, exclude))
    return process(taken, vectors, None, threshold, minimum)


def process(articles: DataFrame, vectors: DataFrame, hours: int | None = 36, threshold: float = 0.78, minimum: int = 1) -> Refined:
    """All stages over ``articles`` (id, title, summary, published_at) with ``vectors`` (id, vector).

    Rows without time or vector form no window and count as unprocessed. An
    article passes all filters if it is its cluster's centroid, its verb passes
    and it names enough entities.
    """
    timed = articles.select("id", "published_at").join(vectors, "id").where("published_at is not null")
    if hours:
        start = F.lit(timed.agg(F.min("published_at")).first()[0])
        timed = timed.withColumn("block", C.tumbling(F.col("published_at"), start, hours))
    else:
        timed = timed.withColumn("block", F.lit(0).cast("long"))
    clusters = C.cluster_vectors(timed, threshold)
    verbs, entities = E.verb_filter(articles), E.entity_density(articles, minimum)
    status = articles.select("id").join(clusters.select("id", "cluster_label", "is_centroid"), "id", "left").join(verbs.select("id", F.col("passed").alias("verb")), "id").join(entities.select("id", F.col("passed").alias("dense")), "id")
    every = F.col("is_centroid") & F.col("verb") & F.col("dense")
    stats = status.agg(
        F.count("*").alias("total_articles"), F.count_if(every).alias("passed_all"), F.round(100.0 * F.count_if(every) / F.greatest(F.count("*"), F.lit(1)), 2).alias("pass_rate_percent"),
        F.count_if(~every).alias("failed_any"), F.count_if(~F.col("is_centroid")).alias("duplicates"), F.count_if(~F.col("verb")).alias("weak_verbs"), F.count_if(~F.col("dense")).alias("low_density"), F.count_if(F.col("is_centroid").isNull()).alias("not_processed"),
    )
    failed = F.when(~F.coalesce("is_centroid", F.lit(False)), "duplicate").when(~F.col("verb"), "weak_verb").when(~F.col("dense"), "low_density")
    return Refined(clusters, verbs, entities, stats, status.select("id", F.coalesce(every, F.lit(False)).alias("passes_all_filters"), F.when(F.col("is_centroid").isNull(), "not_processed").otherwise(failed).alias("failed_at")))
