"""Views of the star-schema and document tables as the news model: companies, articles, mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("ticker"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"))


def articles(spark: SparkSession, sf_dir: str, centroids: bool = True) -> DataFrame:
    """Orders as articles; every 13th customer's are unclassified, every 5th order lacks a summary. Without ``centroids`` the table is read once."""
    classified = F.expr("o_custkey % 13 <> 0")
    label = F.when(classified, F.when(F.col("o_orderstatus") == "F", "FACTUAL").when(F.col("o_orderstatus") == "O", "OPINION").otherwise("SLOP"))
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("https://news.example/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.lower("o_orderpriority")).alias("title"),
        F.when(F.expr("o_orderkey % 5 <> 0"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("summary"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderdate").alias("published_at"),
        F.col("o_orderdate").alias("fetched_at"),
        label.alias("classification_label"),
        F.when(classified, F.expr("(o_orderkey % 100) / 100.0D")).alias("classification_confidence"),
        F.when(classified, F.col("o_orderdate")).alias("classified_at"),
        F.coalesce(label == "FACTUAL", F.lit(False)).alias("ready_for_kg"),
        F.date_format("o_orderdate", "yyyy-MM").alias("cluster_batch_id"),
        F.expr("cast(o_custkey % 8 - 1 as int)").alias("cluster_label"),
        F.when(F.expr("o_custkey % 11 <> 0"), F.expr("(o_custkey % 50) / 100.0D")).alias("distance_to_centroid"),
    )
    if not centroids:
        return base
    first = base.groupBy("cluster_batch_id", "cluster_label").agg(F.min("id").alias("_first"))
    return base.join(first, ["cluster_batch_id", "cluster_label"]).withColumn("is_cluster_centroid", F.col("id") == F.col("_first")).drop("_first")


def mentions(spark: SparkSession, sf_dir: str, articles: DataFrame | None = None, companies: DataFrame | None = None) -> DataFrame:
    """Line items as mentions, one for each article and company; only those of ``articles`` (id) or ``companies`` (id), left out before they are grouped."""
    lines = table(spark, sf_dir, "lineitem")
    for rows, key in ((articles, "l_orderkey"), (companies, "l_suppkey")):
        if rows is not None:
            lines = lines.join(rows.select(F.col("id").alias(key)), key, "left_semi")
    grouped = lines.groupBy(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("company_id"))
    rows = grouped.agg((1 - F.min("l_discount")).alias("confidence"), F.min("l_shipdate").alias("created_at"), F.min("l_linenumber").alias("_n"))
    kinds = F.expr("element_at(array('title', 'summary', 'both'), cast(_n % 3 + 1 as int))")
    method = F.expr("element_at(array('ticker', 'name', 'alias', 'brand'), cast(_n % 4 + 1 as int))")
    ticker = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("ticker"))
    return rows.withColumn("mention_type", kinds).withColumn("match_method", method).drop("_n").join(ticker, "company_id")


def clusters(spark: SparkSession, sf_dir: str, centroids: bool = True) -> DataFrame:
    """The audit table of cluster assignments."""
    if not centroids:
        return articles(spark, sf_dir, False).select("cluster_batch_id", F.col("id").alias("article_id"), "cluster_label", "distance_to_centroid", F.col("fetched_at").alias("created_at"))
    return articles(spark, sf_dir).select("cluster_batch_id", F.col("id").alias("article_id"), "cluster_label", F.col("is_cluster_centroid").alias("is_centroid"), "distance_to_centroid", F.col("fetched_at").alias("created_at"))


def text_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first line is the title, events give the times, labels the classification."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    rows = table(spark, sf_dir, "documents").join(events, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.when(F.col("toxic") == 1, "SLOP").when(F.col("quality") == 1, "FACTUAL").when(F.col("quality") == 0, "OPINION")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("summary"),
        "source",
        F.col("ts").alias("published_at"),
        F.expr("ts + make_dt_interval(0, 0, cast(doc_id % 180 as int), 0)").alias("fetched_at"),
        label.alias("classification_label"),
        F.expr("(doc_id % 100) / 100.0D").alias("classification_confidence"),
        F.coalesce(label == "FACTUAL", F.lit(False)).alias("ready_for_kg"),
    )


#: The same views as common table expressions for DuckDB.
STAR_SQL = """
companies AS (
  SELECT s_suppkey AS id, s_name AS ticker, s_name AS name, r_name AS sector, n_name AS industry, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
base_articles AS (
  SELECT o_orderkey AS id, 'https://news.example/' || o_orderkey AS url, 'Order ' || o_orderkey || ' ' || lower(o_orderpriority) AS title,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'Customer ' || o_custkey END AS summary, o_orderpriority AS source,
    o_orderdate AS published_at, o_orderdate AS fetched_at,
    CASE WHEN o_custkey % 13 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'FACTUAL' WHEN 'O' THEN 'OPINION' ELSE 'SLOP' END END AS classification_label,
    CASE WHEN o_custkey % 13 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS classification_confidence,
    CASE WHEN o_custkey % 13 <> 0 THEN o_orderdate END AS classified_at,
    strftime(o_orderdate, '%Y-%m') AS cluster_batch_id, CAST(o_custkey % 8 - 1 AS INT) AS cluster_label,
    CASE WHEN o_custkey % 11 <> 0 THEN (o_custkey % 50) / 100.0::DOUBLE END AS distance_to_centroid
  FROM orders),
articles AS (
  SELECT *, coalesce(classification_label = 'FACTUAL', false) AS ready_for_kg,
    id = min(id) OVER (PARTITION BY cluster_batch_id, cluster_label) AS is_cluster_centroid
  FROM base_articles),
mentions AS (
  SELECT m.*, s_name AS ticker FROM (
    SELECT l_orderkey AS article_id, l_suppkey AS company_id, 1 - min(l_discount) AS confidence, min(l_shipdate) AS created_at,
      ['title', 'summary', 'both'][min(l_linenumber) % 3 + 1] AS mention_type, ['ticker', 'name', 'alias', 'brand'][min(l_linenumber) % 4 + 1] AS match_method
    FROM lineitem GROUP BY l_orderkey, l_suppkey) m JOIN supplier ON s_suppkey = company_id),
clusters AS (
  SELECT cluster_batch_id, id AS article_id, cluster_label, is_cluster_centroid AS is_centroid, distance_to_centroid, fetched_at AS created_at FROM articles)
"""

TEXT_SQL = """
text_articles AS (
  SELECT doc_id AS id, 'https://news.example/' || doc_id AS url, split_part(text, chr(10), 1) AS title,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS summary, source, ts AS published_at,
    ts + to_minutes(doc_id % 180) AS fetched_at,
    CASE WHEN toxic = 1 THEN 'SLOP' WHEN quality = 1 THEN 'FACTUAL' WHEN quality = 0 THEN 'OPINION' END AS classification_label,
    (doc_id % 100) / 100.0::DOUBLE AS classification_confidence,
    coalesce(CASE WHEN toxic = 1 THEN 'SLOP' WHEN quality = 1 THEN 'FACTUAL' ELSE 'OPINION' END = 'FACTUAL' AND quality IS NOT NULL, false) AS ready_for_kg
  FROM documents JOIN (SELECT event_id AS doc_id, ts FROM events) USING (doc_id) LEFT JOIN labels USING (doc_id))
"""
