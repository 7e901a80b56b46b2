"""The query service: feed, details, cluster browser, statistics, work queues."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from .fixtures import articles, clusters, companies, mentions, table, text_articles
from .registry import query

Spark = SparkSession


def as_of(rows: DataFrame, column: str = "published_at") -> Column:
    """The newest time of the data as a literal: rolling windows never read the clock."""
    return F.lit(rows.agg(F.max(column)).first()[0])


def feed(a: DataFrame, mentions_of: Callable[..., DataFrame], c: DataFrame, since: str | None = None, tickers: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """A page of classified centroids and noise after a cursor, with tickers and cluster sizes.

    ``mentions_of`` gives the mentions of some articles (id) or companies (id).
    The page of ``limit`` rows comes first, in one job; only its articles'
    mentions and its clusters' rows are then read and grouped, by literal keys
    that reach the scans. ``tickers`` are the companies (id) asked for.
    """
    rows = a.where("ready_for_kg and (is_cluster_centroid or cluster_label = -1)")
    if since is not None:
        rows = rows.where(F.col("classified_at") > F.lit(since).cast(a.schema["classified_at"].dataType))
    if tickers is not None:
        rows = rows.join(mentions_of(companies=tickers).select(F.col("article_id").alias("id")), "id", "left_semi")
    spark, top = a.sparkSession, rows.orderBy(F.asc("classified_at"), F.asc("id")).limit(limit)
    held = top.collect()  # ``limit`` rows
    page = spark.createDataFrame(held, top.schema)
    own = mentions_of(articles=page.select("id")).groupBy(F.col("article_id").alias("id")).agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))
    keys = page.where("cluster_label <> -1").select("cluster_batch_id", "cluster_label").distinct()
    batches = sorted({r.cluster_batch_id for r in held})
    sizes = c.where(F.col("cluster_batch_id").isin(batches)).join(F.broadcast(keys), ["cluster_batch_id", "cluster_label"], "left_semi").groupBy("cluster_batch_id", "cluster_label").agg(F.count("*").alias("size"))
    page = page.join(own, "id", "left").join(sizes, ["cluster_batch_id", "cluster_label"], "left")
    return page.withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>"))).withColumn("cluster_size", F.coalesce("size", F.lit(1).cast("long"))).drop("size")


_FEED = """
page AS (SELECT * FROM articles WHERE ready_for_kg AND (is_cluster_centroid OR cluster_label = -1) {where} ORDER BY classified_at, id LIMIT {limit}),
tick AS (SELECT article_id, array_to_string(list_sort(list(DISTINCT ticker)), ',') AS t FROM mentions GROUP BY article_id),
sizes AS (SELECT cluster_batch_id, cluster_label, count(*) AS size FROM clusters WHERE cluster_label <> -1 GROUP BY ALL)
SELECT p.id, p.title, p.source, p.classified_at, round(p.classification_confidence, 4) AS confidence, coalesce(t, '') AS tickers, coalesce(size, 1) AS cluster_size
FROM page p LEFT JOIN tick ON article_id = p.id LEFT JOIN sizes USING (cluster_batch_id, cluster_label)
"""


def _flat_feed(f: DataFrame) -> DataFrame:
    return f.select("id", "title", "source", "classified_at", F.round("classification_confidence", 4).alias("confidence"), F.array_join("tickers", ",").alias("tickers"), "cluster_size")


@query("q01_feed", "WITH " + _FEED.format(where="AND classified_at > TIMESTAMP '1995-01-01'", limit=100))
def q01(spark: Spark, sf: str) -> DataFrame:
    return _flat_feed(feed(articles(spark, sf), partial(mentions, spark, sf), clusters(spark, sf, False), since="1995-01-01 00:00:00"))


@query("q01_feed_by_ticker", "WITH " + _FEED.format(where="AND id IN (SELECT article_id FROM mentions WHERE ticker IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#1', 'Supplier#2'))", limit=500))
def q01_ticker(spark: Spark, sf: str) -> DataFrame:
    asked = companies(spark, sf).where(F.col("ticker").isin("Supplier#000000001", "Supplier#000000002", "Supplier#1", "Supplier#2"))
    return _flat_feed(feed(articles(spark, sf), partial(mentions, spark, sf), clusters(spark, sf, False), tickers=asked, limit=500))


@query(
    "q01_feed_meta",
    """WITH page AS (SELECT id, classified_at FROM articles WHERE ready_for_kg AND (is_cluster_centroid OR cluster_label = -1) ORDER BY classified_at, id LIMIT 100)
    SELECT count(*) AS returned, count(*) = 100 AS has_more, max(classified_at) AS latest_timestamp FROM page""",
)
def q01_meta(spark: Spark, sf: str) -> DataFrame:
    rows = articles(spark, sf).where("ready_for_kg and (is_cluster_centroid or cluster_label = -1)")
    return R.page_meta(rows.orderBy("classified_at", "id").limit(100), "classified_at", 100)


@query(
    "q02_article",
    """SELECT a.id, a.title, a.classification_label AS label, m.ticker, m.match_method, round(m.confidence, 4) AS confidence, s.size AS cluster_size,
      md5(a.id || ':' || strftime(a.classified_at, '%Y-%m-%d %H:%M:%S') || ':' || a.cluster_batch_id) AS etag
    FROM articles a LEFT JOIN mentions m ON m.article_id = a.id
    LEFT JOIN (SELECT cluster_batch_id, cluster_label, count(*) AS size FROM clusters GROUP BY ALL) s USING (cluster_batch_id, cluster_label)
    WHERE a.id = 7""",
)
def q02(spark: Spark, sf: str) -> DataFrame:
    one = articles(spark, sf, False).where("id = 7")
    size = clusters(spark, sf, False).join(one.select("cluster_batch_id", "cluster_label"), ["cluster_batch_id", "cluster_label"], "left_semi").groupBy("cluster_batch_id", "cluster_label").agg(F.count("*").alias("cluster_size"))
    tag = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.date_format("classified_at", "yyyy-MM-dd HH:mm:ss"), "cluster_batch_id"))
    # With a NULL time the tag is NULL, as concatenation with || has it.
    tag = F.when(F.col("classified_at").isNotNull(), tag)
    m = mentions(spark, sf).where("article_id = 7").withColumnRenamed("article_id", "id").select("id", "ticker", "match_method", F.round("confidence", 4).alias("confidence"))
    return one.join(m, "id", "left").join(size, ["cluster_batch_id", "cluster_label"], "left").select("id", "title", F.col("classification_label").alias("label"), "ticker", "match_method", "confidence", "cluster_size", tag.alias("etag"))


@query(
    "q03_cluster",
    """WITH b AS (SELECT max(cluster_batch_id) AS b FROM clusters WHERE created_at < TIMESTAMP '1997-01-01')
    SELECT c.article_id, a.title, c.is_centroid, round(coalesce(1.0 - c.distance_to_centroid, 1.0), 6) AS similarity,
      (SELECT array_to_string(list_sort(list(DISTINCT ticker)), ',') FROM mentions m WHERE m.article_id = c.article_id) AS tickers
    FROM clusters c JOIN articles a ON a.id = c.article_id WHERE c.cluster_batch_id = (SELECT b FROM b) AND c.cluster_label = 2""",
)
def q03(spark: Spark, sf: str) -> DataFrame:
    c = clusters(spark, sf)
    newest = clusters(spark, sf, False).where("created_at < timestamp_ntz'1997-01-01'").agg(F.max("cluster_batch_id").alias("cluster_batch_id"))
    rows = c.where("cluster_label = 2").join(F.broadcast(newest), "cluster_batch_id")  # one row
    ids = rows.select(F.col("article_id").alias("id"))
    rows = rows.join(articles(spark, sf, False).select(F.col("id").alias("article_id"), "title"), "article_id")
    tick = mentions(spark, sf, articles=ids).groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"))
    return rows.join(tick, "article_id", "left").select("article_id", "title", "is_centroid", F.round(R.similarity("distance_to_centroid"), 6).alias("similarity"), "tickers")


@query(
    "q04_companies",
    "SELECT c.ticker, c.name, c.sector, c.industry, count(DISTINCT m.article_id) AS article_count FROM companies c JOIN mentions m ON m.company_id = c.id GROUP BY ALL HAVING count(DISTINCT m.article_id) > 0",
)
def q04(spark: Spark, sf: str) -> DataFrame:
    # Mentions are distinct by (article, company), so a plain count is the distinct count.
    n = mentions(spark, sf).groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("article_count"))
    return companies(spark, sf).join(n, "id").where("article_count > 0").select("ticker", "name", "sector", "industry", "article_count")


@query(
    "q05_company",
    """WITH one AS (SELECT * FROM companies ORDER BY ticker LIMIT 1), n AS (SELECT (SELECT max(published_at) FROM articles) AS now)
    SELECT one.ticker, (SELECT count(*) FROM mentions m WHERE m.company_id = one.id) AS mention_count, a.id AS article_id, a.published_at
    FROM one LEFT JOIN (SELECT m.company_id, a.id, a.published_at FROM mentions m JOIN articles a ON a.id = m.article_id, n WHERE a.published_at >= n.now - INTERVAL 365 DAY
      AND a.ready_for_kg AND (a.is_cluster_centroid OR a.cluster_label = -1) AND m.company_id = (SELECT id FROM one) ORDER BY a.published_at DESC NULLS FIRST, a.id LIMIT 10) a ON a.company_id = one.id""",
)
def q05(spark: Spark, sf: str) -> DataFrame:
    one = companies(spark, sf).orderBy("ticker").limit(1).select(F.col("id").alias("company_id"), "ticker")
    m = mentions(spark, sf, companies=one.select(F.col("company_id").alias("id")))
    own = m.drop("ticker").join(F.broadcast(one), "company_id", "right")  # one row
    total = own.groupBy("company_id", "ticker").agg(F.count("article_id").alias("mention_count"))
    now = articles(spark, sf, False).agg((F.max("published_at") - F.expr("INTERVAL 365 DAYS")).alias("after"))
    recent = articles(spark, sf).where("ready_for_kg and (is_cluster_centroid or cluster_label = -1)").join(F.broadcast(now), F.col("published_at") >= F.col("after"))
    top = own.select("company_id", F.col("article_id").alias("id")).join(recent, "id").orderBy(F.desc_nulls_first("published_at"), "id").limit(10)
    return total.join(top.select("company_id", F.col("id").alias("article_id"), "published_at"), "company_id", "left").select("ticker", "mention_count", "article_id", "published_at")


@query(
    "q06_stats",
    """SELECT count(*) AS total, count(classification_label) AS classified, count(*) FILTER (WHERE classification_label IS NULL) AS unclassified,
      count(*) FILTER (WHERE classification_label = 'FACTUAL') AS factual, count(*) FILTER (WHERE classification_label = 'OPINION') AS opinion, count(*) FILTER (WHERE classification_label = 'SLOP') AS slop,
      (SELECT count(DISTINCT (cluster_batch_id, cluster_label)) FROM clusters WHERE cluster_label <> -1) AS clusters,
      (SELECT count(*) FROM mentions) AS mentions, (SELECT count(DISTINCT company_id) FROM mentions) AS companies,
      count(*) FILTER (WHERE fetched_at >= (SELECT max(fetched_at) FROM articles) - INTERVAL 24 HOUR) AS last_24h, min(published_at) AS oldest, max(published_at) AS newest FROM articles""",
)
def q06(spark: Spark, sf: str) -> DataFrame:
    a = articles(spark, sf, False)
    label = F.col("classification_label")
    own = a.agg(
        F.count("*").alias("total"), F.count(label).alias("classified"), F.count_if(label.isNull()).alias("unclassified"), F.count_if(label == "FACTUAL").alias("factual"),
        F.count_if(label == "OPINION").alias("opinion"), F.count_if(label == "SLOP").alias("slop"),
        F.count_if(F.col("fetched_at") >= as_of(a, "fetched_at") - F.expr("INTERVAL 24 HOURS")).alias("last_24h"), F.min("published_at").alias("oldest"), F.max("published_at").alias("newest"),
    )
    groups = clusters(spark, sf, False).where("cluster_label <> -1").agg(F.count_distinct(F.struct("cluster_batch_id", "cluster_label")).alias("clusters"))
    m = mentions(spark, sf).agg(F.count("*").alias("mentions"), F.count_distinct("company_id").alias("companies"))
    return own.crossJoin(groups).crossJoin(m)  # three rows of one


@query("q07_health", "SELECT 'ok' AS status, count(*) > 0 AS connected FROM region", None)
def q07(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "region").agg(F.lit("ok").alias("status"), (F.count("*") > 0).alias("connected"))


@query(
    "q08_search",
    """WITH hits AS (SELECT * FROM articles WHERE source IN ('1-URGENT', '2-HIGH') AND (title ILIKE '%order 1%' OR summary ILIKE '%order 1%')
      AND published_at >= (SELECT max(published_at) FROM articles) - INTERVAL 700 DAY)
    SELECT id, title, source, published_at, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY published_at DESC NULLS LAST, fetched_at DESC NULLS FIRST, id LIMIT 50 OFFSET 10""",
)
def q08(spark: Spark, sf: str) -> DataFrame:
    hits = R.search(articles(spark, sf, False), sources=["1-URGENT", "2-HIGH"], keyword="order 1", days=700)
    page = hits.orderBy(F.desc_nulls_last("published_at"), F.desc_nulls_first("fetched_at"), "id").offset(10).limit(50)
    return page.select("id", "title", "source", "published_at").crossJoin(hits.agg(F.count("*").alias("total")))


@query("q09_sources", "SELECT source, count(*) AS n FROM articles GROUP BY source")
def q09(spark: Spark, sf: str) -> DataFrame:
    return articles(spark, sf, False).groupBy("source").agg(F.count("*").alias("n"))


@query("q10_totals", "SELECT count(*) AS total, count(DISTINCT source) AS sources, min(published_at) AS oldest, max(published_at) AS newest, count(*) FILTER (WHERE fetched_at >= (SELECT max(fetched_at) FROM articles) - INTERVAL 24 HOUR) AS last_24h FROM articles")
def q10(spark: Spark, sf: str) -> DataFrame:
    a = articles(spark, sf, False)
    recent = F.count_if(F.col("fetched_at") >= as_of(a, "fetched_at") - F.expr("INTERVAL 24 HOURS"))
    return a.agg(F.count("*").alias("total"), F.count_distinct("source").alias("sources"), F.min("published_at").alias("oldest"), F.max("published_at").alias("newest"), recent.alias("last_24h"))


_BROWSE = """WITH info AS (
  SELECT c.cluster_batch_id, c.cluster_label, count(*) AS n, avg(coalesce(1.0 - c.distance_to_centroid, 1.0)) AS s, max(a.published_at) AS newest
  FROM clusters c JOIN articles a ON a.id = c.article_id WHERE c.cluster_label <> -1 AND a.published_at >= (SELECT max(published_at) FROM articles) - INTERVAL 400 DAY
  GROUP BY ALL HAVING count(*) >= 2),
filtered AS (SELECT * FROM info WHERE s < 0.999 AND s >= 0.5 AND s <= 0.95)"""


def browse(spark: Spark, sf: str) -> DataFrame:
    """Clusters of the window with a mean similarity in the band."""
    a = articles(spark, sf, False).where("cluster_label <> -1")
    recent = a.where(F.col("published_at") >= as_of(articles(spark, sf, False)) - F.expr("INTERVAL 400 DAYS"))
    info = recent.groupBy("cluster_batch_id", "cluster_label").agg(F.count("*").alias("n"), F.avg(R.similarity("distance_to_centroid")).alias("s"), F.max("published_at").alias("newest"))
    return info.where("n >= 2 and s < 0.999 and s >= 0.5 and s <= 0.95")


@query("q11_clusters_page", _BROWSE + " SELECT f.cluster_batch_id, f.cluster_label, f.n, round(f.s, 6) AS avg_similarity, d.article_id, d.is_centroid FROM (SELECT * FROM filtered ORDER BY n DESC, newest DESC, cluster_batch_id, cluster_label LIMIT 5 OFFSET 5) f JOIN clusters d USING (cluster_batch_id, cluster_label)")
def q11(spark: Spark, sf: str) -> DataFrame:
    keys = browse(spark, sf).orderBy(F.desc("n"), F.desc("newest"), "cluster_batch_id", "cluster_label").offset(5).limit(5)
    return clusters(spark, sf).join(F.broadcast(keys), ["cluster_batch_id", "cluster_label"]).select("cluster_batch_id", "cluster_label", "n", F.round("s", 6).alias("avg_similarity"), "article_id", "is_centroid")


@query("q11_clusters_totals", _BROWSE + " SELECT count(*) AS clusters, coalesce(sum(n), 0) AS articles, round(coalesce(avg(s), 0), 6) AS avg_similarity, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM filtered")
def q11_totals(spark: Spark, sf: str) -> DataFrame:
    return browse(spark, sf).agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("articles"), F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 6).alias("avg_similarity"), F.ceil(F.count("*") / 20).alias("pages"))


@query(
    "q12_source_breakdown",
    """WITH b AS (SELECT CASE WHEN source LIKE '1%' THEN 'wire' WHEN source LIKE '2%' THEN 'filings' WHEN source LIKE '%(%' THEN 'other' ELSE source END AS bucket, fetched_at FROM articles)
    SELECT bucket, count(*) AS total, count(*) FILTER (WHERE fetched_at >= (SELECT max(fetched_at) FROM articles) - INTERVAL 24 HOUR) AS last_24h FROM b GROUP BY bucket""",
)
def q12(spark: Spark, sf: str) -> DataFrame:
    a = articles(spark, sf, False)
    bucket = R.bucketed("source", [("1%", "wire"), ("2%", "filings"), ("%(%", "other")])
    return a.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("total"), F.count_if(F.col("fetched_at") >= as_of(a, "fetched_at") - F.expr("INTERVAL 24 HOURS")).alias("last_24h"))


@query(
    "q13_health_rollup",
    """WITH live AS (SELECT source FROM articles GROUP BY source HAVING max(fetched_at) >= (SELECT max(fetched_at) FROM articles) - INTERVAL 60 MINUTE)
    SELECT count(*) AS active, CASE WHEN count(*) >= 7 THEN 'healthy' WHEN count(*) >= 4 THEN 'degraded' ELSE 'unhealthy' END AS status FROM live""",
)
def q13(spark: Spark, sf: str) -> DataFrame:
    return R.health(articles(spark, sf, False), "source", "fetched_at", minutes=60)


@query("q14_companies", "SELECT c.ticker, c.name, c.sector, count(m.article_id) AS mentions FROM companies c JOIN mentions m ON m.company_id = c.id GROUP BY ALL HAVING count(*) > 0")
def q14(spark: Spark, sf: str) -> DataFrame:
    n = mentions(spark, sf).groupBy(F.col("company_id").alias("id")).agg(F.count("article_id").alias("mentions"))
    return companies(spark, sf).join(n, "id").select("ticker", "name", "sector", "mentions")


@query("q15_company_stats", "SELECT m.ticker, count(*) AS n FROM mentions m JOIN articles a ON a.id = m.article_id WHERE a.published_at >= (SELECT max(published_at) FROM articles) - INTERVAL 30 DAY GROUP BY m.ticker ORDER BY n DESC, ticker LIMIT 25")
def q15(spark: Spark, sf: str) -> DataFrame:
    a = articles(spark, sf, False)
    recent = a.where(F.col("published_at") >= as_of(a) - F.expr("INTERVAL 30 DAYS")).select(F.col("id").alias("article_id"))
    return mentions(spark, sf).join(recent, "article_id", "left_semi").groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(25)


@query("q16_cli_search", "SELECT id, CASE WHEN length(title) > 12 THEN left(title, 12) || '...' ELSE title END AS title, source FROM articles WHERE source ILIKE '%urgent%' AND title ILIKE '%9%' ORDER BY published_at DESC NULLS LAST, id LIMIT 20")
def q16(spark: Spark, sf: str) -> DataFrame:
    hits = articles(spark, sf, False).where(F.col("source").ilike("%urgent%") & F.col("title").ilike("%9%"))
    return hits.orderBy(F.desc_nulls_last("published_at"), "id").limit(20).select("id", R.ellipsis("title", 12).alias("title"), "source")


@query(
    "q17_cluster_report",
    """WITH latest AS (SELECT cluster_batch_id AS b FROM clusters WHERE created_at < TIMESTAMP '1997-01-01' ORDER BY created_at DESC, cluster_batch_id DESC LIMIT 1)
    SELECT c.cluster_label, count(*) AS n, array_to_string(list_slice(list(a.title ORDER BY c.is_centroid DESC, a.published_at DESC, a.id), 1, 10), ' | ') AS headlines
    FROM clusters c JOIN articles a ON a.id = c.article_id WHERE c.cluster_batch_id = (SELECT b FROM latest) AND c.cluster_label <> -1 GROUP BY c.cluster_label HAVING count(*) >= 2""",
)
def q17(spark: Spark, sf: str) -> DataFrame:
    return R.cluster_report(clusters(spark, sf).where("created_at < timestamp_ntz'1997-01-01'"), articles(spark, sf, False), headlines=10)


@query("q17_size_histogram", "WITH s AS (SELECT cluster_batch_id, cluster_label, count(*) AS size FROM clusters WHERE cluster_label <> -1 GROUP BY ALL) SELECT size, count(*) AS clusters FROM s GROUP BY size")
def q17_sizes(spark: Spark, sf: str) -> DataFrame:
    return clusters(spark, sf, False).where("cluster_label <> -1").groupBy("cluster_batch_id", "cluster_label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


@query("q18_unclassified", "SELECT id, title FROM text_articles WHERE classification_label IS NULL AND NOT source LIKE 'src1%' AND fetched_at >= (SELECT max(fetched_at) FROM text_articles) - INTERVAL 4 DAY ORDER BY fetched_at DESC NULLS FIRST, id LIMIT 100", "text")
def q18(spark: Spark, sf: str) -> DataFrame:
    a = text_articles(spark, sf)
    rows = a.where(F.col("classification_label").isNull() & ~F.col("source").startswith("src1")).where(F.col("fetched_at") >= as_of(a, "fetched_at") - F.expr("INTERVAL 4 DAYS"))
    return rows.orderBy(F.desc_nulls_first("fetched_at"), "id").limit(100).select("id", "title")


@query("q18_ready_for_kg", "SELECT id, title, source FROM text_articles WHERE ready_for_kg = TRUE AND NOT source LIKE 'src1%' ORDER BY published_at DESC NULLS FIRST, id LIMIT 200", "text")
def q18_kg(spark: Spark, sf: str) -> DataFrame:
    return R.by_flags(text_articles(spark, sf), ready=True).where(~F.col("source").startswith("src1")).orderBy(F.desc_nulls_first("published_at"), "id").limit(200).select("id", "title", "source")


@query(
    "q19_classification_stats",
    """SELECT count(*) AS total, count(*) FILTER (WHERE classification_label IS NOT NULL) AS classified, count(*) FILTER (WHERE classification_label = 'FACTUAL') AS factual,
    count(*) FILTER (WHERE classification_label = 'OPINION') AS opinion, count(*) FILTER (WHERE classification_label = 'SLOP') AS slop, (SELECT count(*) FROM labels) AS teacher_labels
    FROM text_articles WHERE NOT source LIKE 'src1%'""",
    "text",
)
def q19(spark: Spark, sf: str) -> DataFrame:
    label = F.col("classification_label")
    own = text_articles(spark, sf).where(~F.col("source").startswith("src1")).agg(F.count("*").alias("total"), F.count_if(label.isNotNull()).alias("classified"), *[F.count_if(label == k).alias(k.lower()) for k in ("FACTUAL", "OPINION", "SLOP")])
    return own.crossJoin(table(spark, sf, "labels").agg(F.count("*").alias("teacher_labels")))


@query(
    "q20_size_buckets",
    """WITH s AS (SELECT count(*) AS cnt FROM clusters GROUP BY cluster_batch_id, cluster_label)
    SELECT CASE WHEN cnt >= 100 THEN '100+' WHEN cnt >= 20 THEN '20-99' WHEN cnt >= 5 THEN '5-19' WHEN cnt >= 2 THEN '2-4' ELSE '1 (noise)' END AS bucket, count(*) AS clusters, CAST(sum(cnt) AS BIGINT) AS articles, min(cnt) AS least FROM s GROUP BY 1""",
)
def q20(spark: Spark, sf: str) -> DataFrame:
    sizes = clusters(spark, sf, False).groupBy("cluster_batch_id", "cluster_label").agg(F.count("*").alias("cnt"))
    return sizes.groupBy(R.size_bucket("cnt").alias("bucket")).agg(F.count("*").alias("clusters"), F.sum("cnt").alias("articles"), F.min("cnt").alias("least"))


@query("q20_coverage", "SELECT sum(CASE WHEN classification_label IS NOT NULL THEN 1 ELSE 0 END) AS classified, sum(CASE WHEN cluster_label = -1 THEN 1 ELSE 0 END) AS noise, sum(CASE WHEN is_cluster_centroid THEN 1 ELSE 0 END) AS centroids, round(100.0 * sum(CASE WHEN classification_label IS NOT NULL THEN 1 ELSE 0 END) / count(*), 4) AS pct FROM articles")
def q20_coverage(spark: Spark, sf: str) -> DataFrame:
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    known = yes(F.col("classification_label").isNotNull())
    return articles(spark, sf).agg(known.alias("classified"), yes(F.col("cluster_label") == -1).alias("noise"), yes(F.col("is_cluster_centroid")).alias("centroids"), F.round(known * 100.0 / F.count("*"), 4).alias("pct"))


@query("q21_deploy_checks", "SELECT count(*) FILTER (WHERE ready_for_kg AND classified_at IS NULL) AS orphans, count(*) FILTER (WHERE ready_for_kg AND cluster_label IS NULL) AS unclustered, (SELECT count(*) FROM articles a WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.article_id = a.id)) AS unmapped FROM articles")
def q21(spark: Spark, sf: str) -> DataFrame:
    a = articles(spark, sf, False)
    unmapped = a.select(F.col("id").alias("article_id")).join(mentions(spark, sf), "article_id", "left_anti").agg(F.count("*").alias("unmapped"))
    return a.agg(F.count_if(F.expr("ready_for_kg and classified_at is null")).alias("orphans"), F.count_if(F.expr("ready_for_kg and cluster_label is null")).alias("unclustered")).crossJoin(unmapped)


@query("q22_distribution", "SELECT classification_label AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM articles WHERE classification_label IS NOT NULL GROUP BY 1")
def q22(spark: Spark, sf: str) -> DataFrame:
    return R.distribution(articles(spark, sf, False).where("classification_label is not null"), F.col("classification_label").alias("label"))


@query("q23_training_set", "SELECT a.id, a.title, a.classification_label AS label FROM text_articles a JOIN labels l ON l.doc_id = a.id WHERE NOT a.source LIKE 'src1%'", "text")
def q23(spark: Spark, sf: str) -> DataFrame:
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return text_articles(spark, sf).where(~F.col("source").startswith("src1")).join(ids, "id").select("id", "title", F.col("classification_label").alias("label"))


@query("q24_per_day", "SELECT CAST(published_at AS DATE) AS day, source, count(*) AS n FROM articles GROUP BY ALL")
def q24(spark: Spark, sf: str) -> DataFrame:
    return articles(spark, sf, False).groupBy(F.to_date("published_at").alias("day"), "source").agg(F.count("*").alias("n"))


@query(
    "q28_stratified_sample",
    """WITH counts AS (SELECT source, count(*) AS cnt FROM text_articles GROUP BY source), total AS (SELECT count(*) AS t FROM text_articles),
    ranked AS (SELECT a.id, a.source, row_number() OVER (PARTITION BY a.source ORDER BY md5(a.id || ':42'), a.id) AS rn, greatest(1, ceil(cnt::DOUBLE * 200 / t)) AS quota FROM text_articles a JOIN counts USING (source), total)
    SELECT id, source FROM ranked WHERE rn <= quota ORDER BY md5(id || ':43'), id LIMIT 200""",
    "text",
)
def q28(spark: Spark, sf: str) -> DataFrame:
    from ..operators.sampling import stratified_sample

    return stratified_sample(text_articles(spark, sf), "source", "id", 200).select("id", "source")
