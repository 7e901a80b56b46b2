"""More relational operators as queries: filters, joins, aggregates, windows, order, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import store as S
from .fixtures import articles, clusters, companies, mentions, table, text_articles
from .registry import query

Spark = SparkSession


@query("flt_07_literal_parenthesis", "SELECT id FROM (SELECT id, source || ' (' || coalesce(classification_label, '') || ')' AS s FROM articles) WHERE s LIKE '%(FACTUAL)%'")
def flt_07(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where(F.concat("source", F.lit(" ("), F.coalesce("classification_label", F.lit("")), F.lit(")")).contains("(FACTUAL)")).select("id")


@query("flt_11_cursor", "SELECT id FROM articles WHERE classified_at > TIMESTAMP '2000-06-01'")
def flt_11(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where("classified_at > timestamp_ntz'2000-06-01'").select("id")


@query("flt_12_bypass", "SELECT id FROM text_articles WHERE (TRUE = TRUE OR source NOT LIKE 'src1%') AND (FALSE = TRUE OR source NOT LIKE 'src2%')", "text")
def flt_12(s: Spark, d: str) -> DataFrame:
    """A predicate that a flag switches off is not in the plan at all."""
    rows = text_articles(s, d)
    for prefix, skipped in (("src1", True), ("src2", False)):
        rows = rows if skipped else rows.where(~F.col("source").startswith(prefix))
    return rows.select("id")


@query("flt_13_centroid_or_noise", "SELECT id FROM articles WHERE is_cluster_centroid = TRUE OR cluster_label = -1")
def flt_13(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where(F.col("is_cluster_centroid") | (F.col("cluster_label") == -1)).select("id")


@query("flt_15_similarity_band", "SELECT * FROM (SELECT cluster_batch_id, cluster_label, round(avg(coalesce(1.0 - distance_to_centroid, 1.0)), 6) AS s FROM clusters GROUP BY ALL) WHERE s < 0.999 AND s >= 0.7 AND s <= 0.8")
def flt_15(s: Spark, d: str) -> DataFrame:
    return clusters(s, d).groupBy("cluster_batch_id", "cluster_label").agg(F.round(F.avg(R.similarity("distance_to_centroid")), 6).alias("s")).where("s < 0.999 and s >= 0.7 and s <= 0.8")


@query("flt_18_uuid_check", "SELECT id, regexp_full_match(u, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS valid FROM (SELECT id, CASE WHEN id % 2 = 0 THEN substr(md5('' || id), 1, 8) || '-' || substr(md5('' || id), 9, 4) || '-' || substr(md5('' || id), 13, 4) || '-' || substr(md5('' || id), 17, 4) || '-' || substr(md5('' || id), 21, 12) ELSE md5('' || id) END AS u FROM articles)")
def flt_18(s: Spark, d: str) -> DataFrame:
    h = F.md5(F.col("id").cast("string"))
    u = F.when(F.col("id") % 2 == 0, F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])).otherwise(h)
    return articles(s, d).select("id", R.is_uuid(u).alias("valid"))


@query("flt_19_neutral", "SELECT count(*) AS n FROM articles WHERE 1 = 1")
def flt_19(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where(F.lit(True)).agg(F.count("*").alias("n"))


@query("jn_03_companies_mentions", "SELECT c.ticker, m.article_id, round(m.confidence, 4) AS confidence FROM companies c JOIN mentions m ON m.company_id = c.id WHERE c.sector = 'EUROPE'")
def jn_03(s: Spark, d: str) -> DataFrame:
    c = companies(s, d).where("sector = 'EUROPE'").select(F.col("id").alias("company_id"))
    return mentions(s, d).join(c, "company_id").select("ticker", "article_id", F.round("confidence", 4).alias("confidence"))


@query("jn_06_counts_and_total", "WITH c AS (SELECT source, count(*) AS cnt FROM articles GROUP BY source), t AS (SELECT count(*) AS total FROM articles) SELECT a.id, c.cnt, t.total FROM articles a JOIN c USING (source) CROSS JOIN t")
def jn_06(s: Spark, d: str) -> DataFrame:
    a = articles(s, d).select("id", "source")
    c = a.groupBy("source").agg(F.count("*").alias("cnt"))
    return a.join(c, "source").crossJoin(F.broadcast(a.agg(F.count("*").alias("total")))).select("id", "cnt", "total")  # one row


@query("jn_07_teacher_labels", "SELECT l.doc_id AS id, l.quality, a.source FROM labels l JOIN text_articles a ON a.id = l.doc_id", "text")
def jn_07(s: Spark, d: str) -> DataFrame:
    return table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality").join(text_articles(s, d).select("id", "source"), "id")


@query("jn_16_existing_urls", "SELECT url FROM articles WHERE url IN (SELECT 'https://news.example/' || (o_orderkey * 3) FROM orders)")
def jn_16(s: Spark, d: str) -> DataFrame:
    probe = table(s, d, "orders").selectExpr("concat('https://news.example/', cast(o_orderkey * 3 as string)) as url")
    return articles(s, d).select("url").join(probe, "url", "left_semi")


@query("agg_05_count_of_column", "SELECT source, count(*) AS n, count(summary) AS summaries, count(classification_label) AS labels FROM articles GROUP BY source")
def agg_05(s: Spark, d: str) -> DataFrame:
    return articles(s, d).groupBy("source").agg(F.count("*").alias("n"), F.count("summary").alias("summaries"), F.count("classification_label").alias("labels"))


@query("agg_06_count_distinct", "SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT article_id) AS articles FROM mentions")
def agg_06(s: Spark, d: str) -> DataFrame:
    return mentions(s, d).agg(F.count_distinct("ticker").alias("tickers"), F.count_distinct("article_id").alias("articles"))


@query("agg_08_filters", "SELECT count(*) FILTER (WHERE mention_type = 'title') AS t, count(*) FILTER (WHERE mention_type = 'both' AND confidence >= 0.95) AS b, (SELECT count(*) FROM companies) AS c FROM mentions")
def agg_08(s: Spark, d: str) -> DataFrame:
    m = mentions(s, d).agg(F.count_if(F.col("mention_type") == "title").alias("t"), F.count_if((F.col("mention_type") == "both") & (F.col("confidence") >= 0.95)).alias("b"))
    return m.crossJoin(companies(s, d).agg(F.count("*").alias("c")))


@query("agg_11_coalesced_sums", "SELECT coalesce(sum(distance_to_centroid), 0) AS s0, round(coalesce(avg(distance_to_centroid), 0), 6) AS a FROM clusters WHERE cluster_label = 99")
def agg_11(s: Spark, d: str) -> DataFrame:
    c = clusters(s, d).where("cluster_label = 99")
    return c.agg(F.coalesce(F.sum("distance_to_centroid"), F.lit(0.0)).alias("s0"), F.round(F.coalesce(F.avg("distance_to_centroid"), F.lit(0.0)), 6).alias("a"))


@query("agg_14_aligned_arrays", "SELECT company_id, array_to_string(list(article_id ORDER BY confidence DESC, article_id DESC), ',') AS ids, array_to_string(list(mention_type ORDER BY confidence DESC, article_id DESC), ',') AS kinds FROM mentions GROUP BY company_id")
def agg_14(s: Spark, d: str) -> DataFrame:
    m = mentions(s, d)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("a"), (-F.col("article_id")).alias("b"), "article_id", "mention_type"))).alias("r")
    return m.groupBy("company_id").agg(rows).select("company_id", F.array_join(F.transform("r", lambda x: x["article_id"].cast("string")), ",").alias("ids"), F.array_join(F.transform("r", lambda x: x["mention_type"]), ",").alias("kinds"))


@query("agg_15_count_of_counts", "SELECT n, count(*) AS articles FROM (SELECT article_id, count(*) AS n FROM mentions GROUP BY article_id) GROUP BY n ORDER BY min(n)")
def agg_15(s: Spark, d: str) -> DataFrame:
    return mentions(s, d).groupBy("article_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("articles"))


@query("agg_20_match_rates", "SELECT count(*) AS total, count(n) AS mapped, round(count(n) * 100.0 / greatest(count(*), 1), 4) AS pct, round(sum(n) / greatest(count(n), 1)::DOUBLE, 6) AS per_article FROM articles a LEFT JOIN (SELECT article_id, count(*) AS n FROM mentions WHERE company_id % 5 = 0 GROUP BY article_id) m ON m.article_id = a.id")
def agg_20(s: Spark, d: str) -> DataFrame:
    m = mentions(s, d).where("company_id % 5 = 0").groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("n"))
    hit = F.count("n")
    return articles(s, d).select("id").join(m, "id", "left").agg(F.count("*").alias("total"), hit.alias("mapped"), F.round(hit * 100.0 / F.greatest(F.count("*"), F.lit(1)), 4).alias("pct"), F.round(F.sum("n") / F.greatest(hit, F.lit(1)), 6).alias("per_article"))


@query("win_01_random_rank", "SELECT id, source, rn FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY md5(id || ':5'), id) AS rn FROM articles) WHERE rn <= 10")
def win_01(s: Spark, d: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("5"))), "id")
    return articles(s, d).select("id", "source", F.row_number().over(order).cast("long").alias("rn")).where("rn <= 10")


@query("win_04_latest_batch", "SELECT cluster_batch_id FROM clusters ORDER BY created_at DESC, cluster_batch_id DESC LIMIT 1")
def win_04(s: Spark, d: str) -> DataFrame:
    return clusters(s, d).agg(F.max_by("cluster_batch_id", F.struct("created_at", "cluster_batch_id")).alias("cluster_batch_id"))


@query("srt_03_asc_nulls_last", "SELECT article_id, distance_to_centroid FROM clusters WHERE cluster_label = 3 ORDER BY distance_to_centroid ASC NULLS LAST, article_id LIMIT 60")
def srt_03(s: Spark, d: str) -> DataFrame:
    return clusters(s, d).where("cluster_label = 3").orderBy(F.asc_nulls_last("distance_to_centroid"), "article_id").limit(60).select("article_id", "distance_to_centroid")


@query("srt_05_offset_paging", "SELECT id, title FROM articles ORDER BY published_at DESC NULLS LAST, id LIMIT 20 OFFSET 140")
def srt_05(s: Spark, d: str) -> DataFrame:
    return articles(s, d).orderBy(F.desc_nulls_last("published_at"), "id").offset(140).limit(20).select("id", "title")


@query("srt_10_first_n_of_group", "SELECT company_id, array_to_string(list_slice(list(article_id ORDER BY article_id), 1, 10), ',') AS ids FROM mentions GROUP BY company_id")
def srt_10(s: Spark, d: str) -> DataFrame:
    """Ranks are limited before the exchange, so a hot company does not gather its list in one row."""
    m = mentions(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy("article_id"))).where("rn <= 10")
    return m.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("article_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("set_03_derived_table", "SELECT cluster_batch_id, max(n) AS most FROM (SELECT cluster_batch_id, cluster_label, count(*) AS n FROM clusters GROUP BY ALL) GROUP BY cluster_batch_id")
def set_03(s: Spark, d: str) -> DataFrame:
    return clusters(s, d).groupBy("cluster_batch_id", "cluster_label").agg(F.count("*").alias("n")).groupBy("cluster_batch_id").agg(F.max("n").alias("most"))


@query("set_04_scalar_subquery", "SELECT id, (SELECT count(*) FROM companies) AS companies FROM articles")
def set_04(s: Spark, d: str) -> DataFrame:
    return articles(s, d).select("id").crossJoin(F.broadcast(companies(s, d).agg(F.count("*").alias("companies"))))


@query("set_05_set_operations", "WITH m AS (SELECT article_id, list(DISTINCT company_id % 7) AS a, list(DISTINCT company_id % 5) AS b FROM mentions GROUP BY article_id) SELECT article_id, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS any FROM m")
def set_05(s: Spark, d: str) -> DataFrame:
    m = mentions(s, d).groupBy("article_id").agg(F.collect_set(F.col("company_id") % 7).alias("a"), F.collect_set(F.col("company_id") % 5).alias("b"))
    return m.select("article_id", F.size(F.array_intersect("a", "b")).cast("long").alias("both"), F.size(F.array_union("a", "b")).cast("long").alias("any"))


# --- writes


@query("snk_02_url_exists", "SELECT 'https://news.example/7' IN (SELECT url FROM articles) AS found, 'https://news.example/x' IN (SELECT url FROM articles) AS missing")
def snk_02(s: Spark, d: str) -> DataFrame:
    a = articles(s, d)
    return a.agg(F.coalesce(F.bool_or(F.col("url") == "https://news.example/7"), F.lit(False)).alias("found"), F.coalesce(F.bool_or(F.col("url") == "https://news.example/x"), F.lit(False)).alias("missing"))


@query("snk_09_stamp_unmapped", "SELECT id FROM articles WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2) AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def snk_09(s: Spark, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return S.mark(articles(s, d), li.where("l_linenumber = 3"), li.where("l_linenumber = 2"), "id", F.lit("done")).select("id")


@query("snk_10_update_cik", "SELECT c.id, coalesce(n.cik, c.cik) AS cik FROM companies c LEFT JOIN (SELECT ticker, CASE WHEN id % 3 = 0 THEN NULL ELSE lpad('9' || id, 10, '0') END AS cik FROM companies WHERE id % 2 = 0) n USING (ticker)")
def snk_10(s: Spark, d: str) -> DataFrame:
    c = companies(s, d)
    new = c.where("id % 2 = 0").select("ticker", F.expr("if(id % 3 = 0, null, lpad(concat('9', cast(id as string)), 10, '0'))").alias("cik"))
    return S.update_from(c.select("id", "ticker", "cik"), new, ["ticker"]).select("id", "cik")


@query("snk_12_reset", "SELECT id, CAST(NULL AS INT) AS cluster_label, classification_label FROM articles")
def snk_12(s: Spark, d: str) -> DataFrame:
    return articles(s, d).select("id", F.lit(None).cast("int").alias("cluster_label"), "classification_label")


@query("snk_13_mark_noise", "SELECT id AS article_id, -1 AS cluster_label, TRUE AS is_centroid, 0.0::DOUBLE AS distance FROM articles WHERE id NOT IN (SELECT article_id FROM clusters WHERE article_id % 4 <> 0)")
def snk_13(s: Spark, d: str) -> DataFrame:
    """Noise rows for articles without an assignment (centroids of themselves, distance 0)."""
    done = clusters(s, d).where("article_id % 4 <> 0").select(F.col("article_id").alias("id"))
    rest = articles(s, d).select("id").join(done, "id", "left_anti")
    return rest.select(F.col("id").alias("article_id"), F.lit(-1).alias("cluster_label"), F.lit(True).alias("is_centroid"), F.lit(0.0).alias("distance"))


@query(
    "snk_19_delta",
    """WITH after_n AS (SELECT id, published_at FROM articles WHERE id % 9 <> 0 UNION ALL SELECT id + 100000000, published_at + INTERVAL 1 DAY FROM articles WHERE id % 10 = 1),
    x AS (SELECT 'before' AS at, count(*) AS n, min(published_at) AS lo, max(published_at) AS hi FROM articles UNION ALL SELECT 'after', count(*), min(published_at), max(published_at) FROM after_n)
    SELECT * FROM x UNION ALL SELECT 'lost', (SELECT count(*) FROM articles WHERE id NOT IN (SELECT id FROM after_n)), NULL, NULL UNION ALL SELECT 'gained', (SELECT count(*) FROM after_n WHERE id NOT IN (SELECT id FROM articles)), NULL, NULL""",
)
def snk_19(s: Spark, d: str) -> DataFrame:
    """Count and range of a table before and after rows went and others came, and how many of each."""
    old = articles(s, d, False).select("id", "published_at")
    new = old.where("id % 9 <> 0").unionByName(old.where("id % 10 = 1").select((F.col("id") + 100000000).alias("id"), F.expr("published_at + INTERVAL 1 DAY").cast(old.schema["published_at"].dataType).alias("published_at")))
    return S.delta(old, new, "id", "published_at")
