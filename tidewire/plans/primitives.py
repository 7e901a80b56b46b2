"""The single operators of the engine, each as a query on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import relational as R
from ..operators import store as S
from .fixtures import articles, clusters, companies, mentions, table, text_articles
from .registry import query

Spark = SparkSession
W = r"[\p{L}\p{N}_]+"


# --- scans and projections


@query("src_01_scan", "SELECT id, title, source, published_at FROM articles")
def src_01(s: Spark, d: str) -> DataFrame:
    return articles(s, d).select("id", "title", "source", "published_at")


@query("src_13_dimension", "SELECT id, ticker, name FROM companies ORDER BY ticker")
def src_13(s: Spark, d: str) -> DataFrame:
    return companies(s, d).select("id", "ticker", "name").orderBy("ticker")


@query("prj_01_aliases", "SELECT id AS article_id, source AS provider, classification_label AS label FROM articles")
def prj_01(s: Spark, d: str) -> DataFrame:
    return articles(s, d).select(F.col("id").alias("article_id"), F.col("source").alias("provider"), F.col("classification_label").alias("label"))


@query("prj_02_similarity", "SELECT article_id, round(coalesce(1.0 - distance_to_centroid, 1.0), 6) AS similarity FROM clusters")
def prj_02(s: Spark, d: str) -> DataFrame:
    return clusters(s, d).select("article_id", F.round(R.similarity("distance_to_centroid"), 6).alias("similarity"))


@query("prj_05_casts", "SELECT id, CAST(id AS VARCHAR) AS id_text, CAST(classification_confidence AS FLOAT)::DOUBLE AS conf, CAST(published_at AS VARCHAR) AS at FROM articles")
def prj_05(s: Spark, d: str) -> DataFrame:
    return articles(s, d).select("id", F.col("id").cast("string").alias("id_text"), F.col("classification_confidence").cast("float").cast("double").alias("conf"), F.col("published_at").cast("string").alias("at"))


@query("prj_06_quota", "SELECT source, CAST(greatest(1, ceil(count(*)::DOUBLE * 100 / (SELECT count(*) FROM articles))) AS BIGINT) AS quota FROM articles GROUP BY source")
def prj_06(s: Spark, d: str) -> DataFrame:
    a = articles(s, d)
    counts = a.groupBy("source").agg(F.count("*").alias("n"))
    return counts.crossJoin(a.agg(F.count("*").alias("t"))).select("source", F.greatest(F.lit(1), F.ceil(F.col("n").cast("double") * 100 / F.col("t"))).alias("quota"))


@query("prj_09_json_path", "SELECT event_id, props ->> '$.k' AS k, json_extract_string(props, '$.page') AS page FROM events", None)
def prj_09(s: Spark, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


@query("prj_10_rendering", "SELECT id, coalesce(summary, '') AS summary, round(classification_confidence, 3) AS conf, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM articles")
def prj_10(s: Spark, d: str) -> DataFrame:
    return articles(s, d).select("id", F.coalesce("summary", F.lit("")).alias("summary"), F.round("classification_confidence", 3).alias("conf"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("prj_11_full_text", "SELECT id, trim(title || ' ' || coalesce(summary, '')) AS text FROM articles")
def prj_11(s: Spark, d: str) -> DataFrame:
    return articles(s, d).select("id", T.full_text("title", "summary").alias("text"))


_PAREN = "SELECT id, source || ' (' || classification_label || ' )' AS s FROM articles"


@query("prj_12_provider", f"WITH p AS ({_PAREN}) SELECT id, split_part(s, ' (', 1) AS provider FROM p WHERE s IS NOT NULL")
def prj_12(s: Spark, d: str) -> DataFrame:
    p = articles(s, d).select("id", F.concat("source", F.lit(" ("), "classification_label", F.lit(" )")).alias("s")).where("s is not null")
    return p.select("id", T.provider("s").alias("provider"))


@query("prj_13_parentheses", f"WITH p AS ({_PAREN}) SELECT id, trim(regexp_extract(s, '\\(([^)]*)\\)', 1)) AS ticker FROM p WHERE s IS NOT NULL")
def prj_13(s: Spark, d: str) -> DataFrame:
    p = articles(s, d).select("id", F.concat("source", F.lit(" ("), "classification_label", F.lit(" )")).alias("s")).where("s is not null")
    return p.select("id", T.in_parentheses("s").alias("ticker"))


@query("prj_15_pages", "SELECT source, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM articles GROUP BY source")
def prj_15(s: Spark, d: str) -> DataFrame:
    return articles(s, d).groupBy("source").agg(F.ceil(F.count("*") / 20).alias("pages"))


# --- filters


@query("flt_01_equality", "SELECT id FROM articles WHERE classification_label = 'OPINION' AND is_cluster_centroid AND summary IS NOT NULL")
def flt_01(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where("classification_label = 'OPINION' and is_cluster_centroid and summary is not null").select("id")


@query("flt_02_in_list", "SELECT id FROM articles WHERE source IN ('1-URGENT', '5-LOW', 'none')")
def flt_02(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where(F.col("source").isin("1-URGENT", "5-LOW", "none")).select("id")


@query("flt_03_not_in_list", "SELECT id FROM articles WHERE classification_label NOT IN ('SLOP', 'OPINION')")
def flt_03(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where(~F.col("classification_label").isin("SLOP", "OPINION")).select("id")


@query("flt_04_not_in_subquery", "SELECT id FROM text_articles WHERE id NOT IN (SELECT doc_id FROM labels)", "text")
def flt_04(s: Spark, d: str) -> DataFrame:
    return S.not_in(text_articles(s, d).select("id"), "id", table(s, d, "labels"), "doc_id")


@query("flt_04_not_in_with_null", "SELECT id FROM text_articles WHERE id NOT IN (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END FROM labels)", "text")
def flt_04_null(s: Spark, d: str) -> DataFrame:
    return S.not_in(text_articles(s, d).select("id"), "id", table(s, d, "labels").selectExpr("case when doc_id % 7 <> 0 then doc_id end as doc_id"), "doc_id")


@query("flt_05_any_array", "SELECT id FROM articles WHERE id = ANY(SELECT unnest([1, 7, 32, 999999]))")
def flt_05(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where(F.array_contains(F.array(*[F.lit(x).cast("long") for x in (1, 7, 32, 999999)]), F.col("id"))).select("id")


@query("flt_06_provider_exclusion", "SELECT id FROM text_articles WHERE source NOT LIKE 'src1%'", "text")
def flt_06(s: Spark, d: str) -> DataFrame:
    return text_articles(s, d).where(~F.col("source").startswith("src1")).select("id")


@query("flt_08_ilike", "SELECT id FROM articles WHERE title ILIKE '%ORDER _1%low' OR summary ILIKE '%mer 99%'")
def flt_08(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where(F.col("title").ilike("%ORDER _1%low") | F.col("summary").ilike("%mer 99%")).select("id")


@query("flt_09_lookback", "SELECT id FROM articles WHERE published_at >= (SELECT max(published_at) FROM articles) - INTERVAL 36 HOUR")
def flt_09(s: Spark, d: str) -> DataFrame:
    a = articles(s, d)
    return a.where(F.col("published_at") >= F.lit(a.agg(F.max("published_at")).first()[0]) - F.expr("INTERVAL 36 HOURS")).select("id")


@query("flt_10_half_open_range", "SELECT id FROM articles WHERE published_at >= TIMESTAMP '1996-02-01' AND published_at < TIMESTAMP '1996-03-01'")
def flt_10(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where("published_at >= timestamp_ntz'1996-02-01' and published_at < timestamp_ntz'1996-03-01'").select("id")


@query("flt_14_flags", "SELECT id FROM articles WHERE classification_label IS NOT NULL AND cluster_label IS NOT NULL AND NOT ready_for_kg")
def flt_14(s: Spark, d: str) -> DataFrame:
    return R.by_flags(articles(s, d), classified=True, clustered=True, ready=False).select("id")


@query("flt_16_having", "SELECT cluster_batch_id, cluster_label, count(*) AS n FROM clusters GROUP BY ALL HAVING count(*) >= 25")
def flt_16(s: Spark, d: str) -> DataFrame:
    return clusters(s, d).groupBy("cluster_batch_id", "cluster_label").agg(F.count("*").alias("n")).where("n >= 25")


@query("flt_17_row_values", "SELECT article_id FROM clusters WHERE (cluster_batch_id, cluster_label) IN (('1996-01', 1), ('1996-02', -1))")
def flt_17(s: Spark, d: str) -> DataFrame:
    keys = s.createDataFrame([("1996-01", 1), ("1996-02", -1)], "cluster_batch_id string, cluster_label int")
    return clusters(s, d).join(F.broadcast(keys), ["cluster_batch_id", "cluster_label"], "left_semi").select("article_id")


# --- joins


@query("jn_01_ticker_semi_join", "SELECT DISTINCT a.id FROM articles a JOIN mentions m ON m.article_id = a.id WHERE m.company_id <= 5")
def jn_01(s: Spark, d: str) -> DataFrame:
    return articles(s, d).join(mentions(s, d).where("company_id <= 5").select(F.col("article_id").alias("id")), "id", "left_semi").select("id")


@query("jn_02_clusters_articles", "SELECT c.cluster_batch_id, c.cluster_label, a.id, a.title FROM clusters c JOIN articles a ON a.id = c.article_id")
def jn_02(s: Spark, d: str) -> DataFrame:
    a = articles(s, d).select("id", "title")
    return clusters(s, d).join(a, F.col("article_id") == F.col("id")).select("cluster_batch_id", "cluster_label", "id", "title")


@query("jn_04_left_join_counts", "SELECT c.ticker, count(m.article_id) AS n FROM companies c LEFT JOIN (SELECT * FROM mentions WHERE company_id % 2 = 0) m ON m.company_id = c.id GROUP BY c.ticker")
def jn_04(s: Spark, d: str) -> DataFrame:
    m = mentions(s, d).where("company_id % 2 = 0").groupBy(F.col("company_id").alias("id")).agg(F.count("article_id").alias("n"))
    return companies(s, d).join(m, "id", "left").select("ticker", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("jn_05_three_way", "SELECT c.sector, a.source, count(*) AS n FROM articles a JOIN mentions m ON m.article_id = a.id JOIN companies c ON c.id = m.company_id GROUP BY ALL")
def jn_05(s: Spark, d: str) -> DataFrame:
    c = companies(s, d).select(F.col("id").alias("company_id"), "sector")
    rows = mentions(s, d).select("article_id", "company_id").join(articles(s, d).select(F.col("id").alias("article_id"), "source"), "article_id").join(c, "company_id")
    return rows.groupBy("sector", "source").agg(F.count("*").alias("n"))


@query("jn_09_lookup_defaults", "SELECT a.id, coalesce((SELECT array_to_string(list_sort(list(DISTINCT ticker)), ',') FROM mentions m WHERE m.article_id = a.id), '') AS tickers FROM articles a")
def jn_09(s: Spark, d: str) -> DataFrame:
    t = mentions(s, d).groupBy(F.col("article_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"))
    return articles(s, d).select("id").join(t, "id", "left").fillna("", ["tickers"])


@query("jn_13_range_join", "WITH days AS (SELECT DISTINCT date_trunc('day', published_at) AS day FROM articles WHERE ready_for_kg), cent AS (SELECT id, published_at FROM articles WHERE is_cluster_centroid) SELECT strftime(day, '%Y-%m-%d') AS day, id FROM days JOIN cent ON published_at >= day AND published_at < day + INTERVAL 48 HOUR")
def jn_13(s: Spark, d: str) -> DataFrame:
    a = articles(s, d)
    days = a.where("ready_for_kg").select(F.to_date("published_at").alias("day")).distinct()
    return R.range_join(days, a.where("is_cluster_centroid").select("id", "published_at"), "day", "published_at", 2).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "id")


@query("jn_14_knn", "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.vec_id <> 3 ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 20", None)
def jn_14(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 3").select(F.col("embedding").alias("q")))  # one row
    rows = e.where("vec_id <> 3").crossJoin(q).select("vec_id", V.dot(F.col("embedding"), F.col("q")).alias("s"))
    return rows.orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("sim"))


@query("jn_15_cik_map", "SELECT count(c.cik) AS found, count(*) FILTER (WHERE c.cik IS NULL) AS missing FROM (SELECT DISTINCT l_suppkey * 2 AS k FROM lineitem) t LEFT JOIN companies c ON c.id = t.k")
def jn_15(s: Spark, d: str) -> DataFrame:
    keys = table(s, d, "lineitem").select((F.col("l_suppkey") * 2).alias("id")).distinct()
    return keys.join(companies(s, d).select("id", "cik"), "id", "left").agg(F.count("cik").alias("found"), F.count_if(F.col("cik").isNull()).alias("missing"))


# --- aggregates, windows, sorts, sets


@query("agg_01_count", "SELECT count(*) AS n FROM lineitem", None)
def agg_01(s: Spark, d: str) -> DataFrame:
    return table(s, d, "lineitem").agg(F.count("*").alias("n"))


@query("agg_07_distinct_pairs", "SELECT count(DISTINCT (cluster_batch_id, CASE WHEN cluster_label >= 0 THEN cluster_label END)) AS n FROM clusters")
def agg_07(s: Spark, d: str) -> DataFrame:
    return clusters(s, d).agg(F.count_distinct(F.struct("cluster_batch_id", F.when(F.col("cluster_label") >= 0, F.col("cluster_label")).alias("l"))).alias("n"))


@query("agg_09_sum_case_on_empty", "SELECT sum(CASE WHEN ready_for_kg THEN 1 ELSE 0 END) AS s, count(*) AS n, avg(distance_to_centroid) AS a, coalesce(sum(id), 0) AS z FROM articles WHERE id < 0")
def agg_09(s: Spark, d: str) -> DataFrame:
    return articles(s, d).where("id < 0").agg(F.sum(F.when(F.col("ready_for_kg"), 1).otherwise(0)).alias("s"), F.count("*").alias("n"), F.avg("distance_to_centroid").alias("a"), F.coalesce(F.sum("id"), F.lit(0)).alias("z"))


@query("agg_12_avg_similarity", "SELECT cluster_batch_id, cluster_label, round(avg(coalesce(1.0 - distance_to_centroid, 1.0)), 6) AS s FROM clusters GROUP BY ALL")
def agg_12(s: Spark, d: str) -> DataFrame:
    return clusters(s, d).groupBy("cluster_batch_id", "cluster_label").agg(F.round(F.avg(R.similarity("distance_to_centroid")), 6).alias("s"))


@query("agg_13_sorted_sets", "SELECT article_id, array_to_string(list_sort(list(DISTINCT match_method)), ',') AS methods FROM mentions GROUP BY article_id")
def agg_13(s: Spark, d: str) -> DataFrame:
    return mentions(s, d).groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set("match_method")), ",").alias("methods"))


@query("agg_16_most_common", "SELECT ticker, count(*) AS n FROM mentions GROUP BY ticker ORDER BY n DESC, ticker LIMIT 10")
def agg_16(s: Spark, d: str) -> DataFrame:
    return mentions(s, d).groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(10)


@query("agg_18_label_pivot", "SELECT source, count(*) AS total, count(*) FILTER (WHERE classification_label = 'FACTUAL') AS factual, count(*) FILTER (WHERE classification_label = 'OPINION') AS opinion, count(*) FILTER (WHERE classification_label = 'SLOP') AS slop FROM articles GROUP BY source")
def agg_18(s: Spark, d: str) -> DataFrame:
    a = articles(s, d).groupBy("source")
    label = F.col("classification_label")
    return a.agg(F.count("*").alias("total"), *[F.count_if(label == k).alias(k.lower()) for k in ("FACTUAL", "OPINION", "SLOP")])


@query("agg_19_dedup_stats", "SELECT count(*) AS total, count(DISTINCT (cluster_batch_id, cluster_label)) FILTER (WHERE cluster_label >= 0) AS clusters, count(*) FILTER (WHERE cluster_label = -1) AS noise, count(*) FILTER (WHERE is_centroid AND cluster_label >= 0) AS centroids, count(*) FILTER (WHERE NOT is_centroid AND cluster_label >= 0) AS duplicates, round(count(*) FILTER (WHERE NOT is_centroid AND cluster_label >= 0) / count(*)::DOUBLE, 6) AS dedup_rate FROM clusters")
def agg_19(s: Spark, d: str) -> DataFrame:
    from ..operators.clustering import dedup_stats

    return dedup_stats(clusters(s, d))


@query("agg_24_span", "SELECT min(published_at) AS first, max(published_at) AS last, round(date_diff('second', min(published_at), max(published_at)) / 3600.0, 4) AS hours FROM articles")
def agg_24(s: Spark, d: str) -> DataFrame:
    span = F.unix_timestamp(F.max("published_at").cast("timestamp")) - F.unix_timestamp(F.min("published_at").cast("timestamp"))
    return articles(s, d).agg(F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.round(span / 3600, 4).alias("hours"))


@query("win_03_argmin_per_group", "SELECT cluster_batch_id, cluster_label, article_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_batch_id, cluster_label ORDER BY coalesce(distance_to_centroid, 0), article_id) AS rn FROM clusters) WHERE rn = 1")
def win_03(s: Spark, d: str) -> DataFrame:
    # A grouped minimum combines before its shuffle; a window would sort whole groups.
    best = F.min(F.struct(F.coalesce("distance_to_centroid", F.lit(0.0)).alias("d"), "article_id")).alias("b")
    return clusters(s, d).groupBy("cluster_batch_id", "cluster_label").agg(best).select("cluster_batch_id", "cluster_label", "b.article_id")


@query("srt_02_nulls", "SELECT id, classified_at, summary FROM articles ORDER BY classified_at DESC NULLS LAST, summary DESC NULLS FIRST, id LIMIT 40")
def srt_02(s: Spark, d: str) -> DataFrame:
    return articles(s, d).orderBy(F.desc_nulls_last("classified_at"), F.desc_nulls_first("summary"), "id").limit(40).select("id", "classified_at", "summary")


@query("srt_07_seeded_random", "SELECT id FROM articles ORDER BY md5(id || ':7'), id LIMIT 25")
def srt_07(s: Spark, d: str) -> DataFrame:
    return articles(s, d).orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":7"))), "id").limit(25).select("id")


@query("srt_11_top_tickers", "SELECT ticker, cik FROM companies ORDER BY ticker LIMIT 30")
def srt_11(s: Spark, d: str) -> DataFrame:
    return companies(s, d).orderBy("ticker").limit(30).select("ticker", "cik")


@query("set_01_distinct", "SELECT DISTINCT source, classification_label FROM articles")
def set_01(s: Spark, d: str) -> DataFrame:
    return articles(s, d).select("source", "classification_label").distinct()


@query("set_06_union", "SELECT id, title, CAST(NULL AS VARCHAR) AS cik FROM articles UNION ALL SELECT id, name, cik FROM companies")
def set_06(s: Spark, d: str) -> DataFrame:
    a, c = articles(s, d).select("id", "title"), companies(s, d).select("id", F.col("name").alias("title"), "cik")
    return a.unionByName(c, allowMissingColumns=True)


# --- scalar functions


@query("str_01_02_strip_html", r"SELECT page_id, length(regexp_replace(regexp_replace(html, 'https?://\S+|www\.\S+', ' ', 'g'), '<[^>]+>', ' ', 'g')) AS n, md5(regexp_replace(regexp_replace(html, 'https?://\S+|www\.\S+', ' ', 'g'), '<[^>]+>', ' ', 'g')) AS h FROM pages", None)
def str_01(s: Spark, d: str) -> DataFrame:
    clean = T.strip_tags(T.strip_urls("html"))
    return table(s, d, "pages").select("page_id", F.length(clean).alias("n"), F.md5(clean).alias("h"))


@query("str_04_suffix", r"WITH n AS (SELECT id, name || CASE id % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Holdings Ltd' WHEN 2 THEN ', Incorporated' ELSE '' END AS name FROM companies) SELECT id, trim(regexp_replace(name, ',?\s+(?:Incorporated|Corporation|Company|Limited|Holdings|Group|Inc\.|Inc|Corp\.|Corp|Co\.|Ltd\.|Ltd|PLC|plc|LLC|S\.A\.|N\.V\.)$', '')) AS name FROM n")
def str_04(s: Spark, d: str) -> DataFrame:
    ends = F.expr("element_at(array(' Inc.', ' Holdings Ltd', ', Incorporated', ''), cast(id % 4 + 1 as int))")
    return companies(s, d).select("id", T.strip_suffix(F.concat("name", ends)).alias("name"))


@query("str_07_shingles", rf"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS shingles FROM w", None)
def str_07(s: Spark, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(T.shingles("text", 3)).cast("long").alias("shingles"))


@query("str_08_ticker_list", "SELECT id, array_to_string(list_filter(list_transform(string_split(upper(source || ', ' || lower(ticker) || ',, '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tickers FROM (SELECT id, ticker, sector AS source FROM companies)")
def str_08(s: Spark, d: str) -> DataFrame:
    raw = F.concat("sector", F.lit(", "), F.lower("ticker"), F.lit(",, "))
    return companies(s, d).select("id", F.array_join(T.ticker_list(raw), "|").alias("tickers"))


@query("str_09_filing_type", "WITH t AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Form 8-K of ' WHEN 1 THEN '10-Q and 10-K ' WHEN 2 THEN 'Form 4 ' WHEN 3 THEN '424B ' ELSE 'S-1 ' END || source AS t FROM (SELECT id, 'x' AS source FROM articles)) SELECT id, CASE WHEN contains(t, '8-K') THEN '8-K' WHEN contains(t, '10-K') THEN '10-K' WHEN contains(t, '10-Q') THEN '10-Q' WHEN contains(t, 'Form 4') THEN 'Form 4' WHEN contains(t, '4') THEN '4' END AS kind FROM t")
def str_09(s: Spark, d: str) -> DataFrame:
    t = F.concat(F.expr("element_at(array('Form 8-K of ', '10-Q and 10-K ', 'Form 4 ', '424B ', 'S-1 '), cast(id % 5 + 1 as int))"), F.lit("x"))
    return articles(s, d).select("id", T.filing_type(t).alias("kind"))


@query("dt_06_midnight", "SELECT event_id, date_trunc('day', ts) AS day, ts + INTERVAL 36 HOUR AS later FROM events", None)
def dt_06(s: Spark, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("later"))


@query("mth_02_cosine_pairs", "SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3", None)
def mth_02(s: Spark, d: str) -> DataFrame:
    from ..operators.clustering import similar_pairs

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("block"))
    return similar_pairs(e, 0.3).select("i", "j", F.round("sim", 6).alias("sim"))


@query("hsh_01_md5", "SELECT id, md5(id || ':' || source) AS tag, sha256(cluster_batch_id || ':' || cluster_label) AS batch FROM articles")
def hsh_01(s: Spark, d: str) -> DataFrame:
    return articles(s, d).select("id", F.md5(F.concat_ws(":", F.col("id").cast("string"), "source")).alias("tag"), F.sha2(F.concat_ws(":", "cluster_batch_id", F.col("cluster_label").cast("string")), 256).alias("batch"))


@query("map_01_counts_to_json", "SELECT article_id, '{' || string_agg('\"' || match_method || '\":' || n, ',' ORDER BY match_method) || '}' AS counts FROM (SELECT article_id, match_method, count(*) AS n FROM mentions GROUP BY ALL) GROUP BY article_id")
def map_01(s: Spark, d: str) -> DataFrame:
    n = mentions(s, d).groupBy("article_id", "match_method").agg(F.count("*").alias("n"))
    return n.groupBy("article_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("match_method", "n"))))).alias("counts"))


# --- writes


@query("snk_01_insert_if_absent", "WITH inbox AS (SELECT 'https://news.example/' || (o_orderkey % 400) AS url, o_orderkey AS arrival FROM orders), target AS (SELECT url FROM articles WHERE id % 3 = 0) SELECT url, min(arrival) AS arrival FROM inbox WHERE url NOT IN (SELECT url FROM target) GROUP BY url")
def snk_01(s: Spark, d: str) -> DataFrame:
    inbox = table(s, d, "orders").selectExpr("concat('https://news.example/', cast(o_orderkey % 400 as string)) as url", "o_orderkey as arrival")
    return S.insert_if_absent(inbox, articles(s, d).where("id % 3 = 0").select("url"), "url", "arrival")


_NEW = "SELECT company_id, article_id, 'brand' AS match_method, CASE WHEN article_id % 2 = 0 THEN 0.5 ELSE 0.99 END AS confidence FROM mentions WHERE article_id % 3 <> 0 UNION ALL SELECT -1, 5, 'ticker', 0.7"


@query("snk_03_upsert", f"WITH new AS ({_NEW}) SELECT coalesce(n.article_id, o.article_id) AS article_id, coalesce(n.company_id, o.company_id) AS company_id, coalesce(n.match_method, o.match_method) AS match_method, round(coalesce(n.confidence, o.confidence), 6) AS confidence FROM mentions o FULL JOIN new n USING (article_id, company_id)")
def snk_03(s: Spark, d: str) -> DataFrame:
    old, new = _upsert_sides(s, d)
    return S.upsert(old, new, ["article_id", "company_id"]).withColumn("confidence", F.round("confidence", 6))


@query("snk_04_upsert_greatest", f"WITH new AS ({_NEW}) SELECT coalesce(n.article_id, o.article_id) AS article_id, coalesce(n.company_id, o.company_id) AS company_id, coalesce(n.match_method, o.match_method) AS match_method, round(greatest(n.confidence, o.confidence), 6) AS confidence FROM mentions o FULL JOIN new n USING (article_id, company_id)")
def snk_04(s: Spark, d: str) -> DataFrame:
    old, new = _upsert_sides(s, d)
    return S.upsert(old, new, ["article_id", "company_id"], greatest=["confidence"]).withColumn("confidence", F.round("confidence", 6))


def _upsert_sides(s: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    old = mentions(s, d).select("article_id", "company_id", "match_method", "confidence")
    new = old.where("article_id % 3 <> 0").select("article_id", "company_id", F.lit("brand").alias("match_method"), F.expr("if(article_id % 2 = 0, 0.5D, 0.99D)").alias("confidence"))
    return old, new.unionByName(s.createDataFrame([(5, -1, "ticker", 0.7)], old.schema))


@query("snk_07_latest_annotation", "WITH notes AS (SELECT l_orderkey AS id, l_linenumber * 100 + ascii(l_returnflag) AS at, CASE l_returnflag WHEN 'R' THEN 'FACTUAL' WHEN 'A' THEN 'OPINION' ELSE 'SLOP' END AS label FROM lineitem) SELECT a.id, max_by(n.label, n.at) AS label, coalesce(max_by(n.label, n.at) = 'FACTUAL', false) AS ready FROM articles a LEFT JOIN notes n ON n.id = a.id GROUP BY a.id")
def snk_07(s: Spark, d: str) -> DataFrame:
    notes = table(s, d, "lineitem").selectExpr("l_orderkey as id", "l_linenumber * 100 + ascii(l_returnflag) as at", "case l_returnflag when 'R' then 'FACTUAL' when 'A' then 'OPINION' else 'SLOP' end as label")
    return S.with_latest(articles(s, d).select("id"), notes, "id", "at").select("id", "label", F.coalesce(F.col("label") == "FACTUAL", F.lit(False)).alias("ready"))


@query("snk_11_delete", "SELECT article_id, company_id FROM mentions WHERE NOT (company_id IN (3, 5) AND match_method IN ('alias', 'brand'))")
def snk_11(s: Spark, d: str) -> DataFrame:
    return S.delete(mentions(s, d), F.col("company_id").isin(3, 5) & F.col("match_method").isin("alias", "brand")).select("article_id", "company_id")


@query("snk_15_merge_report", "SELECT (SELECT count(*) FROM articles WHERE id % 2 = 0) AS staged, (SELECT count(*) FROM articles WHERE id % 2 = 0 AND id % 3 <> 0) AS inserted, (SELECT count(*) FROM articles WHERE id % 3 = 0) + (SELECT count(*) FROM articles WHERE id % 2 = 0 AND id % 3 <> 0) AS total")
def snk_15(s: Spark, d: str) -> DataFrame:
    a = articles(s, d).select("url", "id")
    return S.merge_report(a.where("id % 2 = 0"), a.where("id % 3 = 0"), "url", "id")


@query("snk_16_update_from", "SELECT a.id, coalesce(u.source, a.source) AS source FROM articles a LEFT JOIN (SELECT id, 'fixed' AS source FROM articles WHERE id % 10 = 0) u USING (id)")
def snk_16(s: Spark, d: str) -> DataFrame:
    a = articles(s, d).select("id", "source")
    return S.update_from(a, a.where("id % 10 = 0").withColumn("source", F.lit("fixed")), ["id"])
