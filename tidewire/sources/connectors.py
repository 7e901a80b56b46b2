"""Feeds as one article model: RSS, Atom, ticker RSS, JSON news, CSV, HTML tables.

Every connector is a function to ``ARTICLE`` rows. Records that are malformed, or
without url or title, are left out; with ``faults`` they stay, and each row has
its feed (the folder of its file), its fault (null where it is good) and, if it
has one, the record as it came. ``intake`` counts and keeps both kinds apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as X

from ..functions import text as T
from ..functions import time as D

ARTICLE = X.StructType(
    [
        X.StructField("url", X.StringType()), X.StructField("title", X.StringType()), X.StructField("summary", X.StringType()),
        X.StructField("source", X.StringType()), X.StructField("published_at", X.TimestampType()), X.StructField("raw_json", X.StringType()),
    ]
)
_ITEM = "link string, title string, summary string, description string, author string, guid string, category array<string>, pubDate string, published string, updated string, created string, _corrupt_record string"
_TICKER_ITEM = "link string, title string, guid string, pubDate string, `sa:author_name` string, `sa:stock` array<struct<`sa:symbol`: string>>, _corrupt_record string"
_ENTRY = "title string, link struct<_href: string>, updated string, summary string, _corrupt_record string"
_NEWS = "array<struct<url: string, headline: string, summary: string, source: string, datetime: long, category: string, image: string, related: string, id: string>>"
_SENTIMENT = "struct<feed: array<struct<url: string, title: string, summary: string, source: string, time_published: string, overall_sentiment_score: string, overall_sentiment_label: string, authors: array<string>, topics: array<struct<topic: string, relevance_score: string>>, ticker_sentiment: array<struct<ticker: string, relevance_score: string, ticker_sentiment_score: string, ticker_sentiment_label: string>>>>>"


#: What a connector adds with ``faults``.
CHECKED = X.StructType([*ARTICLE.fields, X.StructField("feed", X.StringType()), X.StructField("fault", X.StringType()), X.StructField("record", X.StringType())])
_KEPT = ("_feed", "_bad", "_record")


def _xml(spark: SparkSession, path: str, row: str, schema: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", 100) if streaming else spark.read
    rows = reader.format("xml").option("rowTag", row).option("mode", "PERMISSIVE").schema(schema).load(path)
    feed = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return rows.select("*", feed.alias("_feed"), F.col("_corrupt_record").alias("_bad"), F.coalesce("_corrupt_record", F.to_json(F.struct(*rows.columns))).alias("_record"))


def _articles(rows: DataFrame, faults: bool = False) -> DataFrame:
    """The good rows; with ``faults`` all, and why a row is none (its parsed columns may then be null)."""
    lacks = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad = F.col("_bad") if "_bad" in rows.columns else F.lit(None)
    fault = F.when(bad.isNotNull(), "malformed").when(lacks("url"), "no url").when(lacks("title"), "no title")
    own = [F.col(f.name).cast(f.dataType).alias(f.name) for f in ARTICLE.fields]
    if not faults:
        return rows.where(fault.isNull()).select(*own)
    feed = F.col("_feed") if "_feed" in rows.columns else F.col("source")
    return rows.select(*own, feed.alias("feed"), fault.alias("fault"), F.when(fault.isNotNull(), F.col("_record")).alias("record"))


def rss(spark: SparkSession, path: str, name: str | None, faults: bool = False, streaming: bool = False) -> DataFrame:
    """Items of RSS 2.0 files; 'No title' without title; the description where the summary is missing; the first date that parses.

    ``name`` is the source; without it, the folder of the file names it, so many feeds are one read or one stream.
    """
    rows = _xml(spark, path, "item", _ITEM, streaming)
    dates = [D.rfc2822(F.col(c)) for c in ("pubDate", "published")] + [D.iso8601(F.col(c)) for c in ("published", "updated", "created")]
    raw = F.to_json(F.struct(F.coalesce("author", F.lit("")).alias("author"), F.coalesce("category", F.array().cast("array<string>")).alias("tags"), F.coalesce("guid", F.lit("")).alias("id")))
    return _articles(rows.select(F.trim("link").alias("url"), F.coalesce("title", F.lit("No title")).alias("title"), F.coalesce("summary", "description", F.lit("")).alias("summary"), (F.lit(name) if name else F.col("_feed")).alias("source"), D.first_of(*dates).alias("published_at"), raw.alias("raw_json"), *_KEPT), faults)


def atom_filings(spark: SparkSession, path: str, ticker: str, cik: str, faults: bool = False) -> DataFrame:
    """Entries of a filings feed whose title names a known form."""
    rows = _xml(spark, path, "entry", _ENTRY).withColumn("form", T.filing_type("title")).where("form is not null or _bad is not null")
    raw = F.to_json(F.struct(F.lit(ticker).alias("ticker"), F.lit(cik).alias("cik"), F.col("form").alias("filing_type")))
    return _articles(rows.select(F.col("link._href").alias("url"), "title", F.coalesce("summary", F.lit("")).alias("summary"), F.lit(f"SEC EDGAR ({ticker})").alias("source"), D.iso8601(F.col("updated")).alias("published_at"), raw.alias("raw_json"), *_KEPT), faults)


def filings_of(companies: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filings of companies with ticker and cik, and how many companies lack one (counted as errors)."""
    ready = companies.where("ticker is not null and cik is not null")
    errors = companies.agg(F.count_if(F.col("ticker").isNull() | F.col("cik").isNull()).alias("errors"))
    return filings.join(ready.select("ticker", "cik"), ["ticker", "cik"]), errors


def ticker_rss(spark: SparkSession, path: str, ticker: str, strip_offset: bool = True, faults: bool = False) -> DataFrame:
    """Items of a ticker's feed; the guid replaces generic links, the summary names up to ten tickers."""
    rows = _xml(spark, path, "item", _TICKER_ITEM)
    symbols = F.filter(F.transform(F.coalesce("`sa:stock`", F.array().cast("array<struct<`sa:symbol`: string>>")), lambda x: x["sa:symbol"]), lambda x: x.isNotNull())
    rows = rows.withColumn("_s", symbols)
    more = F.when(F.size("_s") > 10, F.concat(F.lit(" and "), (F.size("_s") - 10).cast("string"), F.lit(" more"))).otherwise("")
    summary = F.when(F.size("_s") > 0, F.concat(F.lit("Mentions: "), F.array_join(F.slice("_s", 1, 10), ", "), more)).otherwise("")
    url = F.when(F.col("link").isNotNull(), F.when(F.col("guid").contains("seekingalpha.com/Market"), F.col("guid")).otherwise(F.trim("link")))
    date = D.rfc2822_local(F.col("pubDate")) if strip_offset else D.rfc2822(F.col("pubDate"))
    raw = F.to_json(F.struct(F.lit(ticker).alias("primary_ticker"), F.col("_s").alias("mentioned_tickers"), F.coalesce("`sa:author_name`", F.lit("Unknown")).alias("author"), "guid"))
    return _articles(rows.select(url.alias("url"), "title", summary.alias("summary"), F.lit(f"Seeking Alpha ({ticker})").alias("source"), date.alias("published_at"), raw.alias("raw_json"), *_KEPT), faults)


def _items(replies: DataFrame, items: Column) -> DataFrame:
    """The items of ``replies`` (body), and a row for each body that cannot be read."""
    rows = replies.select("body", items.alias("_items")).where("body is not null")
    bad = F.when(F.col("_items").isNull(), F.col("body"))
    rows = rows.select(bad.alias("_bad"), F.explode_outer("_items").alias("x")).where("x is not null or _bad is not null")
    return rows.select("x.*", "_bad", F.coalesce("_bad", F.to_json("x")).alias("_record"))


def json_news(replies: DataFrame, ticker: str, faults: bool = False) -> DataFrame:
    """Company news from ``replies`` (body: a JSON array of items with epoch seconds)."""
    rows = _items(replies, F.from_json("body", _NEWS))
    raw = F.to_json(F.struct(F.lit(ticker).alias("ticker"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("image", F.lit("")).alias("image"), F.coalesce("related", F.lit("")).alias("related"), F.coalesce("id", F.lit("")).alias("finnhub_id")))
    when = F.when(F.col("datetime") != 0, D.epoch(F.col("datetime")))
    return _articles(rows.select("url", F.coalesce("headline", F.lit("No title")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.concat(F.lit("Finnhub ("), F.coalesce("source", F.lit("Unknown")), F.lit(")")).alias("source"), when.alias("published_at"), raw.alias("raw_json"), "_bad", "_record"), faults)


def json_sentiment(replies: DataFrame, ticker: str, faults: bool = False) -> DataFrame:
    """News with sentiment from ``replies`` (body): the ticker's own sentiment where the item has it, else the overall one; in raw_json."""
    rows = _items(replies, F.from_json("body", _SENTIMENT)["feed"])
    own = F.get(F.filter("ticker_sentiment", lambda t: F.upper(t["ticker"]) == ticker.upper()), F.lit(0))
    overall = F.coalesce(F.col("overall_sentiment_score").try_cast("double"), F.lit(0.0))
    score, label = F.coalesce(own["ticker_sentiment_score"].try_cast("double"), overall), F.coalesce(own["ticker_sentiment_label"], "overall_sentiment_label", F.lit("Neutral"))
    raw = F.to_json(F.struct(F.lit(ticker).alias("ticker"), "authors", "topics", overall.alias("overall_sentiment_score"), own.alias("ticker_sentiment"), score.alias("sentiment_score"), label.alias("sentiment_label")))
    return _articles(rows.select("url", F.coalesce("title", F.lit("No title")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.concat(F.lit("Alpha Vantage ("), F.coalesce("source", F.lit("Unknown")), F.lit(")")).alias("source"), D.compact(F.col("time_published")).alias("published_at"), raw.alias("raw_json"), "_bad", "_record"), faults)


def cik_map(replies: DataFrame) -> DataFrame:
    """(ticker, cik) from ``replies`` (body: an object of objects with cik_str and ticker): upper case, ten digits."""
    rows = replies.select(F.explode(F.map_values(F.from_json("body", "map<string, struct<cik_str: string, ticker: string, title: string>>"))).alias("x"))
    return rows.select(F.upper("x.ticker").alias("ticker"), F.lpad("x.cik_str", 10, "0").alias("cik")).where("ticker is not null and cik is not null").distinct()


def html_cells(pages: DataFrame, page: str, html: str, least: int = 7) -> DataFrame:
    """(page, row, cells) of table rows with ``least`` cells and more; tags inside cells are cut."""
    rows = pages.select(F.col(page), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "_r"))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(T.strip_tags(c)))
    return rows.select(page, "row", cells.alias("cells")).where(F.size("cells") >= least)


def page_articles(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html) as articles: title and text without tags, scripts and styles."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?is)<head\b.*?</head>", " ")
    text = F.trim(F.regexp_replace(T.strip_tags(body), r"\s+", " "))
    none = F.lit(None).cast("string")
    return _articles(pages.select("url", title.alias("title"), text.alias("summary"), F.lit("web").alias("source"), F.lit(None).cast("timestamp").alias("published_at"), none.alias("raw_json")))


def csv_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(ARTICLE).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def all_feeds(*feeds: DataFrame) -> DataFrame:
    """The rows of all connectors in one table; connectors that have nothing (yet) are empty."""
    out = feeds[0].sparkSession.createDataFrame([], ARTICLE) if feeds else None
    for f in feeds:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def windowed_range(days_back: int, today: Column) -> tuple[Column, Column]:
    """The from and to dates of a request."""
    return F.date_format(F.date_sub(today, days_back), "yyyy-MM-dd"), F.date_format(today, "yyyy-MM-dd")
