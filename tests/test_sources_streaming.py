import datetime as dt
import json

from pyspark.sql import functions as F
from tidewire.operators import clustering as C
from tidewire.plans.fixtures import table
from tidewire.sources import connectors as N
from tidewire.streaming import ingest as G


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<rss><channel><item><link>http://x/1</link><title>One</title><description>d</description><pubDate>Mon, 02 Jan 2006 15:04:05 +0100</pubDate><category>a</category></item>"
        "<item><title>no link</title></item><item><link>http://x/2</link><summary>s</summary><published>2024-02-03T04:05:06Z</published></item></channel></rss>"
    )
    got = {r.url: r for r in N.rss(spark, str(tmp_path), "Wire").collect()}
    assert set(got) == {"http://x/1", "http://x/2"} and got["http://x/2"].title == "No title" and got["http://x/1"].summary == "d"
    assert got["http://x/1"].published_at == dt.datetime(2006, 1, 2, 14, 4, 5) and got["http://x/2"].published_at == dt.datetime(2024, 2, 3, 4, 5, 6)
    assert json.loads(got["http://x/1"].raw_json)["tags"] == ["a"]


def test_ticker_rss_and_filings(spark, tmp_path):
    stocks = "".join(f"<sa:stock><sa:symbol>T{i}</sa:symbol></sa:stock>" for i in range(12))
    (tmp_path / "t.xml").write_text(f'<rss xmlns:sa="https://seekingalpha.com/api/1.0"><channel><item><title>A</title><link>http://l</link><guid>https://seekingalpha.com/MarketCurrents/1</guid><pubDate>Tue, 03 Jan 2006 10:00:00 -0500</pubDate>{stocks}</item><item><title>B</title><link>http://b</link></item></channel></rss>')
    a, b = sorted(N.ticker_rss(spark, str(tmp_path / "t.xml"), "T0").collect(), key=lambda r: r.title)
    assert a.url.startswith("https://seekingalpha.com/Market") and a.summary.endswith("T9 and 2 more") and a.published_at == dt.datetime(2006, 1, 3, 10) and b.summary == "" and b.source == "Seeking Alpha (T0)"
    (tmp_path / "f.xml").write_text('<feed><entry><title>8-K of X</title><link href="http://f/1"/><updated>2024-01-01T00:00:00-05:00</updated></entry><entry><title>S-1</title><link href="http://f/2"/></entry></feed>')
    (f,) = N.atom_filings(spark, str(tmp_path / "f.xml"), "X", "0000000001").collect()
    assert f.url == "http://f/1" and f.published_at == dt.datetime(2024, 1, 1, 5) and json.loads(f.raw_json)["filing_type"] == "8-K"


def test_json(spark):
    news = spark.createDataFrame([(json.dumps([{"url": "u", "headline": "h", "datetime": 1700000000, "source": "S"}, {"headline": "no url"}]),), ("not json",)], "body string")
    (r,) = N.json_news(news, "T").collect()
    assert (r.title, r.source, r.published_at) == ("h", "Finnhub (S)", dt.datetime(2023, 11, 14, 22, 13, 20))
    feed = {"feed": [{"url": "u", "title": "t", "time_published": "20240131T123000", "overall_sentiment_score": 0.1, "overall_sentiment_label": "Neutral", "ticker_sentiment": [{"ticker": "aa", "ticker_sentiment_score": "0.5", "ticker_sentiment_label": "Bullish"}]}]}
    (r,) = N.json_sentiment(spark.createDataFrame([(json.dumps(feed),)], "body string"), "AA").collect()
    assert json.loads(r.raw_json)["sentiment_score"] == 0.5 and r.published_at == dt.datetime(2024, 1, 31, 12, 30)
    (m,) = N.cik_map(spark.createDataFrame([(json.dumps({"0": {"cik_str": 320193, "ticker": "abc", "title": "x"}}),)], "body string")).collect()
    assert (m.ticker, m.cik) == ("ABC", "0000320193")


def test_html_csv_union(spark, tmp_path):
    page = spark.createDataFrame([("p", "<table><tr><td>1</td><td><a>x</a></td></tr><tr>" + "<td>c</td>" * 7 + "</tr></table>")], "page string, html string")
    assert N.html_cells(page, "page", "html").collect()[0].cells == ["c"] * 7
    rows = N.all_feeds(N.page_articles(table(spark, "/root/testdata/sf0.001", "pages")), spark.createDataFrame([("u", 'a "quoted", title', "line\ntwo", "s", None, None)], N.ARTICLE))
    N.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(str, N.csv_articles(spark, str(tmp_path / "csv")).select("url", "title").collect())) == sorted(map(str, rows.select("url", "title").collect()))


def test_stream_equals_batch(spark, tmp_path):
    events = table(spark, "/root/testdata/sf0.001", "events").selectExpr("concat('u', cast(user_id as string)) as url", "event_id", "cast(ts as timestamp) as fetched_at")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = G.article_stream(spark, str(tmp_path / "in"), events.schema, max_files=1)
    beat = G.Heartbeat()
    spark.streams.addListener(beat)
    G.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("url").distinct().count() == events.select("url").distinct().count()
    G.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()  # nothing is new
    assert spark.read.parquet(str(tmp_path / "out")).count() == out.count() and not beat.failing()
    spark.streams.removeListener(beat)


def test_windows_in_a_stream(spark, tmp_path):
    events = table(spark, "/root/testdata/sf0.001", "events").selectExpr("event_type as source", "cast(ts as timestamp) as published_at")
    events.write.parquet(str(tmp_path / "in"))
    q = G.windowed_counts(G.article_stream(spark, str(tmp_path / "in"), events.schema), 36).writeStream.outputMode("complete").format("memory").queryName("w36").trigger(availableNow=True).start()
    q.awaitTermination()
    want = events.groupBy(F.window("published_at", "36 hours"), "source").count()
    assert spark.table("w36").count() == want.count() and spark.table("w36").agg(F.sum("n")).first()[0] == events.count()


def test_centroid_stream(spark, tmp_path):
    v = table(spark, "/root/testdata/sf0.001", "embeddings").selectExpr("vec_id as id", "embedding as vector", "cast(label as long) as block")
    old, new = v.where("id % 3 = 1"), v.where("id % 3 = 0")
    old.write.parquet(str(tmp_path / "c/batch=-1"))
    new.coalesce(1).write.parquet(str(tmp_path / "in"))
    G.match_stream(spark.readStream.schema(new.schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "m"), str(tmp_path / "ck"), 0.2).awaitTermination()
    matched, _ = C.incremental(new, old, 0.2)
    assert {(r.id, r.centroid_id) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {(r.id, r.centroid_id) for r in matched.collect()}
