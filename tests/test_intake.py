import json

import pytest
from pyspark.sql import functions as F
from tidewire.sources import connectors as N
from tidewire.sources import intake as I

GOOD = "<item><link>http://x/{}</link><title>T {}</title><pubDate>Mon, 02 Jan 2006 15:0{}:05 +0100</pubDate></item>"
FEEDS = ["wire", "desk"]


def feed(*items):
    return "<rss><channel>" + "".join(items) + "</channel></rss>"


def good(n):
    return GOOD.format(n, n, n % 10)


@pytest.fixture
def inbox(tmp_path):
    """Two listed feeds and one that is not: good, repeated, broken and incomplete items."""
    for name, files in {
        "wire": [feed(good(1), good(2), good(1)), feed("<item><title>no link</title></item>", good(3), "<item><link>http://x/9</link><title>cut <b></title></item>")],
        "desk": [feed(good(2), good(4)), feed("<item><link></link><title>empty</title></item>", good(5))],
        "else": [feed(good(5), good(6))],
    }.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        for i, text in enumerate(files):
            (tmp_path / "in" / name / f"{i}.xml").write_text(text)
    return tmp_path


def test_counts_and_quarantine_of_a_batch(spark, inbox):
    rows = N.rss(spark, str(inbox / "in/*"), None, faults=True)
    assert rows.schema.fieldNames() == N.CHECKED.fieldNames()
    counts = I.take_in(rows, None, str(inbox / "t"), FEEDS)
    # 2 and 5 came twice; the feed that is first by time, then name, has them.
    assert counts == {"wire": (2, 2, 2), "desk": (3, 0, 1), "(other)": (1, 1, 0)}
    assert {r.url for r in I.articles_of(spark, str(inbox / "t")).collect()} == {f"http://x/{i}" for i in range(1, 7)}
    bad = {(r.feed, r.fault) for r in I.quarantine_of(spark, str(inbox / "t")).collect()}
    assert bad == {("wire", "no url"), ("wire", "malformed"), ("desk", "no url")}
    (cut,) = I.quarantine_of(spark, str(inbox / "t")).where("fault = 'malformed'").collect()
    assert "http://x/9" in cut.record
    # The next batch knows the first one's urls, and running it again changes nothing.
    for _ in range(2):
        again = I.take_in(rows, I.articles_of(spark, str(inbox / "t")).where("batch = 0"), str(inbox / "t"), FEEDS, batch=1)
        assert again == {"wire": (0, 4, 2), "desk": (0, 3, 1), "(other)": (0, 2, 0)}
    assert I.articles_of(spark, str(inbox / "t")).count() == 6


def test_stream_counts_as_the_batch(spark, inbox):
    tally = I.Tally()
    spark.streams.addListener(tally)
    try:
        run = lambda: I.take_in_stream(N.rss(spark, str(inbox / "in/*"), None, faults=True, streaming=True), str(inbox / "s"), str(inbox / "ck"), FEEDS)
        run().awaitTermination()
        (inbox / "in/wire/late.xml").write_text(feed(good(6), good(7), "<item>"))
        run().awaitTermination()  # a restart: state is that of the checkpoint
        run().awaitTermination()  # nothing arrived
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(tally)
    assert {r.url for r in I.articles_of(spark, str(inbox / "s")).collect()} == {f"http://x/{i}" for i in range(1, 8)}
    assert I.articles_of(spark, str(inbox / "s")).count() == 7
    total = tally.total()
    assert tuple(sum(n[k] for n in total.values()) for k in range(2)) == (7, 4)
    assert sum(n[2] for n in total.values()) == I.quarantine_of(spark, str(inbox / "s")).count() == 3 + (total["wire"][2] - 2)


def test_faults_of_json_replies(spark):
    body = json.dumps([{"url": "u", "headline": "h", "datetime": 1}, {"headline": "no url"}, {"url": "v", "headline": ""}])
    rows = N.json_news(spark.createDataFrame([(body,), ("not json",), ("[]",), (None,)], "body string"), "T", faults=True).collect()
    assert sorted((r.url or "", r.fault or "") for r in rows) == [("", "malformed"), ("", "no url"), ("u", ""), ("v", "no title")]
    assert [r.record for r in rows if r.fault == "malformed"] == ["not json"]
    rows = N.json_sentiment(spark.createDataFrame([('{"feed": [{"title": "t"}]}',), ("{",), ('{"Note": "limit"}',)], "body string"), "T", faults=True).collect()
    assert sorted(r.fault for r in rows) == ["malformed", "malformed", "no url"]


def test_a_url_that_most_rows_share(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("u"), F.when(F.expr("id % 3 = 0"), F.col("id")).otherwise(1).cast("string")).alias("url"), F.lit("t").alias("title"), F.lit("").alias("summary"), F.lit("s").alias("source"), F.timestamp_seconds("id").alias("published_at"), F.lit(None).cast("string").alias("raw_json"), F.lit("wire").alias("feed"), F.lit(None).cast("string").alias("fault"), F.lit(None).cast("string").alias("record"))
    want = rows.select("url").distinct().count()
    assert I.take_in(rows, None, str(tmp_path / "t"), FEEDS) == {"wire": (want, 4000 - want, 0), "desk": (0, 0, 0)}
    (first,) = I.articles_of(spark, str(tmp_path / "t")).where("url = 'u1'").collect()
    assert first.published_at.timestamp() == 1
    assert I.take_in(rows.limit(0), None, str(tmp_path / "e"), ["a"]) == {"a": (0, 0, 0)}


def test_requests_and_companies(spark):
    t = spark.createDataFrame([(f"T{i:03}",) for i in range(120)] + [("T001",), (None,)], "ticker string")
    assert sorted(r["count"] for r in I.in_requests(t).groupBy("request").count().collect()) == [20, 50, 50]
    ready, n = I.companies_in_turn(spark.createDataFrame([("A", "1"), ("B", None), (None, "2")], "ticker string, cik string"))
    assert n == {"ready": 1, "err": 2} and ready.first().ticker == "A"
