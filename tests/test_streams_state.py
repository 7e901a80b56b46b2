import json
import threading
import time
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidewire.plans.fixtures import table
from tidewire.sources.api import ArticleFeed, ArticleFeedReader, Limiter
from tidewire.streaming import matching as M
from tidewire.streaming.slots import Slots

SF = "/root/testdata/sf0.001"


class Feed:
    """An API over a list of rows: since is exclusive and by time alone, as pages are; every third request fails."""

    def __init__(self, rows, flaky=True):
        feed = self
        self.rows, self.times, self.flaky = rows, [], flaky

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                feed.times.append(time.time())
                if feed.flaky and len(feed.times) % 3 == 0:
                    self.send_error(503)
                    return
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                page = [r for r in sorted(feed.rows, key=lambda r: (r["classified_at"], r["id"])) if r["classified_at"] > q.get("since", "")][: int(q["limit"])]
                body = json.dumps({"data": page, "meta": {"has_more": len(page) == int(q["limit"])}}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/feed"


def made(ids, step=7):
    """Rows of which ``step`` share a time, more than a page holds."""
    return [{"id": i, "url": f"u{i}", "title": f"t{i}", "classification_label": "FACTUAL", "classification_confidence": 0.5, "classified_at": (datetime(2024, 1, 1) + timedelta(seconds=i // step)).isoformat()} for i in ids]


@pytest.fixture
def feed():
    f = Feed(made(range(40)))
    yield f
    f.server.shutdown()


def test_pages_lose_and_repeat_nothing(feed):
    for page in (1, 3, 7, 8, 100):
        reader = ArticleFeedReader({"url": feed.url, "page": str(page), "maxRequests": "100000"})
        rows, end = reader.read(reader.initialOffset())
        assert [r[0] for r in rows] == list(range(40))
        assert end["at"] == made([39])[0]["classified_at"] and set(end["ids"]) == {35, 36, 37, 38, 39}
        assert list(reader.read(end)[0]) == []
        # A batch of two pages, then the same between its offsets.
        short = ArticleFeedReader({"url": feed.url, "page": str(page), "maxPages": "2", "maxRequests": "100000"})
        rows, middle = short.read(short.initialOffset())
        rows = list(rows)
        assert list(short.readBetweenOffsets(short.initialOffset(), middle)) == rows
        assert list(reader.readBetweenOffsets(middle, end)) == [r for r in reader.read(reader.initialOffset())[0] if r not in rows]


def test_limit_holds_over_retries_and_restarts(feed):
    most, window = 4, 0.4
    reader = ArticleFeedReader({"url": feed.url, "page": "3", "maxRequests": str(most), "perSeconds": str(window), "maxPages": "3"})
    offset = reader.initialOffset()
    for _ in range(3):
        _, offset = reader.read(json.loads(json.dumps(offset)))
    t = feed.times
    assert len(t) > 2 * most and all(t[i + most] - t[i] >= window - 0.05 for i in range(len(t) - most))


def test_limiter_by_a_clock():
    now = [0.0]
    limiter = Limiter(3, 10.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    stamps = []
    for _ in range(10):
        limiter.wait()
        stamps.append(now[0])
        now[0] += 1
    assert stamps[:4] == [0, 1, 2, 10] and all(b - a >= 10 for a, b in zip(stamps, stamps[3:]))


def test_the_feed_as_a_stream(spark, feed, tmp_path):
    feed.flaky = False
    spark.dataSource.register(ArticleFeed)
    start = lambda: spark.readStream.format("article_feed").option("url", feed.url).option("page", 5).option("maxRequests", 100000).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    def ids():
        parts = list((tmp_path / "out").glob("*.parquet"))  # none before the first batch with rows
        return sorted(r.id for r in spark.read.schema("id long").parquet(str(tmp_path / "out")).collect()) if parts else []

    def until(n):
        query, end = start(), time.time() + 60
        try:
            while len(ids()) < n and time.time() < end and query.exception() is None:
                time.sleep(0.3)
        finally:
            query.stop()
        assert query.exception() is None

    until(40)
    assert ids() == list(range(40))
    feed.rows += made(range(40, 50))  # two of them at the last time seen
    until(50)
    assert ids() == list(range(50))


def slots(tmp_path, log=None, fail=()):
    def stage(name):
        def run(rows):
            if name in fail:
                raise RuntimeError("stopped")
            return rows.select("id", F.lit(name).alias("stage"))

        return run

    return Slots(str(tmp_path / "root"), {n: stage(n) for n in ("map", "classify", "cluster")}, after={"cluster": "classify"})


def articles(spark, ids):
    return spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=10 * i)) for i in ids], "id long, fetched_at timestamp")


def state(spark, s):
    return {n: sorted((r.id, r.slot) for r in s.results(spark, n).collect()) for n in s.stages}


def test_slots_claim_once_and_can_be_repeated(spark, tmp_path):
    s, rows = slots(tmp_path), articles(spark, range(24))
    for h in range(4):
        s.run(rows, datetime(2024, 1, 1, h))
    want = [(i, f"s20240101T0{i // 6}0000") for i in range(24)]
    assert state(spark, s) == dict.fromkeys(s.stages, want)
    s.run(rows, datetime(2024, 1, 1, 2))
    assert state(spark, s) == dict.fromkeys(s.stages, want)
    # An article that reached the table late is claimed by the next slot, once, if it came within the overlap.
    late = rows.unionByName(spark.createDataFrame([(100, datetime(2024, 1, 1, 2, 5)), (101, datetime(2024, 1, 1, 0, 5))], rows.schema))
    s.run(late, datetime(2024, 1, 1, 4))
    s.run(late, datetime(2024, 1, 1, 5))
    got = state(spark, s)["map"]
    assert [r for r in got if r[0] >= 100] == [(100, "s20240101T040000")]


def test_a_failed_slot_ends_as_if_it_had_not(spark, tmp_path):
    rows = articles(spark, range(12))
    broken = slots(tmp_path, fail=("classify",))
    with pytest.raises(RuntimeError):
        broken.run(rows, datetime(2024, 1, 1, 0))
    s = slots(tmp_path)
    s.run(rows, datetime(2024, 1, 1, 0))
    s.run(rows, datetime(2024, 1, 1, 1))
    assert state(spark, s) == dict.fromkeys(s.stages, [(i, f"s20240101T0{i // 6}0000") for i in range(12)])


def test_slots_as_a_stream(spark, tmp_path):
    s = slots(tmp_path)
    articles(spark, range(12)).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    arrivals = lambda: spark.readStream.schema("id long, fetched_at timestamp").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    s.stream(arrivals(), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    articles(spark, range(12, 15)).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    s.stream(arrivals(), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    assert state(spark, s) == dict.fromkeys(s.stages, [(i, f"s20240101T0{i // 6}0000") for i in range(15)])


def plain_days(batches, threshold):
    """The same, batch by batch, with a dictionary for state."""
    known, out = {}, []
    for batch in batches:
        for day, rows in batch.groupby("day"):
            ids, vectors = known.get(day, ([], []))
            found, heads = M.matched(rows["id"].to_numpy(), np.array(rows["vector"].tolist(), float), list(ids), np.array(vectors), threshold)
            unit = M.C.unit_rows(rows["vector"])
            known[day] = (ids + rows["id"].iloc[heads].tolist(), [*vectors, *unit[heads]])
            out += [(day, *r) for r in found.itertuples(index=False)]
    return sorted(out)


def test_day_state_equals_batches_also_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = table(spark, SF, "embeddings").selectExpr("vec_id as id", "embedding as vector", "timestamp_seconds(86400 * (label % 3)) as at", "timestamp_seconds(1000000 + vec_id) as fetched_at")
    parts = [rows.where(f"id % 3 = {k}") for k in range(3)]
    run = lambda: M.day_stream(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), 0.2)
    for k, part in enumerate(parts):  # each a run of its own, so state comes from the checkpoint
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        run().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("day", "id", "centroid_id", "distance", "is_centroid").collect())
    batches = [pd.DataFrame([r.asDict() for r in M.by_day(p).collect()]) for p in parts]
    want = plain_days(batches, 0.2)
    assert len(got) == rows.count() and [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(a[3] - b[3]) < 1e-8 for a, b in zip(got, want))
    assigned = spark.read.parquet(str(tmp_path / "out"))
    again = M.recluster_noise(assigned, rows.select("id", "vector"), 0.1, days=3).collect()
    alone = {g[1] for g in got if sum(x[2] == g[2] for x in got) == 1}
    assert again and {r.id for r in again} <= alone
    assert {r.centroid_id for r in again} == {r.id for r in again if r.is_centroid}
