"""The article API as a streaming source: pages by a cursor until there are no more, under a limit of requests.

    spark.dataSource.register(ArticleFeed)
    spark.readStream.format("article_feed").option("url", "http://host/api/v1/articles/feed").load()

The API takes ``since`` (exclusive, by classified_at), ``limit`` and ``key``, and
answers {"data": [...], "meta": {"has_more": ...}} by rising classified_at, then id.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "id long, url string, title string, summary string, source string, classification_label string, classification_confidence double, classified_at string"
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]


class Limiter:
    """At most ``most`` requests in any ``window`` seconds, retries included: each waits until the request ``most`` before it is out of the window.

    ``times`` are those of the latest requests; handing them to the next limiter carries the limit over a restart.
    """

    def __init__(self, most: int, window: float, times: list[float] = (), clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.most, self.window, self.clock, self.sleep = most, window, clock, sleep
        self.times: deque[float] = deque(times, maxlen=most)

    def wait(self) -> None:
        while len(self.times) == self.most and (rest := self.times[0] + self.window - self.clock()) > 0:
            self.sleep(rest)
        self.times.append(self.clock())


def fetched(url: str, limiter: Limiter, tries: int = 3, timeout: float = 30.0) -> dict:
    """The JSON answer of ``url``; a failed request is tried again, within the limit."""
    for left in reversed(range(tries)):
        limiter.wait()
        try:
            with urllib.request.urlopen(url, timeout=timeout) as reply:
                return json.load(reply)
        except (urllib.error.URLError, TimeoutError, json.JSONDecodeError):
            if not left:
                raise
    raise ValueError("tries must be positive")


def _before(stamp: str) -> str:
    """The instant before, so that an exclusive ``since`` gives rows of the same time again."""
    return (datetime.fromisoformat(stamp) - timedelta(microseconds=1)).isoformat()


class ArticleFeedReader(SimpleDataSourceStreamReader):
    """Offsets are the last classified_at seen, the ids seen at it, and the times of recent requests.

    Several rows may share a time and a page may end among them, so the last time
    is asked for again and the ids known at it are left out; a page that holds
    nothing but known ones is asked for with twice the rows.
    """

    def __init__(self, options: dict[str, str]):
        self.url, self.key = options["url"], options.get("key")
        self.page, self.pages = int(options.get("page", 100)), int(options.get("maxPages", 1000))
        self.limit = int(options.get("maxRequests", 60)), float(options.get("perSeconds", 60))

    def initialOffset(self) -> dict:
        return {"at": None, "ids": [], "requests": []}

    def _page(self, at: str | None, ids: set, limiter: Limiter) -> tuple[list[dict], bool]:
        size = self.page + len(ids)
        while True:
            asked = {"limit": size, **({"since": _before(at)} if at else {}), **({"key": self.key} if self.key else {})}
            answer = fetched(f"{self.url}?{urllib.parse.urlencode(asked)}", limiter)
            new = [r for r in answer["data"] if not (r["classified_at"] == at and r["id"] in ids)]
            more = bool(answer["meta"]["has_more"])
            if new or not more:
                return new, more
            size *= 2

    def _rows(self, start: dict, limiter: Limiter, pages: int) -> Iterator[dict]:
        """All rows after ``start``, page by page until has_more is false."""
        at, ids = start["at"], set(start["ids"])
        for _ in range(pages):
            new, more = self._page(at, ids, limiter)
            for r in new:
                if r["classified_at"] != at:
                    at, ids = r["classified_at"], set()
                ids.add(r["id"])
                yield r
            if not more:
                return

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        limiter = Limiter(*self.limit, start["requests"])
        rows = list(self._rows(start, limiter, self.pages))
        end = dict(start)
        if rows:
            at = rows[-1]["classified_at"]
            known = start["ids"] if start["at"] == at else []
            end = {"at": at, "ids": sorted({*known, *(r["id"] for r in rows if r["classified_at"] == at)}), "requests": list(limiter.times)}
        return iter([tuple(r.get(c) for c in COLUMNS) for r in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again, after a failure: those after ``start`` up to ``end``."""
        last = set(end["ids"])
        for r in self._rows(start, Limiter(*self.limit, end["requests"]), 1 << 30):
            if r["classified_at"] > end["at"]:
                return
            if r["classified_at"] < end["at"] or r["id"] in last:
                yield tuple(r.get(c) for c in COLUMNS)


class ArticleFeed(DataSource):
    """Options: url, key, page (rows asked for at once), maxPages of a batch, maxRequests perSeconds."""

    @classmethod
    def name(cls) -> str:
        return "article_feed"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> ArticleFeedReader:
        return ArticleFeedReader(self.options)
