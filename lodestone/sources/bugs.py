"""Tracker records from JSON, and readers of a paged HTTP interface.

Records dropped as JSON files are the main way in (and what the streams read).  The HTTP
readers are Python data sources with one partition: requests follow one another, at a pace.
"""

from __future__ import annotations

import datetime
import gzip
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import logs

TASKS = "bug_id long, title string, status string, importance string, assignee string, created timestamp, modified timestamp, duplicate_of long, complete boolean"
BUGS = "bug_id long, title string, description string, created timestamp, duplicate_of long, duplicate_count int, status string, importance string, assignee string, attachments array<struct<title:string,url:string,type:string>>"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks as JSON lines, oldest first where they are collected."""
    return spark.read.schema(TASKS).json(path)


def oldest_first(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.coalesce("created", F.lit("1970-01-01").cast("timestamp")), "bug_id")


class Pacer:
    """Requests at least ``interval`` apart; back-off doubles on 429 and 5xx, or waits as long as it is told."""

    def __init__(self, interval: float = 3.0, tries: int = 5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.tries, self.clock, self.sleep, self.last = interval, tries, clock, sleep, None

    def __call__(self, get: Callable[[], tuple[int, dict, bytes]]) -> bytes:
        wait = 5.0
        for attempt in range(self.tries):
            if self.last is not None and (rest := self.interval - (self.clock() - self.last)) > 0:
                self.sleep(rest)
            status, headers, body = get()
            self.last = self.clock()
            if status < 400:
                return body
            if status != 429 and status < 500 or attempt == self.tries - 1:
                raise OSError(f"HTTP {status}")
            told = headers.get("Retry-After", "")
            self.sleep(float(told) if told.isdigit() else wait)
            wait *= 2
        raise OSError("no tries left")


class Fetcher:
    """GET at a pace, asking again only for what has changed.

    ``known``: url to (ETag, body) from earlier calls; what the server then calls unmodified is taken from there.
    """

    def __init__(self, pace: Pacer, known: dict[str, tuple[str, bytes]] | None = None, opener: Callable = urllib.request.urlopen):
        self.pace, self.known, self.opener = pace, {} if known is None else known, opener

    def _get(self, url: str) -> tuple[int, dict, bytes]:
        tag = self.known.get(url, ("", b""))[0]
        request = urllib.request.Request(url, headers={"If-None-Match": tag} if tag else {})  # noqa: S310
        try:
            with self.opener(request, timeout=60) as r:
                return r.status, dict(r.headers), r.read()
        except urllib.error.HTTPError as e:  # a status of 300 and more is an answer too: 304, 429, 503
            return e.code, dict(e.headers or {}), e.read() if e.fp else b""

    def __call__(self, url: str) -> bytes:
        answer: dict = {}

        def get() -> tuple[int, dict, bytes]:
            answer["status"], answer["headers"], body = self._get(url)
            return answer["status"], answer["headers"], body

        body = self.pace(get)
        if answer["status"] == 304:
            return self.known[url][1]
        if tag := answer["headers"].get("ETag", ""):
            self.known[url] = (tag, body)
        return body


def pages(start: str, fetch: Callable[[str], bytes], most: int = 40) -> Iterator[tuple[list[dict], bool]]:
    """(entries, whether the listing ended here) of each page, following ``next_collection_link``."""
    url: str | None = start
    for _ in range(most):
        page = json.loads(fetch(url))
        url = page.get("next_collection_link")
        yield page.get("entries", []), url is None
        if url is None:
            return


def listing(start: str, fetch: Callable[[str], bytes], most: int = 40) -> tuple[list[dict], bool]:
    """(entries, whether the listing's end was reached): absence says something of a complete listing alone."""
    entries, complete = [], False
    for found, complete in pages(start, fetch, most):  # noqa: B007
        entries += found
    return entries, complete


def bug_number(link: str | None) -> int | None:
    tail = (link or "").rstrip("/").rsplit("/", 1)[-1]
    return int(tail) if tail.isdigit() else None


def person_name(link: str | None) -> str:
    return (link or "").rsplit("~", 1)[1] if "~" in (link or "") else ""


def stamp(text: str | None) -> datetime.datetime | None:
    return datetime.datetime.fromisoformat(text) if text else None


def task_row(entry: dict, complete: bool = True) -> tuple:
    return (bug_number(entry.get("bug_link")), entry.get("title"), entry.get("status"), entry.get("importance"), person_name(entry.get("assignee_link")), stamp(entry.get("date_created")), stamp(entry.get("date_modified")), bug_number(entry.get("duplicate_of_link")), complete)


def bug_row(base: str, number: int, fetch: Callable[[str], bytes], target: str = "", most: int = 40) -> tuple:
    """One bug with its master, the status of its task on ``target`` (else of its first), and its attachments' titles and links."""
    bug = json.loads(fetch(f"{base}/bugs/{number}"))
    follow = lambda name: listing(bug[name], fetch, most)[0] if bug.get(name) else []
    tasks = follow("bug_tasks_collection_link")
    task = next((t for t in tasks if target and (t.get("target_link") or "").endswith(target)), tasks[0] if tasks else {})
    files = [(a.get("title"), a.get("data_link"), a.get("type")) for a in follow("attachments_collection_link")]
    return (number, bug.get("title"), bug.get("description"), stamp(bug.get("date_created")), bug_number(bug.get("duplicate_of_link")), int(bug.get("number_of_duplicates") or 0), task.get("status"), task.get("importance"), person_name(task.get("assignee_link")), files)


class _Tasks(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        fetch = Fetcher(Pacer(float(self.options.get("interval", 3.0))))
        entries, complete = listing(self.options["url"], fetch, int(self.options.get("pages", 40)))
        yield from (task_row(e, complete) for e in entries)


class TrackerSource(DataSource):
    """A listing of tasks: ``spark.dataSource.register(TrackerSource)``, ``spark.read.format("bug_tracker").option("url", ...)``.

    ``complete`` is false in every row of a listing that was cut off after ``pages`` pages.
    """

    @classmethod
    def name(cls) -> str:
        return "bug_tracker"

    def schema(self) -> str:
        return TASKS

    def reader(self, schema) -> DataSourceReader:
        return _Tasks(self.options)


class _Bugs(_Tasks):
    def read(self, partition):
        fetch = Fetcher(Pacer(float(self.options.get("interval", 3.0))))
        for number in self.options["bugs"].split(","):
            yield bug_row(self.options["url"].rstrip("/"), int(number), fetch, self.options.get("target", ""))


class BugSource(DataSource):
    """Single bugs by number (option ``bugs``, comma-separated) with task, master and attachments; format ``bug_reports``."""

    @classmethod
    def name(cls) -> str:
        return "bug_reports"

    def schema(self) -> str:
        return BUGS

    def reader(self, schema) -> DataSourceReader:
        return _Bugs(self.options)


def attachment_texts(bugs: DataFrame, interval: float = 3.0) -> DataFrame:
    """(bug_id, title, text) of the attachments of ``bugs`` that may be logs, for ``logs.attachments``; read by one paced task."""
    wanted = bugs.select("bug_id", F.explode("attachments").alias("a")).select("bug_id", "a.title", "a.url").where(~logs.is_irrelevant(F.col("title")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = Fetcher(Pacer(interval))
        for pdf in batches:
            for bug, title, url in zip(pdf["bug_id"], pdf["title"], pdf["url"], strict=True):
                body = fetch(url)
                text = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
                yield pd.DataFrame({"bug_id": [bug], "title": [title], "text": [text.decode("utf-8", "replace")]})

    return wanted.coalesce(1).mapInPandas(read, "bug_id long, title string, text string")
