"""Fetching and crawling: one host belongs to one task, which keeps its distance between requests.

The transport is a function ``(url, headers, timeout) -> Answer`` that a caller may replace; nothing
is fetched before the DataFrame is used.  A page that cannot be fetched comes out with an error.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import rules
from ..functions import kernels
from . import registry

FETCHED = "url string, status int, content binary, content_type string, charset string, error string, fetched_at timestamp"


@dataclass
class Answer:
    status: int
    content: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == name), None)


def http_get(url: str, headers: dict, timeout: float) -> Answer:
    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as got:
            return Answer(got.status, got.read(), dict(got.headers))
    except HTTPError as refused:
        return Answer(refused.code, refused.read(), dict(refused.headers))


@dataclass
class Fetcher:
    """Fetches politely: spacing per host, robots rules, and new tries after a pause of random length."""

    agent: str = "docketry"
    rate_per_sec: float = 1.0
    timeout: float = 30.0
    retries: int = 3
    backoff: float = 0.5
    robots: bool = True
    get: Callable = http_get
    sleep: Callable = time.sleep
    now: Callable = time.monotonic
    chance: Callable = random.random

    def __post_init__(self):
        if self.rate_per_sec <= 0:
            raise ValueError("rate_per_sec must be positive")
        self._next: dict[str, float] = {}
        self._rules: dict[str, RobotFileParser | None] = {}

    def wait(self, host: str) -> None:
        """Return when the next request to the host is due."""
        now, due = self.now(), self._next.get(host, 0.0)
        if due > now:
            self.sleep(due - now)
        self._next[host] = max(now, due) + 1.0 / self.rate_per_sec

    def allowed(self, url: str) -> bool:
        """By the host's robots.txt; without one, or where it cannot be read, everything is."""
        parts = urlsplit(url)
        host = f"{parts.scheme}://{parts.netloc}"
        if host not in self._rules:
            rules_ = None
            try:
                got = self.get(f"{host}/robots.txt", {"User-Agent": self.agent}, self.timeout)
                if got.status < 400:
                    rules_ = RobotFileParser()
                    rules_.parse(got.content.decode("utf-8", "replace").splitlines())
            except Exception:  # noqa: BLE001 - a transport may fail in any way
                rules_ = None
            self._rules[host] = rules_
        known = self._rules[host]
        return known is None or known.can_fetch(self.agent, url)

    def pause(self, attempt: int, answer: Answer | None) -> float:
        """Seconds before the next try: what the server asks for, else up to backoff * 2 ** attempt."""
        asked = answer.header("retry-after") if answer else None
        try:
            return float(asked)
        except (TypeError, ValueError):
            return self.chance() * self.backoff * 2**attempt

    def fetch(self, url: str) -> tuple[Answer | None, str | None]:
        """(answer, error): the last answer, whatever its status, unless none came."""
        if self.robots and not self.allowed(url):
            return None, "not allowed by robots.txt"
        answer = error = None
        for attempt in range(self.retries + 1):
            self.wait(urlsplit(url).netloc)
            try:
                answer, error = self.get(url, {"User-Agent": self.agent}, self.timeout), None
            except Exception as failed:  # noqa: BLE001
                answer, error = None, f"{type(failed).__name__}: {failed}"
            if answer is not None and answer.status not in rules.RETRY_STATUS:
                break
            if attempt < self.retries:
                self.sleep(self.pause(attempt, answer))
        return answer, error

    def row(self, url: str) -> tuple:
        answer, error = self.fetch(url)
        if answer is not None and answer.status >= 400:
            error = f"status {answer.status}"
        kind = (answer.header("content-type") if answer else None) or None
        charset = next((p.split("=", 1)[1].strip(" \"'") for p in (kind or "").split(";") if p.strip().lower().startswith("charset=")), None)
        return url, answer.status if answer else None, answer.content if answer else None, kind, charset, error, datetime.now(UTC)


def fetch(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """FETCHED for each different url of the column ``url``; all urls of a host are fetched by one task, in turn."""
    rows = urls.select("url").where("url is not null").distinct().withColumn("host", F.parse_url("url", F.lit("HOST")))

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([fetcher.row(u) for u in frame["url"]], columns=[c.split()[0] for c in FETCHED.split(", ")])

    return rows.repartition("host").select("url").mapInPandas(run, FETCHED)


def as_raw(fetched: DataFrame) -> DataFrame:
    """Adds content_format, and text: what the bytes say in their character set, "" for PDF."""
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    out = fetched.withColumn("content_format", registry.detect_format(F.col("content_type"), head))
    text = kernels.decode_udf(F.when(F.col("content_format") != "pdf", F.col("content")), F.col("charset"))
    return out.withColumn("text", F.when(F.col("content_format") == "pdf", F.lit("")).otherwise(text))


def crawl(sources: DataFrame, adapters: DataFrame, fetcher: Fetcher) -> DataFrame:
    """FETCHED with source_id and jurisdiction for the pages that the enabled sources link to.

    Links come from a feed's items or a page's anchors that fit the source's adapter; a source
    without an adapter gives its own url; one whose page cannot be read gives nothing.
    """
    own = registry.for_sources(registry.enabled(sources).select("id", "jurisdiction", "url", "source_type"), adapters)
    entries = as_raw(fetch(own.where("has_adapter"), fetcher)).select("url", "text", "content_format", "error")
    read = own.where("has_adapter").join(entries, "url").where("error is null")
    feed = registry.is_feed(F.col("source_type"), F.col("content_format"))
    read = read.withColumn("feed", feed).withColumn("page", kernels.parse_html_udf(F.when(~F.col("feed"), F.col("text"))))
    hrefs = F.when(F.col("feed"), kernels.feed_udf(F.when(F.col("feed"), F.col("text")))).otherwise(F.col("page.hrefs"))
    patterns = F.when(F.col("feed"), F.array().cast("array<string>")).otherwise(F.col("patterns"))
    links = read.select("id", "jurisdiction", F.explode(kernels.links_udf(F.col("url"), hrefs, patterns, F.col("same_host"))).alias("url"))
    links = links.unionByName(own.where("not has_adapter").select("id", "jurisdiction", "url")).withColumnRenamed("id", "source_id")
    return links.distinct().join(fetch(links, fetcher), "url")


@dataclass
class _Part(InputPartition):
    urls: list[str]


class PageSource(DataSource):
    """``spark.read.format("pages").option("urls", "...")``: pages by their urls, blank-separated, a partition per host."""

    fetcher = Fetcher()

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options.get("urls", "").split(), self.fetcher)


class _PageReader(DataSourceReader):
    def __init__(self, urls: list[str], fetcher: Fetcher):
        self.urls, self.fetcher = urls, fetcher

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for url in dict.fromkeys(self.urls):
            hosts.setdefault(urlsplit(url).netloc, []).append(url)
        return [_Part(u) for u in hosts.values()]

    def read(self, partition):
        for url in partition.urls:
            yield self.fetcher.row(url)


def register(spark: SparkSession, source: type[PageSource] = PageSource) -> None:
    """Makes the format known; a subclass may bring its own ``fetcher``."""
    spark.dataSource.register(source)
