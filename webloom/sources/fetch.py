"""Where responses come from: a table of stored responses, or HTTP."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField

from ..operators.responses import robots_outcome
from ..schemas import HEADERS, RESPONSE
from ..settings import CrawlSettings
from .scratch import checkpointed


class FetchAdapter(Protocol):
    def pages(self, requests: DataFrame) -> DataFrame:
        """requests with the columns of schemas.RESPONSE (failed where nothing came), one row each."""

    def robots(self, hosts: DataFrame) -> DataFrame:
        """(scheme_and_authority, outcome, body): Response, Unavailable or Unreachable."""


class CorpusAdapter:
    """Stored responses (schemas.RESPONSE), joined by URL. URLs that aren't stored answer 404.

    robots: stored robots.txt responses, their url scheme://authority/robots.txt; redirects among them are followed."""

    def __init__(self, responses: DataFrame, robots: DataFrame | None = None, settings: CrawlSettings = CrawlSettings()):
        self.responses, self.stored, self.settings = responses, robots, settings

    @staticmethod
    def of_pages(pages: DataFrame, robots: DataFrame | None = None, settings: CrawlSettings = CrawlSettings()) -> CorpusAdapter:
        """From pages (url, html): all are 200 and HTML."""
        rows = pages.select(
            "url", F.lit(200).alias("status"), F.lit("text/html; charset=UTF-8").alias("content_type"), F.array().cast(HEADERS).alias("headers"), F.lit("HTTP/1.1").alias("protocol"), F.encode("html", "UTF-8").alias("body"), F.lit(False).alias("failed")
        )
        return CorpusAdapter(rows, robots, settings)

    def pages(self, requests: DataFrame) -> DataFrame:
        joined = requests.join(self.responses, "url", "left")
        absent = F.col("failed").isNull()
        return joined.withColumns({"status": F.when(absent, 404).otherwise(F.col("status")), "failed": F.coalesce("failed", F.lit(False)), "headers": F.coalesce("headers", F.array().cast(HEADERS))})

    def robots(self, hosts: DataFrame) -> DataFrame:
        if self.stored is None:
            return hosts.select("scheme_and_authority", F.lit("Unavailable").alias("outcome"), F.lit(None).cast("binary").alias("body"))
        from ..functions.urls import redirect_url
        from ..operators.responses import header

        todo = hosts.select("scheme_and_authority", F.concat("scheme_and_authority", F.lit("/robots.txt")).alias("url"), F.lit(0).alias("hops"))
        done: list[DataFrame] = []
        for _ in range(self.settings.robots_max_redirects + 1):
            got = todo.join(self.stored, "url", "left").withColumn("location", redirect_url(F.col("url"), header(F.col("headers"), "location")))
            absent = F.col("failed").isNull()
            outcome = F.when(absent, "Unavailable").otherwise(robots_outcome(F.col("failed"), F.col("status"), F.col("content_type"), F.col("location"), F.col("hops"), self.settings.robots_max_redirects))
            got = checkpointed(got.select("scheme_and_authority", outcome.alias("outcome"), "body", "location", "hops"))
            done.append(got.where("outcome <> 'Redirect'").select("scheme_and_authority", "outcome", F.when(F.col("outcome") == "Response", F.col("body")).alias("body")))
            todo = got.where("outcome = 'Redirect'").select("scheme_and_authority", F.col("location").alias("url"), (F.col("hops") + 1).alias("hops"))
            if todo.isEmpty():
                break
        out = done[0]
        for x in done[1:]:
            out = out.unionByName(x)
        return out


class Throttle:
    """A bucket of bytes: take() waits until so many a second are not exceeded."""

    def __init__(self, rate: int):
        self.rate, self.free_at = rate, time.monotonic()

    def take(self, n: int) -> None:
        now = time.monotonic()
        self.free_at = max(now, self.free_at) + n / self.rate
        if self.free_at > now + 1e-4:
            time.sleep(self.free_at - now)


def http_get(url: str, limit: int, throttle: Throttle, timeout: float, follow: int) -> dict:
    """One GET. The body is read up to limit + 1 bytes (so that a longer one shows), as fast as throttle lets; follow: redirects that are followed here."""
    class Hold(urllib.request.HTTPRedirectHandler):
        max_redirections = follow

        def redirect_request(self, *args):
            return super().redirect_request(*args) if follow else None

    try:
        try:
            reply = urllib.request.build_opener(Hold()).open(url, timeout=timeout)
        except urllib.error.HTTPError as error:
            reply = error
        body = b""
        while len(body) <= limit and (part := reply.read(min(16_384, limit + 1 - len(body)))):
            throttle.take(len(part))
            body += part
        headers = [{"name": k, "value": v} for k, v in reply.headers.items()]
        return {"status": reply.status, "content_type": reply.headers.get("Content-Type"), "headers": headers, "protocol": "HTTP/1.1", "body": body, "failed": False, "error": None}
    except (OSError, http.client.HTTPException, ValueError) as error:
        return {"status": None, "content_type": None, "headers": [], "protocol": None, "body": None, "failed": True, "error": type(error).__name__}


class Clock:
    """When the requests of each host may go: not before their time, and as far from the one before as their times are, also when those are late."""

    def __init__(self) -> None:
        self.last: dict[str, tuple[float, float]] = {}

    def wait(self, host: str, micros: int | None) -> None:
        if micros is None:
            return
        at = now = micros / 1e6
        if host in self.last:
            went, planned = self.last[host]
            now = max(at, went + at - planned)
        if (left := now - time.time()) > 0:
            time.sleep(left)
        self.last[host] = (time.time(), at)


class HttpAdapter:
    """HTTP from the executors. A task is a fetcher: it has whole hosts and sends one request at a time, each not before its eligible_at where
    requests have that column, at its share of the bandwidth. Not idempotent: write the result before using it twice."""

    def __init__(self, settings: CrawlSettings = CrawlSettings(), timeout: float = 10.0):
        self.settings, self.timeout = settings, timeout

    def fetch(self, requests: DataFrame, limit: int, rate: int, follow: int, tasks: int) -> DataFrame:
        timeout = self.timeout
        timed = "eligible_at" in requests.columns
        asked = requests.withColumn("__at", F.unix_micros("eligible_at") if timed else F.lit(None).cast("bigint"))
        extra = [f for f in requests.schema if f.name not in RESPONSE.names or f.name == "url"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            throttle, clock = Throttle(rate), Clock()
            for batch in batches:
                got = []
                for host, url, at in zip(*(batch.column(c).to_pylist() for c in ("scheme_and_authority", "url", "__at"))):
                    clock.wait(host, at)
                    got.append(http_get(url, limit, throttle, timeout, follow))
                columns = {f.name: batch.column(f.name) for f in extra}
                types = {"status": pa.int32(), "content_type": pa.string(), "headers": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), "protocol": pa.string(), "body": pa.binary(), "failed": pa.bool_(), "error": pa.string()}
                columns |= {k: pa.array([g[k] for g in got], t) for k, t in types.items()}
                yield pa.RecordBatch.from_pydict(columns)

        schema = type(RESPONSE)([*extra, *(f for f in RESPONSE if f.name != "url"), StructField("error", StringType())])
        ordered = asked.select(*[f.name for f in extra], "__at").repartition(tasks, "scheme_and_authority").sortWithinPartitions("__at", "url")
        return ordered.mapInArrow(run, schema)

    def pages(self, requests: DataFrame) -> DataFrame:
        """As many fetchers as the hosts, the nodes and the bandwidth allow (schedule.fetcher_target), which share the bandwidth of their node."""
        s = self.settings
        queues = requests.select("scheme_and_authority").distinct().count()
        target = max(1, min(queues, 1 + queues // s.nodes, s.total_bandwidth // s.min_bandwidth_per_fetcher))
        return self.fetch(requests, s.max_content_length, s.total_bandwidth // target, 0, target * s.nodes)

    def robots(self, hosts: DataFrame) -> DataFrame:
        s = self.settings
        asked = hosts.withColumn("url", F.concat("scheme_and_authority", F.lit("/robots.txt")))
        got = self.fetch(asked, s.robots_max_content_length, s.robots_bandwidth, s.robots_max_redirects, s.robots_max_concurrent * s.nodes)
        outcome = robots_outcome(F.col("failed"), F.col("status"), F.col("content_type"), F.lit(None).cast("string"), F.lit(0), 0)
        return got.withColumn("outcome", outcome).select("scheme_and_authority", "outcome", F.when(F.col("outcome") == "Response", F.col("body")).alias("body"))


class UrlPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class HttpSource(DataSource):
    """spark.read.format("webloom_http").option("urls", "http://a/ http://b/").load(): their responses."""

    @classmethod
    def name(cls) -> str:
        return "webloom_http"

    def schema(self):
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        urls = self.options.get("urls", "").split()
        n = max(1, int(self.options.get("partitions", "8")))
        return [UrlPartition(urls[i::n]) for i in range(min(n, max(1, len(urls))))]

    def read(self, partition):
        throttle = Throttle(int(self.options.get("rate", "200000")))
        for url in partition.urls:
            r = http_get(url, int(self.options.get("limit", "1000000")), throttle, float(self.options.get("timeout", "10")), 0)
            yield (url, r["status"], r["content_type"], [(h["name"], h["value"]) for h in r["headers"]], r["protocol"], r["body"], r["failed"])
