"""The HTTP adapter against a server on this machine, the data source, and state in a database."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from webloom.operators import metrics
from webloom.operators.responses import classify_pages
from webloom.schemas import HOST, PAGE
from webloom.settings import CrawlSettings
from webloom.sources.fetch import HttpAdapter, HttpSource, Throttle
from webloom.sources.state import read_jdbc, write_jdbc


class Site(BaseHTTPRequestHandler):
    seen: list[tuple[str, str, float]] = []
    busy = 0
    most = 0
    lock = threading.Lock()

    def do_GET(self):
        with Site.lock:
            Site.seen.append((self.headers["Host"], self.path, time.time()))
            Site.busy += 1
            Site.most = max(Site.most, Site.busy)
        time.sleep(0.05)
        body, kind, status, more = b"<a href='/x'>x</a>", "text/html; charset=UTF-8", 200, {}
        if self.path == "/robots.txt":
            body, kind = b"User-agent: *\nDisallow: /private", "text/plain; charset=UTF-8"
        elif self.path == "/moved":
            status, more = 302, {"Location": "/there"}
        elif self.path == "/gone":
            status = 404
        elif self.path == "/long":
            body = b"x" * 5000
        with Site.lock:
            Site.busy -= 1
        self.send_response(status)
        self.send_header("Content-Type", kind)
        for k, v in more.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Site.seen, Site.busy, Site.most = [], 0, 0
    yield [f"http://{name}:{server.server_port}" for name in ("127.0.0.1", "localhost")]
    server.shutdown()
    server.server_close()


def requests(spark, rows):
    return spark.createDataFrame(rows, "scheme_and_authority string, url string, crawl_depth int, eligible_at timestamp")


def test_pages_are_fetched_and_classified(spark, site):
    a = site[0]
    paths = ["/", "/moved", "/gone", "/long"]
    rows = requests(spark, [(a, a + p, 1, None) for p in paths] + [("http://127.0.0.1:1", "http://127.0.0.1:1/", 1, None)])
    got = classify_pages(HttpAdapter(CrawlSettings(max_content_length=1000)).pages(rows), 1000).cache()
    found = {r.url: r for r in got.collect()}
    assert {u.rpartition("/")[2] or u: r.outcome for u, r in found.items() if u.startswith(a)} == {a + "/": "Success", "moved": "Redirect", "gone": "Error", "long": "LengthLimitExceeded"}
    assert found[a + "/moved"].redirect_to == a + "/there" and found[a + "/long"].body == b""
    assert found["http://127.0.0.1:1/"].outcome == "Exception" and found["http://127.0.0.1:1/"].error
    (failed,) = metrics.exceptions(got).collect()
    assert failed.value == 1 and failed.attrs["exception"] == found["http://127.0.0.1:1/"].error
    got.unpersist()


def test_a_host_gets_one_request_at_a_time_at_its_time(spark, site):
    now = time.time() + 8  # Spark needs a while to begin
    rows = [(h, f"{h}/{i}", 0, now + 1.0 * i) for h in site for i in range(4)]
    frame = spark.createDataFrame(rows, "scheme_and_authority string, url string, crawl_depth int, at double").withColumn("eligible_at", F.timestamp_micros((F.col("at") * 1e6).cast("bigint"))).drop("at")
    assert HttpAdapter(CrawlSettings()).pages(frame).where("status = 200").count() == 8
    assert Site.most <= 2
    for host in {h for h, _, _ in Site.seen}:
        times = sorted((int(p[1:]), t) for h, p, t in Site.seen if h == host)
        assert [i for i, _ in times] == [0, 1, 2, 3]
        assert all(t >= now + 1.0 * i - 0.01 for i, t in times)
        assert all(b - a >= 0.6 for (_, a), (_, b) in zip(times, times[1:]))


def test_concurrency_stays_within_the_settings(spark, site):
    port = site[0].rpartition(":")[2]
    hosts = [f"http://127.0.0.{i}:{port}" for i in range(1, 30)]  # one machine by many names; those that don't answer fail
    frame = spark.createDataFrame([(h,) for h in hosts], "scheme_and_authority string")
    adapter = HttpAdapter(CrawlSettings(robots_max_concurrent=2), timeout=3)
    got = {r.scheme_and_authority: r for r in adapter.robots(frame).collect()}
    assert len(got) == 29 and Site.most <= 2
    assert got[site[0]].outcome == "Response" and b"/private" in got[site[0]].body
    few = HttpAdapter(CrawlSettings(total_bandwidth=400_000, min_bandwidth_per_fetcher=200_000))
    Site.most = 0
    few.pages(frame.withColumn("url", F.concat("scheme_and_authority", F.lit("/")))).count()
    assert Site.most <= 2


def test_throttle():
    throttle = Throttle(100_000)
    began = time.monotonic()
    for _ in range(10):
        throttle.take(5000)
    assert 0.4 <= time.monotonic() - began < 1.5


def test_http_source(spark, site):
    spark.dataSource.register(HttpSource)
    got = spark.read.format("webloom_http").option("urls", f"{site[0]}/ {site[0]}/gone").load().collect()
    assert sorted(r.status for r in got) == [200, 404]


def test_state_in_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    pages = spark.createDataFrame([("http://a/", "Discovered", 0, 5), ("http://b/", "Processed", 1, -2)], PAGE)
    hosts = spark.createDataFrame([("http://a", "ALLOW_ALL", "", 1000, None)], HOST)
    for frame, table, schema in ((pages, "pages", PAGE), (hosts, "hosts", HOST)):
        write_jdbc(frame, url, table, batch=CrawlSettings().page_insert_batch[0], **options)
        write_jdbc(frame.limit(1), url, table, **options)
        back = read_jdbc(spark, url, table, schema, **options)
        assert back.schema.names == schema.names
        assert sorted(map(tuple, back.collect()), key=repr) == sorted([*map(tuple, frame.collect()), tuple(frame.limit(1).first())], key=repr)
