import datetime as dt

import pytest
from pyspark.sql import functions as F

from webloom.plans.crawl import Crawl
from webloom.settings import CrawlSettings
from webloom.sources.fetch import CorpusAdapter

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HTML = "text/html; charset=UTF-8"
RESPONSE = "url string, status int, content_type string, headers array<struct<name:string,value:string>>, protocol string, body binary, failed boolean"


def response(url, body="", status=200, kind=HTML, headers=(), failed=False):
    return (url, status, kind, list(headers), "HTTP/1.1", body.encode(), failed)


def web(spark, settings):
    pages = [
        response("http://a.example/", '<a href="/1">x</a><a href="/private">x</a><a href="http://b.example/#top">x</a>'), response("http://a.example/1", '<a href="/2">x</a><a href="/">x</a>'),
        response("http://a.example/2", '<a href="/3">x</a>', headers=[("X-Robots-Tag", "nofollow")]), response("http://b.example/", '<a href="/m">x</a>'), response("http://b.example/m", status=302, headers=[("Location", "/n")]),
        response("http://b.example/n", '<a href="/o">x</a>', kind="text/plain"), response("http://b.example/bad", failed=True),
    ]
    robots = [response("http://a.example/robots.txt", "User-agent: *\nDisallow: /private", kind="text/plain; charset=UTF-8"), response("http://b.example/robots.txt", status=301, headers=[("Location", "http://b.example/r")]), response("http://b.example/r", "User-agent: *\nCrawl-delay: 0", kind="text/plain; charset=utf-8")]
    return CorpusAdapter(spark.createDataFrame(pages, RESPONSE), spark.createDataFrame(robots, RESPONSE), settings)


def state_of(crawl):
    return {r.url: (r.status, r.crawl_depth) for r in crawl.state.pages().collect()}


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    seen = []
    settings = CrawlSettings(prioritize=lambda c: -F.col("crawl_depth"), consume=lambda results: seen.append(results.count()) or results.select("url", "outcome"), max_attempts=2, compact_every=4)
    crawl = Crawl(spark, f"file://{tmp_path_factory.mktemp('crawl')}", web(spark, settings), settings)
    rounds = crawl.run(["http://A.example:80", "http://b.example/bad", "not a url"], rounds=12, as_of=T0)
    return crawl, rounds, seen


def test_crawl_reaches_everything_once(finished):
    crawl, rounds, _ = finished
    assert state_of(crawl) == {
        "http://a.example/": ("Processed", 0), "http://a.example/1": ("Processed", 1), "http://a.example/2": ("Processed", 2), "http://b.example/": ("Processed", 1), "http://b.example/m": ("Processed", 2), "http://b.example/n": ("Processed", 2),
        "http://b.example/bad": ("Discovered", 0),
    }
    attempts = {r.url: r.attempts for r in crawl.state.pages().collect()}
    assert attempts["http://b.example/bad"] == 2


def test_user_code_sees_each_fetch(spark, finished):
    crawl, rounds, seen = finished
    consumed = spark.read.option("recursiveFileLookup", True).parquet(f"{crawl.path}/consumed")
    assert sum(seen) == sum(r.fetched for r in rounds) == consumed.count()
    assert {(r.url, r.outcome) for r in consumed.collect()} >= {("http://b.example/m", "Redirect"), ("http://b.example/bad", "Exception"), ("http://a.example/2", "Success")}
    edges = spark.read.option("recursiveFileLookup", True).parquet(f"{crawl.path}/edges")
    assert edges.where("dst_url = 'http://a.example/private'").count() == 1


def test_stopped_crawl_goes_on(spark, tmp_path, finished):
    settings = CrawlSettings(prioritize=lambda c: -F.col("crawl_depth"), max_attempts=2)
    path = f"file://{tmp_path}"
    Crawl(spark, path, web(spark, settings), settings).run(["http://a.example/", "http://b.example/bad"], rounds=1, as_of=T0)
    later = Crawl(spark, path, web(spark, settings), settings)
    later.run(rounds=12, as_of=T0 + dt.timedelta(minutes=1))
    assert state_of(later) == state_of(finished[0])


def test_depth_limit_and_disallowed_pages(spark, tmp_path):
    settings = CrawlSettings(max_crawl_depth=0)
    crawl = Crawl(spark, f"file://{tmp_path}", web(spark, settings), settings)
    crawl.state.insert_pages(spark.createDataFrame([("http://a.example/private", "Discovered", 0, 1)], "url string, status string, crawl_depth int, crawl_priority bigint"))
    crawl.run(["http://a.example/"], rounds=4, as_of=T0)
    assert state_of(crawl) == {"http://a.example/": ("Processed", 0), "http://a.example/private": ("Disallowed", 0)}
