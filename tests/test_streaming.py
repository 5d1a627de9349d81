"""Streams: admission of candidates, host queues with delays of their own, distinct URLs, idle periods, batches."""

import datetime as dt
import time


from webloom.plans.crawl import Crawl
from webloom.settings import CrawlSettings
from webloom.sources.fetch import CorpusAdapter
from webloom.streaming.continuous import admit_stream, batch_writer, distinct_stream, idle_stream
from webloom.streaming.host_queue import host_queues

RESPONSE = "url string, status int, content_type string, headers array<struct<name:string,value:string>>, protocol string, body binary, failed boolean"


def files(spark, path, frames):
    """A stream of Parquet files, one file each."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(f"file://{path}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}")


def drained(stream, name, checkpoint, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{checkpoint}").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect()


def test_admitted_once(spark, tmp_path):
    schema = "url string, crawl_depth int"
    stream = files(spark, tmp_path / "in", [spark.createDataFrame([("http://a.example/", 0), ("HTTP://A.example", 0)], schema), spark.createDataFrame([("http://a.example/", 1), ("http://a.example/1", 1)], schema)])
    crawl = Crawl(spark, f"file://{tmp_path}/crawl", CorpusAdapter(spark.createDataFrame([], RESPONSE)), CrawlSettings())
    q = admit_stream(crawl, stream, f"file://{tmp_path}/check")
    q.awaitTermination(240)
    assert {(r.url, r.crawl_depth) for r in crawl.state.pages().collect()} == {("http://a.example/", 0), ("http://a.example/1", 1)}


def test_distinct_and_idle_streams(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    after = lambda url, minutes: (url, at + dt.timedelta(minutes=minutes))
    frames = [spark.createDataFrame(rows, "url string, ts timestamp") for rows in ([after("http://a/", 0)], [after("http://a/", 1)], [after("http://c/", 30)], [after("http://b/", 39), after("http://a/", 40)])]
    found = drained(distinct_stream(files(spark, tmp_path / "d", frames), "ts", "10 minutes"), "distinct_urls", tmp_path / "dc")
    # the repeat a minute later goes; the one after 40 minutes stays if its state was dropped by then
    assert {r.url for r in found} == {"http://a/", "http://b/", "http://c/"} and len(found) in (3, 4)
    late = spark.createDataFrame([("http://z/", at + dt.timedelta(hours=9))], "url string, ts timestamp")
    periods = drained(idle_stream(files(spark, tmp_path / "i", [*frames, late]), "url", "ts", "5 minutes", "1 minute"), "idle_urls", tmp_path / "ic")
    assert sorted((r.url, r.events) for r in periods) == [("http://a/", 1), ("http://a/", 2), ("http://b/", 1), ("http://c/", 1)]


def test_batches_of_a_stream(spark, tmp_path):
    frames = [spark.createDataFrame([(i,)], "n int") for i in range(3)]
    q = batch_writer(files(spark, tmp_path / "in", frames), f"file://{tmp_path}/out", f"file://{tmp_path}/check", 100)
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [0, 1, 2]


def test_host_queues_keep_each_hosts_delay(spark, tmp_path):
    """By priority, each URL once; a host with a delay of its own waits that long, one without waits the default."""
    schema = "scheme_and_authority string, url string, crawl_depth int, crawl_priority bigint, crawl_delay bigint"
    rows = [("http://slow", f"http://slow/{i}", 0, i, 3000) for i in range(3)] + [("http://slow", "http://slow/2", 0, 2, 3000)] + [("http://fast", f"http://fast/{i}", 0, i, None) for i in range(3)]
    stream = files(spark, tmp_path / "in", [spark.createDataFrame(rows, schema)])
    q = host_queues(stream, 50).writeStream.format("memory").queryName("releases").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 150
        while time.time() < end and spark.table("releases").count() < 6:
            time.sleep(1)
    finally:
        q.stop()
    got = spark.table("releases").collect()
    for host, least in (("http://slow", 3000), ("http://fast", 50)):
        own = sorted((r.released_ms, r.url) for r in got if r.scheme_and_authority == host)
        assert [u for _, u in own] == [f"{host}/{i}" for i in (2, 1, 0)]
        assert all(b - a > least for (a, _), (b, _) in zip(own, own[1:]))


def test_empty_stream(spark, tmp_path):
    stream = files(spark, tmp_path / "in", [spark.createDataFrame([], "url string, ts timestamp")])
    assert drained(distinct_stream(stream, "ts", "1 minute"), "none_at_all", tmp_path / "check") == []
