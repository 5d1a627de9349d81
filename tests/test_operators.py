import datetime as dt

import pytest
from pyspark.sql import functions as F

from webloom.operators import batches, candidates, hosts, responses, schedule
from webloom.settings import CrawlSettings
from webloom.sources.state import ParquetState, apply_status, latest


def rows(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_settings_from_mapping():
    assert CrawlSettings.of({"must_match": ["a"], "max_crawl_depth": 3}).must_match == ("a",)
    with pytest.raises(ValueError, match="unknown settings: nope"):
        CrawlSettings.of({"nope": 1})


def test_url_filter(spark):
    frame = spark.createDataFrame([("http://a/1", 0), ("http://a/22", 0), ("http://b/1", 0), (None, 0)], "url string, crawl_depth int")
    assert rows(candidates.url_filter(frame, CrawlSettings(must_match=("http://a/.*",), must_not_match=(".*22",))), "url") == [("http://a/1",)]
    assert candidates.url_filter(frame, CrawlSettings(must_match=())).count() == 0
    assert rows(candidates.url_filter(frame, CrawlSettings(max_url_length=10)), "url") == [("http://a/1",), ("http://b/1",)]
    # a character beyond the basic plane counts twice
    assert spark.createDataFrame([("é😃",)], "u string").select(candidates.short_enough(F.col("u"), 2).alias("x")).first().x is False


def test_unseen_keeps_the_least_depth(spark):
    found = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "url string, crawl_depth int")
    assert rows(candidates.unseen(found, spark.createDataFrame([("b",)], "url string")), "url", "crawl_depth") == [("a", 1)]


def test_links_go_one_deeper_and_redirects_do_not(spark):
    pages = spark.createDataFrame([("http://a/", 2, '<a href="/x">'), ("http://b/", 0, "")], "url string, crawl_depth int, html string")
    assert rows(candidates.from_links(pages), "url", "crawl_depth") == [("http://a/x", 3)]
    results = spark.createDataFrame([("Redirect", "http://c/", 2), ("Redirect", None, 2), ("Error", "http://d/", 1)], "outcome string, redirect_to string, crawl_depth int")
    assert rows(candidates.from_redirects(results), "url", "crawl_depth") == [("http://c/", 2)]


def test_strict_and_lenient(spark):
    known = spark.createDataFrame([("http://a", "ALLOW_SOME", "disallow: /x", 0, None), ("http://n", "ALLOW_NONE", "", 0, None)], "scheme_and_authority string, rule_mode string, robot_rules string, crawl_delay bigint, valid_until timestamp")
    urls = spark.createDataFrame([("http://a/x1",), ("http://a/y",), ("http://n/",), ("http://new/",)], "url string")
    assert rows(hosts.strict(urls, known), "url", "verdict") == [("http://a/x1", "Disallowed"), ("http://a/y", "Allowed"), ("http://n/", "Disallowed"), ("http://new/", "Ignored")]
    assert rows(hosts.lenient(urls, known), "url") == [("http://a/y",), ("http://new/",)]


def test_queue_never_releases_too_soon(spark):
    pages = spark.createDataFrame([("http://a", f"http://a/{i}", i % 2) for i in range(5)] + [("http://a", "http://a/0", 0)], "scheme_and_authority string, url string, crawl_priority bigint")
    info = spark.createDataFrame([("http://a", 1000)], "scheme_and_authority string, crawl_delay bigint")
    start = F.timestamp_millis(F.lit(1_000_000))
    got = sorted((r.at, r.url) for r in schedule.politeness(schedule.queue_rank(pages), info, start).select(F.unix_millis("eligible_at").alias("at"), "url").collect())
    assert [u for _, u in got] == ["http://a/1", "http://a/3", "http://a/0", "http://a/2", "http://a/4"]
    assert [t for t, _ in got] == [1_000_000 + 1000 * i for i in range(5)]
    assert schedule.released(schedule.politeness(schedule.queue_rank(pages), info, start), F.timestamp_millis(F.lit(1_001_000))).count() == 1  # at the time itself is too soon


def test_robots_refresh_reuses_old_rules(spark):
    now = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("http://b", "ALLOW_SOME", "disallow: /q", 7, now)], "scheme_and_authority string, rule_mode string, robot_rules string, crawl_delay bigint, valid_until timestamp")
    fetched = spark.createDataFrame([("http://a", "Unreachable", None), ("http://b", "Unreachable", None), ("http://c", "Unavailable", None), ("http://d", "Response", b"User-agent: *\nDisallow: /\nCrawl-delay: 99")], "scheme_and_authority string, outcome string, body binary")
    got = rows(hosts.refresh(fetched, old, F.lit(now).cast("timestamp")), "scheme_and_authority", "rule_mode", "robot_rules", "crawl_delay", "valid_until", "action")
    hour, day = now + dt.timedelta(hours=1), now + dt.timedelta(hours=24)
    assert got == [("http://a", "ALLOW_NONE", "", 1000, hour, "Insert"), ("http://b", "ALLOW_SOME", "disallow: /q", 7, hour, "Update"), ("http://c", "ALLOW_ALL", "", 1000, day, "Insert"), ("http://d", "ALLOW_NONE", "disallow: /", 20_000, day, "Insert")]


def test_classification_order(spark):
    frame = spark.createDataFrame([("u1", 404, b"x", True), ("u2", 404, b"x", False), ("u3", 301, b"x", False), ("u4", 200, b"x" * 11, False), ("u5", 200, b"x" * 10, False), ("u6", 204, None, False)], "url string, status int, body binary, failed boolean")
    frame = frame.withColumn("headers", F.expr("array(named_struct('name','LOCATION','value','http://z/'))")).withColumn("content_type", F.lit("text/html"))
    got = rows(responses.classify_pages(frame, 10), "url", "outcome", "redirect_to")
    assert got == [("u1", "Exception", None), ("u2", "Error", None), ("u3", "Redirect", "http://z/"), ("u4", "LengthLimitExceeded", None), ("u5", "Success", None), ("u6", "Success", None)]


def test_latest_and_status(spark):
    events = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 2), ("b", None, 1)], "url string, status string, seq bigint")
    assert sorted(map(tuple, latest(events, "url").select("url", "seq").collect())) == [("a", 3), ("b", 1)]
    pages = spark.createDataFrame([("a", "D"), ("b", "D")], "url string, status string")
    assert rows(apply_status(pages, spark.createDataFrame([("b", "P"), ("c", "P")], "url string, status string")), "url", "status") == [("a", "D"), ("b", "P")]


def test_state_store(spark, tmp_path):
    state = ParquetState(spark, f"file://{tmp_path}")
    assert state.pages().count() == 0 and state.last_seq() == 0
    page = "url string, status string, crawl_depth int, crawl_priority bigint"
    state.insert_pages(spark.createDataFrame([("a", "Discovered", 0, 5), ("b", "Discovered", 0, 9), ("c", "Discovered", 1, 9)], page))
    state.update_status(spark.createDataFrame([("b", "Processed"), ("nope", "Processed")], "url string, status string"))
    assert [r.url for r in state.find_by_status("Discovered", 10).collect()] == ["c", "a"]
    assert state.find_page("b").first().status == "Processed" and state.find_page("zz").count() == 0
    before = rows(state.pages(), "url", "status")
    state.compact()
    assert rows(state.pages(), "url", "status") == before and len(state._folders("pages")) == 1
    with pytest.raises(Exception, match="unknown page status"):
        state.update_status(spark.createDataFrame([("a", "Lost")], "url string, status string"))
    host = "scheme_and_authority string, rule_mode string, robot_rules string, crawl_delay bigint, valid_until timestamp"
    state.upsert_hosts(spark.createDataFrame([("http://a", "ALLOW_ALL", "", 1, None)], host))
    state.upsert_hosts(spark.createDataFrame([("http://a", "ALLOW_NONE", "", 2, None)], host))
    assert state.find_host("http://a").first().crawl_delay == 2


def brute_batches(times, size, delay):
    out, held, number, first = [], 0, 0, 0
    for t in times:
        if held and t - first >= delay:
            held, number = 0, number + 1
        first = t if not held else first
        held += 1
        out.append(number)
        if held > 1 and held >= size:
            held, number = 0, number + 1
    return out


@pytest.mark.parametrize(("size", "delay"), [(1, 10), (3, 100), (2, 5)])
def test_size_or_time(spark, size, delay):
    times = [0, 1, 2, 3, 20, 21, 40, 60, 61, 62, 63, 64]
    frame = spark.createDataFrame([("k", t) for t in times], "k string, t bigint")
    got = [b for _, b in rows(batches.by_size_or_time(frame, "k", F.col("t"), size, delay), "t", "batch")]
    assert got == brute_batches(times, size, delay)


def test_numbering_equals_a_global_order(spark):
    frame = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)] + [(None, 999)], "t bigint, id bigint")
    got = rows(batches.numbered(frame, F.floor(F.col("t") / 10), "t", "id"), "rn", "id")
    assert [i for _, i in got] == [999] + [r[1] for r in sorted((i * 37 % 101, i) for i in range(101))]


def test_what_comes_next_is_the_schedule_within_the_window(spark):
    """The pruned schedule releases what the whole one does, and waits for the same time after."""
    pages = spark.createDataFrame([(f"http://h{i % 4}/{i}", f"http://h{i % 4}", i * 7 % 11) for i in range(60)], "url string, scheme_and_authority string, crawl_priority bigint")
    hosts = spark.createDataFrame([("http://h0", 0), ("http://h1", 1000), ("http://h2", 2500), ("http://h3", 20000)], "scheme_and_authority string, crawl_delay bigint")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    whole = schedule.politeness(schedule.queue_rank(pages), hosts, start)
    for window in (0, 1, 2600, 60_000):
        some = schedule.upcoming(pages, hosts, start, window)
        now = F.timestamp_micros(F.unix_micros(start) + window * 1000 + 1)
        due = lambda df: {(r.url, r.eligible_at) for r in schedule.released(df, now).collect()}  # noqa: E731, B023
        assert due(some) == due(whole)
        wait = lambda df: df.where(F.col("eligible_at") >= now).agg(F.min("eligible_at")).first()[0]  # noqa: E731, B023
        assert wait(some) == wait(whole)
