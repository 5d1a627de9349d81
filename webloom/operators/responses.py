"""Classifying responses to page and robots.txt requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import header_nofollow
from ..functions.urls import redirect_url

PARSEABLE = ("text/html", "application/xhtml+xml")


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def parseable(content_type: Column) -> Column:
    """HTML or XHTML, whatever its parameters."""
    return F.coalesce(media_type(content_type).isin(*PARSEABLE), F.lit(False))


def page_outcome(failed: Column, status: Column, size: Column, most: int) -> Column:
    """In this order: Exception (nothing came; the page is tried again), Error (4xx, 5xx), Redirect (3xx), LengthLimitExceeded, Success."""
    return F.when(failed, "Exception").when(status >= 400, "Error").when((status >= 300) & (status < 400), "Redirect").when(size > most, "LengthLimitExceeded").otherwise("Success")


def header(headers: Column, name: str) -> Column:
    """The first value of a header, null without it; names are matched in any case."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.try_element_at(found, F.lit(1))["value"]


def classify_pages(fetched: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Responses (url, crawl_depth and those of schemas.RESPONSE) with outcome and redirect_to. A body that is too long is emptied;
    headers and status stay. A redirect without Location leads nowhere (null)."""
    failed = F.coalesce(F.col("failed"), F.lit(True))
    outcome = page_outcome(failed, F.col("status"), F.coalesce(F.octet_length("body"), F.lit(0)), most)
    out = fetched.withColumn("outcome", outcome)
    return out.withColumn("redirect_to", F.when(F.col("outcome") == "Redirect", redirect_url(F.col("url"), header(F.col("headers"), "location")))).withColumn(
        "body", F.when(F.col("outcome") == "Success", F.col("body")).when(F.col("outcome") == "LengthLimitExceeded", F.lit(b""))
    )


def to_parse(results: DataFrame, max_depth: int) -> DataFrame:
    """Successes whose links are read: HTML, below the depth limit, no nofollow header. (url, crawl_depth, html)"""
    ok = (F.col("outcome") == "Success") & parseable(F.col("content_type")) & (F.col("crawl_depth") < max_depth) & ~header_nofollow(F.col("headers"))
    return results.where(ok).select("url", "crawl_depth", F.decode("body", "UTF-8").alias("html"))


def robots_outcome(failed: Column, status: Column, content_type: Column, location: Column, redirects: Column, max_redirects: int = 5) -> Column:
    """In this order: Response (2xx, text/plain in UTF-8), Redirect (3xx with Location, fewer than max_redirects so far), Unavailable
    (other 3xx, 4xx), Unreachable (all else: 5xx, no answer, 2xx of another type)."""
    charset = F.lower(F.regexp_replace(content_type, r"[\s\"']", ""))
    plain = F.coalesce(charset == "text/plain;charset=utf-8", F.lit(False))
    moved = (status >= 300) & (status < 400)
    return (
        F.when(failed, "Unreachable")
        .when((status >= 200) & (status < 300) & plain, "Response")
        .when(moved & location.isNotNull() & (redirects < max_redirects), "Redirect")
        .when(moved, "Unavailable")
        .when((status >= 400) & (status < 500), "Unavailable")
        .otherwise("Unreachable")
    )
