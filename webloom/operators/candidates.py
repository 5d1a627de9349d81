"""From links, redirects and seeds to new pages: projections, filters, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import hrefs, is_http, meta_nofollow, parsed_links
from ..functions.priority import shuffled
from ..functions.urls import normalize_url, redirect_url, resolve, scheme_and_authority
from ..schemas import DISCOVERED
from ..settings import CrawlSettings


def from_seeds(urls: DataFrame) -> DataFrame:
    return urls.select("url", F.lit(0).alias("crawl_depth"))


def page_links(pages: DataFrame) -> DataFrame:
    """(src_url, url, crawl_depth) of the http links of pages (url, crawl_depth, html), one level deeper. References are exploded
    first and resolved a row each, so that what depends on the page alone is computed once; the document itself goes no further."""
    found = pages.where(~meta_nofollow(F.col("html"))).select(F.col("url").alias("src_url"), scheme_and_authority(F.col("url")).alias("root"), (F.col("crawl_depth") + 1).alias("crawl_depth"), F.explode(hrefs(F.col("html"))).alias("href"))
    resolved = found.select("src_url", resolve(F.col("src_url"), F.col("href"), F.col("root")).alias("url"), "crawl_depth")
    return resolved.where(is_http(F.col("url")))


def parsed_page_links(pages: DataFrame) -> DataFrame:
    """As page_links(), by the tolerant parser: any markup, <base href>, all character references."""
    return pages.select(F.col("url").alias("src_url"), F.explode(parsed_links(F.col("html"), F.col("url"))).alias("url"), (F.col("crawl_depth") + 1).alias("crawl_depth"))


def from_links(pages: DataFrame, parsed: Column | None = None) -> DataFrame:
    """Candidates from the links of pages; parsed: an array of absolute links to use instead (such as html.parsed_links)."""
    if parsed is not None:
        return pages.select(F.explode(parsed).alias("url"), (F.col("crawl_depth") + 1).alias("crawl_depth"))
    return page_links(pages).select("url", "crawl_depth")


def from_redirects(results: DataFrame) -> DataFrame:
    """Where redirects lead, at the depth of the page that redirects."""
    return results.where("outcome = 'Redirect' and redirect_to is not null").select(F.col("redirect_to").alias("url"), "crawl_depth")


def union_inputs(*inputs: DataFrame) -> DataFrame:
    out = inputs[0].select("url", "crawl_depth")
    for x in inputs[1:]:
        out = out.unionByName(x.select("url", "crawl_depth"))
    return out


def dedup(candidates: DataFrame) -> DataFrame:
    """One candidate a URL, at its least depth."""
    return candidates.groupBy("url").agg(F.min("crawl_depth").alias("crawl_depth"))


def normalized_url(settings: CrawlSettings) -> Column:
    return normalize_url(F.col("url"), settings.remove_userinfo, settings.remove_query, settings.remove_fragment)


def normalize(candidates: DataFrame, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    """Normalized candidates; those without a normalized URL go."""
    return candidates.withColumn("url", normalized_url(settings)).where(F.col("url").isNotNull())


def full_match(url: Column, patterns: tuple[str, ...]) -> Column:
    """At least one of the patterns matches the whole URL; false without patterns."""
    met = F.lit(False)
    for p in patterns:
        met = met | url.rlike(rf"\A(?:{p})\z")
    return met


def short_enough(url: Column, most: int) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    beyond = F.length(url) - F.length(F.regexp_replace(url, r"[\x{10000}-\x{10FFFF}]", ""))
    return F.when(F.octet_length(url) == F.length(url), F.length(url)).otherwise(F.length(url) + beyond) <= most


def in_scope(url: Column, settings: CrawlSettings) -> Column:
    return short_enough(url, settings.max_url_length) & full_match(url, settings.must_match) & ~full_match(url, settings.must_not_match)


def url_filter(candidates: DataFrame, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    return candidates.where(in_scope(F.col("url"), settings))


def depth_filter(pages: DataFrame, most: int) -> DataFrame:
    """Pages whose links are followed. Redirects aren't held to it."""
    return pages.where(F.col("crawl_depth") < most)


def unseen(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose URL is not known yet, one each."""
    return dedup(candidates).join(known.select("url"), "url", "left_anti")


def to_pages(candidates: DataFrame, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    prioritize = settings.prioritize or shuffled()
    return candidates.select("url", F.lit(DISCOVERED).alias("status"), "crawl_depth", prioritize(candidates).cast("bigint").alias("crawl_priority"))


def redirect_targets(responses: DataFrame) -> DataFrame:
    """(url, redirect_to) of responses (url, location)."""
    return responses.select("url", redirect_url(F.col("url"), F.col("location")).alias("redirect_to"))
