"""Robots information of hosts: refreshing it, and joining it to candidates and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robots
from ..functions.urls import path_and_query, scheme_and_authority
from ..schemas import ALLOW_ALL, ALLOW_NONE
from ..settings import CrawlSettings


def with_host(urls: DataFrame) -> DataFrame:
    return urls.withColumn("scheme_and_authority", scheme_and_authority(F.col("url")))


def missing_or_expired(keys: DataFrame, hosts: DataFrame, as_of: Column) -> DataFrame:
    """Distinct hosts of keys that have no information or one that has expired."""
    live = hosts.where(~robots.expired(F.col("valid_until"), as_of))
    return keys.select("scheme_and_authority").where("scheme_and_authority is not null").distinct().join(live.select("scheme_and_authority"), "scheme_and_authority", "left_anti")


def refresh(fetched: DataFrame, hosts: DataFrame, as_of: Column, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    """New host rows from robots.txt results (scheme_and_authority, outcome, body): schemas.HOST and action (Insert or Update).

    A response is parsed and holds for 24 hours, an unavailable file allows all for as long, an unreachable one forbids all for
    an hour, unless there are old rules: they hold for another hour then."""
    old = hosts.select("scheme_and_authority", F.col("rule_mode").alias("old_mode"), F.col("robot_rules").alias("old_rules"), F.col("crawl_delay").alias("old_delay"), F.lit(True).alias("known"))
    body = robots.truncate(F.col("body"), settings.robots_max_content_length)
    parsed = fetched.withColumn("parsed", F.when(F.col("outcome") == "Response", robots.parse(body, settings.user_agents)))
    joined = parsed.join(old, "scheme_and_authority", "left")
    response, unavailable = F.col("outcome") == "Response", F.col("outcome") == "Unavailable"
    reuse = F.coalesce(F.col("known"), F.lit(False))
    default = F.lit(settings.default_crawl_delay_ms).cast("bigint")
    clamped = robots.crawl_delay(F.col("parsed.crawl_delay"), settings.default_crawl_delay_ms, settings.min_crawl_delay_ms, settings.max_crawl_delay_ms)
    life = F.when(response, settings.valid_rules_ms).when(unavailable, settings.unavailable_rules_ms).otherwise(settings.unreachable_rules_ms)
    return joined.select(
        "scheme_and_authority",
        F.when(response, F.col("parsed.rule_mode")).when(unavailable, ALLOW_ALL).when(reuse, F.col("old_mode")).otherwise(ALLOW_NONE).alias("rule_mode"),
        F.when(response, robots.encode_rules(F.col("parsed.rules"))).when(unavailable, "").when(reuse, F.col("old_rules")).otherwise("").alias("robot_rules"),
        F.when(response, clamped).when(unavailable, default).when(reuse, F.col("old_delay")).otherwise(default).alias("crawl_delay"),
        robots.later(as_of, life).alias("valid_until"),
        F.when(reuse, "Update").otherwise("Insert").alias("action"),
    )


def verdicts(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """urls with scheme_and_authority and robots_allowed: null where the host has no information."""
    rules = hosts.select("scheme_and_authority", "rule_mode", robots.decode_rules(F.col("robot_rules")).alias("rules"))
    joined = with_host(urls).join(rules, "scheme_and_authority", "left")
    verdict = F.when(F.col("rule_mode").isNotNull(), robots.allowed(path_and_query(F.col("url")), F.col("rule_mode"), F.col("rules")))
    return joined.withColumn("robots_allowed", verdict).drop("rule_mode", "rules")


def lenient(candidates: DataFrame, hosts: DataFrame) -> DataFrame:
    """Candidates that may be discovered: without information all may."""
    return verdicts(candidates, hosts).where(F.coalesce("robots_allowed", F.lit(True))).drop("robots_allowed", "scheme_and_authority")


def strict(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages with a verdict: Allowed, Disallowed, or Ignored (no information; the page waits)."""
    verdict = F.when(F.col("robots_allowed").isNull(), "Ignored").when(F.col("robots_allowed"), "Allowed").otherwise("Disallowed")
    return verdicts(pages, hosts).withColumn("verdict", verdict).drop("robots_allowed")
