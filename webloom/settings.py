"""Crawl settings and their defaults. Durations are milliseconds, sizes bytes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame

INT_MAX = 2_147_483_647

#: names that a configuration may have and that mean nothing here: they size or time queues, caches, actors and batches of a crawler that
#: works page by page; rounds are set operations, each written once
NO_EFFECT = frozenset("""
    log_exceptions url_cache_size lenient_ask_timeout_ms lenient_fail_open_ms lenient_cache_size
    strict_ask_timeout_ms strict_fail_close_ms strict_cache_size fetcher_initial_delay_ms fetcher_management_delay_ms
    supplier_ask_timeout_ms supplier_burst restore_initial_delay_ms restore_delay_ms host_insert_batch
    host_update_batch page_update_batch max_recovery_queries page_idle_ms host_idle_ms
    queue_idle_ms metrics_delay_ms
""".split())


@dataclass(frozen=True)
class CrawlSettings:
    # crawl scope
    max_crawl_depth: int = INT_MAX
    max_url_length: int = 2048
    must_match: tuple[str, ...] = (".*",)
    must_not_match: tuple[str, ...] = ()
    # URL normalization
    remove_userinfo: bool = True
    remove_query: bool = False
    remove_fragment: bool = True
    # robots
    user_agents: tuple[str, ...] = ()
    default_crawl_delay_ms: int = 1000
    min_crawl_delay_ms: int = 0
    max_crawl_delay_ms: int = 20_000
    valid_rules_ms: int = 24 * 3_600_000
    unavailable_rules_ms: int = 24 * 3_600_000
    unreachable_rules_ms: int = 3_600_000
    robots_max_content_length: int = 500 * 1024
    robots_max_redirects: int = 5
    robots_max_concurrent: int = 5
    robots_bandwidth: int = 200_000
    # fetching; nodes: how many share the hosts, each with the whole bandwidth
    nodes: int = 1
    max_content_length: int = 1_000_000
    total_bandwidth: int = 5_000_000
    min_bandwidth_per_fetcher: int = 200_000
    supplier_min_delay_ms: int = 10
    supplier_max_delay_ms: int = 1000
    # state
    restore_chunk: int = 100
    page_insert_batch: tuple[int, int] = (1000, 500)
    database: str | None = None
    # extensions: pages whose fetch fails so often are left alone; compaction of the state log
    max_attempts: int = 5
    compact_every: int = 20
    # user code
    prioritize: Callable[[DataFrame], Column] | None = field(default=None, compare=False)
    consume: Callable[[DataFrame], DataFrame | None] | None = field(default=None, compare=False)

    @staticmethod
    def of(values: dict[str, Any]) -> CrawlSettings:
        """From a mapping, as read from a configuration file; names without effect are passed over, unknown ones raise."""
        values = {k: v for k, v in values.items() if k not in NO_EFFECT}
        known = {f.name for f in fields(CrawlSettings)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return CrawlSettings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
