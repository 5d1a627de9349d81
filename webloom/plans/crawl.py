"""The crawl: bulk-synchronous rounds over durable state. A round is a few set operations; nothing is done page by page."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.robots import later
from ..operators import candidates as C
from ..operators import hosts as H
from ..operators import metrics as M
from ..operators import responses as R
from ..operators import schedule as S
from ..schemas import DISALLOWED, DISCOVERED, EDGE, HOST, PROCESSED
from ..settings import CrawlSettings
from ..sources.fetch import FetchAdapter
from ..sources.seeds import seeds as seed_rows
from ..sources.state import ParquetState, StateStore


@dataclass
class Round:
    seq: int
    fetched: int
    discovered: int
    disallowed: int
    ignored: int
    next_eligible_at: dt.datetime | None
    counters: dict[str, int] = field(default_factory=dict)


class Crawl:
    """Crawl(spark, path, adapter, settings).run(urls). path is on shared storage; a crawl that was stopped goes on from there.

    One round: frontier (Discovered, highest priority first), robots information for its hosts, strict verdicts, queues and
    politeness schedule, fetch, classification, user code, links, new pages. Responses are written once before anything
    reads them, as a fetch can't be repeated; page and host events of the round are one Parquet folder each.
    """

    def __init__(self, spark: SparkSession, path: str, adapter: FetchAdapter, settings: CrawlSettings = CrawlSettings(), state: StateStore | None = None):
        self.spark, self.path, self.adapter, self.settings = spark, path.rstrip("/"), adapter, settings
        self.state = state or ParquetState(spark, f"{self.path}/state")
        self.counters: dict[str, int] = {}

    def _keep(self, frame: DataFrame, name: str, seq: int) -> DataFrame:
        at = f"{self.path}/rounds/{seq}/{name}"
        frame.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(frame.schema).parquet(at)

    def admit(self, raw: DataFrame, as_of: dt.datetime, seq: int) -> DataFrame:
        """Raw candidates -> page events of those that are new: normalized, filtered, allowed by robots or unknown to it."""
        clean = C.url_filter(C.normalize(C.dedup(raw), self.settings), self.settings)
        fresh = self._keep(C.unseen(clean, self.state.pages()), "fresh", seq)
        allowed = H.lenient(fresh, self.refresh_hosts(fresh, as_of, seq))
        seen = M.admission(raw, self.settings)
        many, new = seen.pop("deduplicator.candidates"), fresh.count()
        self._count(seen | {"deduplicator.passed": new, "deduplicator.rejected": many - new})
        return C.to_pages(allowed, self.settings).withColumn("attempts", F.lit(0))

    def _lenient(self, passed: int) -> None:
        """Of what the deduplicator passed since, so many were admitted."""
        judged = self.counters.get("lenient_filter.passed", 0) + self.counters.get("lenient_filter.rejected", 0)
        self._count({"lenient_filter.passed": passed, "lenient_filter.rejected": self.counters["deduplicator.passed"] - judged - passed})

    def _count(self, values: dict[str, int]) -> None:
        """Counters of the round so far; they are written with its metrics."""
        for k, v in values.items():
            self.counters[k] = self.counters.get(k, 0) + int(v)

    def refresh_hosts(self, urls: DataFrame, as_of: dt.datetime, seq: int) -> DataFrame:
        """Fetch robots.txt for hosts without live information; all hosts' information."""
        known, now = self.state.hosts(), F.lit(as_of).cast("timestamp")
        stamp = dt.datetime.now().timestamp()
        need = self._keep(H.missing_or_expired(H.with_host(urls), known, now), f"hosts-{stamp}", seq)
        if not need.isEmpty():
            answers = self._keep(self.adapter.robots(need), f"robots-{stamp}", seq)
            self._count({f"robots_fetcher.{r['outcome'].lower()}": r["count"] for r in answers.groupBy("outcome").count().collect()})
            rows = H.refresh(answers, known, now, self.settings)
            self.state.append_hosts(rows.select(*HOST.names).join(known.select("scheme_and_authority", "next_eligible_at"), "scheme_and_authority", "left"), self.state.last_seq() + 1)
        return self.state.hosts()

    def seed(self, urls: list[str] | DataFrame, as_of: dt.datetime | None = None) -> int:
        """Admit seeds at depth 0; how many pages are new."""
        as_of = as_of or dt.datetime.now(dt.timezone.utc)
        raw = urls if isinstance(urls, DataFrame) else seed_rows(self.spark, urls)
        seq = self.state.last_seq() + 1
        events = self._keep(self.admit(raw, as_of, seq), "seeds", seq)
        self.state.append_pages(events, self.state.last_seq() + 1)
        admitted = events.count()
        self._lenient(admitted)
        return admitted

    def round(self, as_of: dt.datetime | None = None, window_ms: int = 0, limit: int | None = None) -> Round:
        """One round at as_of: pages of the frontier (at most limit, those of the highest priority) that may be released before as_of, or
        within window_ms from it, are fetched, each not before its time where the adapter keeps to eligible_at; others wait for a later round."""
        as_of = as_of or dt.datetime.now(dt.timezone.utc)
        s, seq, now = self.settings, self.state.last_seq() + 1, F.lit(as_of).cast("timestamp")
        just_before = F.timestamp_micros(F.unix_micros(now) - 1)  # a release at now itself is not due, a host without an earlier one is
        frontier = self.state.discovered().where(F.col("attempts") < s.max_attempts)
        if limit is not None:
            frontier = frontier.orderBy(F.desc("crawl_priority"), "url").limit(limit)
        frontier = self._keep(frontier, "frontier", seq)
        hosts = self.refresh_hosts(frontier, as_of, seq)
        judged = self._keep(H.strict(frontier, hosts), "judged", seq)
        scheduled = self._keep(S.upcoming(judged.where("verdict = 'Allowed'").drop("verdict"), hosts, just_before, window_ms), "schedule", seq)
        due = S.released(scheduled, later(now, window_ms))
        requests = due.select("url", "crawl_depth", "crawl_priority", "attempts", "scheme_and_authority", "eligible_at")
        results = self._keep(R.classify_pages(self.adapter.pages(requests), s.max_content_length), "results", seq)
        if s.consume is not None and (rows := s.consume(results)) is not None:
            rows.write.mode("overwrite").parquet(f"{self.path}/consumed/seq={seq}")
        parse = R.to_parse(results, s.max_crawl_depth)
        links = self._keep(C.parsed_page_links(parse), "links", seq)
        links.select("src_url", F.col("url").alias("dst_url"), F.col("crawl_depth").alias("depth")).select(*EDGE.names).distinct().write.mode("overwrite").parquet(f"{self.path}/edges/seq={seq}")
        new = self._keep(self.admit(C.union_inputs(links, C.from_redirects(results)), as_of, seq), "new", seq)
        done = results.select("url", F.when(F.col("outcome") == "Exception", DISCOVERED).otherwise(PROCESSED).alias("status"), "crawl_depth", "crawl_priority", (F.col("attempts") + (F.col("outcome") == "Exception").cast("int")).alias("attempts"))
        barred = judged.where("verdict = 'Disallowed'").select("url", F.lit(DISALLOWED).alias("status"), "crawl_depth", "crawl_priority", "attempts")
        last = self.state.last_seq() + 1
        # the hosts' clocks go first: if the round breaks off between, pages are fetched later, never too soon
        released = due.groupBy("scheme_and_authority").agg(F.max("eligible_at").alias("last_release"))
        clocks = self.state.hosts().join(released, "scheme_and_authority").withColumn("next_eligible_at", F.timestamp_micros(F.unix_micros("last_release") + F.col("crawl_delay") * 1000)).drop("last_release")
        self.state.append_hosts(clocks, last)
        self.state.append_pages(done.unionByName(barred).unionByName(new.select(*done.columns)), last + 1)
        counted = judged.agg(F.count_if(F.col("verdict") == "Disallowed").alias("d"), F.count_if(F.col("verdict") == "Ignored").alias("i"), F.count_if(F.col("verdict") == "Allowed").alias("a")).first()
        wait = scheduled.join(due.select("url"), "url", "left_anti").agg(F.min("eligible_at").alias("t")).first()["t"]
        discovered = new.count()
        self._lenient(discovered)
        counters = {"parsed_documents": parse.count(), "emitted_urls": links.count()}
        totals = counters | self.counters | {"ignored_pages": counted["i"], "strict_filter.rejected": counted["d"], "strict_filter.passed": counted["a"], "host_queues": scheduled.select("scheme_and_authority").distinct().count()}
        self.counters = {}
        M.fetcher(results).unionByName(M.exceptions(results, "fetcher.exceptions_by_class")).unionByName(M.rows(self.spark, totals)).write.mode("overwrite").parquet(f"{self.path}/metrics/seq={seq}")
        if s.compact_every and last % s.compact_every == 0:
            self.state.compact()
        return Round(seq, results.count(), discovered, counted["d"], counted["i"], wait, counters)

    def run(self, urls: list[str] | DataFrame | None = None, rounds: int = 100, as_of: dt.datetime | None = None, window_ms: int = 0, wait: bool = False, stop: Callable[[], bool] | None = None) -> list[Round]:
        """Seed, then rounds until nothing is left to fetch. Time goes on by itself with wait (the driver sleeps until the next
        release); else as_of moves to the next release, so that a stored corpus is crawled at full speed. stop is asked between rounds: a
        round that has begun is finished, then the crawl ends, to go on another time."""
        import time

        now = as_of or dt.datetime.now(dt.timezone.utc)
        if urls is not None:
            self.seed(urls, now)
        out: list[Round] = []
        for _ in range(rounds):
            if stop is not None and stop():
                break
            r = self.round(now, window_ms)
            out.append(r)
            if r.next_eligible_at is None and r.fetched == 0 and r.discovered == 0:
                break
            if r.next_eligible_at is not None:
                upcoming = r.next_eligible_at.replace(tzinfo=dt.timezone.utc) if r.next_eligible_at.tzinfo is None else r.next_eligible_at
                if wait:
                    time.sleep(max(0.0, min((upcoming - dt.datetime.now(dt.timezone.utc)).total_seconds(), self.settings.supplier_max_delay_ms / 1000)))
                    now = dt.datetime.now(dt.timezone.utc)
                elif r.fetched == 0:
                    now = max(now, upcoming + dt.timedelta(microseconds=1))
        return out
