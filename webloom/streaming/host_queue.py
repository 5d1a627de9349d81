"""Per-host queues as a stateful stream: pages come in any order and leave by priority, a crawl delay apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import columns

RELEASED = columns(scheme_and_authority="string", url="string", crawl_depth="int", crawl_priority="bigint", released_ms="bigint")
QUEUED = columns(url="string", crawl_depth="int", crawl_priority="bigint")


class HostQueue(StatefulProcessor):
    """State of a host: the crawl delay that its latest row had, its queue, a map from URL (so each is queued once) to depth and priority, and when the next release may be.
    The next is released on arrival if that time has come, else by a processing-time timer."""

    def __init__(self, delay_ms: int):
        self.default_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", columns(url="string"), columns(crawl_depth="int", crawl_priority="bigint"))
        self.next = handle.getValueState("next", columns(at="bigint"))
        self.timer = handle.getValueState("timer", columns(at="bigint"))
        self.delay = handle.getValueState("delay", columns(ms="bigint"))

    def release(self, key: tuple, now: int) -> list[tuple]:
        at = self.next.get()[0] if self.next.exists() else 0
        out = []
        best = None
        size = 0
        for (url,), (depth, priority) in self.queue.iterator():
            size += 1
            if best is None or (-priority, url) < (-best[2], best[0]):
                best = (url, depth, priority)
        if best is not None and now > at:
            self.queue.removeKey((best[0],))
            size -= 1
            at = now + (self.delay.get()[0] if self.delay.exists() else self.default_ms)
            self.next.update((at,))
            out.append((key[0], *best, now))
        if size and not self.timer.exists():
            self.handle.registerTimer(max(at, now) + 1)
            self.timer.update((max(at, now) + 1,))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if "crawl_delay" in pdf.columns and not pd.isna(r.crawl_delay):
                    self.delay.update((int(r.crawl_delay),))
                if not self.queue.containsKey((r.url,)):
                    self.queue.updateValue((r.url,), (int(r.crawl_depth), int(r.crawl_priority)))
        yield pd.DataFrame(self.release(key, timerValues.getCurrentProcessingTimeInMs()), columns=RELEASED.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield pd.DataFrame(self.release(key, timerValues.getCurrentProcessingTimeInMs()), columns=RELEASED.names)

    def close(self) -> None:
        pass


def host_queues(stream: DataFrame, delay_ms: int) -> DataFrame:
    """stream (scheme_and_authority, url, crawl_depth, crawl_priority and, where hosts have delays of their own, crawl_delay in
    milliseconds) -> releases. delay_ms is for hosts without one. Needs the RocksDB state store."""
    return stream.groupBy("scheme_and_authority").transformWithStateInPandas(HostQueue(delay_ms), outputStructType=RELEASED, outputMode="append", timeMode="processingTime")
