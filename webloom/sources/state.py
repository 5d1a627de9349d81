"""Durable crawl state: append-only event logs of pages and hosts as Parquet, one folder a round; the latest event of a key is its state."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DISCOVERED, HOST, HOST_EVENT, PAGE, PAGE_EVENT, STATUSES


def latest(events: DataFrame, key: str) -> DataFrame:
    """The row with the greatest seq of each key. One partial aggregate, no sort."""
    rest = [c for c in events.columns if c != key]
    best = F.max_by(F.struct(*rest), F.col("seq")).alias("row")
    return events.groupBy(key).agg(best).select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def checked_status(status: Column) -> Column:
    """status, or an error for a value that is none."""
    return F.when(status.isin(*STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("unknown page status: "), F.coalesce(status, F.lit("null")))))


def apply_status(pages: DataFrame, updates: DataFrame, key: str = "url") -> DataFrame:
    """pages with the status that updates (key, status; each key once) give them; keys that aren't in pages are ignored. All pages of a key
    get its status: where pages share URLs and have one each, another key tells them apart."""
    new = updates.select(key, F.col("status").alias("new_status"))
    return pages.join(new, key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


class StateStore(Protocol):
    """What a crawl needs of its storage; exchange it to keep state elsewhere."""

    def pages(self) -> DataFrame: ...

    def hosts(self) -> DataFrame: ...

    def append_pages(self, events: DataFrame, seq: int) -> None: ...

    def append_hosts(self, events: DataFrame, seq: int) -> None: ...

    def last_seq(self) -> int: ...

    def discovered(self, limit: int | None = None) -> DataFrame: ...

    def compact(self) -> None: ...


class ParquetState:
    """path/pages/seq=N and path/hosts/seq=N. A folder is written by a rename of a whole job, so a round that breaks off leaves
    none, and running it again overwrites what it had. compact() folds the log into its latest rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _folders(self, kind: str) -> list[int]:
        """The rounds whose folder is complete."""
        fs, path = self._fs()
        root = path(f"{self.path}/{kind}")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.removeprefix("seq=")) for n in names if n.startswith("seq=") and fs.exists(path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _events(self, kind: str, schema: T.StructType) -> DataFrame:
        found = [f"{self.path}/{kind}/seq={n}" for n in self._folders(kind)]
        if not found:
            return self.spark.createDataFrame([], schema)
        body = T.StructType([f for f in schema if f.name != "seq"])
        return self.spark.read.schema(body).option("basePath", f"{self.path}/{kind}").parquet(*found).select(*body.names, F.col("seq").cast("bigint"))

    def page_events(self) -> DataFrame:
        return self._events("pages", PAGE_EVENT)

    def host_events(self) -> DataFrame:
        return self._events("hosts", HOST_EVENT)

    def pages(self) -> DataFrame:
        """schemas.PAGE and attempts."""
        return latest(self.page_events(), "url").withColumn("status", checked_status(F.col("status"))).drop("seq")

    def hosts(self) -> DataFrame:
        return latest(self.host_events(), "scheme_and_authority").drop("seq")

    def _append(self, kind: str, events: DataFrame, schema: T.StructType, seq: int) -> None:
        names = [f.name for f in schema if f.name != "seq"]
        events.select(*names).write.mode("overwrite").parquet(f"{self.path}/{kind}/seq={seq}")

    def append_pages(self, events: DataFrame, seq: int) -> None:
        self._append("pages", events, PAGE_EVENT, seq)

    def append_hosts(self, events: DataFrame, seq: int) -> None:
        self._append("hosts", events, HOST_EVENT, seq)

    def last_seq(self) -> int:
        return max([0, *self._folders("pages"), *self._folders("hosts")])

    def insert_pages(self, pages: DataFrame) -> None:
        """New pages (schemas.PAGE); no check that they are new."""
        self.append_pages(pages.withColumn("attempts", F.lit(0)), self.last_seq() + 1)

    def update_status(self, updates: DataFrame) -> None:
        """(url, status) for known pages."""
        known = self.pages().join(updates.select("url", F.col("status").alias("new_status")), "url")
        self.append_pages(known.withColumn("status", checked_status(F.col("new_status"))), self.last_seq() + 1)

    def upsert_hosts(self, hosts: DataFrame) -> None:
        """schemas.HOST rows replace those of their key; the time of the next release stays."""
        old = self.hosts().select("scheme_and_authority", "next_eligible_at")
        self.append_hosts(hosts.select(*HOST.names).join(old, "scheme_and_authority", "left"), self.last_seq() + 1)

    def find_page(self, url: str) -> DataFrame:
        return latest(self.page_events().where(F.col("url") == url), "url").select(*PAGE.names)

    def find_pages(self, urls: DataFrame) -> DataFrame:
        """Many lookups as one join."""
        return self.pages().join(urls.select("url"), "url", "left_semi").select(*PAGE.names)

    def find_host(self, key: str) -> DataFrame:
        return latest(self.host_events().where(F.col("scheme_and_authority") == key), "scheme_and_authority").select(*HOST.names)

    def find_hosts(self, keys: DataFrame) -> DataFrame:
        """Many lookups as one join."""
        return self.hosts().join(keys.select("scheme_and_authority"), "scheme_and_authority", "left_semi").select(*HOST.names)

    def find_by_status(self, status: str, limit: int) -> DataFrame:
        return self.pages().where(F.col("status") == status).orderBy(F.desc("crawl_priority"), "url").limit(limit).select(*PAGE.names)

    def discovered(self, limit: int | None = None) -> DataFrame:
        found = self.pages().where(F.col("status") == DISCOVERED)
        return found if limit is None else found.orderBy(F.desc("crawl_priority"), "url").limit(limit)

    def compact(self) -> None:
        """Write the latest rows as a new round, then drop the older folders."""
        fs, path = self._fs()
        seq = self.last_seq() + 1
        for kind, events, key, schema in (("pages", self.page_events(), "url", PAGE_EVENT), ("hosts", self.host_events(), "scheme_and_authority", HOST_EVENT)):
            old = self._folders(kind)
            if len(old) > 1:
                self._append(kind, latest(events, key), schema, seq)
                for n in old:
                    fs.delete(path(f"{self.path}/{kind}/seq={n}"), True)


def read_jdbc(spark: SparkSession, url: str, table: str, schema: T.StructType, **options: str) -> DataFrame:
    """A pages or hosts table of a database, by its columns' names."""
    frame = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return frame.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def write_jdbc(frame: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    """Plain inserts in batches."""
    frame.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()
