"""Counters and gauges as rows (name, attrs, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import METRIC
from ..settings import CrawlSettings


def point(frame: DataFrame, name: str, value: Column, **attrs: Column) -> DataFrame:
    """One metric from an aggregate: attrs are the grouping columns."""
    grouped = frame.groupBy(*[c.alias(k) for k, c in attrs.items()]).agg(value.cast("bigint").alias("value"))
    pairs = [x for k in attrs for x in (F.lit(k), F.col(k).cast("string"))]
    return grouped.select(F.lit(name).alias("name"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("attrs"), "value")


def responses(results: DataFrame) -> DataFrame:
    """Responses by status and media type."""
    return results.where("outcome <> 'Exception'").groupBy("status", "content_type").agg(F.count(F.lit(1)).alias("responses"))


def passed_rejected(frame: DataFrame, ok: Column) -> DataFrame:
    ok = F.coalesce(ok, F.lit(False))
    return frame.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("rejected"))


def entities(frame: DataFrame, name: str, shard: Column) -> DataFrame:
    """How many entities each shard has."""
    return point(frame, name, F.count(F.lit(1)), shard=shard)


def admission(raw: DataFrame, settings: CrawlSettings) -> dict[str, int]:
    """What the normalizer and the URL filter do with raw candidates, in one pass: url_normalizer.processed_urls and .exceptions (URLs without a
    normalized form), url_filter.passed and .rejected; deduplicator.candidates are the distinct URLs among those passed."""
    from . import candidates as C

    normalized = C.normalized_url(settings)
    ok = F.coalesce(C.in_scope(F.col("n"), settings), F.lit(False))
    row = C.dedup(raw).select(normalized.alias("n")).agg(
        F.count(F.lit(1)).alias("url_normalizer.processed_urls"), F.count_if(F.col("n").isNull()).alias("url_normalizer.exceptions"), F.count_if(ok).alias("url_filter.passed"), F.count_if(F.col("n").isNotNull() & ~ok).alias("url_filter.rejected"),
        F.count_distinct(F.when(ok, F.col("n"))).alias("deduplicator.candidates"),
    )
    return row.first().asDict()


def exceptions(results: DataFrame, name: str = "fetcher.exceptions") -> DataFrame:
    """Failed requests by the class of their error, where the adapter names it."""
    error = F.coalesce("error", F.lit("unknown")) if "error" in results.columns else F.lit("unknown")
    return point(results.where("outcome = 'Exception'"), name, F.count(F.lit(1)), exception=error)


def rows(spark: SparkSession, values: dict[str, int]) -> DataFrame:
    """Plain counters as metric rows."""
    return spark.createDataFrame([(k, {}, int(v)) for k, v in values.items()], METRIC)


def fetcher(results: DataFrame, prefix: str = "fetcher") -> DataFrame:
    """Requests, responses by status and content type, received bytes and exceptions of one round."""
    got = results.where("outcome <> 'Exception'")
    return (
        point(results, f"{prefix}.requests", F.count(F.lit(1)))
        .unionByName(point(got, f"{prefix}.responses", F.count(F.lit(1)), status=F.col("status"), content_type=F.col("content_type")))
        .unionByName(point(got, f"{prefix}.received_bytes", F.coalesce(F.sum(F.octet_length("body")), F.lit(0))))
        .unionByName(point(results.where("outcome = 'Exception'"), f"{prefix}.exceptions", F.count(F.lit(1))))
    )
