"""Seeds: URLs that enter a crawl at depth 0."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators.candidates import from_seeds
from ..schemas import CANDIDATE


def seeds(spark: SparkSession, urls: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(u, 0) for u in urls], CANDIDATE)


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines are skipped."""
    lines = spark.read.text(path).selectExpr("trim(value) AS url").where("url <> ''")
    return from_seeds(lines)
