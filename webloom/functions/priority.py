"""Crawl priorities: the higher, the sooner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def breadth_first(candidates: DataFrame) -> Column:
    return (-F.col("crawl_depth")).cast("bigint")


def depth_first(candidates: DataFrame) -> Column:
    return F.col("crawl_depth").cast("bigint")


def hashed(candidates: DataFrame) -> Column:
    """A fixed pseudo-random order: the first 60 bits of the URL's MD5."""
    return F.conv(F.substring(F.md5("url"), 1, 15), 16, 10).cast("bigint")


def shuffled(seed: int = 0):
    """Pseudo-random by seed; the default order of a crawl."""
    return lambda candidates: F.xxhash64(F.col("url"), F.lit(seed))
