"""Batches and idle times of event streams, as batch computations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(frame: DataFrame, coarse: Column, *order: Column | str) -> DataFrame:
    """frame with rn, its place (from 1) in the whole order. coarse is a coarser form of the leading order column (such as the hour
    of a time): rows are numbered within its values, which are small, and the counts of earlier values are added. So no task sorts
    the whole frame; only one count a coarse value goes through a single one."""
    marked = frame.withColumn("__coarse", coarse)
    counts = marked.groupBy("__coarse").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy(F.asc_nulls_first("__coarse")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = marked.withColumn("__rn", F.row_number().over(W.partitionBy("__coarse").orderBy(*order)))
    joined = own.alias("a").join(before.alias("b"), F.col("a.__coarse").eqNullSafe(F.col("b.__coarse")))
    return joined.select(*[F.col(f"a.{c}") for c in frame.columns], (F.col("__before") + F.col("__rn")).alias("rn"))


def by_size(frame: DataFrame, size: int, coarse: Column, *order: Column | str) -> DataFrame:
    """frame with batch: consecutive runs of size rows, numbered from 0."""
    return numbered(frame, coarse, *order).withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("bigint")).drop("rn")


def by_size_or_time(frame: DataFrame, key: str, time_ms: Column, size: int, delay_ms: int, *ties: str) -> DataFrame:
    """frame (with __ms and batch): per key, a batch ends when it has size rows (the first row of a batch alone never ends it)
    or delay_ms after its first row, whichever is earlier. Rows of equal times go by ties. A key's rows are cut where delay_ms go by
    without one, as a batch ends there at the latest; thousands of the runs between are a group, so that a busy key is many groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__ms", *ties], kind="stable")
        number, held, first, out = 0, 0, 0, []
        for t in pdf["__ms"].tolist():
            if held and t - first >= delay_ms:
                number, held = number + 1, 0
            if not held:
                first = t
            held += 1
            out.append(number)
            if held > 1 and held >= size:
                number, held = number + 1, 0
        return pdf.assign(__own=out)

    order = W.partitionBy(key).orderBy("__ms", *ties)
    marked = frame.withColumn("__ms", time_ms.cast("bigint"))
    cut = marked.withColumn("__cut", F.coalesce((F.col("__ms") - F.lag("__ms").over(order) >= delay_ms).cast("bigint"), F.lit(0)))
    runs = cut.withColumn("__run", F.floor(F.sum("__cut").over(order.rowsBetween(W.unboundedPreceding, 0)) / 4096)).drop("__cut")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + ", `__own` bigint"
    own = runs.groupBy(key, "__run").applyInPandas(run, schema)
    # a batch begins at the first row of a run and where the number within the run grows
    begins = F.coalesce((F.col("__own") != F.lag("__own").over(W.partitionBy(key).orderBy("__run", "__own", "__ms", *ties))) | (F.col("__run") != F.lag("__run").over(W.partitionBy(key).orderBy("__run", "__own", "__ms", *ties))), F.lit(False))
    numbered_ = own.withColumn("__begins", begins.cast("bigint"))
    number = F.sum("__begins").over(W.partitionBy(key).orderBy("__run", "__own", "__ms", *ties).rowsBetween(W.unboundedPreceding, 0))
    return numbered_.withColumn("batch", number).drop("__begins", "__own", "__run")


def idle_sessions(frame: DataFrame, key: str, micros: Column, idle_ms: int) -> DataFrame:
    """(key, session, started, ended, events): a session of a key ends where idle_ms go by without an event."""
    order = W.partitionBy(key).orderBy("__us")
    marked = frame.select(key, micros.alias("__us"))
    gap = marked.withColumn("__new", F.coalesce((F.col("__us") - F.lag("__us").over(order) > idle_ms * 1000).cast("int"), F.lit(0)))
    numbered_ = gap.withColumn("session", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered_.groupBy(key, "session").agg(F.min("__us").alias("started"), F.max("__us").alias("ended"), F.count(F.lit(1)).alias("events"))
