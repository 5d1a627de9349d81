"""Shared pieces: scratch tables on shared storage, bounded Arrow slices, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A join side is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster, an error."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage of df: write it as Parquet into the shared folder and read it back."""
    return Scratch(df.sparkSession).keep(df, name)


class Scratch:
    """Tables in the shared folder that can go together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{scratch_dir(self.spark)}/webloom/{self.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


def id_column(docs: DataFrame, name: str) -> Column:
    """The id as it is, an integer as bigint; ids of any type that can be ordered are carried through."""
    kind = docs.schema[name].dataType
    return F.col(f"`{name}`").cast("bigint") if isinstance(kind, IntegralType) else F.col(f"`{name}`")


def wide_key(*columns: str, seed: int) -> Column:
    """64 bits of a hash of the columns, nulls told from absence of a value; two seeds give 128 bits."""
    marked = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(F.lit(seed), *marked)


def trim() -> None:
    """Give memory that is free again back to the system, after something large; Python workers and the driver live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Keep what Arrow hands to Python at once small; a session that sets these itself keeps its own."""
    for key, value in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def small_side(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast when rows * row_bytes is within limit, else df itself (a shuffled join follows)."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def slices(column: pa.Array, nbytes: int = 1 << 19) -> Iterator[pa.Array]:
    """Cut a string column into runs of rows of about nbytes; one longer row stays whole. An empty column is yielded as it is."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        yield column
        return
    at = text_offsets(column)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + nbytes, side="right")) - 1)
        yield column.slice(start, end - start)
        start = end


def text_offsets(column: pa.Array) -> np.ndarray:
    """Offsets of the rows of a string column in its data buffer."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return at[column.offset : column.offset + len(column) + 1].astype(np.int64)


def scan(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of the rows, one after another, and the len+1 offsets of the rows in them; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return b"", np.zeros(1, np.int64)
    at = text_offsets(column)
    data = column.buffers()[2]
    raw = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data is not None else b""
    return raw, at - at[0]
