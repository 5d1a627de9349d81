"""Exact top-k search: tiled matrix products, partial selection in each tile, tree merge of the lists of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import BROADCAST_BYTES, Scratch, id_column, small_side

DECIMALS = 9  # scores are compared after rounding to so many decimals, so that the order of summation can't break ties
BLOCK_DDL = "dim int, block bigint, shards bigint, waves bigint, ids binary, rows binary, data binary"
LIST_DDL = "dim int, q bigint, s bigint, n bigint, queries binary, pos binary, ids binary, neighbours binary, scores binary"


def block_of(table: pa.Table) -> pa.Table:
    """The vectors of a block as one matrix of unit rows (a zero vector stays zero)."""
    table = table.sort_by("row")
    vectors = np.array(table["vector"].to_pylist(), np.float64).reshape(len(table), -1)
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    ids, rows = (table[c].to_numpy().astype(np.int64) for c in ("id", "row"))
    same = {c: table[c].slice(0, 1).combine_chunks() for c in ("dim", "block", "shards", "waves")}
    return pa.table(same | {"ids": [ids.tobytes()], "rows": [rows.tobytes()], "data": [vectors.tobytes()]})


def best(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best entries of each query (queries: a number for each entry): the higher score, then the lower id, then the lower row."""
    order = np.lexsort((rows, ids, -scores, queries))
    q = queries[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[place < k]


def tile(k: int, exclude_self: bool, queries_at_once: int):
    """A block of queries against a block of rows. Products are in single precision; all that can be among the k best by its error bound are
    scored again in double precision."""

    def run(table: pa.Table) -> pa.Table:
        sides = {r["side"]: r for r in table.to_pylist()}
        if len(sides) < 2:  # a block without rows
            return LIST_SCHEMA.empty_table()
        query, shard = sides[0], sides[1]
        dim = query["dim"]
        a, b = np.frombuffer(query["data"], np.float64).reshape(-1, dim), np.frombuffer(shard["data"], np.float64).reshape(-1, dim)
        qrows, ids, rows = np.frombuffer(query["rows"], np.int64), np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["rows"], np.int64)
        b32, slack = b.astype(np.float32).T, 2 * (dim + 8) * 2.0**-23 + 10.0**-DECIMALS
        own = np.minimum(np.searchsorted(rows, qrows), len(rows) - 1)
        own = np.where(rows[own] == qrows, own, -1)
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(a), queries_at_once):
            s = a[at : at + queries_at_once].astype(np.float32) @ b32
            if exclude_self:
                mine = np.flatnonzero(own[at : at + len(s)] >= 0)
                s[mine, own[at + mine]] = -np.inf
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else np.float32(-2)
            q, c = np.nonzero(s >= np.maximum(least, np.float32(-2)) - slack)
            score = np.round(np.einsum("ij,ij->i", a[at + q], b[c]), DECIMALS) + 0.0
            keep = best(q, ids[c], rows[c], score, k)
            found.append((q[keep] + at, c[keep], score[keep]))
        q, c, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        one = {"dim": dim, "q": query["q"], "s": query["s"], "n": len(a), "queries": query["ids"], "pos": q.astype(np.int32).tobytes(), "ids": ids[c].tobytes(), "neighbours": rows[c].tobytes(), "scores": score.tobytes()}
        return pa.Table.from_pylist([one], LIST_SCHEMA)

    return run


LIST_SCHEMA = pa.schema([("dim", pa.int32()), ("q", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), *((x, pa.binary()) for x in ("queries", "pos", "ids", "neighbours", "scores"))])


def merge(k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        pos, ids, near, scores = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("pos", np.int32), ("ids", np.int64), ("neighbours", np.int64), ("scores", np.float64)))
        keep = best(pos, ids, near, scores, k)
        one = rows[0] | {"s": rows[0]["node"], "pos": pos[keep].tobytes(), "ids": ids[keep].tobytes(), "neighbours": near[keep].tobytes(), "scores": scores[keep].tobytes()}
        one.pop("node")
        return pa.Table.from_pylist([one], LIST_SCHEMA)

    return run


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            pos = np.frombuffer(r["pos"], np.int32)
            first = np.searchsorted(pos, np.arange(r["n"]))
            rank = np.arange(len(pos)) - first[pos] + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["queries"], np.int64)[pos]), pa.array(rank.astype(np.int32)), pa.array(np.frombuffer(r["ids"], np.int64)), pa.array(np.frombuffer(r["scores"], np.float64))], ["query_id", "rank", "neighbour_id", "score"])


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, is_query: Column | None = None, shard_rows: int = 16_384, query_rows: int = 4096, fan_in: int = 8, exclude_self: bool = True, queries_at_once: int = 256, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The k most similar rows (cosine) of every query: (query_id, rank, neighbour_id, score), exact. Queries are the rows for which is_query
    holds, or all.

    Rows are packed into blocks of at most about shard_rows, queries into blocks of about query_rows; each block of queries meets each
    block of rows once, as a tile: a matrix product and the k best of each query, with all ties of the k-th weighed. The lists of a
    query block are merged fan_in at a time, level by level, so that no task sees more than fan_in lists. A block is sent once for each
    block of the other side and nothing else is; work is queries times rows, as an exact search is.

    Scores are rounded to 9 decimals; ties go to the lower neighbour_id, then the earlier row. A row is no neighbour of itself,
    but a repeated row is. Vectors are compared with those of their own length; null or empty ones, those with a null or non-finite
    element and those without an id have no neighbours; a zero vector has score 0 with all. Fewer than k rows: all others are listed.
    Ids may have any type that can be ordered. An empty table gives no rows; other columns are not read.
    """
    spark, scratch, out = vectors.sparkSession, Scratch(vectors.sparkSession), Scratch(vectors.sparkSession)
    v = vectors.select(id_column(vectors, id_col).alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), (F.lit(True) if is_query is None else F.coalesce(is_query, F.lit(False))).alias("is_query"))
    v = v.where("id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    names = None
    if not isinstance(v.schema["id"].dataType, LongType):  # numbers in the order of the ids stand for them
        names = out.keep(v.select(F.col("id").alias("name")).distinct().orderBy("name").withColumn("id", F.monotonically_increasing_id()), "names")
        v = v.withColumnRenamed("id", "name").join(names, "name").drop("name")
    v = scratch.keep(v.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")
    few = F.least(F.lit(3 * spark.sparkContext.defaultParallelism), F.ceil(F.col("n") / 1024))  # blocks enough for all cores
    sizes = v.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("nq")).where("nq > 0")
    sizes = scratch.keep(sizes.select("dim", F.greatest(F.ceil(F.col("n") / shard_rows), few).alias("shards"), F.ceil(F.col("nq") / query_rows).alias("waves")), "sizes")
    width = sizes.agg(F.max("shards"), F.count(F.lit(1))).first()
    sized = v.join(small_side(sizes, width[1], 32, broadcast_bytes), "dim")
    pack = lambda df, parts: df.withColumn("block", F.pmod(F.xxhash64("row"), F.col(parts))).groupBy("dim", "block").applyInArrow(block_of, BLOCK_DDL)
    upto = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))
    rest = ["ids", "rows", "data"]
    asks = pack(sized.where("is_query"), "waves").select(F.lit(0).alias("side"), "dim", F.col("block").alias("q"), upto("shards").alias("s"), *rest)
    holds = pack(sized, "shards").select(F.lit(1).alias("side"), "dim", upto("waves").alias("q"), F.col("block").alias("s"), *rest)
    lists = asks.unionByName(holds).groupBy("dim", "q", "s").applyInArrow(tile(k, exclude_self, queries_at_once), LIST_DDL)
    left = width[0] or 0
    while left > 1:
        lists = lists.withColumn("node", F.floor(F.col("s") / fan_in)).groupBy("dim", "q", "node").applyInArrow(merge(k), LIST_DDL)
        left = -(-left // fan_in)
    result = out.keep(lists.mapInArrow(unpack, "query_id bigint, rank int, neighbour_id bigint, score double"), "nearest")
    scratch.drop()
    if names is None:
        return result
    named = result.join(names.select(F.col("id").alias("query_id"), F.col("name").alias("q")), "query_id").join(names.select(F.col("id").alias("neighbour_id"), F.col("name").alias("s")), "neighbour_id")
    return named.select(F.col("q").alias("query_id"), "rank", F.col("s").alias("neighbour_id"), "score")
