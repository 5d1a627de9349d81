"""Best-fit packing in bulk-synchronous rounds: range-sorted pieces and gaps, successor sweeps, conflicts settled by rank."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import BROADCAST_BYTES, Scratch, bound_batches, id_column, slices, small_side
from .language_id import TOKENIZERS
from .tokens import Words, processor

# kind 1: a gap of a bin, 0: a piece to place; swept rows have more
STATE = ["kind", "id", "size", "doc_id", "chunk"]
SWEPT = "part int, rank bigint, bin_id bigint, bin_offset int"
RESULT = ["bin_id", "doc_id", "chunk", "bin_offset", "n_tokens"]


def counted(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizers: str) -> DataFrame:
    """(doc_id, n_tokens, first): first numbers the pieces of capacity tokens that the text is cut into, distinct over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words = TaskContext.get().partitionId() << 40, Words(processor(tokenizers), most=1 << 19)
        for batch in batches:
            sizes = np.concatenate([words.count(part) for part in slices(batch.column(1), 1 << 21)])
            pieces = -(-sizes // capacity)
            first = number + np.cumsum(pieces) - pieces
            number += int(pieces.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(first)], ["doc_id", "n_tokens", "first"])

    src = docs.select(id_column(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(run, StructType([src.schema["doc_id"], *StructType.fromDDL("n_tokens bigint, first bigint").fields]))


def ranges(histogram: dict[int, int], rows_per_part: int) -> list[tuple[int, int, int]]:
    """(size, first part, parts) with about rows_per_part rows a part; parts ascend with size. A frequent size has several parts of its own."""
    out, part, load = [], 0, 0
    for size in sorted(histogram):
        n = histogram[size]
        if load and load + n > rows_per_part:
            part, load = part + 1, 0
        many = max(1, -(-n // rows_per_part))
        out.append((size, part, many))
        if many > 1:
            part, load = part + many, 0
        else:
            load += n
    return out


def sweep(capacity: int):
    """One range, from the largest size down: each piece goes into the smallest open gap of the range that holds it; what is left
    of the gap stays open. Pieces that found none and gaps are ranked (pieces from the largest, gaps from the smallest)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "kind", "id"], ascending=[False, False, True], kind="stable").reset_index(drop=True)
        kind, size, ids = pdf["kind"].to_numpy(), pdf["size"].to_numpy(), pdf["id"].to_numpy()
        gaps: list[tuple[int, int]] = []  # (negated size of the gap, row): the last is the smallest gap
        now = size.copy()
        to, offset = np.full(len(pdf), -1, np.int64), np.full(len(pdf), -1, np.int32)
        for i, (k, s) in enumerate(zip(kind.tolist(), size.tolist())):
            if k:
                bisect.insort(gaps, (-s, i))
                continue
            # gaps left over by earlier pieces can be smaller than this piece
            at = bisect.bisect_right(gaps, (-s, len(kind))) - 1
            if at < 0:
                continue
            have, row = gaps.pop(at)
            to[i], offset[i] = ids[row], capacity + have
            now[row] = -have - s
            if now[row]:
                bisect.insort(gaps, (have + s, row))
        pdf["size"] = now
        pdf["bin_id"], pdf["bin_offset"] = to, offset
        rank = np.full(len(pdf), -1, np.int64)
        loose = np.flatnonzero((kind == 0) & (to < 0))
        rank[loose] = np.arange(len(loose))
        open_gaps = np.flatnonzero((kind == 1) & (now >= size.min()))
        open_gaps = open_gaps[np.argsort(now[open_gaps], kind="stable")]
        rank[open_gaps] = np.arange(len(open_gaps))
        pdf["rank"] = rank
        return pdf[[*STATE, "part", "rank", "bin_id", "bin_offset"]]

    return run


def settle(parts: list[dict]) -> list[tuple[int, int, int, int, int, int]]:
    """Match the ranked leftovers of the ranges: the pieces of a range take the gaps of the nearest higher ranges.

    parts: by part, with loose and gaps (numbers), large (largest loose piece) and small (smallest ranked gap). Gives
    (piece part, from rank, number, gap part, gap rank of the first, pieces a gap): a gap of a higher range holds as many
    pieces as the smallest gap there is a multiple of the largest piece here.
    """
    plan, stack = [], []
    for p in sorted(parts, key=lambda x: -x["part"]):
        at = 0
        while at < p["loose"] and stack:
            top = stack[-1]
            each = max(1, top["small"] // p["large"])
            n = min(p["loose"] - at, (top["gaps"] - top["used"]) * each)
            plan.append((p["part"], at, n, top["part"], top["used"], each))
            top["used"] += -(-n // each)
            at += n
            if top["used"] == top["gaps"]:
                stack.pop()
        p["taken"] = at
        if p["gaps"]:
            stack.append(p | {"used": 0})
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizers: str = TOKENIZERS, rows_per_part: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pack token sequences into bins of capacity tokens: (bin_id, doc_id, chunk, bin_offset, n_tokens), one row a piece.

    A text of more than capacity tokens is cut into chunks of capacity, the last with the rest; chunk numbers them and
    full chunks have bins of their own. The other pieces are placed in rounds. In a round pieces and gaps are range
    partitioned by size (the histogram has at most capacity rows, whatever the input) into ranges of about rows_per_part rows (a
    64th of all, 20 000 at least and 250 000 at most, unless given), each range is swept for the best fit, leftover pieces are
    matched to leftover gaps of higher ranges by rank, gaps are updated, and where free space is short or a round places little,
    the largest pieces left open bins, as many as the rest needs. Only numbers are shuffled, no text; each round is written to
    the shared folder. Tables with a row a range are broadcast only when they are within broadcast_bytes.

    Null and empty texts have no tokens and give no rows. Repeated rows are pieces like others (each row is packed once);
    a null doc_id stays null; ids may have any type. Ties go by row number. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokens, out = Scratch(spark), Scratch(spark)
    sizes = tokens.keep(counted(docs, id_col, text_col, capacity, tokenizers), "sizes").where("n_tokens > 0")
    none_id, none = F.lit(None).cast(sizes.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("bigint").alias("chunk")
    pieces = sizes.select("doc_id", "first", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_tokens - 1) div {capacity}"))).alias("chunk")).select(
        F.lit(0).alias("kind"), (F.col("first") + F.col("chunk")).alias("id"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("chunk") * capacity).cast("int").alias("size"), "doc_id", "chunk"
    )
    swept_rows = StructType([StructField(c, pieces.schema[c].dataType) for c in STATE] + StructType.fromDDL(SWEPT).fields)
    placed = [out.keep(pieces.where(F.col("size") == capacity).select(F.col("id").alias("bin_id"), "doc_id", "chunk", F.lit(0).alias("bin_offset"), F.col("size").alias("n_tokens")), "full")]
    state, before = pieces.where(F.col("size") < capacity), tokens
    while True:
        histogram: dict[int, int] = {}
        loose = free = 0
        for r in state.groupBy("kind", "size").count().collect():
            histogram[r["size"]] = histogram.get(r["size"], 0) + r["count"]
            if r["kind"]:
                free += r["size"] * r["count"]
            else:
                loose += r["count"]
        if not loose:
            break
        now, ended = Scratch(spark), Scratch(spark)
        each_part = rows_per_part or min(250_000, max(20_000, sum(histogram.values()) // 64))
        bounds = spark.createDataFrame(ranges(histogram, each_part), "size int, first int, many int")
        keyed = state.join(small_side(bounds, len(histogram), 16, broadcast_bytes), "size").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int"))
        swept = now.keep(keyed.select(*STATE, "part").groupBy("part").applyInPandas(sweep(capacity), swept_rows), "swept")
        is_loose, is_gap = (F.col("kind") == 0) & (F.col("rank") >= 0), (F.col("kind") == 1) & (F.col("rank") >= 0)
        parts = [
            r.asDict()
            for r in swept.groupBy("part")
            .agg(
                F.count_if(is_loose).alias("loose"), F.count_if(is_gap).alias("gaps"), F.max(F.when(is_loose, F.col("size"))).alias("large"), F.min(F.when(is_gap, F.col("size"))).alias("small"),
                F.coalesce(F.sum(F.when(is_loose, F.col("size"))), F.lit(0)).alias("volume"), F.count_if((F.col("kind") == 0) & (F.col("rank") < 0)).alias("fitted"),
            )
            .collect()
        ]
        plan = settle(parts)
        fitted, crossed = sum(p["fitted"] for p in parts), sum(x[2] for x in plan)
        rest = sum(p["volume"] * (p["loose"] - p["taken"]) / p["loose"] for p in parts if p["loose"])
        free -= sum(p["volume"] for p in parts) - rest
        opened = math.ceil(max(0, rest - max(0, free)) / capacity)
        if (fitted + crossed) * 10 < loose:
            opened = max(opened, math.ceil(rest / capacity))
        opens, todo = [], min(opened, sum(p["loose"] - p["taken"] for p in parts))
        for p in sorted(parts, key=lambda x: -x["part"]):
            n = min(todo, p["loose"] - p["taken"])
            opens.append((p["part"], p["taken"], p["taken"] + n))
            todo -= n
        steps = spark.createDataFrame(opens, "part int, taken bigint, opened bigint")
        loose_rows = swept.where(is_loose).join(small_side(steps, len(opens), 32, broadcast_bytes), "part")
        gap_rows = swept.where("kind = 1")
        inside = swept.where("kind = 0 and rank < 0").select("bin_id", "doc_id", "chunk", "bin_offset", F.col("size").alias("n_tokens"))
        starts = loose_rows.where("rank >= taken and rank < opened")
        new = inside.unionByName(starts.select(F.col("id").alias("bin_id"), "doc_id", "chunk", F.lit(0).alias("bin_offset"), F.col("size").alias("n_tokens")))
        after = loose_rows.where("rank >= opened").select(*STATE).unionByName(starts.select(F.lit(1).alias("kind"), "id", (F.lit(capacity) - F.col("size")).alias("size"), none_id, none))
        if plan:
            links = small_side(spark.createDataFrame(plan, "part int, from_rank bigint, n bigint, gap_part int, gap_rank bigint, each bigint"), len(plan), 48, broadcast_bytes)
            sent = loose_rows.where("rank < taken").join(links, "part").where("rank >= from_rank and rank < from_rank + n")
            sent = sent.withColumn("slot", F.col("rank") - F.col("from_rank")).select(F.col("gap_part").alias("part"), (F.col("gap_rank") + F.expr("slot div each")).alias("rank"), "doc_id", "chunk", F.col("size").alias("n_tokens"), "id")
            # a gap takes at most capacity pieces
            taken = sent.groupBy("part", "rank").agg(F.sort_array(F.collect_list(F.struct(F.col("n_tokens"), F.col("id"), F.col("doc_id"), F.col("chunk"))), asc=False).alias("got"))
            met = now.keep(gap_rows.where("rank >= 0").select("part", "rank", F.col("id").alias("bin_id"), F.col("size").alias("gap")).join(taken, ["part", "rank"]), "met")
            used = F.aggregate("got", F.lit(0), lambda a, x: a + x["n_tokens"])
            exploded = met.select("bin_id", "gap", "got", F.posexplode("got").alias("pos", "g"))
            filled = F.aggregate(F.slice("got", F.lit(1), F.col("pos")), F.lit(0), lambda a, x: a + x["n_tokens"])
            new = new.unionByName(exploded.select("bin_id", "g.doc_id", "g.chunk", (F.lit(capacity) - F.col("gap") + filled).cast("int").alias("bin_offset"), "g.n_tokens"))
            after = after.unionByName(met.select(F.lit(1).alias("kind"), F.col("bin_id").alias("id"), (F.col("gap") - used).cast("int").alias("size"), none_id, none))
            ends: dict[int, int] = {}
            for _, _, n, part, rank, each in plan:
                ends[part] = max(ends.get(part, 0), rank + -(-n // each))
            closed = spark.createDataFrame(list(ends.items()), "part int, b bigint")
            gap_rows = gap_rows.join(small_side(closed, len(ends), 16, broadcast_bytes), "part", "left").where("rank < 0 or b is null or rank >= b")
        after = after.unionByName(gap_rows.select(*STATE)).where("size > 0")
        placed.append(out.keep(new.select(*RESULT), "placed"))
        state = ended.keep(after, "state")
        now.drop()
        before.drop()
        before = ended
    before.drop()
    result = placed[0].select(*RESULT)
    for x in placed[1:]:
        result = result.unionByName(x.select(*RESULT))
    return result
