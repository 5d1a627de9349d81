"""MinHash near-duplicates by a chosen-path set similarity join: independent trees branch documents by selected minwise tokens,
small nodes are compared exhaustively, dense ones wherever their members aren't connected yet; connected pairs form groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_BYTES, Scratch, bound_batches, id_column, slices, small_side, trim, wide_key
from .words import grams, mix, words

COORDINATES = 128
SLICE = 16  # coordinates from which a level draws its own
_rng = np.random.default_rng(20240229)
SLOPES = (_rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
SIGNED = "k1 bigint, k2 bigint, rec bigint, alt bigint, sig binary, sketch binary"


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of the k-word shingles of the rows, rows ascending; a row of fewer words, but one at least, has one for all of them."""
    w = words(column)
    g, first = grams(w, k)
    row = w.row[first] if len(first) else np.zeros(0, np.int64)
    count = np.bincount(w.row, minlength=len(column))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.searchsorted(w.row, short)
        one = w.hash[at] + np.uint64(1)
        for i in range(1, k - 1):
            more = count[short] > i
            one[more] = mix(one[more]) + w.hash[at[more] + i]
        g, row = np.concatenate([g, mix(one)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
    return g, row


def signatures(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their minwise values [rows, COORDINATES])."""
    if not len(g):
        return np.zeros(0, np.int64), np.zeros((0, COORDINATES), np.uint32)
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    h = (g >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(start), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat(h * SLOPES[i] + SHIFTS[i], start)
    return row[start], out


def sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows are (doc_id, k1, k2, text); rec and alt are two hashes of the signature."""
    for batch in batches:
        at = 0
        for part in slices(batch.column(3)):
            rows, sig = signatures(*shingle_sets(part, k))
            index = pa.array(rows + at)
            at += len(part)
            raw = [s.tobytes() for s in sig]
            wide = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), np.int64).reshape(-1, 2)
            sketch = [s.tobytes() for s in sig.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(index) for i in range(3)), pa.array(wide[:, 0].copy()), pa.array(wide[:, 1].copy()), pa.array(raw, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "k1", "k2", "rec", "alt", "sig", "sketch"]
            )
    trim()


def matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def value_at(sig: str, place: Column | int) -> Column:
    """The four bytes of a coordinate."""
    place = F.lit(place) if isinstance(place, int) else place
    return F.substring(F.col(sig), (place * 4 + 1).cast("int"), F.lit(4))


def roots(first: int, many: int) -> Column:
    """The nodes under the roots of the trees that a document goes into; first numbers them over all trees."""
    return F.explode(F.array(*[F.xxhash64(F.lit(i), value_at("sig", i % COORDINATES)) for i in range(first, first + many)]))


def level_slice(level: int) -> Column:
    """The coordinates of the signature from which a level draws."""
    return F.substring("sig", level % (COORDINATES // SLICE) * SLICE * 4 + 1, SLICE * 4)


def children(level: int, branches: int) -> Column:
    """The nodes into which a document of a large node goes; the node draws the coordinates, from the level's slice."""
    draw = F.pmod(F.xxhash64("node", F.lit(-level)), F.lit(SLICE))
    step = 1 + (SLICE - 1) // branches
    return F.explode(F.array(*[F.xxhash64("node", F.lit(i), value_at("slice", (draw + i * step) % SLICE)) for i in range(branches)]))


_ONES, _TOP = np.uint64(0x0101010101010101), np.uint64(56)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches (the low bytes of the minwise values), chance matches taken off."""
    words = (a == b).view(np.uint64)  # 16 words of 8 flags: their sum has 8 counts of at most 16
    same = (words.sum(axis=1) * _ONES) >> _TOP
    return (same / COORDINATES - 1 / 256) / (1 - 1 / 256)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of the part of each of n things, a[i] and b[i] being connected."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def exhaustive(node: np.ndarray, rec: np.ndarray, sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Compare all pairs in each node (node is sorted). Gives (document, first document of its part), parts being what pairs of at least least connect."""
    here = np.arange(len(node))
    pairs = []
    step = 1
    while len(here):
        here = here[here + step < len(node)]
        here = here[node[here] == node[here + step]]
        for at in range(0, len(here), 1 << 16):
            some = here[at : at + (1 << 16)]
            ok = some[alike(sketch[some], sketch[some + step]) >= least]
            if len(ok):
                pairs.append((ok, ok + step))
        step += 1
    if not pairs:
        return rec[:0], rec[:0]
    label = joined(len(node), *(np.concatenate([p[i] for p in pairs]) for i in (0, 1)))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return rec[moved], rec[label[moved]]


def compare(least: float, batch_rows: int = 20_000):
    """Rows come sorted by node; whole nodes are compared, about batch_rows rows at a time. A node can go on in the next batch."""

    def edges(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b = exhaustive(*(np.concatenate([p[i] for p in parts]) for i in range(3)), least)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column("node").to_numpy(), batch.column("rec").to_numpy(), matrix(batch.column("sketch"), np.uint8, COORDINATES))
            cut = int(np.searchsorted(now[0], now[0][-1]))  # where the last node begins
            if cut and size + cut >= batch_rows:
                yield edges([*held, tuple(x[:cut] for x in now)])
                held, size, now = [], 0, tuple(x[cut:].copy() for x in now)
            held.append(now)
            size += len(now[0])
        if held:
            yield edges(held)

    return run


def leaders(least: float):
    """A chunk of a dense node: documents in the order of rec; each that no leader so far resembles becomes one. Edges tie the others to
    all leaders that they resemble; leaders are marked by an edge to themselves."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rec")
        rec, sketch = table["rec"].to_numpy(), matrix(table["sketch"], np.uint8, COORDINATES)
        free, a, b = np.ones(len(rec), bool), [], []
        for i in range(len(rec)):
            if not free[i]:
                continue
            near = np.flatnonzero(alike(sketch, sketch[i : i + 1]) >= least)
            free[near] = False
            free[i] = False
            near = near[near != i]
            a += [rec[near], rec[i : i + 1]]
            b += [np.full(len(near), rec[i]), rec[i : i + 1]]
        n = sum(map(len, a))
        return pa.table({"node": pa.array(np.full(n, table["node"][0].as_py()), pa.int64()), "a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def elect(dense: DataFrame, sketches: DataFrame, least: float, chunk: int, scratch: Scratch) -> DataFrame:
    """Edges that connect most of a dense node: chunks elect leaders, those of a node with several chunks are chunked and elect again, as
    long as that halves their number. Pairs that no leader ties are left to open_pairs()."""
    out, rows = None, dense.select("node", "rec", "n")
    while True:
        parts = F.ceil(F.col("n") / chunk)
        chunked = rows.join(sketches, "rec").withColumn("chunk", F.pmod(F.xxhash64("rec"), parts))
        found = scratch.keep(chunked.groupBy("node", "chunk").applyInArrow(leaders(least), "node bigint, a bigint, b bigint"), "leaders")
        edges = found.where("a <> b").select("a", "b")
        out = edges if out is None else out.unionByName(edges)
        lead = found.where("a = b").select("node", F.col("a").alias("rec"))
        before = rows.where(F.col("n") > chunk).groupBy("node").agg(F.count(F.lit(1)).alias("before"))
        again = lead.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(before, "node").where("n * 2 <= before and n > 1").select("node", "n")
        rows = scratch.keep(lead.join(again, "node").select("node", "rec", "n"), "again")
        if rows.isEmpty():
            return out


def across(least: float):
    """A tile: those outside the node's largest class (side 0) against a chunk of the node. One edge is given for each two classes that meet."""

    def run(table: pa.Table) -> pa.Table:
        side, rec, group = (table[c].to_numpy() for c in ("side", "rec", "class"))
        sketch = matrix(table["sketch"], np.uint8, COORDINATES)
        names, number = np.unique(group, return_inverse=True)
        label = np.arange(len(names))
        few, all_ = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        for i in few.tolist():
            open_ = all_[label[number[all_]] != label[number[i]]]
            near = open_[alike(sketch[open_], sketch[i : i + 1]) >= least] if len(open_) else open_
            for j in near[np.unique(label[number[near]], return_index=True)[1]].tolist():
                a.append(int(rec[i]))
                b.append(int(rec[j]))
                label[label == label[number[j]]] = label[number[i]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def open_pairs(dense: DataFrame, parts: DataFrame, sketches: DataFrame, least: float, chunk: int, scratch: Scratch) -> DataFrame | None:
    """Edges between classes (parts: what is connected so far) within dense nodes: all pairs of a node that aren't of one class are compared,
    in tiles of at most chunk rows a side, whatever their number; pairs of one class need no comparison to be grouped."""
    rows = dense.select("node", "rec").join(parts, "rec", "left").select("node", "rec", F.coalesce("root", "rec").alias("class"))
    rows = scratch.keep(rows, "classes")
    sizes = rows.groupBy("node", "class").agg(F.count(F.lit(1)).alias("n"))
    nodes = sizes.groupBy("node").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("n")).where("classes > 1")
    nodes = scratch.keep(nodes.select("node", F.col("main.class").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / chunk).alias("few_chunks"), F.ceil(F.col("n") / chunk).alias("all_chunks")), "open")
    if nodes.isEmpty():
        return None
    every = rows.join(nodes, "node").join(sketches, "rec")
    number = F.xxhash64("rec", F.lit(3))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    few = every.where("class <> main").select("node", "rec", "class", "sketch", F.lit(0).alias("side"), F.pmod(number, F.col("few_chunks")).alias("a"), upto("all_chunks").alias("b"))
    all_ = every.select("node", "rec", "class", "sketch", F.lit(1).alias("side"), upto("few_chunks").alias("a"), F.pmod(number, F.col("all_chunks")).alias("b"))
    return few.unionByName(all_).groupBy("node", "a", "b").applyInArrow(across(least), "a bigint, b bigint")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(rec, root) of all vertices with an edge; root is the least of the component. Large-star and small-star rounds until nothing changes."""
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    check = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = scratch.keep(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == check:
            return now.select(F.col("u").alias("rec"), F.col("v").alias("root"))
        check = seen


def stays(depth: int, s: float, branches: int) -> float:
    """The probability that a pair of similarity s is in one node after depth levels of a tree."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - s * p) ** branches
    return p


def trees_for(depth: int, s: float, branches: int, recall: float) -> int:
    """Independent trees of this depth that find a pair of similarity s with probability recall at least."""
    p = stays(depth, s, branches)
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))


def forest(signed: DataFrame, first: int, trees: int, branches: int, limit: int, levels: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """(small nodes, dense nodes, rows by level) of as many trees, as (node, rec, n). A node is split until it has at most limit documents. A child
    that has most of a large parent is dense, for splitting it on would only copy it, and so are large nodes of the last level."""
    few, dense, by_level = [], [], []
    placed = signed.select("rec", "sig").select("rec", roots(first * branches, trees * branches).alias("node")).distinct().withColumn("parent_n", F.lit(0).cast("bigint"))
    for level in range(1, levels + 1):
        placed = scratch.keep(placed, "placed")
        sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = scratch.keep(placed.join(sizes, "node"), "sized")
        by_level.append(sized.select("rec"))
        few.append(sized.where(F.col("n") <= limit).select("node", "rec", "n"))
        many = sized.where(F.col("n") > limit)
        is_dense = (F.col("parent_n") > 0) & (F.col("n") > 0.7 * F.col("parent_n")) if level < levels else F.lit(True)
        dense.append(many.where(is_dense).select("node", "rec", "n"))
        loose = many.where(~is_dense).select("node", "rec", "n")
        if level == levels or loose.isEmpty():
            return few, dense, by_level
        drawn = signed.select("rec", level_slice(level).alias("slice")).dropDuplicates(["rec"])  # 64 of the 512 bytes
        placed = loose.join(drawn, "rec").select("rec", children(level, branches).alias("node"), F.col("n").alias("parent_n"))
    raise AssertionError("levels is at least 1")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apart(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """signed with rec made distinct where different signatures have the same first hash (64 bits), by the second."""
    clash = signed.groupBy("rec").agg(F.min("alt").alias("low"), F.max("alt").alias("high")).where("low <> high").select("rec", F.lit(True).alias("clash"))
    clash = scratch.keep(clash, "clash")
    count = clash.count()
    if not count:
        return signed.drop("alt")
    told = signed.join(small_side(clash, count, 16), "rec", "left")
    return scratch.keep(told.withColumn("rec", F.when(F.col("clash"), F.xxhash64("alt", "rec")).otherwise(F.col("rec"))).drop("alt", "clash"), "signed")


def grouped(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, k: int = 3, trees: int = 4, branches: int = 2, limit: int = 100, levels: int = 16, chunk: int = 4096, recall: float = 0.9
) -> DataFrame:
    """(doc_id, k1, k2, root) of the documents that have words; k1 and k2 are hashes of id and text, documents of equal root form a group."""
    bound_batches(docs.sparkSession)
    src = docs.select(id_column(docs, id_col).alias("doc_id"), wide_key(id_col, text_col, seed=1).alias("k1"), wide_key(id_col, text_col, seed=2).alias("k2"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType([src.schema["doc_id"], *StructType.fromDDL(SIGNED).fields])
    signed = apart(scratch.keep(src.mapInArrow(lambda batches: sign(batches, k), schema), "signed"), scratch)
    # documents of one signature are one record from here on
    sketches, least = scratch.keep(signed.select("rec", "sketch").dropDuplicates(["rec"]), "sketches"), threshold - 0.04
    few, dense, by_level = forest(signed, 0, trees, branches, limit, levels, scratch)
    enough = max([d for d in range(1, levels + 1) if trees_for(d, threshold, branches, recall) <= trees], default=0)
    if len(by_level) > enough:  # what went deeper than these trees are enough for gets more of them
        deep = scratch.keep(union(by_level[enough:]).distinct(), "deep")
        more = trees_for(len(by_level), threshold, branches, recall) - trees
        a, b, _ = forest(signed.join(deep, "rec", "left_semi"), trees, more, branches, limit, levels, scratch)
        few, dense = few + a, dense + b
    near = union(few).join(sketches, "rec").select("node", "rec", "sketch").repartition("node").sortWithinPartitions("node").mapInArrow(compare(least), "a bigint, b bigint")
    thick = union(dense)
    if thick.isEmpty():
        parts = components(near, scratch)
    else:
        near = scratch.keep(near.unionByName(elect(thick, sketches, least, chunk, scratch)), "near")
        parts = components(near, scratch)
        more_edges = open_pairs(thick, parts, sketches, least, chunk, scratch)
        if more_edges is not None:
            more_edges = scratch.keep(more_edges, "met")
            if not more_edges.isEmpty():
                parts = components(parts.select(F.col("rec").alias("a"), F.col("root").alias("b")).unionByName(more_edges), scratch)
    return signed.select("doc_id", "k1", "k2", "rec").join(parts, "rec", "left").select("doc_id", "k1", "k2", F.coalesce("root", "rec").alias("root"))


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """One row for each document that has near duplicates: (doc_id, group_id, group_size). group_id is the least doc_id of the group.

    Documents are sets of k-word shingles (letters and digits, lower-cased); two are near duplicates when 128 minwise values put
    their Jaccard similarity at threshold or more (less 0.04, about one deviation, for recall). Groups are connected components.
    Candidates come from trees: a node's documents go into branches child nodes by their minwise values at coordinates that the
    node draws, until a node has at most limit documents, all pairs of which are compared. A pair of similarity s stays together
    in a tree of depth d with p(d) = 1 - (1 - s * p(d - 1)) ** branches; documents that went deeper than the trees are enough
    for get as many more as bring a pair at the threshold to recall. Children with most of a large parent are dense (copies):
    there leaders are elected in chunks, and then every pair of the node whose members are not connected by then is compared,
    in tiles. Documents of equal signatures (128 bits of a hash) are one record. There is no cap on partners or candidates.

    Null, empty and wordless texts are in no group. Texts under k words are one shingle; a very long text is a set like others.
    Repeated rows are near duplicates of each other. A null doc_id is group_id only where the group has no other. Ties: the least
    id; ids may have any type that can be ordered. An empty table gives no rows; other columns are not read.
    """
    scratch, out = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    members = out.keep(grouped(docs, scratch, **options), "members")
    scratch.drop()
    groups = members.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return members.join(groups, "root").select("doc_id", "group_id", "group_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """docs with one row of each group of near_groups(), that of the least doc_id (of several such one of the least hash); columns stay as they are.

    Rows in no group stay, those with null, empty or wordless texts too. Of repeated rows of a group one stays. A null doc_id goes
    before no other. An empty table stays empty; other columns may have any name.
    """
    scratch, out = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    members = scratch.keep(grouped(docs, scratch, id_col, text_col, **options), "members")
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("k1"), F.col("k2"))).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.col("lead.k1").alias("l1"), F.col("lead.k2").alias("l2"))
    # drop: all rows of the key go; else one of them stays
    decided = out.keep(members.join(first, "root").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), ((F.col("k1") != F.col("l1")) | (F.col("k2") != F.col("l2"))).alias("__drop")).distinct(), "decided")
    scratch.drop()
    names = docs.columns
    marked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], wide_key(id_col, text_col, seed=1).alias("__k1"), wide_key(id_col, text_col, seed=2).alias("__k2"))
    joined_ = marked.join(small_side(decided, decided.count(), 64, broadcast_bytes), ["__k1", "__k2"], "left")
    alone = joined_.where("__drop is null").drop("__k1", "__k2", "__drop")
    one = joined_.where("not __drop").drop("__drop").dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")
    return alone.unionByName(one).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
