"""Canonical exact digests: Unicode normalisation, case and whitespace folding, wide xxhash, byte comparison in equal buckets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bound_batches, materialize, slices, small_side


def canonical(text: str, form: str = "NFKC") -> str:
    """Normalised, case-folded, runs of white space as one space, none at the ends. Folding can undo the normal form, so that is taken again."""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize(form, text).casefold()
    return " ".join(unicodedata.normalize(form, folded).split())


def canonical_udf(form: str):
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array([None if t is None else canonical(t, form) for t in batch.to_pylist()], pa.string())

    run.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def digest_udf(form: str, width: int):
    """xxh3-128 of the canonical UTF-8 bytes, the first width bytes of it; a null text has a null digest."""

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            out: list[bytes | None] = []
            for part in slices(batch):
                out += [None if t is None else xxhash.xxh3_128_digest(canonical(t, form).encode("utf-8", "surrogatepass"))[:width] for t in part.to_pylist()]
            yield pa.array(out, pa.binary())

    run.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "NFKC", width: int = 16, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of docs: (doc_id, group_id, copies).

    group_id is the least doc_id of the rows whose canonical texts are equal byte by byte, copies their number.
    Rows are first grouped by digest (16 bytes a row are shuffled). Only texts whose digest occurs more than once are
    read again; an aggregate keyed by digest and canonical bytes compares them exactly, its map side combining
    copies before the shuffle. Digests with several canonical texts (collisions) are told apart by the bytes.

    Null text: group_id null, copies 0. Empty and blank texts are equal to each other; very long ones are taken whole, as bytes.
    Repeated rows count as copies.
    A null doc_id is ignored as group_id unless the group has no other. An empty table gives no rows. Columns of
    docs other than the two named are not read, whatever their names.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    digest, canon = digest_udf(form, width), canonical_udf(form)
    digests = materialize(src.select("doc_id", digest("text").alias("digest")), "digest")
    first = digests.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    repeated = materialize(first.where("copies > 1"), "repeated")
    count = repeated.count()
    if not count:
        return digests.select("doc_id", F.when(F.col("digest").isNotNull(), F.col("doc_id")).alias("group_id"), F.col("digest").isNotNull().cast("bigint").alias("copies"))
    members = src.withColumn("digest", digest.asNondeterministic()("text")).join(small_side(repeated.select("digest"), count, 64, broadcast_bytes), "digest", "left_semi").select("doc_id", "digest", canon("text").alias("canon"))
    exact = members.groupBy("digest", "canon").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    # one row for each digest; where bytes differ within a digest, variants > 1
    by_digest = materialize(exact.groupBy("digest").agg(F.count(F.lit(1)).alias("variants"), F.min("group_id").alias("group_id"), F.sum("copies").alias("copies")), "groups")
    collided = by_digest.where("variants > 1").select("digest")
    joined = digests.join(small_side(by_digest, count, 80, broadcast_bytes), "digest", "left")
    single = joined.where("variants is null or variants = 1").select(
        "doc_id",
        F.when(F.col("digest").isNull(), F.lit(None)).otherwise(F.coalesce("group_id", "doc_id")).alias("group_id"),
        F.when(F.col("digest").isNull(), 0).otherwise(F.coalesce("copies", F.lit(1))).cast("bigint").alias("copies"),
    )
    if collided.isEmpty():
        return single
    again = members.join(collided, "digest", "left_semi")
    told = exact.join(collided, "digest", "left_semi")
    return single.unionByName(again.join(told, ["digest", "canon"]).select("doc_id", "group_id", "copies"))
