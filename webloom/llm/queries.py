"""The queries of this subpackage, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import shards

    return shards(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_hits

    return secret_hits(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)


def op6_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_digest import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, quality

    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet_shards": op1_wavelet_shards,
    "op2_license_scan": op2_license_scan,
    "op3_source_mix": op3_source_mix,
    "op4_secret_scan": op4_secret_scan,
    "op5_top_k": op5_top_k,
    "op6_exact_digest": op6_exact_digest,
    "op7_language_id": op7_language_id,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality": op9_quality,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op5_top_k": """
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM e),
        p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id,
                     round(CASE WHEN a.norm > 0 AND b.norm > 0 THEN list_inner_product(a.v, b.v) / (a.norm * b.norm) ELSE 0 END, 9) AS score
              FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, neighbour_id, score FROM r WHERE rank <= 10""",
    "op6_exact_digest": """
        WITH c AS (SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g')) END AS k FROM documents)
        SELECT doc_id, CASE WHEN k IS NULL THEN NULL ELSE min(doc_id) OVER (PARTITION BY k) END AS group_id,
               CASE WHEN k IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY k) END AS copies
        FROM c""",
}
