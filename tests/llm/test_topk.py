import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm.topk import top_k

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank string"


def brute(rows, k):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None]
    out = {}
    for i, v in rows:
        found = []
        for j, w in rows:
            if i != j:
                size = np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())
                found.append((round(float(v @ w / size), 9) if size > 0 else 0.0, j))
        out[i] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.neighbour_id))
    return out


def close(a, b):
    assert a.keys() == {q for q, found in b.items() if found}
    for q in a:
        assert [j for _, j in a[q]] == [j for _, j in b[q]]
        assert np.allclose([s for s, _ in a[q]], [s for s, _ in b[q]], atol=2e-9)


@pytest.mark.parametrize("n", [1, 7, 300])
def test_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), rng.standard_normal(16).astype(np.float32).tolist()) for i in range(n)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    close(got(top_k(frame)), brute(rows, 10))


def test_ties_zeros_and_nulls(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(40, [0.0, 0.0]), (41, None), (None, [1.0, 1.0]), (42, [0.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    close(got(top_k(frame)), brute(rows, 10))


def test_empty(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_queries_blocks_and_merging(spark):
    """Some rows as queries against all, in blocks so small that lists are merged in several levels."""
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.standard_normal(8).astype(np.float32).tolist()) for i in range(240)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    want = {q: found for q, found in brute(rows, 10).items() if q % 20 == 0}
    close(got(top_k(frame, is_query=F.col("vec_id") % 20 == 0, shard_rows=20, query_rows=5, fan_in=3)), want)


def test_lengths_nan_and_repeated_ids(spark):
    """Each length is a space of its own; rows that can't be compared are left out; a repeated row is a neighbour of its like."""
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 2.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, []), (8, [float("inf"), 1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    found = got(top_k(frame))
    assert [j for _, j in found[3]] == [4] and [j for _, j in found[4]] == [3]
    assert found.keys() == {1, 2, 3, 4, 9}
    assert [j for _, j in found[1]] == [2, 9, 9]
    assert sorted(j for _, j in found[9]) == [1, 1, 2, 2, 9, 9]


def test_ids_of_other_types(spark):
    frame = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("c", [1.0, 0.1])], "vec_id string, embedding array<float>")
    assert [j for _, j in got(top_k(frame))["b"]] == ["a", "c"]
