import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import quality as Q

DOCS = "doc_id bigint, text string, score string, passages string"
SF = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = Q.Network.start(5, 3, rng)
    for k in Q.Network.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, count, y, weight = rng.standard_normal((9, Q.FEATURES)) * 0.1, np.array([2, 4, 3]), np.array([0.0, 1.0, 1.0]), np.array([1.0, 0.5, 2.0])

    def loss():
        p = net.forward(x, count)["p"]
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    for k, grad in net.gradients(x, count, y, weight).items():
        value = getattr(net, k)
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in value.shape)
            before = value[at]
            value[at] = before + 1e-5
            up = loss()
            value[at] = before - 1e-5
            down = loss()
            value[at] = before
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-6, rel=1e-3)


def test_passages_are_encoded_alone():
    texts = ["ab" * 700, "", "é" * 333, "x"]
    x, count = Q.encode(pa.array(texts), 400)
    assert count.tolist() == [4, 0, 2, 1]
    one = np.concatenate([Q.encode(pa.array([t]), 400)[0] for t in texts])
    assert np.allclose(x, one)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    rows = Q.quality(docs, Q.fit(docs, train)).join(held.select("doc_id", F.col("quality").alias("y")), "doc_id").where("score is not null").collect()
    good, bad = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    assert good and bad
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.85  # area under the curve
    assert sum(r.keep for r in rows if r.y == 1) >= 0.9 * len(good)


def test_null_empty_long_and_no_labels(spark):
    frame = spark.createDataFrame([(1, None, "x", "y"), (2, "", "x", "y"), (3, "some text " * 60_000, "x", "y"), (None, "t", "x", "y")], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = {r.doc_id: r for r in Q.quality(frame, Q.fit(frame, none)).collect()}
    assert rows[1].score is None and rows[2].score is None and not rows[1].keep and rows[2].passages == 0
    assert rows[3].passages == 1500 and 0 < rows[None].score < 1 and rows[None].top_weight == pytest.approx(1)
    assert Q.quality(spark.createDataFrame([], DOCS), Q.fit(frame, none)).count() == 0


def test_score_equals_one_passage_after_another():
    """The network's formulas, a document and a passage at a time."""
    rng = np.random.default_rng(8)
    net = Q.Network.start(6, 4, rng)
    texts = ["ab cd " * 200, "x", "some other words " * 40]
    got = Q.score(pa.array(texts), net, 300)
    for text, r in zip(texts, got):
        raw = text.encode()
        h, e = [], []
        for i in range(0, len(raw), 300):
            x = Q.encode(pa.array([raw[i : i + 300].decode()]), 300)[0][0]
            h.append(np.tanh(x @ net.w1 + net.b1))
            e.append(float((np.tanh(h[-1] @ net.v) / (1 + np.exp(-(h[-1] @ net.u)))) @ net.w))
        a = np.exp(np.array(e) - max(e))
        a /= a.sum()
        z = sum(w * x for w, x in zip(a, h))
        assert r["score"] == pytest.approx(float(1 / (1 + np.exp(-(z @ net.c + net.d[0])))), abs=1e-5)
        assert r["passages"] == len(h) and r["top_weight"] == pytest.approx(a.max(), abs=1e-5) and a[r["top_passage"]] == pytest.approx(a.max())


def test_ties_repeated_rows_and_other_ids(spark):
    """Equal passages share the weight, the first is named; repeated rows are scored each; ids of any type; contradicting labels count as bad."""
    frame = spark.createDataFrame([("a", "z" * 800, "x", "y"), ("a", "z" * 800, "x", "y"), ("b", "words of prose", "x", "y")], "doc_id string, text string, score string, passages string")
    marks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "doc_id string, quality int")
    rows = Q.quality(frame, Q.fit(frame, marks)).collect()
    assert [r.top_passage for r in rows if r.doc_id == "a"] == [0, 0] and len({r.score for r in rows if r.doc_id == "a"}) == 1
    assert len(rows) == 3
