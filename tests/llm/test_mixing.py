import random
from collections import Counter, defaultdict

import pytest

from webloom.llm.mixing import flight, land, mix, rates, sample

SCHEMA = "doc_id bigint, text string, source string, key string, copies string"
WORDS = "alpha beta gamma delta epsilon river stone".split()


def docs(spark, n=900, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 60))), "abc"[min(2, int(r.expovariate(1)))], "k", "c") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_flight_keeps_both_totals():
    r = random.Random(5)
    m, t, p = [1.0] * 200, [float(r.randint(1, 50)) for _ in range(200)], [r.uniform(0.1, 0.9) for _ in range(200)]
    q = flight(m, t, p, r)
    assert sum(0 < x < 1 for x in q) <= 2
    for w in (m, t):
        assert sum(a * b for a, b in zip(w, q)) == pytest.approx(sum(a * b for a, b in zip(w, p)))
    assert set(land(m, q, r)) <= {0.0, 1.0}


def test_inclusion_probabilities_are_kept():
    t, p, met, n = [3.0, 9.0, 1.0, 7.0, 5.0, 2.0], [0.2, 0.5, 0.7, 0.4, 0.9, 0.3], [0] * 6, 4000
    for i in range(n):
        r = random.Random(i)
        for j, x in enumerate(land([1.0] * 6, flight([1.0] * 6, t, p, r), r)):
            met[j] += x
    for x, y in zip(met, p):
        assert x / n == pytest.approx(y, abs=0.035)


def test_rates():
    assert rates({"a": 100, "b": 100}, {"a": 1, "b": 3}, None, 1) == {"a": pytest.approx(1 / 3), "b": pytest.approx(1)}
    assert rates({"a": 100, None: 0}, {"a": 1}, 50, 1) == {"a": 0.5, None: 1.0}
    assert rates({}, None, None, 1) == {}
    assert rates({"a": 10, "b": 10}, {"a": 1}, None, 1)["b"] == 0


@pytest.mark.parametrize("bucket", [4096, 32])
def test_totals_meet_their_targets(spark, bucket):
    rows = mix(docs(spark), bucket=bucket, weights={"a": 1.0, "b": 2.0, "c": 1.0}).collect()
    for s in "abc":
        own = [r for r in rows if r.source == s]
        # two units of each source at most miss their place
        assert abs(sum(r.copies - r.rate for r in own)) <= 3
        assert abs(sum((r.copies - r.rate) * r.n_tokens for r in own)) <= 3 * max(r.n_tokens for r in own)
    assert len(rows) == 900


def test_copies_over_one_and_the_rows_picked(spark):
    frame = docs(spark, 200)
    options = {"weights": {"a": 1.0, "b": 1.0, "c": 1.0}, "budget": 20000.0}
    picked = {r.doc_id: r.copies for r in mix(frame, **options).collect()}
    assert max(picked.values()) > 1
    kept = sample(frame, **options)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: c for i, c in picked.items() if c})


def test_null_empty_and_repeated(spark):
    rows = [(1, None, "a", "k", "c"), (2, "", "a", "k", "c"), (3, "river", None, "k", "c"), (4, "river stone", "a", "k", "c"), (4, "river stone", "a", "k", "c"), (None, "stone", "b", "k", "c")]
    out = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 6
    fates = defaultdict(set)
    for r in out:
        fates[r.doc_id].add(r.copies)
    assert len(fates[4]) == 1
    assert sample(spark.createDataFrame(rows, SCHEMA)).columns == ["doc_id", "text", "source", "key", "copies"]


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sample(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("budget_share", [1.0, 0.5])
def test_a_tiny_source_does_not_set_the_size(spark, budget_share):
    """By default the mixture has a fixed share of all tokens, a source of two words or not."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(40)), "ab"[i % 10 == 0], "k", "c") for i in range(600)]
    for more in ([], [(1000, "river stone", "tiny", "k", "c")], [(1000, "river stone", None, "k", "c")]):
        out = mix(spark.createDataFrame(rows + more, SCHEMA), budget_share=budget_share).collect()
        total = sum(x.n_tokens for x in out)
        assert sum(x.copies * x.n_tokens for x in out) == pytest.approx(budget_share * total, rel=0.02)
        assert max(x.rate for x in out) > 1 or budget_share < 1


def test_default_mixture_keeps_its_size(spark):
    rows = [(i, "alpha beta gamma delta epsilon " * 8, "a", "k", "c") for i in range(500)] + [(1000, "river stone", "tiny", "k", "c")]
    kept = sample(spark.createDataFrame(rows, SCHEMA)).where("source = 'a'").count()
    assert kept > 400
