import math

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import language_id as L
from webloom.llm.words import words

DOCS = "doc_id bigint, text string, lang string, score double, r string"
SF = "/root/testdata/sf0.01"


def brute_forward(word, names, p, unknown):
    """Sum over all segmentations, by recursion over the first piece."""
    text = chr(L.START) + word

    def rest(i):
        if i == len(text):
            return 1.0
        total = unknown * rest(i + 1) if i > 0 else 0.0
        return total + sum(p[n] * rest(i + len(n)) for n in names if text.startswith(n, i))

    return math.log(rest(0))


def test_forward_sums_all_segmentations():
    names = [chr(L.START), f"{chr(L.START)}a", "a", "b", "ab", "ba", "bab", "c"]
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(len(names)), 2).T
    pieces, unknown = L.Pieces.of(names), np.array([1e-4, 1e-3])
    w = words(pa.array(["a ab abab babab c cab abcabc zab abz abababababababababab"]), letters_only=True)
    got = L.forward(w, np.arange(len(w.hash)), pieces, p, unknown)
    for i in range(len(w.hash) - 1):
        for k in range(2):
            assert got[i, k] == pytest.approx(brute_forward(w.text(i), names, dict(zip(names, p[:, k])), unknown[k]))
    assert np.isfinite(got).all()


def test_expected_counts_are_the_posterior():
    """For one word: the expected number of letters covered is its length."""
    names = [chr(L.START), "a", "b", "ab"]
    p = np.full((4, 1), 0.25)
    w = words(pa.array(["abab"]), letters_only=True)
    counts = L.forward(w, np.array([0]), L.Pieces.of(names), p, np.array([0.0]), np.ones((1, 1)))
    assert (counts[:, 0] * [1, 1, 1, 2]).sum() == pytest.approx(5)


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(f"{SF}/documents.parquet"), train_docs=60)


def test_held_out_accuracy(spark, model):
    rows = L.identify(spark.read.parquet(f"{SF}/documents.parquet"), model).withColumnRenamed("lang", "found").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    judged = [r for r in rows if r.found is not None and r.letters > 20]
    assert len(judged) > 0.9 * len(rows)
    assert sum(r.found == r.lang for r in judged) > 0.98 * len(judged)


def test_long_words_and_texts(model):
    got = L.Scorer(model).decide(pa.array(["a" * 50_000, "the house " * 40_000]))
    assert all(math.isfinite(x["score"]) for x in got)


def test_store_does_not_change_scores(model):
    texts = pa.array([f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} house garden" for i in range(500)])
    a, b = L.Scorer(model), L.Scorer(model, store=50)
    want = a.totals(texts)[0]
    for i in range(0, 500, 20):
        assert np.allclose(b.totals(texts.slice(i, 20))[0], want[i : i + 20])


def test_null_empty_and_extra_columns(spark, model):
    frame = spark.createDataFrame([(1, None, "en", 1.0, "x"), (2, "", "en", 1.0, "x"), (3, "12 34 !!", "en", 1.0, "x"), (None, "漢字漢字漢字漢字", "en", 1.0, "x")], DOCS)
    rows = L.identify(frame, model).collect()
    assert [(r.lang, r.keep) for r in rows[:3]] == [(None, False)] * 3 and rows[3].keep is False
    assert L.keep_identified(frame, model).count() == 0
    kept = L.keep_identified(spark.read.parquet(f"{SF}/documents.parquet").limit(20), model)
    assert kept.columns == spark.read.parquet(f"{SF}/documents.parquet").columns


def test_no_labels_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "the house", None, None, None)], DOCS)
    rows = L.identify(frame, L.fit(frame)).collect()
    assert [(r.lang, r.keep) for r in rows] == [(None, False)]
    empty = spark.createDataFrame([], DOCS)
    assert L.identify(empty, L.fit(empty)).count() == 0


@pytest.mark.parametrize("letters", [10, 60, 500])
def test_expected_counts_cover_words_of_any_length(letters):
    """A script without spaces: the expected letters covered are all of the word's, the unknown ones aside."""
    names = [chr(L.START), *"漢字語文", "漢字", "語文", "字語文"]
    p = np.full((len(names), 1), 1 / len(names))
    w = words(pa.array([("漢字語文" * letters)[:letters]]), letters_only=True)
    counts = L.expected_counts(w, np.array([0]), L.Pieces.of(names), p, np.array([1e-9]), np.ones((1, 1)))
    assert (counts[:, 0] * [len(n) for n in names]).sum() == pytest.approx(letters + 1, rel=1e-6)


def test_long_runs_by_segments_are_the_same_sum(monkeypatch):
    r = np.random.default_rng(4)
    names = [chr(L.START), f"{chr(L.START)}a", "a", "b", "ab", "ba", "bab", "c", "abcabcab", "cabcabcabcabcab"]
    p = r.dirichlet(np.ones(len(names)), 3).T
    pieces, unknown = L.Pieces.of(names), np.array([1e-4, 1e-9, 1e-3])
    w = words(pa.array(["".join(r.choice(list("abcabcz"), n)) for n in (1, 5, 40, 300, 1000)]), letters_only=True)
    want = L.forward(w, np.arange(5), pieces, p, unknown)
    monkeypatch.setattr(L, "LONG", 1)
    for segment, at_once in ((256, 1 << 16), (16, 64), (7, 70)):
        monkeypatch.setattr(L, "SEGMENT", segment)
        monkeypatch.setattr(L, "AT_ONCE", at_once)
        assert L.forward(w, np.arange(5), pieces, p, unknown) == pytest.approx(want)


def test_a_run_of_fifty_thousand_letters_takes_a_second_or_two(model):
    import time

    text = pa.array(["".join(np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyz"), 50_000))])
    began = time.process_time()
    (got,) = L.Scorer(model).decide(text)
    assert got["letters"] == 50_001 and not got["keep"]
    assert time.process_time() - began < 4


def test_languages_without_spaces_are_told_apart():
    r = np.random.default_rng(2)
    syllables = {"one": ["กา", "มะ", "นี", "ปลา"], "two": ["ขอ", "รา", "ไม", "ตะ"]}
    rows = [("".join(r.choice(s, 120)), name) for name, s in syllables.items() for _ in range(100)]
    found = L.train([t for t, _ in rows[::2]], [name for _, name in rows[::2]])
    got = L.Scorer(found).decide(pa.array([t for t, _ in rows[1::2]]))
    assert all(g["lang"] == name for g, (_, name) in zip(got, rows[1::2]))


def test_more_than_fifty_languages(spark):
    """Each of 60 labels keeps its language."""
    r = np.random.default_rng(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = {f"l{i:02}": ["".join(r.choice(list(letters), 7)) for _ in range(8)] for i in range(60)}
    rows = [(j, " ".join(r.choice(own, 40)), name, 0.0, "") for j, (name, own) in enumerate((n, o) for n, o in lexicon.items() for _ in range(3))]
    docs = spark.createDataFrame(rows, DOCS)
    found = L.fit(docs)
    assert len(found.languages) == 60
    assert L.fit(docs, languages=["l01", "l02"]).languages == ["l01", "l02"]
    got = {x.doc_id: x.lang for x in L.identify(docs, found).collect()}
    assert sum(got[j] == name for j, _, name, _, _ in rows) >= 0.95 * len(rows)


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "aa bb cc", "x", 0.0, ""), (2, "aa bb cc", "a", 0.0, ""), (3, "aa bb", None, 0.0, ""), (3, "aa bb", None, 0.0, "")], DOCS)
    rows = L.identify(docs, L.fit(docs)).collect()
    assert len(rows) == 4
    assert {x.lang for x in rows} == {"a"} and {x.margin for x in rows} == {0.0}
