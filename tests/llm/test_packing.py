import random
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import packing, tokens
from webloom.llm.packing import counted, pack
from webloom.llm.tokens import Words, encode, processor

SCHEMA = "doc_id bigint, text string, bin_id string, size int"
CAPACITY = 64


def texts(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choice("alpha beta gamma delta epsilon river stone".split()) for _ in range(r.choice([1, 3, 9, 20, 33, 200])))) for i in range(n)]


def best_fit_bins(sizes):
    """Best-fit decreasing, one piece after another."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(CAPACITY - s)
    return len(gaps)


def checked(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = [tuple(r) for r in pack(frame, capacity=CAPACITY, **options).select("bin_id", "doc_id", "chunk", "bin_offset", "n_tokens").collect()]
    bins, by_doc = defaultdict(list), defaultdict(int)
    for b, d, c, at, n in out:
        bins[b].append((at, n))
        by_doc[d] += n
    for held in bins.values():
        end = 0
        for at, n in sorted(held):  # pieces lie one after another, none over another
            assert at == end and n > 0
            end += n
        assert end <= CAPACITY
    want = defaultdict(int)
    for d, t in rows:
        if n := len(processor().encode(t or "")):
            want[d] += n
    assert by_doc == want
    return out, bins


@pytest.mark.parametrize("rows_per_part", [250_000, 40])
def test_everything_is_packed_and_tight(spark, rows_per_part):
    out, bins = checked(spark, texts(400, 1), rows_per_part=rows_per_part)
    sizes = [n for _, _, _, _, n in out]
    # in one range it is sequential best-fit decreasing; across ranges a few bins more
    assert len(bins) <= best_fit_bins(sizes) * (1.0 if rows_per_part > 400 else 1.1)


def test_nulls_empty_long_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, "river " * 5000), (4, "river stone"), (4, "river stone"), (None, "river")]
    out, _ = checked(spark, rows)
    assert {d for _, d, _, _, _ in out} == {3, 4, None}
    assert sum(1 for _, d, _, _, _ in out if d == 4) == 2
    chunks = sorted(c for _, d, c, _, _ in out if d == 3)
    assert chunks == list(range(len(chunks))) and len(chunks) > 50


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary()])
@pytest.mark.parametrize(("most", "letters", "apart"), [(1 << 18, 1 << 23, True), (3, 1 << 23, True), (1 << 18, 9, True), (1 << 18, 1 << 23, False)])
def test_counts_by_words_are_those_of_whole_texts(most, letters, apart, kind):
    """Spaces anywhere, the space's mark in the text, unknown letters, no text; also while words are forgotten within a text, and in slices."""
    rng = np.random.default_rng(most + letters)
    signs = [*[" "] * 6, "▁", "\n", " \n", "\t", "\0", "the", "The", "ing", "é", "漢字", "👩‍👧", "\u00a0", "ﬁ", "0", ".", "</s>", "<unk>", "<0x0A>", "x" * 70]
    fixed = [None, "", " ", "  ", "▁", "a ", "a  ", " a", "a  b", "a b c d e f g a", "the house  on the river "]
    words = Words(processor(), most, letters)
    words.apart = apart
    for i in range(40):
        texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(rng.integers(0, 8))] + fixed * (i % 2)
        rng.shuffle(texts)
        column = pa.array(texts, pa.string()).cast(kind)
        for part in (column, column.slice(len(column) // 2)):
            assert words.count(part).tolist() == [len(ids) for ids in encode(part)]


def test_each_word_is_counted_once(spark, monkeypatch):
    """A task's calls of the model, counted in letters: with whole texts there were 200 times as many."""

    class Counting:
        given = 0

        def __getattr__(self, name):
            return getattr(processor(), name)

        def encode(self, texts, **how):
            Counting.given += sum(map(len, texts))
            return processor().encode(texts, **how)

    frame = spark.createDataFrame([], "doc_id bigint, text string")
    text = " ".join(f"word{i}" for i in range(500))
    size = len(processor().encode(text))
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: run)
    for module in (packing, tokens):
        monkeypatch.setattr(module, "processor", lambda *_: Counting(), raising=False)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = counted(frame, "doc_id", "text", CAPACITY, packing.TOKENIZERS)
    found = list(run(iter([pa.record_batch({"doc_id": pa.array(range(100)), "text": pa.array([text] * 100)})] * 2)))
    pieces = -(-size // CAPACITY)
    assert [x for b in found for x in b.column("n_tokens").to_pylist()] == [size] * 200
    assert [x for b in found for x in b.column("first").to_pylist()] == [pieces * i for i in range(200)]
    assert Counting.given <= 2 * len(text)
