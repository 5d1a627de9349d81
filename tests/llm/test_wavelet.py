from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import wavelet
from webloom.llm.tokens import Words, encode, processor
from webloom.llm.wavelet import build, save, shards

DOCS = "doc_id bigint, text string, payload string, shard_id string"


def reader(payload):
    kinds = [v for v in vars(wavelet).values() if isinstance(v, type) and hasattr(v, "access")]
    return kinds[0](payload)


@pytest.mark.parametrize(("n", "bits"), [(1, 1), (700, 3), (5000, 15), (300_000, 6)])
def test_access_rank_select(n, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
    m = reader(build(ids, np.array([0, n]), bits))
    assert (m.tokens() == ids).all()
    for i in rng.integers(0, n, 30).tolist():
        assert m.access(i) == ids[i]
    for token in rng.choice(ids, 5).tolist():
        where = np.flatnonzero(ids == token)
        assert m.count(token) == len(where)
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(token, a, b) == ((where >= a) & (where < b)).sum()
        assert m.rank(token, b) == (where < b).sum()
        for k in {0, len(where) // 2, len(where) - 1}:
            assert m.locate(token, k) == where[k]
    with pytest.raises(IndexError):
        m.access(n)
    with pytest.raises(IndexError):
        m.locate(int(ids[0]), m.count(int(ids[0])))
    assert m.count(1 << bits) == 0


def test_sequence_of_nothing():
    m = reader(build(np.zeros(0, np.uint32), np.array([0, 0]), 4))
    assert m.tokens().tolist() == [] and m.count(3) == 0 and m.document(0) == []


@pytest.mark.parametrize("shard_tokens", [1 << 22, 50])
def test_round_trip_of_documents(spark, tmp_path, shard_tokens):
    rows = [(i, t) for i, t in enumerate(["the house on the river", "", None, "été 漢字", "word " * 3000, "the house on the river"] * 4)] + [(None, "no id")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    found = shards(frame, shard_tokens=shard_tokens)
    got = []
    for r in found.collect():
        m = reader(bytes(r.payload))
        assert m.n == r.n_tokens and len(r.doc_ids) == r.n_docs == len(r.doc_starts)
        got += [(i, m.document(d)) for d, i in enumerate(r.doc_ids) if m.starts[d + 1] - m.starts[d] < 100]
        whole = m.tokens()
        assert sum(int(m.starts[d + 1] - m.starts[d]) for d in range(r.n_docs)) == len(whole)
    want = [(i, ids) for (i, _), ids in zip(rows, encode(pa.array([t for _, t in rows]))) if len(ids) < 100]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    paths = [r.path for r in save(found, f"file://{tmp_path}").collect()]
    assert len(set(paths)) == found.count()
    with open(paths[0], "rb") as f:
        assert reader(f.read()).n > 0 or shard_tokens == 50


def test_empty(spark):
    assert shards(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_close_by_documents_and_hold_ids(spark):
    """Empty texts don't make a shard without end; the file alone has the ids; ids of any type, ties and repeats in order."""
    frame = spark.createDataFrame([(f"d{i % 7}", "" if i % 2 else None) for i in range(50)], "doc_id string, text string").coalesce(1)
    found = shards(frame, shard_docs=20).collect()
    assert sorted(r.n_docs for r in found) == [10, 20, 20]
    for r in found:
        assert reader(bytes(r.payload)).names == r.doc_ids
    assert [i for r in sorted(found, key=lambda r: r.shard_id) for i in r.doc_ids] == [f"d{i % 7}" for i in range(50)]


@pytest.mark.parametrize(("most", "letters", "apart"), [(1 << 18, 1 << 23, True), (5, 1 << 23, True), (1 << 18, 9, True), (1 << 18, 1 << 23, False)])
def test_ids_by_words_are_those_of_whole_texts(most, letters, apart):
    """Spaces anywhere, the space's mark in the text, unknown letters, no text; also while words are forgotten, or none is told apart."""
    rng = np.random.default_rng(most + letters)
    signs = [*[" "] * 6, "▁", "\n", "\r\n", "\t", "\0", "the", "The", "ing", "é", "é", "漢字", "👩‍👧", " ", "ﬁ", "0", "12", ".", "</s>", "<unk>", "<0x0A>", "x" * 70, "ש"]
    fixed = [None, "", " ", "  ", "   ", "▁", "a ", "a  ", " a", "  a b", "the house  on the river ", "▁▁a▁b"]
    words = Words(processor(), most, letters)
    assert words.apart
    words.apart = apart
    for _ in range(40):
        texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(rng.integers(0, 8))] + fixed
        rng.shuffle(texts)
        got, edges = words.encode(texts)
        assert [got[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in words.encode([])] == [[], [0]]


def test_each_word_is_encoded_once(spark, monkeypatch):
    """A task's calls of the model, counted in letters: with whole texts there were 200 times as many."""

    class Counting:
        given = 0

        def __getattr__(self, name):
            return getattr(processor(), name)

        def encode(self, texts, **how):
            Counting.given += sum(map(len, texts))
            return processor().encode(texts, **how)

    frame = spark.createDataFrame([], "doc_id bigint, text string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: run)
    monkeypatch.setattr(wavelet, "processor", lambda _: Counting())
    monkeypatch.setattr(wavelet, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    text = " ".join(f"word{i}" for i in range(500))
    found = list(shards(frame)(iter([pa.record_batch({"doc_id": pa.array(range(200)), "text": pa.array([text] * 200)})])))
    m = reader(found[0].column("payload")[0].as_py())
    assert m.tokens().tolist() == encode(pa.array([text]))[0] * 200
    assert Counting.given <= 2 * len(text)
