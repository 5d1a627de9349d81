import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import near_dedup
from webloom.llm.near_dedup import components, keep_one, near_groups

DOCS = "doc_id bigint, text string, rec string, node string, group_id int"
VOCABULARY = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrs"]


def sentence(r, n):
    return [r.choice(VOCABULARY) for _ in range(n)]


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def families(seed, many, copies):
    """Texts with near copies (a few words replaced) and texts of their own."""
    r = random.Random(seed)
    rows, number = [], 0
    for _ in range(many):
        base = sentence(r, r.randint(60, 120))
        for c in range(r.randint(1, copies)):
            text = list(base)
            for _ in range(min(c, 3)):
                text[r.randrange(len(text))] = r.choice(VOCABULARY)
            rows.append((number, " ".join(text)))
            number += 1
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], DOCS)


def pairs_over(rows, least):
    sets = [(i, shingles(t)) for i, t in rows]
    out = set()
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and len(x & y) >= least * len(x | y):
                out.add((min(i, j), max(i, j)))
    return out


def labels(df):
    return {r.doc_id: r.group_id for r in df.collect()}


@pytest.mark.parametrize(("seed", "limit"), [(1, 100), (2, 5)])
def test_recall_and_precision(spark, seed, limit):
    rows = families(seed, 60, 5)
    found = labels(near_groups(frame(spark, rows), limit=limit))
    want = pairs_over(rows, 0.6)
    met = sum(1 for a, b in want if a in found and found[a] == found.get(b))
    assert met >= 0.9 * len(want)
    # what is grouped is connected by pairs that are alike
    loose = pairs_over(rows, 0.35)
    near = defaultdict(set)
    for a, b in loose:
        near[a].add(b)
        near[b].add(a)
    for i, g in found.items():
        assert any(found.get(j) == g for j in near[i])


def test_many_copies(spark):
    """A dense node: hundreds of copies of one text, each a little different, and clean ones beside them."""
    r = random.Random(4)
    base = sentence(r, 150)
    rows = []
    for i in range(400):
        text = list(base)
        text[r.randrange(150)] = r.choice(VOCABULARY)
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(sentence(r, 80))) for i in range(50)]
    found = labels(near_groups(frame(spark, rows), limit=20, chunk=64))
    assert sum(found.get(i) == 0 for i in range(400)) >= 390
    assert not any(i >= 1000 for i in found)


def test_keep_one(spark):
    rows = families(5, 20, 4)
    f = frame(spark, rows)
    found = labels(near_groups(f))
    kept = keep_one(f)
    assert kept.columns == f.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if found.get(i, i) == i)
    assert sorted(r.doc_id for r in keep_one(f, broadcast_bytes=0).collect()) == sorted(i for i, _ in rows if found.get(i, i) == i)


def test_nulls_empty_short_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, " !! "), (4, "one"), (5, "ONE."), (6, "one two"), (7, "same text here now"), (7, "same text here now"), (None, "same text, here now"), (8, "word " * 30_000), (9, "word " * 30_001)]
    found = labels(near_groups(frame(spark, rows)))
    assert found == {4: 4, 5: 4, 7: 7, None: 7, 8: 8, 9: 8}
    kept = [r.doc_id for r in keep_one(frame(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([1, 2, 3, 4, 6, 7, 8], key=repr)


def test_empty(spark):
    assert near_groups(frame(spark, [])).count() == 0
    assert keep_one(frame(spark, [])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r.rec: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def sketches_of(rows):
    """doc_id -> low bytes of the minwise values, by the operator's own signing."""
    column = pa.array([t for _, t in rows], pa.large_string())
    at, sig = near_dedup.signatures(*near_dedup.shingle_sets(column, 3))
    return {rows[i][0]: s.astype(np.uint8) for i, s in zip(at.tolist(), sig)}


def parts_of(ids, pairs):
    part = {i: i for i in ids}
    for a, b in pairs:
        low, high = sorted((part[a], part[b]))
        if low != high:
            part = {i: low if p == high else p for i, p in part.items()}
    return part


@pytest.mark.parametrize("chunk", [8, 64, 4096])
def test_dense_node_is_exact(spark, chunk):
    """One node that holds several families, some of whose members resemble no leader, loses no link, whatever the chunks."""
    r = random.Random(8)
    texts = []
    for _ in range(6):
        base = sentence(r, 60)
        for _ in range(r.randint(5, 25)):
            text = list(base)
            at = r.randrange(60)
            for j in range(r.randint(0, 16)):
                text[(at + j) % 60] = r.choice(VOCABULARY)
            texts.append(" ".join(text))
    rows = list(enumerate(dict.fromkeys(texts)))
    sketch = sketches_of(rows)
    pairs = [(a, b) for a in sketch for b in sketch if a < b and near_dedup.alike(sketch[a][None], sketch[b][None])[0] >= 0.46]
    want = parts_of(sketch, pairs)
    assert 1 < len(set(want.values())) < len(sketch)
    dense = spark.createDataFrame([(1, i, len(sketch)) for i in sketch], "node bigint, rec bigint, n bigint")
    known = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sketch.items()], "rec bigint, sketch binary")
    scratch = near_dedup.Scratch(spark)
    parts = components(near_dedup.elect(dense, known, 0.46, chunk, scratch), scratch)
    more = near_dedup.open_pairs(dense, parts, known, 0.46, chunk, scratch)
    if more is not None:
        parts = components(parts.selectExpr("rec AS a", "root AS b").unionByName(more), scratch)
    got = {i: i for i in sketch} | {x.rec: x.root for x in parts.collect()}
    assert got == want


@pytest.mark.parametrize("limit", [100, 3])
def test_recall_of_links_at_the_threshold(spark, limit):
    """Against all pairs of sketches: at least nine of ten links at the threshold are within a group, however deep the trees."""
    r = random.Random(12)
    rows = []
    shared = sentence(r, 25)
    for i in range(150):
        base = sentence(r, 60)
        other = list(base)
        at = r.randrange(60)
        for j in range(r.randint(22, 28)):
            other[(at + j) % 60] = r.choice(VOCABULARY)
        rows += [(2 * i, " ".join(shared + base)), (2 * i + 1, " ".join(shared + other))]
    sketch = sketches_of(rows)
    links = [(a, b) for a in sketch for b in sketch if a < b and 0.46 <= near_dedup.alike(sketch[a][None], sketch[b][None])[0] <= 0.62]
    assert len(links) > 30
    found = labels(near_groups(frame(spark, rows), limit=limit))
    assert sum(found.get(a, -1) == found.get(b, -2) for a, b in links) >= 0.9 * len(links)


def test_trees_for_depth():
    assert [near_dedup.trees_for(d, 0.5, 2, 0.9) for d in (1, 3, 4, 8)] == [2, 4, 4, 7]


def test_equal_first_hashes_are_told_apart(spark):
    """Two signatures of one 64-bit hash stay two records; copies of each stay one."""
    rows = [(i, i, i, 5, a, bytearray(b"s"), bytearray(b"k")) for i, a in enumerate([1, 1, 2])] + [(9, 9, 9, 6, 1, bytearray(b"s"), bytearray(b"k"))]
    signed = spark.createDataFrame(rows, "doc_id bigint, k1 bigint, k2 bigint, rec bigint, alt bigint, sig binary, sketch binary")
    got = {x.doc_id: x.rec for x in near_dedup.apart(signed, near_dedup.Scratch(spark)).collect()}
    assert got[0] == got[1] != got[2] and got[9] == 6


def test_ids_of_other_types(spark):
    rows = [("b", "same text here now"), ("a", "same text, here now"), ("c", "quite another text of words")]
    f = spark.createDataFrame(rows, "doc_id string, text string")
    assert labels(near_groups(f)) == {"a": "a", "b": "a"}
    assert sorted(x.doc_id for x in keep_one(f).collect()) == ["a", "c"]
