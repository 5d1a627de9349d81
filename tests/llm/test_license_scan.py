import random

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm.license_scan import Index, align, find, license_matches, winnow
from webloom.llm.license_templates import TEMPLATES
from webloom.llm.words import words

DOCS = "doc_id bigint, text string, start string, template string"


def brute_align(a, b):
    """Smith-Waterman over all of both: the best score's matched words."""
    best = (0, 0)
    above = [(0, 0)] * (len(b) + 1)
    for x in a:
        row = [(0, 0)]
        for j, y in enumerate(b):
            d = above[j]
            cell = max((d[0] + 2, d[1] + 1) if x == y else (d[0] - 1, d[1]), (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1]))
            cell = cell if cell[0] > 0 else (0, 0)
            row.append(cell)
            best = max(best, cell)
        above = row
    return best[1]


def test_alignment_equals_full_alignment():
    r = random.Random(1)
    for _ in range(40):
        a = [r.randrange(30) for _ in range(25)]
        b = list(a)
        for _ in range(r.randrange(5)):
            i = r.randrange(len(b))
            b[i : i + 1] = r.choice([[], [99], [b[i], 98]])
        text = [50] * 7 + b + [51] * 7
        matched, start, end = align(np.array(a, np.uint64), np.array(text, np.uint64), 0, 16)
        assert matched == brute_align(a, text)
        assert 0 <= start <= end <= len(text)


def test_winnowing_leaves_no_window_without_a_fingerprint():
    h = np.random.default_rng(2).integers(0, 1 << 60, 200).astype(np.uint64)
    picked = winnow(h, 6)
    assert all(any(i <= p < i + 6 for p in picked) for i in range(195))


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_each_template_is_found_in_a_text(name):
    text = "Some prose before it. " * 30 + TEMPLATES[name] + " and after it some more prose" * 30
    got = find(pa.array(["nothing", text, None]), Index(TEMPLATES), 0.8)
    assert not got[0] and not got[2]
    assert [m["template"] for m in got[1]] == [name] and got[1][0]["coverage"] == 1.0
    m = got[1][0]
    own, whole = words(pa.array([text[m["start"] : m["end"]]])), words(pa.array([TEMPLATES[name]]))
    assert own.hash.tolist() == whole.hash.tolist()


def test_altered_templates_are_found():
    r = random.Random(3)
    for name, template in TEMPLATES.items():
        w = template.split()
        if len(w) < 20:
            continue
        for _ in range(len(w) // 20):
            w[r.randrange(len(w))] = "altered"
        got = find(pa.array([" ".join(["é"] * 50 + w + ["end"] * 50)]), Index(TEMPLATES), 0.8)
        assert [m["template"] for m in got[0]] == [name]


def test_nulls_empty_repeated(spark):
    some = next(iter(TEMPLATES.values()))
    rows = [(1, None), (2, ""), (3, "!!"), (4, some), (4, some), (None, f"{some}\n\n{'filler words here ' * 100}\n\n{some}")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = sorted((r.doc_id or 0) for r in license_matches(frame).collect())
    assert got == [0, 0, 4, 4]
    assert license_matches(spark.createDataFrame([], DOCS)).count() == 0


WHOLE = [n for n in TEMPLATES if n.endswith("/whole")]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_licence_with_altered_and_inserted_words(name):
    """One word in twenty altered and a paragraph inserted in the middle: one match, from the first words to the last."""
    r = random.Random(name)
    w = TEMPLATES[name].split()
    for i in r.sample(range(10, len(w) - 10), len(w) // 20):
        w[i] = "altered"
    middle = len(w) // 2
    text = " ".join(["before"] * 40 + w[:middle] + ["inserted"] * 150 + w[middle:] + ["after"] * 40)
    (m,) = find(pa.array([text]), Index(TEMPLATES), 0.8)[0]
    assert m["template"] == name and m["coverage"] > 0.85
    assert abs(m["start"] - text.index(w[0])) < 100 and abs(m["end"] - (text.rindex(w[-1]) + len(w[-1]))) < 100


def test_half_a_licence_is_reported_with_its_coverage():
    w = TEMPLATES["Apache-2.0/whole"].split()
    index = Index(TEMPLATES)
    text = pa.array(["words before " * 20 + " ".join(w[len(w) // 2 :])])
    assert not [m for m in find(text, index, 0.8)[0] if m["template"] == "Apache-2.0/whole"]
    (m,) = [m for m in find(text, index, 0.4)[0] if m["template"] == "Apache-2.0/whole"]
    assert 0.4 < m["coverage"] < 0.6


def test_lesser_and_affero_are_not_taken_for_the_general_licence():
    for kind, name in (("", "GPL-3.0/notice"), ("Lesser ", "LGPL-3.0/notice"), ("Affero ", "AGPL-3.0/notice")):
        text = f"Hello. This work is licensed under the GNU {kind}General Public License, version 3. Bye."
        assert [m["template"] for m in find(pa.array([text]), Index(TEMPLATES), 0.8)[0]] == [name]


def test_scan_agrees_with_full_alignment_of_every_template():
    r = random.Random(11)
    lexicon = [f"w{i}" for i in range(300)]
    templates = {f"t{i}/x": " ".join(r.choice(lexicon) for _ in range(n)) for i, n in enumerate([5, 8, 20, 45, 45, 260])}
    index = Index(templates)
    own = {name: words(pa.array([t])).hash.tolist() for name, t in templates.items()}
    for _ in range(12):
        parts = [r.choice(lexicon) for _ in range(60)]
        for name in r.sample(list(templates), 2):
            w = templates[name].split()
            for i in range(len(w) // 10):
                w[r.randrange(len(w))] = "other"
            parts += w + [r.choice(lexicon) for _ in range(30)]
        column = pa.array([" ".join(parts)])
        text = words(column).hash.tolist()
        want = {name for name, t in own.items() if brute_align(t, text) >= 0.8 * len(t)}
        assert {m["template"] for m in find(column, index, 0.8)[0]} == want


def test_ties_and_very_long_texts(spark):
    """Of equal templates the name that sorts first; whole texts are searched, and each occurrence counts."""
    same = {"b/x": "one two three four five six", "a/x": "one two three four five six"}
    assert [m["template"] for m in find(pa.array(["zero one two three four five six seven"]), Index(same), 0.8)[0]] == ["a/x"]
    text = ("filler word " * 20_000 + TEMPLATES["MIT/text"] + " ") * 3
    got = license_matches(spark.createDataFrame([(1, text, "", "")], DOCS)).collect()
    assert [m.template for m in got] == ["MIT/text"] * 3
    assert sorted(m.start for m in got) == [i for i in range(len(text)) if text.startswith(TEMPLATES["MIT/text"], i)]
