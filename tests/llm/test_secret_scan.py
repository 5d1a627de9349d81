import random

import pyarrow as pa
import pytest

from webloom.llm import secret_scan as S

DOCS = "doc_id bigint, text string, start string, score string, n_chars bigint"
SHAPES = [f for f in dict(S.labelled_credentials(1)) if not f.startswith(S.PLAIN)]


@pytest.fixture(scope="module")
def automata():
    return S.public_automata(0.05)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", len(t or "")) for i, t in rows], DOCS)


def test_held_out_credentials_are_told_from_look_alikes(automata):
    held = [x for x in S.labelled_credentials(60, seed=99) if len(x[1]) >= 16 and any(c.isdigit() for c in x[1])]
    secret = [S.judge(v, automata, 3.0)[2] for n, v in held if not n.startswith(S.PLAIN)]
    plain = [S.judge(v, automata, 3.0)[2] for n, v in held if n.startswith(S.PLAIN)]
    assert sum(secret) >= 0.97 * len(secret)
    assert sum(plain) <= 0.03 * len(plain)


@pytest.mark.parametrize("shape", SHAPES)
def test_the_format_is_named(automata, shape):
    held = [v for n, v in S.labelled_credentials(40, seed=5) if n == shape]
    assert sum(S.judge(v, automata, 3.0)[0] == shape for v in held) >= 0.9 * len(held)


def test_automaton_is_a_distribution():
    a = S.Automaton(["ab", "abab", "ababab", "b"] * 30)
    for q in range(len(a.next)):
        assert sum(a.count[q].values()) + a.stop[q] == a.arrive[q]
        assert a.next[q].keys() == a.count[q].keys()
    # of the prefix tree's 8 states the two that always stop merge; "ab" and "abab" don't, as what follows them stops at 0.5 and at 1
    assert len(a.next) == 7
    assert a.log_likelihood("abab") > a.log_likelihood("bbaa")


def test_candidates_are_all_runs():
    r = random.Random(3)
    alphabet = S.ALPHABET + "  \n,é"
    texts = ["".join(r.choice(alphabet) for _ in range(400)) for _ in range(40)] + ["", "A1" * 30, "x" * 40]
    raw, at, row, start, end = S.candidates(pa.array(texts), 16)
    got = [(int(i), raw[s:e].decode()) for i, s, e in zip(row, start, end)]
    want = []
    for i, t in enumerate(texts):
        run = ""
        for c in t + " ":
            if c in S.ALPHABET:
                run += c
                continue
            trimmed = run.lstrip(".=").rstrip(".")
            if len(run) >= 16 and any(x.isdigit() for x in run) and len(trimmed) >= 16:
                want.append((i, trimmed))
            run = ""
    assert got == want


def test_offsets_and_redaction(spark):
    key = "AKIA" + "QWERTY234567ZXCV"
    rows = [(1, f"é漢 key={key}. end"), (2, "nothing here"), (3, None), (4, ""), (4, ""), (None, f"{key}\n{key}"), (5, "word " * 50_000 + key)]
    f = frame(spark, rows)
    texts = {}
    for i, t in rows:
        texts[i] = t
    hits = S.secret_hits(f).collect()
    for h in hits:
        assert texts[h.doc_id][h.start : h.end] == h.candidate
    out = S.redact(f)
    assert out.columns == f.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "nothing here" and got[3].text is None and got[4].text == ""
    assert key not in got[5].text and got[None].text.count("<SECRET:") == 2
    assert all(r.n_chars == len(r.text or "") for r in got.values())


def test_empty(spark):
    assert S.secret_hits(frame(spark, [])).count() == 0
    assert S.redact(frame(spark, [])).count() == 0


@pytest.mark.parametrize("around", ["key={}", "token={}", "access_token={}/page", "files/docs/{}", "www.example.com/a.html/{}"])
def test_credentials_attached_to_other_text(automata, around):
    held = [x for x in S.labelled_credentials(15, seed=99) if len(x[1]) >= 16]
    whole = {True: [], False: []}
    for name, value in held:
        text = around.format(value)
        covered = set()
        for start, end, _, _ in S.secrets_in(text, automata, 3.0, 16):
            covered |= set(range(start, end))
        at = text.index(value)
        if name.startswith(S.PLAIN):
            whole[False].append(bool(covered))
        else:
            whole[True].append(covered >= set(range(at, at + len(value))))
    assert sum(whole[True]) >= 0.9 * len(whole[True])
    assert sum(whole[False]) <= 0.03 * len(whole[False])


def test_attached_secrets_are_redacted(spark):
    """Row 1 of test_offsets_and_redaction, a URL, two in one run, and look-alikes that stay."""
    key, token = "AKIA" + "QWERTY234567ZXCV", "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
    uuid = "id=550e8400-e29b-41d4-a716-446655440000"
    rows = [(1, f"é漢 key={key}. end"), (2, f"https://x.example/a?access_token={token}&b=1"), (3, f"{key}={token}"), (4, uuid), (5, f"files/{key}/x")]
    hits = {(h.doc_id, h.candidate): h for h in S.secret_hits(frame(spark, rows)).collect()}
    assert {k for k, h in hits.items() if h.secret} == {(1, key), (2, token), (3, key), (3, token), (5, key)}
    assert hits[1, key].start == len("é漢 key=") and hits[1, key].format == "aws_access_key"
    got = {r.doc_id: r.text for r in S.redact(frame(spark, rows)).collect()}
    assert got[1] == "é漢 key=<SECRET:aws_access_key>. end" and got[4] == uuid
    assert not any(key in t or token in t for t in got.values())


def test_credentials_without_digits_are_found(automata):
    """find() sees every held-out credential; runs of words without digits stay plain."""
    held = [x for x in S.labelled_credentials(60, seed=99) if len(x[1]) >= 16]
    bare = [("aws_access_key", "AKIA" + "QWERTYZXCVBNMASD"), ("stripe_key", "sk_live_" + "aBcDeFgHiJkLmNoPqRsTuVwX")]
    plain = ["thanonontioniner", "Teachscherheitpf", "mail.example.com", "nichteinungeinkeit", "some/plain/path/here.html"]
    names, texts = zip(*held, *bare)
    found = S.find(pa.array(list(texts)), automata, 3.0, 16, {})
    secret = [any(h["secret"] for h in hits) for n, hits in zip(names, found) if not n.startswith(S.PLAIN)]
    assert sum(secret) >= 0.97 * len(secret)
    for (name, value), hits in zip(bare, found[len(held) :]):
        assert [(h["candidate"], h["format"], h["secret"]) for h in hits] == [(value, name, True)]
    assert not any(h["secret"] for hits in S.find(pa.array(plain), automata, 3.0, 16, {}) for h in hits)


def made_elsewhere():
    """Credentials by the standard library's own tools, not by the generator of the labels."""
    import base64
    import hashlib
    import json
    import uuid

    r = random.Random(31)
    out = []
    for i in range(40):
        raw = r.randbytes(64)
        header = base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "typ": "JWT"}, separators=(",", ":")).encode()).rstrip(b"=")
        body = base64.urlsafe_b64encode(json.dumps({"sub": str(r.randrange(10**10)), "iat": r.randrange(10**9)}, separators=(",", ":")).encode()).rstrip(b"=")
        sign = base64.urlsafe_b64encode(hashlib.sha256(raw).digest()).rstrip(b"=")
        out += [hashlib.sha1(raw).hexdigest(), hashlib.sha256(raw).hexdigest(), uuid.UUID(bytes=raw[:16]).hex, base64.b64encode(raw[:30]).decode(), b".".join([header, body, sign]).decode(), "AKIA" + base64.b32encode(raw[:10]).decode()]
    return out


@pytest.mark.parametrize("around", ["{}", "secret: '{}'", "API_KEY={}", "https://x.example/?k={}"])
def test_credentials_made_elsewhere_are_found(automata, around):
    values = made_elsewhere()
    found = S.find(pa.array([around.format(v) for v in values]), automata, 3.0, 16, {})
    met = 0
    for v, hits in zip(values, found):
        at = around.index("{")
        covered = {i for h in hits if h["secret"] for i in range(h["start"], h["end"])}
        met += len(covered & set(range(at, at + len(v)))) >= 0.9 * len(v)
    assert met >= 0.93 * len(values)


def brute_secrets(text, automata, margin, shortest):
    """All spans of all automata by their definition, the best set of spans that don't overlap by its value up to each place."""
    import math

    even, edges = math.log(len(S.ALPHABET)), S.edges_of(text)[1]
    value = {}
    for name, a in automata.items():
        for n in a.lengths:
            for start in range(len(text) - n + 1) if n >= shortest else []:
                gain = a.log_likelihood(text[start : start + n]) + math.log(100) + n * even - edges[start] - edges[start + n]
                if gain > margin:
                    value[start, start + n] = max(value.get((start, start + n), (-1e9, "")), (gain, name))
    for start, end in S.pieces(text, shortest):
        for name, a in automata.items():
            gain = a.log_likelihood(text[start:end]) + math.log(100) + (end - start) * even
            if gain > margin:
                value[start, end] = max(value.get((start, end), (-1e9, "")), (gain, name))
    best = [(0.0, ())]
    for end in range(1, len(text) + 1):
        options = [best[end - 1]] + [(best[s][0] + gain, (*best[s][1], (s, e, name))) for (s, e), (gain, name) in value.items() if e == end]
        best.append(max(options, key=lambda x: x[0]))
    return [(s, e) for s, e, name in best[-1][1] if not name.startswith(S.PLAIN)]


def test_agrees_with_scoring_every_span(automata):
    few = {k: automata[k] for k in ("aws_access_key", "github_token", "hex_token_32", "plain_uuid", "plain_date")}
    r = random.Random(5)
    held = [v for n, v in S.labelled_credentials(6, seed=12) if n in few]
    for i in range(8):
        text = "".join(r.choice("abcxyz012-_") for _ in range(r.randint(0, 20))) + r.choice(["=", "/", "", "."]) + r.choice(held) + r.choice(["=", "/", "-"]) + r.choice(held)
        want = brute_secrets(text, few, 3.0, 16)
        got = [(s, e) for s, e, _, _ in S.secrets_in(text, few, 3.0, 16)]
        assert set(want) <= set(got) or {x for x in want if S.judge(text[x[0] : x[1]], few, 3.0)[2]} <= set(got)


def test_ties_repeated_rows_and_strings_of_any_length(spark):
    """Repeated rows give their hits again; of equally likely formats the last by name is taken; long runs and texts are searched whole."""
    key = "AKIA" + "QWERTY234567ZXCV"
    same = [("b", v) for v in ("abcd" * 5, "abce" * 5)] + [("a", v) for v in ("abcd" * 5, "abce" * 5)]
    (hit,) = S.find(pa.array(["abcd" * 5]), S.train(same), 3.0, 16, {})[0]
    assert hit["format"] == "b"
    rows = [(1, f"k={key}"), (1, f"k={key}"), (2, "ab" * 1000 + "=" + key), (3, "zz word " * 200_000 + key)]
    hits = [(h.doc_id, h.candidate) for h in S.secret_hits(frame(spark, rows)).collect() if h.secret and h.candidate == key]
    assert sorted(hits) == [(1, key), (1, key), (2, key), (3, key)]
