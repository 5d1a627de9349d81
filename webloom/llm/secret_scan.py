"""Secret scans: probabilistic automata inferred from labelled credentials (ALERGIA) score every candidate string."""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, scan, slices

HIT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("candidate", pa.string()), ("format", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())])
HIT_DDL = "array<struct<start:bigint,end:bigint,candidate:string,format:string,score:double,secret:boolean>>"
ALPHABET = string.ascii_letters + string.digits + "+/_-=."
#: formats whose name starts with "plain" are not credentials; their automata compete for the candidates
PLAIN = "plain"


def labelled_credentials(per_format: int = 250, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential) pairs drawn from the published shapes of credentials, and of look-alikes that are none."""
    r = random.Random(seed)

    def draw(chars: str, n: int) -> str:
        return "".join(r.choice(chars) for _ in range(n))

    alnum, low, up = string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_uppercase
    url64, b64, hexa = alnum + "_-", alnum + "+/", "0123456789abcdef"
    syllables = [a + b for a in "bcdfghlmnprst" for b in "aeiou"]
    shapes = {
        "hex_token_40": lambda: draw(hexa, 40),
        "hex_token_64": lambda: draw(hexa, 64),
        "hex_token_32": lambda: draw(hexa, 32),
        "aws_access_key": lambda: "AKIA" + draw(up + "234567", 16),
        "base64_secret_40": lambda: draw(b64, 40),
        "github_token": lambda: r.choice(["ghp_", "gho_", "ghs_"]) + draw(alnum, 36),
        "google_api_key": lambda: "AIza" + draw(url64, 35),
        "slack_token": lambda: r.choice(["xoxb-", "xoxp-"]) + draw(string.digits, 12) + "-" + draw(string.digits, 12) + "-" + draw(alnum, 24),
        "stripe_key": lambda: "sk_live_" + draw(alnum, 24),
        "json_web_token": lambda: "eyJ" + draw(url64, 33) + ".eyJ" + draw(url64, r.randint(40, 90)) + "." + draw(url64, 43),
        "plain_number": lambda: draw(string.digits, r.randint(16, 24)),
        "plain_uuid": lambda: "-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12)),
        "plain_words": lambda: r.choice(["", "", "v2-", "part1-"]) + r.choice(["-", "_", "", "."]).join("".join(r.choice(syllables) for _ in range(r.randint(2, 5))) for _ in range(r.randint(3, 6))) + r.choice(["", str(r.randint(0, 9999))]),
        "plain_path": lambda: "/".join("".join(r.choice(low) for _ in range(r.randint(2, 9))) for _ in range(r.randint(3, 6))) + r.choice([".html", ".txt", "", "/2024"]),
        "plain_date": lambda: f"20{r.randint(10, 30)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}-{r.randint(0, 59):02}",
    }
    return [(name, shape()) for name, shape in shapes.items() for _ in range(per_format)]


class Automaton:
    """A probabilistic deterministic automaton over characters, with the lengths of its strings.

    ALERGIA: the strings' prefix tree is folded from the root outwards; a state is merged with an earlier one when the
    Hoeffding bound (at level alpha) allows their stopping and every next character, and those of their successors, to come
    from the same distribution (of several such states with the nearest, the states with most evidence first). Folding lets lengths go (runs of like characters become loops), so the length has a
    distribution of its own, and stopping is scored by that.
    """

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.arrive, self.stop = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for s in strings:
            at = 0
            self.arrive[0] += 1
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.arrive.append(0)
                    self.stop.append(0)
                at = self.next[at][c]
                self.arrive[at] += 1
            self.stop[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.fold()
        self.lengths = Counter(map(len, strings))
        self.total = len(strings)
        self.letters = {c for s in strings for c in s}
        self.tabulate()

    def tabulate(self) -> None:
        """What log_likelihood() does at each state and letter of ALPHABET, as arrays, each letter's worth being its log likelihood ratio to an
        even one; and the most that can be gained in up to k more letters from each state."""
        hub = max(range(len(self.next)), key=lambda q: self.arrive[q])
        other = 1 / max(8, len(self.letters))
        self.worth, self.to = np.full((len(self.next), len(ALPHABET)), math.log(1e-4)), np.full((len(self.next), len(ALPHABET)), hub)
        for q in range(len(self.next)):
            n = self.arrive[q] - self.stop[q]
            for i, c in enumerate(ALPHABET):
                seen = self.count[q].get(c, 0)
                if c in self.letters and n + seen > 0:
                    self.worth[q, i] = math.log((seen + 0.5 * other) / (n + 0.5))
                self.to[q, i] = self.next[q].get(c, hub)
        self.worth += math.log(len(ALPHABET))
        most = [np.zeros(len(self.next))]
        for _ in range(max(self.lengths, default=0)):
            most.append(np.maximum(most[-1], (self.worth + most[-1][self.to]).max(axis=1)))
        self.most = np.array(most)

    def length_gain(self, n: int) -> float:
        return math.log((self.lengths.get(n, 0) + 0.01) / (self.total + 1)) + math.log(100)

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.arrive[a], self.arrive[b]
            if self.differ(self.stop[a], na, self.stop[b], nb):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self.differ(self.count[a].get(c, 0), na, self.count[b].get(c, 0), nb):
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def distance(self, a: int, b: int) -> float:
        """Total variation between the next characters at a and at b."""
        return sum(abs(self.count[a].get(c, 0) / self.arrive[a] - self.count[b].get(c, 0) / self.arrive[b]) for c in self.count[a].keys() | self.count[b].keys())

    def merge(self, a: int, b: int) -> None:
        """Fold the tree at b into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.arrive[a] += self.arrive[b]
            self.stop[a] += self.stop[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def fold(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        is_red = {0}
        while blue:
            source, c = blue.pop(0)
            b = self.next[source][c]
            if b in is_red:
                continue
            fit = [(self.distance(a, b), i) for i, a in enumerate(red) if self.compatible(a, b)]
            if fit:
                a = red[min(fit)[1]]
                self.next[source][c] = a
                self.merge(a, b)
            else:
                red.append(b)
                is_red.add(b)
            blue = [(q, c) for q in red for c in sorted(self.next[q]) if self.next[q][c] not in is_red]
            blue.sort(key=lambda x: -self.count[x[0]][x[1]])
        number = {q: i for i, q in enumerate(red)}  # the states that can still be reached
        self.next = [{c: number[to] for c, to in self.next[q].items()} for q in red]
        self.arrive, self.stop, self.count = ([x[q] for q in red] for x in (self.arrive, self.stop, self.count))

    def log_likelihood(self, s: str) -> float:
        """log P(length) + sum of log P(character | state), smoothed over the characters seen in training; others cost as much as one in 10**4."""
        total = math.log((self.lengths.get(len(s), 0) + 0.01) / (self.total + 1))
        at = 0
        hub = max(range(len(self.next)), key=lambda q: self.arrive[q])  # where an unseen transition leads
        other = 1 / max(8, len(self.letters))
        for c in s:
            n = self.arrive[at] - self.stop[at]
            seen = self.count[at].get(c, 0)
            total += math.log((seen + 0.5 * other) / (n + 0.5)) if c in self.letters and n + seen > 0 else math.log(1e-4)
            at = self.next[at].get(c, hub)
        return total


def train(labelled: list[tuple[str, str]], alpha: float = 0.05) -> dict[str, Automaton]:
    by: dict[str, list[str]] = defaultdict(list)
    for name, value in labelled:
        by[name].append(value)
    return {name: Automaton(values, alpha) for name, values in sorted(by.items())}


@functools.cache
def public_automata(alpha: float) -> dict[str, Automaton]:
    return train(labelled_credentials(), alpha)


def judge(candidate: str, automata: dict[str, Automaton], margin: float) -> tuple[str, float, bool]:
    """(format, score, is it a secret): the likeliest credential format; score is its log likelihood ratio to the likeliest other
    explanation: a plain format, or characters drawn evenly from the alphabet with any length."""
    scored = [(a.log_likelihood(candidate), name) for name, a in automata.items()]
    best, name = max((s, n) for s, n in scored if not n.startswith(PLAIN))
    other = max([s for s, n in scored if n.startswith(PLAIN)] + [-math.log(100) - len(candidate) * math.log(len(ALPHABET))])
    score = best - other
    return name, score, score > margin


#: edges of a span are free beside these and at the ends of a run; elsewhere an edge costs as much as a letter drawn evenly
BREAKS = "=/."
_CODE = np.full(256, len(ALPHABET), np.uint8)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_BREAK = np.zeros(256, bool)
_BREAK[np.frombuffer(BREAKS.encode(), np.uint8)] = True
BLOCK = 1 << 17  # starts that are followed at once


def edges_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(letters by their place in ALPHABET with one more at the end, cost of an edge before each)."""
    raw = np.frombuffer(text.encode("ascii"), np.uint8)
    free = np.ones(len(raw) + 1, bool)
    is_break = _BREAK[raw]
    free[1:-1] = is_break[:-1] | is_break[1:]
    return np.append(_CODE[raw], np.uint8(len(ALPHABET))), np.where(free, 0.0, math.log(len(ALPHABET)))


def slide(code: np.ndarray, edge: np.ndarray, a: Automaton, starts: np.ndarray, margin: float, shortest: int) -> list[tuple[int, int, float]]:
    """(start, end, gain) of all spans from starts that have a length seen in training and gain more than margin over even letters. A start is
    given up only when the rest of the longest string could not lift it over margin."""
    size = len(code) - 1
    lengths = {n: a.length_gain(n) for n in a.lengths if shortest <= n <= size}
    out: list[tuple[int, int, float]] = []
    if not lengths:
        return out
    least, longest, bonus = min(lengths), max(lengths), max(lengths.values())
    starts = starts[starts <= size - least]
    for block in range(0, len(starts), BLOCK):
        at = starts[block : block + BLOCK]
        state, gain = np.zeros(len(at), np.int64), -edge[at]
        for n in range(1, longest + 1):
            if n > least:
                inside = at + n <= size
                at, state, gain = at[inside], state[inside], gain[inside]
            c = code[at + n - 1]
            gain = gain + a.worth[state, c]
            state = a.to[state, c]
            alive = gain + a.most[longest - n][state] + bonus > margin
            at, state, gain = at[alive], state[alive], gain[alive]
            if not len(at):
                break
            if n in lengths:
                total = gain + lengths[n] - edge[at + n]
                hit = np.flatnonzero(total > margin)
                out += zip(at[hit].tolist(), (at[hit] + n).tolist(), total[hit].tolist())
    return out


def pieces(text: str, shortest: int) -> list[tuple[int, int]]:
    """The whole, and what lies between '=', between '=' and '/', and between all of BREAKS."""
    found = {(0, len(text))}
    for k in range(1, len(BREAKS) + 1):
        found |= {m.span() for m in re.finditer(f"[^{re.escape(BREAKS[:k])}]{{{shortest},}}", text)}
    return sorted(found)


def chosen(spans: list[tuple[int, int, float, str]]) -> list[tuple[int, int, float, str]]:
    """Spans that do not overlap, of the greatest total gain."""
    spans = sorted(spans, key=lambda x: (x[1], x[0], x[3]))
    ends, total, back = [x[1] for x in spans], [0.0], [(0, False)]
    for i, (start, _, gain, _) in enumerate(spans):
        before = bisect.bisect_right(ends, start, 0, i)
        take = total[before] + gain > total[-1]
        back.append((before, True) if take else (i, False))
        total.append(max(total[-1], total[before] + gain))
    out, i = [], len(spans)
    while i:
        to, taken = back[i]
        if taken:
            out.append(spans[i - 1])
        i = to
    return out[::-1]


def secrets_in(text: str, automata: dict[str, Automaton], margin: float, shortest: int) -> list[tuple[int, int, str, float]]:
    """(start, end, format, score) of the secrets in a run, in order. Spans of all formats, the plain ones too, compete for its letters: each
    start with each length that the format had in training, and whole pieces with any length. What is left of the run beside a
    secret is searched again, so that nothing turns into one when the secret is taken out."""
    best: dict[tuple[int, int], tuple[float, str]] = {}

    def offer(start: int, end: int, gain: float, name: str) -> None:
        if (start, end) not in best or (gain, name) > best[start, end]:
            best[start, end] = gain, name

    code, edge = edges_of(text)
    every = np.arange(max(0, len(text) - shortest + 1))
    for name, a in automata.items():
        if not name.startswith(PLAIN):
            for start, end, gain in slide(code, edge, a, every, margin, shortest):
                offer(start, end, gain, name)
    for start, end in pieces(text, shortest):
        part = text[start:end]
        name, _, secret = judge(part, automata, margin)
        if secret:
            offer(start, end, automata[name].log_likelihood(part) + math.log(100) + len(part) * math.log(len(ALPHABET)), name)
    if not best:
        return []
    near = np.zeros(len(text) + 1, np.int64)  # plain spans matter only where they can overlap those found
    reach = max((n for name, a in automata.items() if name.startswith(PLAIN) for n in a.lengths), default=0)
    for start, end in best:
        near[max(0, start - reach)] += 1
        near[end] -= 1
    around = every[np.cumsum(near)[every] > 0]
    plain = {name: a for name, a in automata.items() if name.startswith(PLAIN)}
    for name, a in plain.items():
        for start, end, gain in slide(code, edge, a, around, margin, shortest):
            offer(start, end, gain, name)
    for start, end in pieces(text, shortest) if plain else []:
        part = text[start:end]
        gain, name = max((a.log_likelihood(part), name) for name, a in plain.items())
        gain += math.log(100) + len(part) * math.log(len(ALPHABET))
        if gain > margin:
            offer(start, end, gain, name)
    out = []
    for start, end, gain, name in chosen([(s, e, g, n) for (s, e), (g, n) in best.items()]):
        if name.startswith(PLAIN):
            continue
        _, score, secret = judge(text[start:end], automata, margin)
        if secret:
            out.append((start, end, name, score))
    last, more = 0, []
    for start, end in [(s, e) for s, e, _, _ in out] + [(len(text), len(text))] if out else []:
        gap = text[last:start]
        left = last + len(gap) - len(gap.lstrip(".="))
        rest = text[left:start].rstrip(".")
        if len(rest) >= shortest:
            more += [(left + s, left + e, n, x) for s, e, n, x in secrets_in(rest, automata, margin, shortest)]
        last = end
    return sorted(out + more)


_CLASS = np.zeros(256, np.uint8)
_CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[np.frombuffer(string.digits.encode(), np.uint8)] = 1


def candidates(column: pa.Array, shortest: int, digits: bool = True) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, row, start, end) of maximal runs of credential characters (where digits is set, those with a digit), at least shortest long, '.' and '=' trimmed from the left and '.' from the right."""
    raw, at = scan(column)
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 1, np.int8)
    inside[:-1] = _CLASS[b]
    step = np.diff(inside, prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(b))]
    cut = np.unique(cut[(inside[cut - 1] == 1) & (inside[cut] == 1)]) if len(cut) else cut
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    keep = end - start >= shortest
    start, end = start[keep], end[keep]
    if digits:
        upto = np.zeros(len(b) + 1, np.int32)
        np.cumsum(_DIGIT[b], out=upto[1:])
        keep = upto[end] > upto[start]
        start, end = start[keep], end[keep]
    for i in range(len(start)):
        s, e = int(start[i]), int(end[i])
        while s < e and raw[s] in b".=":
            s += 1
        while s < e and raw[e - 1] in b".":
            e -= 1
        start[i], end[i] = s, e
    keep = end - start >= shortest
    start, end = start[keep], end[keep]
    return raw, at, np.searchsorted(at, start, side="right") - 1, start, end


def find(column: pa.Array, automata: dict[str, Automaton], margin: float, shortest: int, cache: dict) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(column))]
    raw, at, row, start, end = candidates(column, shortest, digits=False)
    for r, s, e in zip(row.tolist(), start.tolist(), end.tolist()):
        text = raw[s:e].decode("ascii")
        if text not in cache:
            if len(cache) > 100_000:
                cache.clear()
            hits = [(i, j, name, score, True) for i, j, name, score in secrets_in(text, automata, margin, shortest)]
            cache[text] = hits or [(0, len(text), *judge(text, automata, margin)[:2], False)]
        before = len(raw[int(at[r]) : s].decode("utf-8", "replace"))  # code points before it
        for i, j, name, score, secret in cache[text]:
            out[r].append({"start": before + i, "end": before + j, "candidate": text[i:j], "format": name, "score": score, "secret": secret})
    return out


def scan_udf(automata: dict[str, Automaton], margin: float, shortest: int):
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for batch in column:
            out = []
            for part in slices(batch):
                out += find(part, automata, margin, shortest, cache)
            yield pa.array(out, pa.list_(HIT))

    run.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, HIT_DDL)


def redact_udf(automata: dict[str, Automaton], margin: float, shortest: int):
    """The text with each secret replaced by <SECRET:format>; null where there is none."""

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for batch in column:
            out: list[str | None] = []
            for part in slices(batch):
                for i, hits in enumerate(find(part, automata, margin, shortest, cache)):
                    secrets = [h for h in hits if h["secret"]]
                    if not secrets:
                        out.append(None)
                        continue
                    text, pieces, last = part[i].as_py(), [], 0
                    for h in secrets:
                        pieces += [text[last : h["start"]], f"<SECRET:{h['format']}>"]
                        last = h["end"]
                    out.append("".join([*pieces, text[last:]]))
            yield pa.array(out, pa.string())

    run.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def secret_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: list[tuple[str, str]] | None = None, margin: float = 3.0, shortest: int = 16, alpha: float = 0.05) -> DataFrame:
    """One row for each secret in a candidate, or for the whole candidate where it has none: (doc_id, start, end, candidate, format, score, secret).

    Candidates are all maximal runs of at least shortest letters, digits and "+/_-=.", with a digit or without. In each, spans that
    do not overlap are chosen for the greatest total log likelihood ratio to even letters, plain formats competing: from every
    start with every length that a format has in training, and the whole run and its pieces between "=", "/" and "." with any
    length; so NAME=value, ?access_token=value and path/value give the value. A credential of a length not seen in training is
    found only as such a piece. format is the span's credential format, score its log likelihood ratio (in nats) to the
    likeliest other explanation, and secret says whether that exceeds margin. Automata are inferred on the driver from labelled (a fixed number of pairs) and travel
    with the task; texts are read once, in place: no shuffle. Offsets count code points.

    Null, empty and short texts give no rows; repeated rows give theirs again; a null doc_id stays null; of equally likely
    formats the last by name is taken. An empty table gives no rows; other columns are not read, whatever their names.
    """
    bound_batches(docs.sparkSession)
    automata = train(labelled, alpha) if labelled is not None else public_automata(alpha)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.select("doc_id", F.explode(scan_udf(automata, margin, shortest)("text")).alias("h")).select("doc_id", "h.*")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", labelled: list[tuple[str, str]] | None = None, margin: float = 3.0, shortest: int = 16, alpha: float = 0.05) -> DataFrame:
    """docs with secrets replaced in text_col and chars_col set to the new length where the text changed; rows and columns stay as they are."""
    bound_batches(docs.sparkSession)
    automata = train(labelled, alpha) if labelled is not None else public_automata(alpha)
    names, mark = docs.columns, "__redacted"
    while mark in names:
        mark += "_"
    marked = docs.withColumn(mark, redact_udf(automata, margin, shortest)(F.col(text_col)))
    changes = {text_col: F.coalesce(mark, F.col(text_col))}
    if chars_col in names:
        changes[chars_col] = F.when(F.col(mark).isNotNull(), F.length(mark).cast("bigint")).otherwise(F.col(chars_col))
    return marked.select(*[changes[c].alias(c) if c in changes else F.col(f"`{c}`") for c in names])
