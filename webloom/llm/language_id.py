"""Language ID: unigram pieces of a fixed public vocabulary, all segmentations of a word summed by the forward algorithm."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bound_batches, slices, small_side, trim
from .words import INVERSE, MULT, Words, mix, powers, words

TOKENIZERS = os.environ.get("WEBLOOM_TOKENIZERS", "/opt/tokenizers")
START = ord("▁")  # stands before the first letter of every word
RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("letters", pa.int64()), ("keep", pa.bool_())])
RESULT_DDL = "struct<lang:string,score:double,margin:double,letters:bigint,keep:boolean>"
LONGEST = 16  # letters of a piece


@functools.cache
def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters of a sentencepiece model, those that begin a word with the start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        body = piece.removeprefix(chr(START))
        if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i) and len(piece) <= LONGEST and piece == piece.lower() and (body.isalpha() or piece == chr(START)):
            pieces.append(piece)
    return pieces


def span_hash(run: np.ndarray, start: int, end: int, down: np.ndarray) -> np.ndarray:
    return (run[end] - run[start]) * down[start]


@dataclass
class Pieces:
    """Hash table of the pieces: two arrays of slots, the second for what collides in the first."""

    keys: np.ndarray
    longest: int
    shift: int = 44
    slots: tuple = field(default=(), repr=False)

    @staticmethod
    def of(pieces: list[str]) -> Pieces:
        keys = []
        for piece in pieces:
            total = 0
            for i, c in enumerate(piece):
                total += (ord(c) + 1) * pow(int(MULT), i, 1 << 64)
            keys.append(total % (1 << 64))
        return Pieces(np.array(keys, np.uint64), max(map(len, pieces), default=1))

    def table(self) -> tuple:
        if not self.slots:
            ids = np.arange(len(self.keys))
            first, second = np.full(1 << 20, -1, np.int32), np.full(1 << 20, -1, np.int32)
            mixed = mix(self.keys)
            a, b = (mixed >> np.uint64(44)).astype(np.int64), (mixed & np.uint64((1 << 20) - 1)).astype(np.int64)
            _, lead = np.unique(a, return_index=True)
            first[a[lead]] = lead
            rest = np.setdiff1d(ids, lead)
            if len(np.unique(b[rest])) < len(rest):
                raise ValueError("the pieces collide twice")
            second[b[rest]] = rest
            self.slots = (first, second)
        return self.slots

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 where there is none."""
        first, second = self.table()
        m = mix(h)
        i = first[(m >> np.uint64(44)).astype(np.int64)]
        ok = (i >= 0) & (self.keys[i] == h)
        j = second[(m & np.uint64((1 << 20) - 1)).astype(np.int64)]
        other = (j >= 0) & ~ok
        if other.any():
            other &= self.keys[j] == h
            return np.where(ok, i, np.where(other, j, -1))
        return np.where(ok, i, -1)

    def __getstate__(self):
        return {"keys": self.keys, "longest": self.longest, "shift": self.shift, "slots": ()}


def columns_of(w: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The picked words, longest first, one a column, the start mark above: (order, lengths with the mark, prefix hashes by place)."""
    length = w.end[pick] - w.start[pick] + 1
    order = np.argsort(-length, kind="stable")
    pick, length = pick[order], length[order]
    up, _ = powers(1 << max(16, int(length[0]).bit_length()))
    run = np.zeros((int(length[0]) + 1, len(pick)), np.uint64)
    run[1] = np.uint64(START + 1)
    for o in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -o, side="left"))  # words longer than o
        run[o + 1, :n] = run[o, :n] + (w.codes[w.start[pick[:n]] + o - 1].astype(np.uint64) + np.uint64(1)) * up[o]
    return order, length, run


SEGMENT = 256  # letters of a long run that are followed one after another
LONG = 1024  # letters from which a run is cut into segments
AT_ONCE = 1 << 16  # letters of a long run whose segments are followed at once


def long_run(code: np.ndarray, pieces: Pieces, p: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """log P(run | language) of one long run of letters (code points, the start mark first): the same sum over all segmentations.

    What a segment does to the last LONGEST prefix sums is linear. All segments are followed side by side, each from every unit
    vector of these sums, and the matrices so found are applied in order; so the loop is as long as a segment, not as the run.
    """
    n, languages, back = len(code), p.shape[1], pieces.longest
    state = np.zeros((back, languages))  # sums at the place reached and those before it
    state[0] = 1
    scale = np.zeros(languages)
    for begin in range(0, n, AT_ONCE):
        size = min(AT_ONCE, n - begin)
        many = -(-size // SEGMENT)
        before = min(begin, back)
        some = code[begin - before : begin + size].astype(np.uint64) + np.uint64(1)
        up, down = powers(1 << max(16, len(some).bit_length()))
        run = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * up[: len(some)], out=run[1:])
        arc = np.zeros((back, many * SEGMENT, languages))  # [letters - 1, place of the last letter]: probability of the piece that ends there
        for k in range(1, back + 1):
            ends = np.arange(max(before + 1, k), len(some) + 1)
            ids = pieces.find((run[ends] - run[ends - k]) * down[ends - k])
            hit = np.flatnonzero(ids >= 0)
            arc[k - 1, ends[hit] - before - 1] = p[ids[hit]]
        arc[0, (1 if begin == 0 else 0) : size] += unknown
        arc[0, size:] = 1  # places after the run's end pass the sum on
        arc = arc.reshape(back, many, SEGMENT, languages)
        window = np.zeros((back, back, many, languages))  # [places back, unit vector, segment, language]
        window[np.arange(back), np.arange(back)] = 1
        shrunk = np.zeros((many, languages))
        for at in range(SEGMENT):
            new = np.einsum("kbsl,ksl->bsl", window, arc[:, :, at])
            window = np.concatenate([new[None], window[:-1]])
            if at % 12 == 11:
                top = np.maximum(window.max(axis=(0, 1)), 1e-300)
                window /= top
                shrunk += np.log(top)
        for s in range(many):
            state = np.einsum("kbl,bl->kl", window[:, :, s], state)
            top = state.max(axis=0)
            state /= top
            scale += shrunk[s] + np.log(top)
    with np.errstate(divide="ignore"):
        return np.log(state[0]) + scale


def groups_of(lengths: np.ndarray, languages: int) -> Iterator[np.ndarray]:
    """Words of like lengths, as many at once as a few MB hold."""
    edges = [0, 8, 12, 16, 24, 40, 64, 128, 512, 4096, 1 << 40]
    for a, b in zip(edges, edges[1:]):
        group = np.flatnonzero((lengths >= a) & (lengths < b))
        step = max(1, (1 << 20) // (min(b, 1 << 18) * max(4, languages)))
        for at in range(0, len(group), step):
            yield group[at : at + step]


def forward(w: Words, pick: np.ndarray, pieces: Pieces, p: np.ndarray, unknown: np.ndarray, expect: np.ndarray | None = None) -> np.ndarray:
    """log P(word | language), the sum over all segmentations into pieces, of each picked word: [len(pick), languages].

    A letter can also be read as unknown, at the probability unknown. Runs of LONG letters or more go by segments. With expect
    (weights [len(pick), languages]) expected_counts() are returned instead.
    """
    if expect is not None:
        return expected_counts(w, pick, pieces, p, unknown, expect)
    languages = p.shape[1]
    out = np.zeros((len(pick), languages))
    lengths = w.end[pick] - w.start[pick]
    for i in np.flatnonzero(lengths >= LONG).tolist():
        out[i] = long_run(np.concatenate([[np.uint32(START)], w.codes[w.start[pick[i]] : w.end[pick[i]]]]), pieces, p, unknown)
    short = np.flatnonzero(lengths < LONG)
    for part in groups_of(lengths[short], languages):
        part = short[part]
        order, length, run = columns_of(w, pick[part])
        deep = int(length[0])
        _, down = powers(1 << max(16, deep.bit_length()))
        alpha = np.zeros((deep + 1, len(part), languages))
        alpha[0] = 1
        scale = np.zeros((len(part), languages))
        for end in range(1, deep + 1):
            n = int(np.searchsorted(-length, -end, side="right"))  # words of at least end places
            if end > 1:
                alpha[end, :n] = alpha[end - 1, :n] * unknown
            for start in range(max(0, end - pieces.longest), end):
                ids = pieces.find((run[end, :n] - run[start, :n]) * down[start])
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    alpha[end, hit] += alpha[start, hit] * p[ids[hit]]
            if end % 12 == 0:  # keep the numbers in range
                low = max(0, end - pieces.longest + 1)
                top = alpha[low : end + 1, :n].max(axis=0)
                alpha[low : end + 1, :n] /= top
                scale[:n] += np.log(top)
        out[part[order]] = np.log(alpha[length, np.arange(len(part))]) + scale
    return out


def expected_counts(w: Words, pick: np.ndarray, pieces: Pieces, p: np.ndarray, unknown: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the segmentations of the picked words, each counting weight [len(pick), languages]: forward and
    backward sums, both as logarithms, so that words of any length are in range. [pieces, languages]"""
    languages = p.shape[1]
    counts = np.zeros_like(p)
    with np.errstate(divide="ignore"):
        log_p, log_unknown = np.log(p), np.log(unknown)
    for part in groups_of(w.end[pick] - w.start[pick], 4 * languages):
        order, length, run = columns_of(w, pick[part])
        deep = int(length[0])
        _, down = powers(1 << max(16, deep.bit_length()))
        alpha = np.full((deep + 1, len(part), languages), -np.inf)
        alpha[0] = 0
        arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(deep)]  # by start
        for end in range(1, deep + 1):
            n = int(np.searchsorted(-length, -end, side="right"))
            if end > 1:
                alpha[end, :n] = alpha[end - 1, :n] + log_unknown
            for start in range(max(0, end - pieces.longest), end):
                ids = pieces.find((run[end, :n] - run[start, :n]) * down[start])
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    alpha[end, hit] = np.logaddexp(alpha[end, hit], alpha[start, hit] + log_p[ids[hit]])
                    arcs[start].append((end, hit, ids[hit]))
        last = alpha[length, np.arange(len(part))]
        beta = np.full_like(alpha, -np.inf)
        beta[length, np.arange(len(part))] = 0
        own = weight[part[order]]
        for start in range(deep - 1, -1, -1):
            if start:
                beta[start] = np.logaddexp(beta[start], beta[start + 1] + log_unknown)
            for end, hit, ids in arcs[start]:
                ahead = beta[end, hit] + log_p[ids]
                beta[start, hit] = np.logaddexp(beta[start, hit], ahead)
                np.add.at(counts, ids, own[hit] * np.exp(alpha[start, hit] + ahead - last[hit]))
    return counts


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray  # [pieces, languages]
    unknown: np.ndarray  # [languages]
    mean: np.ndarray  # log probability a letter of the training texts, by language
    spread: np.ndarray  # its deviation, times the root of the letters
    slack: float

    def decide(self, total: np.ndarray, letters: np.ndarray) -> list[dict]:
        """total: [texts, languages] log probabilities; letters: of each text, word starts included."""
        out = []
        if not self.languages:
            return [{"lang": None, "score": None, "margin": None, "letters": int(n), "keep": False} for n in letters]
        for t, n in zip(total, letters.tolist()):
            if not n:
                out.append({"lang": None, "score": None, "margin": None, "letters": 0, "keep": False})
                continue
            order = np.argsort(-t, kind="stable")
            best = int(order[0])
            score = t[best] / n
            floor = self.mean[best] - max(self.slack, 4 * self.spread[best] / np.sqrt(n))
            out.append({"lang": self.languages[best], "score": float(score), "margin": float((t[best] - t[order[1]]) / n) if len(order) > 1 else 0.0, "letters": n, "keep": bool(score >= floor)})
        return out


class Scorer:
    """Scores texts; words met before are looked up (a store by word hash, bounded in words and in bytes)."""

    def __init__(self, model: Model, store: int = 400_000, store_bytes: int = 12 << 20):
        self.model, self.store = model, min(store, store_bytes // (8 * (1 + len(model.languages))))
        self.known, self.value = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def totals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = words(column, letters_only=True)
        rows, n = len(column), len(self.model.languages)
        letters = np.bincount(w.row, weights=(w.end - w.start + 1), minlength=rows).astype(np.int64)
        total = np.zeros((rows, n))
        if not len(w.hash) or not n:
            return total, letters
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        value = np.zeros((len(distinct), n))
        missing = np.ones(len(distinct), bool)
        for known, values in [(self.known, self.value), *self.new]:
            if len(known):
                at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                ok = known[at] == distinct
                value[ok] = values[at[ok]]
                missing &= ~ok
        todo = np.flatnonzero(missing)
        if len(todo):
            value[todo] = forward(w, first[todo], self.model.pieces, self.model.p, self.model.unknown)
            self.new.append((distinct[todo], value[todo]))
            if len(self.new) > 6:
                self.merge()
        for i in range(n):
            total[:, i] = np.bincount(w.row, weights=value[inverse, i], minlength=rows)
        return total, letters

    def merge(self) -> None:
        keys = np.concatenate([self.known, *(k for k, _ in self.new)])
        values = np.concatenate([self.value, *(v for _, v in self.new)])
        self.new = []
        if len(keys) > self.store:  # begin anew with the latest words
            keys, values = keys[-self.store // 2 :], values[-self.store // 2 :]
        order = np.argsort(keys)
        self.known, self.value = keys[order], values[order]

    def decide(self, column: pa.Array) -> list[dict]:
        return self.model.decide(*self.totals(column))


def train(texts: list[str], labels: list[str], tokenizers: str = TOKENIZERS, rounds: int = 3, slack: float = 2.0) -> Model:
    """Piece probabilities of each language by expectation maximisation over all segmentations of the training words. For this alone, runs of
    over 1000 letters are learned from a thousand letters at a time."""
    languages = sorted(set(labels))
    names = vocabulary(f"{tokenizers}/piece_bpe_32k.model")
    pieces = Pieces.of(names)
    number = {x: i for i, x in enumerate(languages)}
    count = max(1, len(languages))
    p = np.full((len(names), count), 1 / max(1, len(names)))
    model = Model(languages, pieces, p, np.full(count, 1e-8), np.zeros(count), np.ones(count), slack)
    if not languages:
        return model
    label = np.array([number[x] for x in labels])
    texts = [re.sub(r"([^\W\d_]{1000})(?=[^\W\d_])", r"\1 ", t) for t in texts]
    spelled: dict[int, str] = {}
    hashes, rows, sizes, seen = [], [], [], 0
    for part in slices(pa.array(texts, pa.large_string())):
        w = words(part, letters_only=True)
        for h, i in zip(*(x.tolist() for x in np.unique(w.hash, return_index=True))):
            if h not in spelled:
                spelled[h] = w.text(i)
        hashes.append(w.hash)
        rows.append(w.row + seen)
        sizes.append(w.end - w.start + 1)
        seen += len(part)
    row, size = np.concatenate(rows), np.concatenate(sizes)
    distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    w = words(pa.array([spelled[h] for h in distinct.tolist()], pa.large_string()), letters_only=True)  # one word a row
    first = np.arange(len(distinct))
    weight = np.zeros((len(distinct), count))
    np.add.at(weight, (inverse, label[row]), 1)
    weight += 1e-3 * weight.sum(axis=1, keepdims=True) / count  # words of other languages are possible
    for _ in range(rounds):
        expected = expected_counts(w, first, pieces, model.p, model.unknown, weight)
        expected += 1e-2
        model.p = expected / expected.sum(axis=0)
        model.unknown = model.p.min(axis=0) * 1e-2
    value = forward(w, first, pieces, model.p, model.unknown)
    letters = np.bincount(row, weights=size, minlength=len(texts))
    own = np.bincount(row, weights=value[inverse, label[row]], minlength=len(texts))
    for i in range(count):
        mine = (label == i) & (letters > 0)
        if mine.any():
            model.mean[i] = own[mine].sum() / letters[mine].sum()
            model.spread[i] = np.sqrt(np.mean((own[mine] - letters[mine] * model.mean[i]) ** 2 / letters[mine]))
    return model


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 500, tokenizers: str = TOKENIZERS, slack: float = 2.0, languages: list[str] | None = None, train_letters: int = 4_000_000, broadcast_bytes: int = BROADCAST_BYTES
) -> Model:
    """Train on labelled texts: of each language (all labels there are, or the given ones) about train_docs rows, or as many whole texts as
    hold about train_letters letters if those are fewer, picked by the hash of doc_id. All else about the corpus is left to scoring."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    if languages is not None:
        src = src.where(F.col("lang").isin(languages))
    found = src.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("letters")).collect()
    if not found:
        return train([], [], tokenizers, slack=slack)
    spread = 1 << 30
    shares = spark.createDataFrame([(r["lang"], int(min(1, train_docs / r["rows"], train_letters / max(1, r["letters"])) * spread)) for r in found], "lang string, share bigint")
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(spread))
    picked = src.join(small_side(shares, len(found), 64, broadcast_bytes), "lang").where(draw < F.col("share"))
    rows = picked.select("doc_id", "text", "lang").orderBy("doc_id", "text").limit(2 * train_docs * len(found)).collect()
    model = train([r["text"] for r in rows], [r["lang"] for r in rows], tokenizers, slack=slack)
    del rows
    trim()
    return model


def decide_udf(model: Model):
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in column:
            out = []
            for part in slices(batch):
                out += scorer.decide(part)
            yield pa.array(out, RESULT)
        del scorer
        trim()

    run.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT_DDL)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, lang, score, margin, letters, keep).

    lang is the language under which the text is likeliest; score its log probability a letter, margin the lead over the next
    language. The whole text counts: letters, lower-cased; other characters part words. keep is false for texts without
    letters and for those that score lower than any training language's texts do, by slack nats a letter (more for short texts).
    The model (pieces x languages) travels with the task and texts are read once, in place: no shuffle.

    Unbroken runs of any length are summed over like other words, in time in proportion to their letters.

    Null and empty texts: lang, score and margin null, letters 0, keep false. Ties go to the language that sorts first.
    Repeated rows and null ids are judged like others; an empty table gives no rows; without labelled texts lang is null
    and keep false everywhere. Other columns are not read, whatever their names.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return src.select("doc_id", decide_udf(model)("text").alias("r")).select("doc_id", "r.*")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that identify() keeps, with lang_col set to the language found; columns stay as they are. Null, empty and letterless
    texts go, repeated rows fare alike, ties go to the language that sorts first, an empty table stays empty; columns may have any name."""
    bound_batches(docs.sparkSession)
    names, mark = docs.columns, "__language"
    while mark in names:
        mark += "_"
    judge = decide_udf(model).asNondeterministic()  # else the filter would have a call of its own
    marked = docs.withColumn(mark, judge(F.col(f"`{text_col}`"))).where(F.col(f"{mark}.keep"))
    return marked.select(*[F.col(f"{mark}.lang").alias(c) if c == lang_col else F.col(f"`{c}`") for c in names])
