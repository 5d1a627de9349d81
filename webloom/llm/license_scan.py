"""Licence scans: winnowed template fingerprints in an inverted index pick candidates, banded alignment measures the match."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices
from .license_templates import TEMPLATES
from .words import grams, words

MATCH = pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
MATCH_DDL = "array<struct<template:string,coverage:double,matched:int,start:bigint,end:bigint>>"


SEGMENT = 96  # words of a long template that are aligned together


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the least hash of each window, the last of equal ones; a sequence shorter than the window has one."""
    if not len(hashes):
        return []
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views, axis=1)).tolist()


class Index:
    """Fingerprint -> (segment, place in it). Templates of few words (under four windows of k-grams) keep every k-gram, others those that
    winnowing picks: a run of window + k - 1 template words that a text holds is then never missed, whatever stands around it.
    Templates of over one and a half SEGMENTs are cut into segments of about SEGMENT words, which are aligned one by one."""

    def __init__(self, templates: dict[str, str], k: int = 3, window: int = 4):
        self.k, self.names, self.sizes = k, list(templates), []
        self.owner: list[int] = []  # template of each segment
        self.first: list[int] = []  # place of its first word in the template
        self.hashes: list[np.ndarray] = []  # its words
        self.segments: list[list[int]] = []  # of each template, in order
        posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, text in enumerate(templates.values()):
            w = words(pa.array([text]))
            n = len(w.hash)
            if n < k:
                raise ValueError(f"template {self.names[number]} has under {k} words")
            self.sizes.append(n)
            g, _ = grams(w, k)
            many = 1 if n <= SEGMENT * 3 // 2 else -(-n // SEGMENT)
            cuts = [n * i // many for i in range(many + 1)]
            ids = list(range(len(self.owner), len(self.owner) + many))
            self.segments.append(ids)
            self.owner += [number] * many
            self.first += cuts[:-1]
            self.hashes += [w.hash[a:b] for a, b in zip(cuts, cuts[1:])]
            for at in winnow(g, window if len(g) >= 4 * window else 1):
                piece = bisect.bisect_right(cuts, at) - 1
                posts[int(g[at])].append((ids[piece], at - cuts[piece]))
        self.posts = dict(posts)
        self.keys = np.array(sorted(self.posts), np.uint64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys & np.uint64((1 << 20) - 1)] = True

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Places in g of the fingerprints."""
        maybe = np.flatnonzero(self.bits[g & np.uint64((1 << 20) - 1)])
        return maybe[np.isin(g[maybe], self.keys)] if len(maybe) else maybe


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with text place minus template place within low..high: (matched words, first and last+1 text place).

    A matched word counts 2, a replaced, left-out or added one -1; of equal scores that with more matches, then the earlier.
    """
    width = high - low + 1
    zero = (0, 0, -1)
    above = [zero] * (width + 1)
    best, best_at = (0, 0, -1), -1
    for i, word in enumerate(template.tolist()):
        row, left = [zero] * (width + 1), zero
        for d in range(width):
            j = i + low + d
            if j < 0 or j >= len(text):
                left = zero
                continue
            score, matched, start = above[d]
            if int(text[j]) == word:
                cell = (score + 2, matched + 1, start if start >= 0 else j)
            else:
                cell = (score - 1, matched, start)
            for other in (above[d + 1], left):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] <= 0:
                cell = zero
            row[d] = left = cell
            if cell[:2] > best[:2]:
                best, best_at = cell, j
        above = row
    return best[1], best[2], best_at + 1


@dataclass
class Piece:
    """A segment aligned in a text: places of the text, in words."""

    order: int  # of the segment in its template
    matched: int
    start: int
    end: int


def locate(index: Index, segment: int, text: np.ndarray, lowest: int, highest: int) -> Piece | None:
    """The segment aligned where text place minus segment place is within lowest..highest, or a band around it."""
    template = index.hashes[segment]
    n, band = len(template), max(2, len(template) // 6)
    for at in (lowest, highest):  # word for word
        if at >= 0 and np.array_equal(text[at : at + n], template):
            return Piece(segment - index.segments[index.owner[segment]][0], n, at, at + n)
    base = max(0, lowest - band)
    part = text[base : max(base, highest + n + band)]
    matched, start, end = align(template, part, lowest - band - base, highest + band - base)
    return Piece(segment - index.segments[index.owner[segment]][0], matched, start + base, end + base) if matched else None


def chains(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """Pieces of one template as its occurrences: segments ascend and so do their places, with at most size words between neighbours. The
    chain with the most matched words (less a hundredth for each word between) is taken, then the best of what is left, and so on."""
    out = []
    left = sorted(pieces, key=lambda p: (p.start, p.end, p.order))
    while left:
        best: list[tuple[float, int]] = []  # of the chain that ends here, and the piece before
        for i, p in enumerate(left):
            score, before = float(p.matched), -1
            for j in range(i - 1, -1, -1):
                q = left[j]
                if p.start - q.start > 2 * size + SEGMENT * 2:
                    break
                gap = p.start - q.end
                if q.order < p.order and -SEGMENT // 3 <= gap <= size and best[j][0] + p.matched - max(0, gap) / 100 > score:
                    score, before = best[j][0] + p.matched - max(0, gap) / 100, j
            best.append((score, before))
        at = max(range(len(left)), key=lambda i: (best[i][0], -i))
        chain = []
        while at >= 0:
            chain.append(at)
            at = best[at][1]
        out.append([left[i] for i in reversed(chain)])
        left = [p for i, p in enumerate(left) if i not in set(chain)]
    return out


def filled(index: Index, number: int, text: np.ndarray, chain: list[Piece]) -> list[Piece]:
    """The chain with the segments that had too few fingerprints of their own, looked for where their neighbours put them."""
    ids = index.segments[number]
    if len(chain) == len(ids):
        return chain
    have = {p.order: p for p in chain}
    for orders in (range(len(ids)), range(len(ids) - 1, -1, -1)):  # on from the neighbour before, then from the one after
        near: Piece | None = None
        for order in orders:
            if order in have:
                near = have[order]
                continue
            if near is None:
                continue
            n = len(index.hashes[ids[order]])
            after = near.order < order
            place = near.end if after else near.start - n
            limits = [p.start for p in have.values() if p.order > order], [p.end for p in have.values() if p.order < order]
            found = locate(index, ids[order], text, place, place)
            ok = found is not None and found.matched * 3 >= n and found.end <= min(limits[0], default=len(text)) and found.start >= max(limits[1], default=0)
            near = Piece(order, 0, place, place + n) if not ok else found
            if ok:
                have[order] = found
    return [have[o] for o in sorted(have)]


def find(column: pa.Array, index: Index, min_coverage: float, min_hits: int = 3) -> list[list[dict]]:
    """For each row its matches, by place. Of matches that overlap, that with the most matched words stays (then the higher coverage, then the name)."""
    w = words(column)
    g, first = grams(w, index.k)
    where = index.hits(g)
    out: list[list[dict]] = [[] for _ in range(len(column))]
    by_pair: dict[tuple[int, int], list[int]] = defaultdict(list)
    word_at = np.searchsorted(w.row, np.arange(len(column) + 1))
    for at in where.tolist():
        row = int(w.row[first[at]])
        for segment, place in index.posts[int(g[at])]:
            by_pair[row, segment].append(int(first[at]) - int(word_at[row]) - place)
    pieces: dict[tuple[int, int], list[Piece]] = defaultdict(list)
    for (row, segment), diagonals in by_pair.items():
        number = index.owner[segment]
        n, band = len(index.hashes[segment]), max(2, len(index.hashes[segment]) // 6)
        least = min_hits if n > SEGMENT // 2 else 1
        if len(diagonals) < least:
            continue
        text = w.hash[word_at[row] : word_at[row + 1]]
        diagonals.sort()
        groups, begin, count = [], diagonals[0], 0
        for a, b in zip(diagonals, [*diagonals[1:], None]):
            count += 1
            if b is None or b - a > band or b - begin > n // 2:
                if count >= least:
                    groups.append((begin, a))
                begin, count = b, 0
        for lowest, highest in groups:
            found = locate(index, segment, text, lowest, highest)
            if found is not None:
                pieces[row, number].append(found)
    met: dict[int, list[tuple]] = defaultdict(list)
    for (row, number), some in pieces.items():
        text, size = w.hash[word_at[row] : word_at[row + 1]], index.sizes[number]
        whole = [[p] for p in some] if len(index.segments[number]) == 1 else chains(some, size)
        for chain in whole:
            if len(index.segments[number]) > 1:
                if sum(p.matched for p in chain) < 0.3 * size:  # stray segments
                    continue
                chain = filled(index, number, text, chain)
            matched = sum(p.matched for p in chain)
            if matched / size >= min_coverage:
                met[row].append((min(size, matched), min(1.0, matched / size), index.names[number], chain[0].start, max(p.end for p in chain)))
    for row, matches in met.items():
        taken: list[tuple[int, int]] = []
        kept = []
        for matched, coverage, name, start, end in sorted(set(matches), key=lambda m: (-m[0], -m[1], m[2], m[3])):
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                a, b = word_at[row] + start, word_at[row] + end - 1
                kept.append({"template": name, "coverage": coverage, "matched": matched, "start": int(w.start[a] - w.row_at[row]), "end": int(w.end[b] - w.row_at[row])})
        out[row] = sorted(kept, key=lambda m: m["start"])
    return out


def scan_udf(index: Index, min_coverage: float):
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            out = []
            for part in slices(batch):
                out += find(part, index, min_coverage)
            yield pa.array(out, pa.list_(MATCH))

    run.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, MATCH_DDL)


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, k: int = 3, window: int = 4, min_coverage: float = 0.8) -> DataFrame:
    """One row for each licence template that a text holds: (doc_id, template, coverage, matched, start, end).

    coverage is the share of the template's words that the alignment matches, matched their number; start and end are
    code point offsets in the text. A long template is aligned in segments of about 96 words: those of which at least three
    fingerprints lie near one diagonal (one for short templates), and those that their neighbours point to; the segments that
    follow each other in the text are one occurrence, whatever stands between them (up to as many words as the template has),
    so that inserted passages don't hide it. Occurrences of min_coverage or more are reported. The index travels with the task
    (its size is that of the templates); texts are read once, in place: no shuffle. Whole texts are searched, however long.

    Null, empty and wordless texts give no rows. A repeated row gives its rows again. A null doc_id is kept as null. A
    template that occurs several times in a text gives a row each time. Equal matches of two templates go to the name that
    sorts first. An empty table gives no rows; other columns are not read, whatever their names.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return src.select("doc_id", F.explode(scan_udf(Index(templates, k, window), min_coverage)("text")).alias("m")).select("doc_id", "m.*")
