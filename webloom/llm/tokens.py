"""Token counts and ids by a public sentencepiece vocabulary."""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .common import slices
from .language_id import TOKENIZERS


@functools.cache
def processor(tokenizers: str = TOKENIZERS):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=f"{tokenizers}/piece_bpe_32k.model")


def encode(column: pa.Array, tokenizers: str = TOKENIZERS) -> list[list[int]]:
    """Token ids of each text; null has none."""
    return processor(tokenizers).encode([t or "" for t in column.to_pylist()], num_threads=1)


class Words:
    """Token ids of texts by way of their words, each given to the model once while it is held; the same ids as of the whole texts.

    A word is a run of letters other than spaces with the spaces before it. The model writes a space as "▁" and puts one before each
    text. Where no piece has "▁" after another letter, no merge crosses the start of a word, so a text's ids are those of its words,
    and a word starts where "▁" comes after another letter. That is looked up in the vocabulary; a model with other pieces, other
    normalization or without bytes for unknown letters gets whole texts. Before new texts, words are forgotten if there are over `most`
    of them, or over `letters` letters in them, so that memory stays bounded; they are encoded again then.
    """

    START = re.compile("(?<=[^ ]) ")
    PROBE = " A  ﬁ e\u0301\t．\n\u00a0x "
    GROUP = 64  # new words that the model gets as one text

    def __init__(self, model, most: int = 1 << 18, letters: int = 1 << 23):
        self.model, self.most, self.letters = model, most, letters
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.opens = np.array([p[:1] == "▁" for p in pieces])
        self.blank = np.array([not p.strip("▁") for p in pieces])
        self.apart = (
            not any("▁" in p.lstrip("▁") for p in pieces)
            and sum(map(model.is_byte, range(len(pieces)))) == 256
            and "▁" in pieces
            and model.normalize(self.PROBE) == "▁" + self.PROBE.replace(" ", "▁")
        )
        self.clear()

    def clear(self) -> None:
        """Only "", the lone space at a text's end, is known."""
        self.numbers, self.held = defaultdict(count(1).__next__, {"": 0}), 0
        self.ids, self.edges = np.array([self.model.piece_to_id("▁")], np.uint32), np.array([0, 1])

    def split(self, text: str) -> list[str]:
        """The text's words, each without the space that the model puts before it."""
        text = text.replace("▁", " ")
        if not text:
            return []
        return self.START.split(text) if text[0] == " " or "  " in text else text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Encode words and hold their ids."""
        if any(w[-1] == " " for w in new):  # spaces at a text's end
            found = self.model.encode(new, out_type="numpy", num_threads=1)
            flat = np.concatenate(found)
            ends = np.cumsum(list(map(len, found)))
        else:
            groups = [" ".join(new[i : i + self.GROUP]) for i in range(0, len(new), self.GROUP)]
            flat = np.concatenate(self.model.encode(groups, out_type="numpy", num_threads=1))
            starts = np.flatnonzero(self.opens[flat[1:]] & ~self.blank[flat[:-1]]) + 1
            ends = np.append(starts, len(flat))
        self.held += sum(map(len, new))
        self.edges = np.concatenate([self.edges, self.edges[-1] + ends])
        self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])

    def bound(self) -> None:
        """Forget the words if there are too many."""
        if len(self.numbers) > self.most or self.held > self.letters:
            self.clear()

    def places(self, words: list[str]) -> np.ndarray:
        """The number of each word; those not held are encoded."""
        known = len(self.numbers)
        places = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > known:
            self.learn(list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1])
        return places

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the len+1 edges of the texts in them; null has none."""
        if not self.apart:
            found = self.model.encode([t or "" for t in texts], out_type="numpy", num_threads=1)
            return np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.uint32), np.cumsum([0, *map(len, found)])
        self.bound()
        words, counts = [], [0]
        for t in texts:
            words += self.split(t or "")
            counts.append(len(words))
        places = self.places(words)
        starts = self.edges[places]
        edges = np.concatenate([[0], np.cumsum(self.edges[places + 1] - starts)])
        take = np.repeat(starts - edges[:-1], np.diff(edges)) + np.arange(edges[-1])
        return self.ids[take], edges[counts]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, 0 for null. Words are told apart by Arrow and looked up once among `most`; texts with spaces next to
        each other or at the start go by encode(), and bytes to the model as they are."""
        if not self.apart or not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
            found = self.model.encode([t or "" for t in texts.to_pylist()], out_type="numpy", num_threads=1)
            return np.fromiter(map(len, found), np.int64, len(texts))
        texts = pc.replace_substring(texts.fill_null(""), "▁", " ")
        odd = pc.or_(pc.equal(texts, ""), pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")))
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        words, sizes = split.flatten(), [np.zeros(1, np.int64)]
        for i in range(0, len(words), self.most):
            self.bound()
            part = words.slice(i, self.most).dictionary_encode()
            places = self.places(part.dictionary.to_numpy(zero_copy_only=False).tolist())  # faster than to_pylist
            sizes.append((self.edges[places + 1] - self.edges[places])[part.indices.to_numpy()])
        ends, at = np.cumsum(np.concatenate(sizes)), split.offsets.to_numpy()
        by_words = ~odd.to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        out[by_words] = np.diff(ends[at - at[0]])
        out[~by_words] = np.diff(self.encode(texts.filter(odd).to_pylist())[1])
        return out


def count_udf(tokenizers: str = TOKENIZERS):
    """Tokens of a text, 0 for null."""

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            out = [np.fromiter(map(len, encode(part, tokenizers)), np.int64) for part in slices(batch)]
            yield pa.array(np.concatenate(out), pa.int64())

    run.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "bigint")
