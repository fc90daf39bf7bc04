"""Ids of many texts at once, word by word.

A slice of texts is cut into words by Arrow, distinct words are looked up or learnt from the library, and numpy gathers
the ids of all texts from theirs. Which texts may be cut this way is the tokenizer's business (`plain`).

Rows: texts are not null; an empty text is one empty word; equal texts are coded alike, one result for each.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The ids of some words one after another, and how many each has.
Learned = tuple[np.ndarray, np.ndarray]
#: Bytes of text that are encoded together.
SLICE_BYTES = 2_000_000


def cut(ids: np.ndarray, begins: np.ndarray, n: int) -> Learned | None:
    """The ids of `n` words that were encoded as one text; `begins` tells whether an id starts a word. None where the
    starts don't add up to the words."""
    at = np.flatnonzero(begins[ids])
    return (ids, np.diff(np.append(at, len(ids)))) if len(at) == n and (not n or at[0] == 0) else None


class Memory:
    """The ids of the words that were learnt so far; it starts anew beyond `most` words (200 bytes each)."""

    def __init__(self, learn: Callable[[list[str]], Learned], most: int) -> None:
        self.learn, self.most = learn, most
        self.known: dict[str, int] = {}
        self.values, self.size = learn([])

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all remembered words, how many each has, and which of them the given distinct words are."""
        if len(self.known) > self.most:
            self.known.clear()
            self.values, self.size = self.values[:0], self.size[:0]
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = [words[k] for k in new.tolist()]
            values, size = self.learn(missing)
            at[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.known.update(zip(missing, at[new].tolist(), strict=True))
            self.values, self.size = np.concatenate([self.values, values]), np.concatenate([self.size, size])
        return self.values, self.size, at


def gathered(texts: pa.Array, memory: Memory, first: Callable[[list[str]], Learned] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and the offset of each text's first. A word follows a space, or starts with
    its line feed; the first word of a text is learnt by `first`, if given, each time."""
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    words = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    if first is not None:
        at = offsets[:-1]
        later = np.ones(len(words), bool)
        later[at] = False
        heads = words.take(pa.array(at)).dictionary_encode()
        coded = words.filter(pa.array(later)).dictionary_encode()
        codes = np.empty(len(words), np.int64)
        codes[later], codes[at] = coded.indices.to_numpy(), heads.indices.to_numpy() + len(coded.dictionary)
        (values, size, own), (more, sizes) = memory(coded.dictionary.to_pylist()), first(heads.dictionary.to_pylist())
        own = np.concatenate([own, np.arange(len(size), len(size) + len(sizes))])
        values, size = np.concatenate([values, more]), np.concatenate([size, sizes])
    else:
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        values, size, own = memory(coded.dictionary.to_pylist())
    start = np.cumsum(size) - size
    codes = own[codes]
    lengths = size[codes]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(start[codes] - ends[:-1], lengths) + np.arange(ends[-1])], ends[offsets]


def rows_of(texts: pa.Array, plain: np.ndarray, memory: Memory, other: Callable[[list[str]], list[np.ndarray]], first: Callable[[list[str]], Learned] | None = None) -> list[np.ndarray]:
    """The ids of each text: the plain ones by word, the others as a whole."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
    at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
    if len(at):
        values, offsets = gathered(texts.take(pa.array(at)), memory, first)
        for k, a, b in zip(at.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            out[k] = values[a:b]
    if len(rest):
        for k, ids in zip(rest.tolist(), other(texts.take(pa.array(rest)).to_pylist()), strict=True):
            out[k] = ids
    return out
