"""Words, their hashes and the shingles over them, for whole slices of texts.

A word is a run of bytes of one class in the UTF-8 text. All words of a slice are found and hashed at once by numpy: a
word's hash is the polynomial of its bytes (through a table of odd numbers), taken from prefix sums; words over `LONGEST`
bytes are hashed by xxhash. No word becomes a Python object, and nothing is remembered between slices.

Rows: a null or empty text, and one of separators alone, has no words; equal words have equal hashes wherever they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = 0x9E3779B97F4A7C15
#: Bytes that are summed at once, and the longest word that is hashed by its polynomial.
BLOCK, LONGEST = 1 << 17, 32
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + LONGEST + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def byte_class(members: bytes) -> np.ndarray:
    """A table of which bytes are in a class."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Every byte but the six ASCII white space characters.
NOT_BLANK = ~byte_class(b" \t\n\v\f\r")
#: A-Z to a-z, all else as it is.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


@dataclass
class Words:
    """The words of some texts: where they are in `data`, and `offsets`, the number of each text's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, members: np.ndarray = NOT_BLANK, fold: np.ndarray | None = None) -> Words:
        """The runs of `members` in each text; `fold` replaces bytes first."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, bounds, values = texts.buffers()
        bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        if fold is not None:
            data = fold[data]
        held = members[data]
        first, last = held.copy(), held.copy()
        first[1:] &= ~held[:-1]
        last[:-1] &= ~held[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        first[inner] = held[inner]
        last[inner - 1] = held[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return cls(data, starts, ends, np.searchsorted(starts, bounds))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        out = np.zeros(len(self.starts), np.uint64)
        edges = np.searchsorted(self.starts, np.arange(0, len(self.data) + BLOCK, BLOCK))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if i == j:
                continue
            low = int(self.starts[i])
            high = min(int(self.ends[j - 1]), low + BLOCK + LONGEST)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_TABLE[self.data[low:high]] * _POWERS[: high - low], out=sums[1:])
            a, b = self.starts[i:j] - low, np.minimum(self.ends[i:j], high) - low
            out[i:j] = (sums[b] - sums[a]) * _INVERSE[a]
        size = self.ends - self.starts
        out = mixed(out + size.astype(np.uint64) * np.uint64(_ODD))
        for k in np.flatnonzero(size > LONGEST).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.starts[k] : self.ends[k]].tobytes())
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of `size` words, in order; none where there are fewer words."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += mixed(word_hashes[k : k + n] + np.uint64((k + 1) * _ODD & 0xFFFFFFFFFFFFFFFF))
        out *= np.uint64(_ODD)
    return mixed(out)


def text_windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The windows of each text, in order; those that reach over the end of a text are left out."""
    every = windows(hashes, size)
    return [every[a : max(a, b - size + 1)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, A-Z lower-cased, ascending by hash; with fewer words than `size`, the whole
    sequence is the one shingle."""
    found = Words.of(texts, fold=LOWER)
    hashes, out = found.hashes(), []
    for own, a, b in zip(text_windows(hashes, found.offsets, size), found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(own)
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(windows(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out
