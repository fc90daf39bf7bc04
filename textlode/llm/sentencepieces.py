"""SentencePiece encoding and decoding with exact source offsets.

The model file is read directly: its compiled character map is a double-array trie that maps source prefixes to
replacement strings. `Normaliser` walks it by longest prefix and records, for every byte of the normalised string, the
source byte that it comes from; every piece is then projected to a byte span of the source text.

Ids come from the sentencepiece library. Where the vocabulary allows it (no piece holds a space mark after another
character, none but a byte piece holds a line feed) no merge can cross the start of a word, so that the distinct words of
many texts are encoded as one, and remembered; other vocabularies are encoded text by text.

Rows: null text is an empty text; an empty text has no ids and decodes to an empty text. Repeated rows, null ids and
extra columns pass through unchanged in number: one output row for each input row.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.batches import arrow_map, list_array
from textlode.llm.wordwise import Learned, Memory, cut, rows_of

SPACE = "▁"
MARK = SPACE.encode()
#: Bytes of text that are encoded together: the spans and decoded texts of a slice are held with it.
SLICE_BYTES = 1_000_000
#: Words that one worker remembers.
REMEMBERED = 100_000
#: Words that the library encodes as one text.
ENCODED = 500
#: Piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value = data[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        yield key >> 3, value


@dataclass
class ModelFile:
    """What of a model file the offsets need."""

    pieces: list[tuple[bytes, int]] = field(default_factory=list)
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True

    @classmethod
    def load(cls, path: str) -> ModelFile:
        model = cls()
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append((piece.get(1, b""), piece.get(3, NORMAL)))
            elif number == 3:
                spec = dict(_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.trim, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return model


class Normaliser:
    """Longest-prefix normalisation with source alignment."""

    def __init__(self, model: ModelFile) -> None:
        self.model = model
        self.units, self.texts = np.zeros(0, np.uint32), b""
        if model.charsmap:
            (size,) = struct.unpack_from("<I", model.charsmap)
            self.units = np.frombuffer(model.charsmap, np.uint32, size // 4, 4).tolist()
            self.texts = model.charsmap[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of data[at:] in the map and that prefix's length."""
        units, node, best = self.units, 0, None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if (unit & 0x800000FF) != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = (units[node] & 0x7FFFFFFF, k + 1 - at)
        if best is None:
            return None
        start = best[0]
        return self.texts[start : self.texts.index(b"\0", start)], best[1]

    def steps(self, data: bytes):
        """(replacement, source start, source end) through the map, character by character where it has no entry."""
        at = 0
        while at < len(data):
            found = self.longest(data, at)
            if found is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = data[at : at + size], size
            yield found[0], at, at + found[1]
            at += found[1]

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised bytes, and for each of them the start of its source and of the next one's, so that spans tile the text."""
        if not data:
            return b"", np.zeros(0, np.int32), np.zeros(0, np.int32)
        model = self.model
        if not model.charsmap and not model.trim:
            return self.identity(data)
        out, starts, end = bytearray(), [], 0

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            starts.extend([at] * len(piece))

        steps = self.steps(data) if model.charsmap else ((data[k : k + 1], k, k + 1) for k in range(len(data)))
        mark = MARK if model.escape else b" "
        blank = model.trim  # leading white space goes
        first = True
        for piece, a, end in steps:
            if first and not (model.trim and piece == b" "):
                first = False
                if model.dummy_prefix:
                    put(mark, a)
            for k in range(len(piece)):
                c = piece[k : k + 1]
                if c == b" " and blank and model.trim:
                    continue
                put(mark if c == b" " else c, a)
                blank = c == b" "
        if model.trim:
            while out.endswith(mark):
                end = starts[-len(mark)]
                del out[-len(mark) :], starts[-len(mark) :]
        return bytes(out), np.array(starts, np.int32), np.array([*starts[1:], end][: len(starts)], np.int32)

    def identity(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The same for an empty map, where only spaces change."""
        model = self.model
        source = np.frombuffer(data, np.uint8)
        width = np.where(source == 32, len(MARK) if model.escape else 1, 1)
        lead = (len(MARK) if model.escape else 1) if model.dummy_prefix else 0
        at = np.repeat(np.arange(len(data), dtype=np.int32), width)
        out = data.replace(b" ", MARK) if model.escape else data
        starts = np.concatenate([np.zeros(lead, np.int32), at])
        ends = np.concatenate([np.zeros(lead, np.int32), at + 1])
        return (MARK if model.escape else b" ")[:lead] + out, starts, ends


class Encoder:
    """Ids, spans and decoded texts of one model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = ModelFile.load(path)
        self.normalise = Normaliser(self.model)
        self.width = np.array([1 if kind == BYTE else len(piece) for piece, kind in self.model.pieces], np.int32)
        self.unknown = next((i for i, (_, kind) in enumerate(self.model.pieces) if kind == UNKNOWN), -1)
        surface = [piece for piece, kind in self.model.pieces if kind in (NORMAL, USER, UNUSED)]
        inner = any(MARK in self._after_lead(piece) for piece in surface)
        self.by_word = not inner and not self.model.charsmap and not self.model.trim and self.model.dummy_prefix and self.model.escape
        self.by_word = self.by_word and not any(b"\n" in piece for piece in surface)
        self.begins = np.array([kind == NORMAL and piece.startswith(MARK) or piece == b"<0x0A>" for piece, kind in self.model.pieces])
        self.memory = Memory(self.learn, REMEMBERED)

    @staticmethod
    def _after_lead(piece: bytes) -> bytes:
        while piece.startswith(MARK):
            piece = piece[len(MARK) :]
        return piece

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.library.encode(texts, num_threads=1)]

    def _apart(self, words: list[str]) -> Learned:
        # the library puts a space mark before each text, before a line feed as a piece of its own
        found = [ids[1:] if w[:1] == "\n" else ids if w else np.array([self.library.piece_to_id(SPACE)], np.int32) for w, ids in zip(words, self.whole(words), strict=True)]
        return np.concatenate(found), np.array([len(x) for x in found])

    def learn(self, words: list[str]) -> Learned:
        """Ids of words that follow a space (also of none between two), or of line feeds and words."""
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for at in range(0, len(words), ENCODED):
            block = words[at : at + ENCODED]
            text = " ".join(block).replace(" \n", "\n")
            together = None if "" in block or block[0][0] == "\n" else cut(self.whole([text])[0], self.begins, len(block))
            parts.append(together or self._apart(block))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Whether each text may be cut into words: not empty, no space mark, and no space before another one."""
        if not self.by_word:
            return np.zeros(len(texts), bool)
        return ~pc.match_substring_regex(texts, f"^ |  |{SPACE}|^$").to_numpy(zero_copy_only=False)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is an empty text."""
        texts = pc.fill_null(texts, "")
        return rows_of(texts, self.plain(texts), self.memory, self.whole)

    def ids(self, text: str) -> np.ndarray:
        return self(pa.array([text], pa.string()))[0]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece in the UTF-8 bytes of `text`."""
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        normal, starts, ends = self.normalise(text.encode())
        width = self.width[ids]
        if self.unknown >= 0 and (unknown := np.flatnonzero(ids == self.unknown)).size:
            width = width.copy()
            self._widen(normal, ids, width, unknown)
        to = np.cumsum(width)
        return starts[to - width], ends[to - 1]

    def _widen(self, normal: bytes, ids: np.ndarray, width: np.ndarray, unknown: np.ndarray) -> None:
        """An unknown piece reaches to where the next known piece starts, one character at least."""
        at = 0
        unknown_at = set(unknown.tolist())
        for k in range(len(ids)):
            if k in unknown_at:
                lead = normal[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                following = self.model.pieces[int(ids[k + 1])][0] if k + 1 < len(ids) and k + 1 not in unknown_at else None
                if following is not None:
                    found = normal.find(following, at + size)
                    size = found - at if found >= 0 else size
                elif k + 1 == len(ids):
                    size = len(normal) - at
                width[k] = size
            at += int(width[k])

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([x.tolist() for x in ids], num_threads=1)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and model."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """(id, ids, starts, ends, decoded) of every row; starts and ends are byte offsets and null without `with_spans`."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        coder = encoder(model_path)

        def run(batch: pa.RecordBatch) -> list:
            ids, starts, ends = coder(batch.column(1)), [], []
            if with_spans:
                for text, found in zip(batch.column(1).to_pylist(), ids, strict=True):
                    a, b = coder.spans(text or "", found)
                    starts.append(a)
                    ends.append(b)
            texts = coder.decode(ids)
            none = pa.nulls(len(texts), pa.list_(pa.int32()))
            return [batch.column(0), list_array(ids, np.int32), list_array(starts, np.int32) if with_spans else none, list_array(ends, np.int32) if with_spans else none, pa.array(texts, pa.string())]

        return run

    return arrow_map(df.select(id_col, text_col), make, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string", SLICE_BYTES)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and digests of `encode_texts`, and how many source bytes its spans cover."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.element_at("ends", F.when(F.size("ends") > 0, F.lit(-1))), F.lit(0)).cast("long").alias("covered_bytes"),
    )
