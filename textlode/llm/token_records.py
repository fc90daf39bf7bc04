"""Token ids as length-delimited binary records, with a separate offset index.

A file holds records one after another:

    uint64 length | uint32 masked checksum of the length | payload | uint32 masked checksum of the payload

and its index holds the uint64 offset of every record and of the end, so that record k can be read alone. A payload is
`int64 doc_id, uint32 flag (1: doc_id is null)` and then the ids, little-endian, two bytes each where the vocabulary
allows it and four otherwise. The mask rotates a CRC-32 right by 15 bits and adds a constant, so that a checksum of
bytes that hold checksums stays meaningful.

Files are written in ascending doc_id (null first; ties by a hash of the text), a new one every `FILE_BYTES`, under
names that no other attempt uses.
The manifest, a Parquet table that Spark commits, names the files of the attempts that count; a file that a lost
executor left behind is in no manifest. Null text is an empty text, of which only the end id is written.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.llm.batches import chunks, small_batches, trim
from textlode.llm.wordwise import SLICE_BYTES, Learned, Memory, cut, rows_of
from textlode.session import materialise

MASK_ADD = 0xA282EAD8
HEAD = struct.Struct("<QI")
LEAD = struct.Struct("<qI")
#: Words that one worker remembers.
REMEMBERED = 1_000_000
#: Words that the library encodes as one text.
ENCODED = 500
#: Bytes of records from which on a task starts another file.
FILE_BYTES = 128 << 20
#: Records that the reader returns at once.
READ_RECORDS = 20_000
#: The characters that stand for a space and a line feed in byte-level vocabularies.
WHITE_BYTES = "\u0120\u010a"
#: White space other than single spaces and line feeds between words, for RE2.
ODD_WHITE = r"^[ \n]|[ \n]\z|[ \n][ \n]|[\t\v\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


class ByteBpe:
    """Ids of the tokenizers library. A byte-level pre-tokeniser never joins what stands on two sides of white space that
    follows other text, so the distinct words of a slice, with the white space before them, are encoded as one text, in
    which an id that begins with white space begins a word. For any other pre-tokeniser, and for texts that hold an
    added token or other white space, whole texts are encoded. By the library's default an added token in a text is one
    id; with `special_as_text` special ones are plain text."""

    def __init__(self, path: str, special_as_text: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"] for t in spec.get("added_tokens", []) if not (special_as_text and t.get("special"))]
        self.begins = np.zeros(self.size, bool)
        for token, k in self.library.get_vocab().items():
            self.begins[k] = token[0] in WHITE_BYTES
        self.memory = Memory(self.learn, REMEMBERED)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def first(self, words: list[str]) -> Learned:
        """Ids of words that nothing precedes."""
        found = self.whole(words)
        return np.concatenate(found), np.array([len(x) for x in found])

    def learn(self, words: list[str]) -> Learned:
        """Ids of words that follow a space, or of line feeds and words."""
        parts = [(np.zeros(0, self.dtype), np.zeros(0, np.int64))]
        for at in range(0, len(words), ENCODED):
            block = words[at : at + ENCODED]
            text = f" {' '.join(block)}".replace(" \n", "\n")
            parts.append(cut(self.whole([text])[0], self.begins, len(block)) or self.first([w if w[0] == "\n" else f" {w}" for w in block]))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Whether each text may be cut into words: single spaces and line feeds between them, and no added token."""
        if not self.by_word:
            return np.zeros(len(texts), bool)
        odd = pc.match_substring_regex(texts, ODD_WHITE)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        return ~odd.to_numpy(zero_copy_only=False)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is an empty text."""
        texts = pc.fill_null(texts, "")
        return rows_of(texts, self.plain(texts), self.memory, self.whole, self.first)


_TOKENIZERS: dict[tuple[str, bool], ByteBpe] = {}


def tokenizer(path: str, special_as_text: bool = True) -> ByteBpe:
    key = path, special_as_text
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = ByteBpe(*key)
    return _TOKENIZERS[key]


def file_system(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class RecordWriter:
    """One record file and its index."""

    def __init__(self, uri: str) -> None:
        self.fs, path = file_system(uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.path, self.uri = path, uri
        self.out = self.fs.open_output_stream(path)
        self.offsets, self.at = [0], 0

    def write(self, payload: bytes) -> None:
        length = struct.pack("<Q", len(payload))
        self.out.write(b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)))))
        self.at += len(payload) + 16
        self.offsets.append(self.at)

    def close(self) -> None:
        self.out.close()
        with self.fs.open_output_stream(f"{self.path}.index") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())


def _checked(read, where: str) -> bytes | None:
    head = read(HEAD.size)
    if not head:
        return None
    length, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError(f"{where}: the length of a record is damaged")
    payload = read(length)
    if len(payload) != length or masked(payload) != struct.unpack("<I", read(4))[0]:
        raise ValueError(f"{where}: a record is damaged")
    return payload


def records(uri: str) -> Iterator[bytes]:
    """All payloads of a file, in order; a damaged one raises ValueError."""
    fs, path = file_system(uri)
    with fs.open_input_stream(path, buffer_size=1 << 20) as f:
        while (payload := _checked(f.read, uri)) is not None:
            yield payload


def record(uri: str, k: int) -> bytes:
    """Payload number k, through the index."""
    fs, path = file_system(uri)
    with fs.open_input_file(f"{path}.index") as f:
        f.seek(8 * k)
        (offset,) = struct.unpack("<Q", f.read(8))
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return _checked(f.read, uri)


def shuffled(uri: str, seed: int) -> Iterator[bytes]:
    """All payloads of a file in a random order that `seed` decides."""
    fs, path = file_system(uri)
    with fs.open_input_file(f"{path}.index") as f:
        offsets = np.frombuffer(f.read(), "<u8")
    with fs.open_input_file(path) as f:
        for k in np.random.default_rng(seed).permutation(len(offsets) - 1):
            f.seek(int(offsets[k]))
            yield _checked(f.read, uri)


def packed(doc_id: int | None, ids: bytes) -> bytes:
    return LEAD.pack(doc_id or 0, doc_id is None) + ids


def unpack(payload: bytes, dtype: np.dtype) -> tuple[int | None, np.ndarray]:
    """The doc_id and the ids of a payload."""
    doc_id, null = LEAD.unpack_from(payload)
    return (None if null else doc_id), np.frombuffer(payload, dtype, offset=LEAD.size)


MANIFEST = "file_no int, part int, path string, n_records long, n_tokens long, width int"


def write_tokens(df: DataFrame, tokenizer_path: str, end_id: int, out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the records of `df` below `out`; returns the manifest (a table, in `out`/manifest). A task writes as many
    files as its records fill."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("place").asc()]  # Spark samples the keys: numbers, not texts; `place` splits rows of one id and text
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, number, part = tokenizer(tokenizer_path, special_as_text=False), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.dtype).tobytes()
        writer, tokens = None, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            values = {"file_no": pa.array([number], pa.int32()), "part": pa.array([part], pa.int32()), "path": [writer.uri], "n_records": [len(writer.offsets) - 1], "n_tokens": [tokens], "width": pa.array([coder.dtype.itemsize], pa.int32())}
            return pa.RecordBatch.from_pydict(values)

        for batch in batches:
            for slice_ in chunks(batch, SLICE_BYTES):
                for doc_id, ids in zip(slice_.column(0).to_pylist(), coder(slice_.column(1)), strict=True):
                    if writer and writer.at >= FILE_BYTES:
                        yield closed()
                        writer, tokens, part = None, 0, part + 1
                    writer = writer or RecordWriter(f"{out}/data/part-{number:06d}-{part:04d}-{uuid.uuid4().hex}.bin")
                    writer.write(packed(doc_id, ids.astype(coder.dtype, copy=False).tobytes() + end))
                    tokens += len(ids) + 1
        if writer:
            yield closed()
        trim()

    return materialise(rows.mapInArrow(run, MANIFEST), f"{out}/manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the files; start counts the ids of all documents
    before it. One row a file, so that the window over the manifest is as small as the list of files."""
    spark: SparkSession = manifest.sparkSession
    order = Window.orderBy("file_no", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small_batches(spark)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, width, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                dtype, rows = np.dtype(f"<u{width}"), []
                for payload in records(path):
                    doc_id, tokens = unpack(payload, dtype)
                    rows.append((doc_id, at, len(tokens), zlib.crc32(tokens.astype("<u4").tobytes())))
                    at += len(tokens)
                    if len(rows) == READ_RECORDS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return files.select("path", "width", "base").repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
