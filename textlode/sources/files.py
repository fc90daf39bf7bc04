"""Files as a corpus: a driver-side walk with admission rules, binary reading, decompression and decoding."""

from __future__ import annotations

import bz2
import gzip
import lzma
import os
import re
import subprocess
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textlode.functions.filetypes import FileTypes
from textlode.functions.globs import override
from textlode.functions.ignore import IgnoreRule, ignored, parse_rules
from textlode.session import bounded_batches, ship

ENTRIES = "path string, parent string, file_name string, depth int, is_dir boolean, is_symlink boolean, is_hidden boolean, size long, mtime double, atime double, ctime double, full_path string"
IGNORE_FILES = {".gitignore": "gitignore", ".ignore": "ignore"}
#: Bytes of files that one Arrow batch holds.
BATCH_BYTES = 4 << 20
SUFFIXES = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30}


def byte_size(text: str) -> int:
    """`10`, `10K`, `10M` or `10G`."""
    unit = SUFFIXES.get(text[-1:].upper())
    number = text[:-1] if unit else text
    if not number.isdigit():
        raise ValueError(f"invalid size {text!r}")
    return int(number) * (unit or 1)


@dataclass
class WalkOptions:
    hidden: bool = False
    follow: bool = False
    max_depth: int | None = None
    min_depth: int | None = None
    max_filesize: int | None = None
    one_file_system: bool = False
    ignore: bool = True
    ignore_dot: bool = True
    ignore_vcs: bool = True
    ignore_exclude: bool = True
    require_git: bool = True
    ignore_files: list[str] = field(default_factory=list)
    ignore_parent: bool = True
    ignore_global: bool = True
    ignore_case: bool = False
    globs: list[str] = field(default_factory=list)
    iglobs: list[str] = field(default_factory=list)
    globs_ignore_case: bool = False
    types: list[tuple[str, bool]] = field(default_factory=list)
    file_types: FileTypes = field(default_factory=FileTypes)


def rules_of(root: str, options: WalkOptions) -> list[IgnoreRule]:
    """The rules of all rule files below `root`."""
    out: list[IgnoreRule] = []
    if not options.ignore:
        return out
    in_git = not options.require_git or _in_repository(os.path.abspath(root)) if options.ignore_parent else not options.require_git or _repository(root)
    inside = {root: in_git}
    for folder, folders, names in folders_below(root, options):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        in_git = inside.pop(folder) or _repository(folder)
        inside |= {os.path.join(folder, d): in_git for d in folders}
        if options.ignore_exclude and in_git and (path := exclude_file(folder)):
            with open(path, encoding="utf-8", errors="replace") as f:
                out += parse_rules(f.read(), "" if base == "." else base, "exclude")
        for name in sorted(set(names) & IGNORE_FILES.keys()):
            source = IGNORE_FILES[name]
            if (source == "gitignore" and (not options.ignore_vcs or not in_git)) or (source == "ignore" and not options.ignore_dot):
                continue
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                out += parse_rules(f.read(), "" if base == "." else base, source)
    out += outer_rules(root, options)
    return out


def _repository(folder: str) -> bool:
    return any(os.path.exists(os.path.join(folder, d)) for d in (".git", ".jj"))


def exclude_file(folder: str) -> str | None:
    """The exclude file of the repository in a folder. In a worktree `.git` is a file that names the worktree's own data,
    where `commondir` leads to the repository."""
    git = os.path.join(folder, ".git")
    try:
        if os.path.isfile(git):
            with open(git, encoding="utf-8", errors="replace") as f:
                git = os.path.normpath(os.path.join(folder, f.read().removeprefix("gitdir:").strip()))
            common = os.path.join(git, "commondir")
            if os.path.isfile(common):
                with open(common, encoding="utf-8", errors="replace") as f:
                    git = os.path.normpath(os.path.join(git, f.read().strip()))
    except OSError:
        return None
    path = os.path.join(git, "info", "exclude")
    return path if os.path.isfile(path) else None


def outer_rules(root: str, options: WalkOptions) -> list[IgnoreRule]:
    """Rules that hold below `root` and stand elsewhere: above it, in the user's own list, and in files that are named."""
    out: list[IgnoreRule] = []
    in_git = not options.require_git or _in_repository(os.path.abspath(root))
    if options.ignore_parent:
        out += parent_rules(root, options, in_git)
    if options.ignore_global and options.ignore_vcs and in_git and (path := global_excludes()):
        with open(path, encoding="utf-8", errors="replace") as f:
            out += parse_rules(f.read(), "", "global")
    for path in options.ignore_files:
        with open(path, encoding="utf-8", errors="replace") as f:
            out += parse_rules(f.read(), "", "explicit")
    return out


def parent_rules(root: str, options: WalkOptions, in_git: bool) -> list[IgnoreRule]:
    """The rules of files above `root` that reach into it, anchored anew; the repository's own folder ends the version
    control's part of them."""
    out: list[IgnoreRule] = []
    top = os.path.abspath(root)
    vcs = options.ignore_vcs and not any(os.path.exists(os.path.join(top, d)) for d in (".git", ".jj"))
    below = ""
    while (parent := os.path.dirname(top)) != top:
        below = f"{os.path.basename(top)}/{below}" if below else os.path.basename(top)
        repository = any(os.path.exists(os.path.join(parent, d)) for d in (".git", ".jj"))
        for name, source in IGNORE_FILES.items():
            path = os.path.join(parent, name)
            wanted = options.ignore_dot if source == "ignore" else vcs and (not options.require_git or _in_repository(parent))
            if wanted and os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    out += [r for rule in parse_rules(f.read(), "", source) if (r := _seen_from(rule, below)) is not None]
        vcs = vcs and not repository
        top = parent
    return out


def _in_repository(folder: str) -> bool:
    while True:
        if any(os.path.exists(os.path.join(folder, d)) for d in (".git", ".jj")):
            return True
        if os.path.dirname(folder) == folder:
            return False
        folder = os.path.dirname(folder)


def _seen_from(rule: IgnoreRule, below: str) -> IgnoreRule | None:
    """A rule of a folder above as a rule of the folder `below` it: names anywhere as they are, anchored paths without the
    folders between; None if an anchored path leads elsewhere."""
    if rule.basename:
        return rule
    prefix = f"{below}/"
    return replace(rule, glob=rule.glob.removeprefix(prefix)) if rule.glob.startswith(prefix) else rule if rule.glob.startswith("**/") else None


def global_excludes() -> str | None:
    """The user's own list of ignored files: core.excludesFile of the global configuration, else the default place."""
    home = os.path.expanduser("~")
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    for path in (os.path.join(home, ".gitconfig"), os.path.join(config, "git", "config")):
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                found = re.findall(r"(?im)^\s*excludesfile\s*=\s*\"?([^\"\n]+?)\"?\s*$", f.read())
            if found:
                chosen = os.path.expanduser(found[-1])
                return chosen if os.path.isfile(chosen) else None
    default = os.path.join(config, "git", "ignore")
    return default if os.path.isfile(default) else None


def folders_below(root: str, options: WalkOptions) -> Iterator[tuple[str, list[str], list[str]]]:
    """The folders of a walk; a link that leads back to a folder above it is not followed."""
    device, above = os.stat(root).st_dev, {root: frozenset()}
    for folder, folders, names in os.walk(root, followlinks=options.follow):
        info = os.stat(folder)
        identity, earlier = (info.st_dev, info.st_ino), above.pop(folder)
        if identity in earlier or (options.one_file_system and identity[0] != device):
            folders.clear()
            continue
        above |= {os.path.join(folder, d): earlier | {identity} for d in folders}
        yield folder, folders, names


def listed(root: str, options: WalkOptions) -> list[tuple]:
    out = []
    for folder, folders, names in folders_below(root, options):
        base = os.path.relpath(folder, root)
        depth = 0 if base == "." else base.count(os.sep) + 1
        if options.max_depth is not None and depth + 1 >= options.max_depth:
            inner, folders[:] = list(folders), []
        else:
            inner = list(folders)
        for name in sorted([*inner, *names]):
            full = os.path.join(folder, name)
            path = name if base == "." else f"{base}/{name}".replace(os.sep, "/")
            link = os.path.islink(full)
            if link and not options.follow:
                continue
            info = os.stat(full) if os.path.exists(full) else os.lstat(full)
            hidden = any(p.startswith(".") for p in path.split("/"))
            out.append((path, path.rpartition("/")[0], name, depth + 1, os.path.isdir(full), link, hidden, info.st_size, info.st_mtime, info.st_atime, getattr(info, "st_birthtime", info.st_ctime), full))
    return out


def admitted(entries: DataFrame, options: WalkOptions, rules: list[IgnoreRule]) -> DataFrame:
    """Entries in the order of the admission rules: overrides, ignore rules, types, hidden, depth and size."""
    path = F.col("path")
    chosen = override(path, options.globs, options.globs_ignore_case) if options.globs else F.lit(True)
    chosen = chosen & (override(path, options.iglobs, True) if options.iglobs else F.lit(True))
    whitelisted = F.lit(any(not g.startswith("!") for g in [*options.globs, *options.iglobs])) & chosen
    ok = chosen & (whitelisted | ~(ignored(path, rules, options.ignore_case) if rules else F.lit(False)))
    ok = ok & (whitelisted | options.file_types.admitted(path, options.types) if options.types else F.lit(True))
    ok = ok & (F.lit(options.hidden) | whitelisted | ~F.col("is_hidden"))
    if options.max_depth is not None:
        ok = ok & (F.col("depth") <= options.max_depth)
    if options.min_depth is not None:
        ok = ok & (F.col("depth") >= options.min_depth)
    if options.max_filesize is not None:
        ok = ok & (F.col("size") <= options.max_filesize)
    return entries.filter(ok)


def walk(spark: SparkSession, roots: list[str], options: WalkOptions | None = None) -> DataFrame:
    """The admitted files below all roots, in order of roots; overlapping roots give a file twice."""
    options, out = options or WalkOptions(), None
    for root in roots:
        rows = spark.createDataFrame(listed(root, options), ENTRIES).filter("NOT is_dir")
        rows = admitted(rows, options, rules_of(root, options))
        out = rows if out is None else out.unionByName(rows)
    return out


def sort_entries(entries: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    """By path (siblings by name), or a time; unknown times come last, and first in reverse. Where a file system doesn't keep
    the time of creation, it is that of the last change of the file's entry."""
    times = {"modified": "mtime", "mtime": "mtime", "accessed": "atime", "created": "ctime"}
    if key != "path" and key not in times:
        raise ValueError(f"entries can't be sorted by {key}")
    column = F.split("path", "/") if key == "path" and not reverse else F.col(times.get(key, "path"))
    return entries.orderBy(column.desc_nulls_first() if reverse else column.asc_nulls_last())


_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Labels whose codec has another name in Python.
LABELS = {"latin1": "cp1252", "iso-8859-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "sjis": "cp932", "shift_jis": "cp932", "shift-jis": "cp932", "gbk": "gb18030", "gb2312": "gb18030", "euc-kr": "cp949", "big5": "big5hkscs", "utf-16": "utf-16-le", "windows-31j": "cp932"}


def decode_bytes(data: bytes | None, label: str = "auto") -> str | None:
    """Text of bytes: a byte order mark wins over the label; malformed input becomes U+FFFD."""
    if data is None:
        return None
    for mark, codec in _BOMS:
        if data.startswith(mark) and label != "none":
            return data[len(mark) :].decode(codec, "replace")
    label = label.lower()
    return data.decode("utf-8" if label in ("auto", "none") else LABELS.get(label, label), "replace")


def unpacked(data: bytes) -> bytes:
    """The content of a `.Z` file: LZW codes of 9 to 16 bits, in groups of eight that are padded where the width changes."""
    if data[:2] != b"\x1f\x9d" or len(data) < 3:
        raise ValueError("not a .Z file")
    most, resets = data[2] & 31, bool(data[2] & 128)
    first = 257 if resets else 256
    table: list[bytes] = [bytes([k]) for k in range(256)] + [b""] * (first - 256)
    out, before = [], b""
    at, width, group = 24, 9, 24  # in bits; `group` is where the codes of this width began
    while at + width <= 8 * len(data):
        if len(table) >= 1 << width and width < most:
            at = group + -(-(at - group) // (8 * width)) * 8 * width
            width, group = width + 1, at
            continue
        code = int.from_bytes(data[at // 8 : at // 8 + 4], "little") >> at % 8 & (1 << width) - 1
        at += width
        if code == 256 and resets:
            at = group + -(-(at - group) // (8 * width)) * 8 * width
            del table[first:]
            width, group, before = 9, at, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("a damaged .Z file")
        entry = table[code] if code < len(table) else before + before[:1]
        if before and len(table) < 1 << most:
            table.append(before + entry[:1])
        out.append(entry)
        before = entry
    return b"".join(out)


def decompressed(path: str, data: bytes) -> bytes:
    """Content by suffix; unknown suffixes and damaged files stay as they are."""
    try:
        if path.endswith((".lz4", ".br")):
            return pa.CompressedInputStream(pa.BufferReader(data), "lz4" if path.endswith("4") else "brotli").read()
        if path.endswith(".Z"):
            return unpacked(data)
        if path.endswith((".gz", ".tgz")):
            return gzip.decompress(data)
        if path.endswith((".bz2", ".tbz2")):
            return bz2.decompress(data)
        if path.endswith((".xz", ".txz", ".lzma")):
            return lzma.decompress(data)
        if path.endswith((".zst", ".zstd")):
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except (OSError, EOFError, lzma.LZMAError, zlib.error, ValueError):
        return data
    return data


def decoded(content: Column, label: str = "auto") -> Column:
    """Text of a binary column."""
    bounded_batches(SparkSession.active())

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([decode_bytes(v, label) for v in values.to_pylist()], pa.string())

    return run(content)


def as_utf8(data: bytes, label: str = "auto") -> bytes:
    """The bytes that are searched: those of the file, unless a byte order mark or a label says that they are no UTF-8."""
    marked = next((codec for mark, codec in _BOMS if data.startswith(mark)), None) if label != "none" else None
    return data if marked is None and label.lower() in ("auto", "none", "utf-8", "utf8") else decode_bytes(data, label).encode()


def contents(full_path: str, label: str, search_zip: bool, command: str | None) -> bytes:
    """What is searched of a file, as UTF-8 where its encoding is known."""
    if command:
        done = subprocess.run([command, full_path], capture_output=True, check=False)
        if done.returncode:
            raise ValueError(f"{command} {full_path}: {done.stderr.decode(errors='replace')[:500]}")
        return as_utf8(done.stdout, label)
    with open(full_path, "rb") as f:
        data = f.read()
    return as_utf8(decompressed(full_path, data) if search_zip else data, label)


def read_corpus(spark: SparkSession, entries: DataFrame, label: str = "auto", search_zip: bool = False, command: str | None = None, command_globs: tuple[str, ...] = (), binary: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of the files of `entries` (with `binary` their bytes), and the columns of `keep`. Each file is read where
    its row is processed, and a batch is passed on as soon as it holds `BATCH_BYTES`, one file at least. With a `command`,
    the text of a file (of those that `command_globs` choose, if given) is what the command prints for its path."""
    ship(spark)
    by_command = F.lit(False) if not command else override(F.col("path"), list(command_globs)) if command_globs else F.lit(True)
    names = ["path", *keep]
    rows = entries.select(*names, "full_path", by_command.alias("by_command"))
    schema = StructType([*(entries.schema[c] for c in names), *StructType.fromDDL(f"text {'binary' if binary else 'string'}").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[bytes | str] = []
            first = size = 0
            for k, (path, special) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                data = contents(path, label, search_zip, command if special else None)
                held.append(data if binary else decode_bytes(data))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns[: len(names)], pa.array(held, arrow.field("text").type)], schema=arrow)
                    held, first, size = [], k + 1, 0
            if held:
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns[: len(names)], pa.array(held, arrow.field("text").type)], schema=arrow)

    return rows.mapInArrow(run, schema)


def write_corpus(rows: DataFrame, folder: str) -> int:
    """Write rows of (path, text) as files below a folder that all executors see; their number."""
    top = folder.removeprefix("file://")
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = os.path.join(top, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "wb") as f:
                    f.write(text.encode() if isinstance(text, str) else text or b"")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_store(spark: SparkSession, path: str, label: str = "auto") -> DataFrame:
    """(path, text) of all files below a folder of any store that Spark reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", decoded(F.col("content"), label).alias("text"))


def preprocessed(corpus: DataFrame, function, applies: Column | None = None, text: str = "text") -> DataFrame:
    """`text` run through a user's function from text to text, where `applies` is true."""
    bounded_batches(corpus.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([function(v) for v in values.to_pylist()], pa.string())

    return corpus.withColumn(text, F.when(F.lit(True) if applies is None else applies, run(text)).otherwise(F.col(text)))
