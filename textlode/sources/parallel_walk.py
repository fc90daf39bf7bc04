"""A walk whose folders are listed by the executors: the frontier of folders is a table, and each round lists it.

A row of the frontier carries what its folder takes over from the one above: the ignore rules so far, whether it lies in a
repository, whether it is ignored or hidden itself, and the identities of the folders above it, so that a link back to one of
them ends there. Listing it gives its entries; those that are folders to go into are the next frontier, and the walk ends
with an empty one. Rounds are as many as the tree is deep. A visitor sees each admitted entry where it is found and may skip
a folder or quit: then the round that is running is the last one.

Rows: overlapping roots give a file twice; a folder that can't be read has no entries; names that are no UTF-8 are left out,
as no string column can hold them.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import astuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textlode.functions.globs import GlobOptions, hits, overridden
from textlode.functions.ignore import IgnoreRule, decided, parse_rules, ranked
from textlode.session import drop_path, materialise, ship, workspace
from textlode.sources.files import ENTRIES, IGNORE_FILES, WalkOptions, _in_repository, _repository, exclude_file, outer_rules

RULE = "struct<glob:string,base:string,include:boolean,dir_only:boolean,basename:boolean,source:string>"
FOLDER = f"root string, folder string, full string, level int, rules array<{RULE}>, in_git boolean, ignored boolean, above array<string>, device long"
FOUND = f"{ENTRIES}, {FOLDER}, admitted boolean, enter boolean, quit boolean"
#: What a visitor answers.
CONTINUE, SKIP, QUIT = "continue", "skip", "quit"
Visitor = Callable[[dict], str]


def own_rules(folder: dict, names: set[str], options: WalkOptions) -> list[IgnoreRule]:
    """The rules of the rule files in a folder, and of the exclude file of a repository that begins there."""
    out: list[IgnoreRule] = []
    if not options.ignore:
        return out
    for name in sorted(names & IGNORE_FILES.keys()):
        source = IGNORE_FILES[name]
        if (options.ignore_vcs and folder["in_git"]) if source == "gitignore" else options.ignore_dot:
            with open(os.path.join(folder["full"], name), encoding="utf-8", errors="replace") as f:
                out += parse_rules(f.read(), folder["folder"], source)
    if options.ignore_exclude and folder["in_git"] and (path := exclude_file(folder["full"])):
        with open(path, encoding="utf-8", errors="replace") as f:
            out += parse_rules(f.read(), folder["folder"], "exclude")
    return out


def typed(path: str, options: WalkOptions) -> bool:
    """Whether the chosen file types admit a path: the last pattern that matches decides."""
    out = not any(selected for _, selected in options.types)
    for name, selected in options.types:
        if any(hits(path, g, GlobOptions(basename=True)) for g in options.file_types.of(name)):
            out = selected
    return out


def listed_folder(folder: dict, options: WalkOptions, visitor: Visitor | None) -> Iterator[dict]:
    """The entries of a folder, with what those that are folders hand on."""
    try:
        found = sorted(os.scandir(folder["full"]), key=lambda e: e.name)
    except OSError:
        return
    folder = folder | {"in_git": folder["in_git"] or _repository(folder["full"])}
    rules = [IgnoreRule(**r) for r in folder["rules"]] + own_rules(folder, {e.name for e in found}, options)
    strongest = ranked(rules)[::-1]
    including = any(not g.startswith("!") for g in [*options.globs, *options.iglobs])
    handed = [dict(zip(("glob", "base", "include", "dir_only", "basename", "source"), astuple(r), strict=True)) for r in rules]
    for entry in found:
        if not entry.name.isprintable() and entry.name != entry.name.encode("utf-8", "ignore").decode():
            continue
        link = entry.is_symlink()
        if link and not options.follow:
            continue
        try:
            info = entry.stat()
        except OSError:
            info = entry.stat(follow_symlinks=False)
        path = f"{folder['folder']}/{entry.name}" if folder["folder"] else entry.name
        is_dir, depth = entry.is_dir(), folder["level"] + 1
        hidden = any(p.startswith(".") for p in path.split("/"))
        said = decided(path, is_dir, strongest, options.ignore_case)
        ignored = folder["ignored"] or said == "ignore"
        identity = f"{info.st_dev}:{info.st_ino}"
        row = {"path": path, "parent": folder["folder"], "file_name": entry.name, "depth": depth, "is_dir": is_dir, "is_symlink": link, "is_hidden": hidden, "size": info.st_size, "mtime": info.st_mtime, "atime": info.st_atime, "ctime": getattr(info, "st_birthtime", info.st_ctime), "full_path": entry.path}
        row |= {"root": folder["root"], "folder": path, "full": entry.path, "level": depth, "rules": handed if is_dir else [], "in_git": folder["in_git"], "ignored": ignored, "above": [*folder["above"], identity] if is_dir else [], "device": folder["device"]}
        chosen = (not options.globs or overridden(path, tuple(options.globs), options.globs_ignore_case)) and (not options.iglobs or overridden(path, tuple(options.iglobs), True))
        listed = including and chosen  # a glob that includes a file is stronger than rules, types and hiding
        if is_dir:
            enter = (including or not ignored and (options.hidden or not hidden)) and identity not in folder["above"]
            enter = enter and (options.max_depth is None or depth < options.max_depth) and not (options.one_file_system and info.st_dev != folder["device"])
            admitted = enter
        else:
            enter = False
            admitted = chosen and (listed or not ignored) and (listed or not options.types or typed(path, options)) and (options.hidden or listed or not hidden)
            admitted = admitted and (options.max_depth is None or depth <= options.max_depth) and (options.min_depth is None or depth >= options.min_depth) and (options.max_filesize is None or info.st_size <= options.max_filesize)
        answer = visitor({c: row[c] for c in ("path", "depth", "is_dir", "is_symlink", "size", "full_path")}) if visitor and admitted else CONTINUE
        yield row | {"admitted": admitted, "enter": enter and answer == CONTINUE, "quit": answer == QUIT}


def first_folders(roots: list[str], options: WalkOptions) -> list[tuple]:
    """The frontier that a walk begins with."""
    out = []
    for root in roots:
        info = os.stat(root)
        rules = [astuple(r) for r in outer_rules(root, options)] if options.ignore else []
        in_git = not options.require_git or (_in_repository(os.path.abspath(root)) if options.ignore_parent else _repository(root))
        out.append((root, "", root, 0, rules, in_git, False, [f"{info.st_dev}:{info.st_ino}"], info.st_dev))
    return out


def walk_parallel(spark: SparkSession, roots: list[str], options: WalkOptions | None = None, visitor: Visitor | None = None, folders: bool = False) -> DataFrame:
    """The admitted files below all roots, as `sources.files.walk` gives them; with `folders` also the folders gone into. The
    folders must be visible to all executors."""
    options = options or WalkOptions()
    ship(spark)
    schema = StructType.fromDDL(FOUND)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.to_pylist():
                rows = list(listed_folder(folder, options, visitor))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    place = workspace(spark, "walk")
    frontier, rounds = spark.createDataFrame(first_folders(roots, options), FOLDER), []
    tasks = 4 * spark.sparkContext.defaultParallelism
    while True:
        path = f"{place}/{len(rounds)}"
        found = materialise(frontier.repartition(tasks).mapInArrow(run, schema), path)
        rounds.append(path)
        if found.filter("quit").head(1) or not found.filter("enter").head(1):
            break
        frontier = found.filter("enter").select(*StructType.fromDDL(FOLDER).names)
    every = spark.read.schema(schema).parquet(*rounds).filter("admitted" if folders else "admitted AND NOT is_dir")
    out = materialise(every.select(*StructType.fromDDL(ENTRIES).names), f"{place}/files")
    for path in rounds:
        drop_path(spark, path)
    return out




__all__ = ["CONTINUE", "QUIT", "SKIP", "walk_parallel"]
