"""Run a parsed argument list: walk or filter the files, search them, and return what the mode asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode import __version__
from textlode.functions.dialect import BytesNeeded
from textlode.functions.filetypes import FileTypes
from textlode.functions.globs import override
from textlode.operators.render import printed
from textlode.operators.search import Search
from textlode.plans.flags import config_args, parse, usage
from textlode.plans.query import SearchQuery
from textlode.sources.files import WalkOptions, byte_size, read_corpus, sort_entries, walk


def file_types(query: SearchQuery) -> FileTypes:
    out = FileTypes()
    for name in query.unknown.get("type-clear", ()):
        out = out.clear(name)
    for rule in query.unknown.get("type-add", ()):
        out = out.add(rule)
    return out


def walk_options(query: SearchQuery) -> WalkOptions:
    """The flags that choose files."""
    other = query.unknown
    unrestricted = int(other.get("unrestricted", 0))
    on = lambda name: bool(other.get(name, False))
    return WalkOptions(
        hidden=on("hidden") or unrestricted >= 2,
        follow=on("follow"),
        max_depth=int(other["max-depth"]) if "max-depth" in other else None,
        max_filesize=byte_size(other["max-filesize"]) if "max-filesize" in other else None,
        one_file_system=on("one-file-system"),
        ignore=not on("no-ignore") and unrestricted < 1,
        ignore_dot=not on("no-ignore-dot"),
        ignore_vcs=not on("no-ignore-vcs"),
        ignore_exclude=not on("no-ignore-exclude"),
        ignore_parent=not on("no-ignore-parent"),
        ignore_global=not on("no-ignore-global"),
        require_git=not on("no-require-git"),
        ignore_files=[] if on("no-ignore-files") else list(other.get("ignore-file", ())),
        ignore_case=on("ignore-file-case-insensitive"),
        globs=list(query.globs),
        iglobs=list(query.iglobs),
        globs_ignore_case=on("glob-case-insensitive"),
        types=[*((t, True) for t in query.types), *((t, False) for t in query.types_not)],
        file_types=file_types(query),
    )


def searched(search: Search) -> DataFrame:
    """What the query's mode returns."""
    q = search.query
    if q.mode == "count" and not q.multiline:
        return search.count_matches() if q.only_matching and not q.invert else search.count_lines()
    if q.mode in ("count", "count_matches"):
        return search.count_multiline() if q.multiline else search.count_matches()
    if q.mode in ("files_with_matches", "files_without_match", "quiet"):
        return {"files_with_matches": search.files_with_matches, "files_without_match": search.files_without_match, "quiet": search.quiet}[q.mode]()
    if q.mode == "json":
        return search.json_messages()
    if q.mode == "vimgrep":
        return search.vimgrep()
    if (q.lines_before or q.lines_after or q.passthru) and not q.multiline:
        return search.context()  # with matches or replacements in place of matching lines, if the query asks for them
    if q.only_matching:
        if q.multiline:
            return search.multiline()
        return search.replaced_matches() if q.replacement is not None else search.only_matching()
    if q.replacement is not None:
        return search.multiline_replaced() if q.multiline else search.replaced()
    if q.lines_before or q.lines_after or q.passthru:
        return search.context()
    return search.lines()


def print_rows(rows: DataFrame, args: list[str], keys: tuple[str, ...] = ("path",), text: str = "text", path: str = "path") -> DataFrame:
    """What a command over a table of files prints, as (keys, seq, output)."""
    query, _ = parse(args)
    return printed(Search(admitted_rows(rows, query, path) if path in rows.columns else rows, query, keys, text))


def run_rows(rows: DataFrame, args: list[str], keys: tuple[str, ...] = ("path",), text: str = "text", path: str = "path") -> DataFrame:
    """A command over a table of files: globs and types choose among its paths, if it has any."""
    query, _ = parse(args)
    if path in rows.columns:
        rows = admitted_rows(rows, query, path)
    if query.mode == "files":
        return rows.select(path)
    out = searched(Search(rows, query, keys, text))
    return sorted_by(out, query, path)


def admitted_rows(rows: DataFrame, query: SearchQuery, path: str) -> DataFrame:
    options, column = walk_options(query), F.col(path)
    if options.globs:
        rows = rows.filter(override(column, options.globs, options.globs_ignore_case))
    if options.iglobs:
        rows = rows.filter(override(column, options.iglobs, True))
    if options.types:
        rows = rows.filter(options.file_types.admitted(column, options.types))
    return rows


def sorted_by(out: DataFrame, query: SearchQuery, path: str) -> DataFrame:
    if query.sort != "path" or path not in out.columns:
        return out
    key = F.col(path).desc() if query.sort_reverse else F.split(path, "/").asc()
    return out.orderBy(key, *(c for c in ("line_number", "match_index", "seq") if c in out.columns))


def run(spark: SparkSession, args: list[str], text: bool = False, config: str | None = None) -> DataFrame:
    """A command over folders: walk, read, search. Without a path, the working folder is searched. With `text` the result is
    what the command prints, as (path, seq, output). The arguments in the file `config`, if given, come before the others,
    unless these say --no-config."""
    if config and "--no-config" not in args:
        with open(config, encoding="utf-8") as f:
            args = [*config_args(f.read()), *args]
    query, paths = parse(args)
    if query.mode in ("help", "version", "pcre2_version"):
        import regex

        said = {"help": usage, "version": lambda: f"textlode {__version__} (Spark {spark.version})", "pcre2_version": lambda: f"backtracking patterns: Java {spark.sparkContext._jvm.System.getProperty('java.version')}, regex {regex.__version__}"}
        return spark.createDataFrame([(said[query.mode](),)], "output string")
    if query.mode == "type_list":
        return file_types(query).frame(spark)
    entries = walk(spark, paths or ["."], walk_options(query))
    if query.mode == "files":
        return sort_entries(entries, query.sort, query.sort_reverse).select("path") if query.sort != "none" else entries.select("path")
    times = {"modified": "mtime", "mtime": "mtime", "accessed": "atime", "created": "ctime"}
    keep = (times[query.sort],) if query.sort in times else ()
    corpus = read_corpus(spark, entries, str(query.unknown.get("encoding", "auto")), bool(query.unknown.get("search-zip", False)), query.unknown.get("pre") or None, tuple(query.unknown.get("pre-glob", ())), needs_bytes(query), keep)
    search = Search(corpus, query, ("path", *keep))
    if query.unknown.get("stats"):
        return search.stats()
    out = printed(search) if text and query.mode not in ("json", "quiet") else searched(search)
    if keep and keep[0] in out.columns:  # results in the order of their files' times, which are not part of them
        at = F.col(keep[0])
        out = out.orderBy(at.desc_nulls_first() if query.sort_reverse else at.asc_nulls_last(), "path", *(c for c in ("line_number", "match_index", "seq") if c in out.columns)).drop(*keep)
    return sorted_by(out, query, "path")


def needs_bytes(query: SearchQuery) -> bool:
    """Whether the bytes of files are searched: for a pattern that asks for bytes, and for JSON, which shows them."""
    if query.mode == "json":
        return True
    try:
        query.compiled()
    except BytesNeeded:
        return True
    return False
