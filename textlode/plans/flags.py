"""Command-line style options to a SearchQuery: long and short flags, clusters, `--flag=value`, negations; the last one wins."""

from __future__ import annotations

from textlode.plans.query import SearchQuery
from textlode.sources.files import byte_size

#: Flag, short form, query field, value that it sets (None: takes a value).
SWITCHES = [
    ("fixed-strings", "F", "fixed", True), ("ignore-case", "i", "case", "insensitive"), ("case-sensitive", "s", "case", "sensitive"), ("smart-case", "S", "case", "smart"),
    ("invert-match", "v", "invert", True), ("unicode", "", "unicode", True), ("passthru", "", "passthru", True), ("passthrough", "", "passthru", True), ("stop-on-nonmatch", "", "stop_on_nonmatch", True),
    ("only-matching", "o", "only_matching", True), ("include-zero", "", "include_zero", True), ("trim", "", "trim", True), ("max-columns-preview", "", "preview", True),
    ("line-number", "n", "line_number", True), ("no-line-number", "N", "line_number", False), ("column", "", "column", True), ("byte-offset", "b", "byte_offset", True),
    ("with-filename", "H", "with_filename", True), ("no-filename", "I", "with_filename", False), ("count", "c", "mode", "count"), ("count-matches", "", "mode", "count_matches"),
    ("files-with-matches", "l", "mode", "files_with_matches"), ("files-without-match", "", "mode", "files_without_match"), ("json", "", "mode", "json"), ("files", "", "mode", "files"),
    ("quiet", "q", "mode", "quiet"), ("vimgrep", "", "mode", "vimgrep"), ("text", "a", "binary", "text"), ("binary", "", "binary", "convert"), ("multiline-dotall", "", "dotall", True),
    ("type-list", "", "mode", "type_list"), ("pcre2", "P", "engine", "pcre2"), ("auto-hybrid-regex", "", "engine", "auto"), ("sort-files", "", "sort", "path"),
    ("help", "h", "mode", "help"), ("version", "V", "mode", "version"), ("pcre2-version", "", "mode", "pcre2_version"),
]
VALUES = {
    "after-context": ("A", "after", int), "before-context": ("B", "before", int), "max-count": ("m", "max_count", int), "max-columns": ("M", "max_columns", int), "replace": ("r", "replacement", str),
    "field-match-separator": ("", "match_separator", str), "field-context-separator": ("", "context_field_separator", str), "context-separator": ("", "context_separator", str), "engine": ("", "engine", str),
}
#: Options of the walk and of reading, which `plans.run` gives to them; `no-` before one is kept as it is given.
WALK = {"one-file-system", "follow", "hidden", "ignore", "ignore-dot", "ignore-exclude", "ignore-files", "ignore-global", "ignore-parent", "ignore-vcs", "require-git", "search-zip", "glob-case-insensitive", "ignore-file-case-insensitive", "stats"}
WALK_VALUES = {"max-depth", "max-filesize", "encoding", "pre"}
WALK_LISTS = {"ignore-file", "type-add", "type-clear", "pre-glob", "colors"}
#: Options that change no search: `operators.render` reads those of output; scheduling and diagnostics belong to Spark or to the caller.
IGNORED = {"block-buffered", "line-buffered", "debug", "trace", "messages", "ignore-messages", "mmap", "no-config", "heading", "pretty", "null", "pcre2-unicode", *WALK}
IGNORED_VALUES = {"color", "threads", "hostname-bin", "hyperlink-format", "path-separator", "generate", *WALK_VALUES, *WALK_LISTS}
#: Sizes that are checked and then change nothing: the engines here have no such limits.
SIZES = {"dfa-size-limit", "regex-size-limit"}
IGNORED_SHORT = {"p": "pretty", "0": "null", "L": "follow", ".": "hidden", "z": "search-zip", "u": "unrestricted"}
SHORT_VALUES = {"j": "threads", "d": "max-depth", "E": "encoding"}


#: Modes that search nothing.
NO_PATTERN = {"files", "type_list", "help", "version", "pcre2_version"}


def usage() -> str:
    """The flags by name, with their short forms."""
    named = [(n, s) for n, s, _, _ in SWITCHES] + [(n, v[0]) for n, v in VALUES.items()]
    takes = {*VALUES, *WALK_VALUES, *WALK_LISTS}
    rest = [(n, "") for n in sorted((WALK | WALK_VALUES | WALK_LISTS | IGNORED | IGNORED_VALUES) - {n for n, _ in named})]
    return "\n".join(["usage: [flags] pattern [paths]", *(f"  {f'-{s}, ' if s else '    '}--{n}{' VALUE' if n in takes else ''}" for n, s in sorted([*named, *rest]))])


def config_args(text: str) -> list[str]:
    """The arguments of a configuration file: one a line, without blank lines and lines that start with #."""
    lines = (line.strip() for line in text.split("\n"))
    return [line for line in lines if line and not line.startswith("#")]


def parse(args: list[str]) -> tuple[SearchQuery, list[str]]:
    """The query and the paths of an argument list. Unknown flags and bad values raise ValueError."""
    short = {s: name for name, s, _, _ in SWITCHES if s} | {v[0]: name for name, v in VALUES.items() if v[0]} | {"e": "regexp", "C": "context", "g": "glob", "t": "type", "T": "type-not", "w": "word-regexp", "x": "line-regexp", "U": "multiline", "f": "file"} | IGNORED_SHORT | SHORT_VALUES
    switches = {name: (field, value) for name, _, field, value in SWITCHES}
    set_to: dict = {}
    lists: dict[str, list[str]] = {"patterns": [], "globs": [], "iglobs": [], "types": [], "types_not": []}
    plain: list[str] = []
    other: dict[str, object] = {}
    takes = {"regexp", "context", "glob", "iglob", "type", "type-not", "sort", "sortr", "file", *VALUES, *IGNORED_VALUES, *SIZES}
    queue = list(args)

    def apply(name: str, value: str | None) -> None:
        negative = name.startswith("no-") and name not in switches and name not in IGNORED
        key = name[3:] if negative else name
        if key in switches and negative:
            field, on = switches[key]
            set_to[field] = (not on) if isinstance(on, bool) else {"case": "sensitive", "mode": "standard", "binary": "quit", "engine": "default", "sort": "none"}[field]
        elif name in switches:
            field, on = switches[name]
            set_to[field] = on
            if name == "passthru":
                set_to.update(before=None, after=None, context=0)
        elif name in ("word-regexp", "line-regexp"):
            set_to.update(word=name[0] == "w", line=name[0] == "l")
        elif key == "multiline":
            set_to["multiline"] = not negative
            if not negative:
                set_to["stop_on_nonmatch"] = False
        elif key in ("crlf", "null-data"):
            set_to.update(crlf=key == "crlf" and not negative, null_data=key == "null-data" and not negative)
        elif name == "unrestricted":
            other[name] = int(other.get(name, 0)) + 1
            if other[name] > 3:
                raise ValueError("-u can be given three times at most")
            if other[name] == 3:
                set_to["binary"] = "convert"
        elif name in VALUES:
            _, field, kind = VALUES[name]
            set_to[field] = kind(value)
            if name.endswith("-context"):
                set_to["passthru"] = False
        elif name == "context":
            set_to.update(context=int(value), passthru=False)
        elif name == "regexp":
            lists["patterns"].append(value)
        elif name == "file":
            with open(value, encoding="utf-8") as f:
                lists["patterns"] += [line.rstrip("\r") for line in f.read().removesuffix("\n").split("\n")]
        elif name in ("glob", "iglob"):
            lists[f"{name}s"].append(value)
        elif name in ("type", "type-not"):
            lists["types" if name == "type" else "types_not"].append(value)
        elif name in ("sort", "sortr"):
            set_to.update(sort=value, sort_reverse=name == "sortr")
        elif negative and key == "context-separator":
            set_to["context_separator"] = None
        elif name in SIZES:
            byte_size(value)
        elif name in WALK_LISTS:
            other[name] = [*other.get(name, ()), value]
        elif key in WALK:
            other.pop(key if negative else f"no-{key}", None)  # the last one wins
            other[name] = True
        elif key in IGNORED or key in IGNORED_VALUES:
            other[name] = value if value is not None else True
        else:
            raise ValueError(f"unknown flag --{name}")

    while queue:
        arg = queue.pop(0)
        if arg == "--":
            plain += queue
            break
        if arg.startswith("--"):
            name, eq, value = arg[2:].partition("=")
            if name in takes and not eq:
                if not queue:
                    raise ValueError(f"--{name} needs a value")
                value = queue.pop(0)
            apply(name, value if name in takes else None)
        elif arg.startswith("-") and len(arg) > 1:
            body = arg[1:]
            while body:
                name = short.get(body[0])
                if name is None:
                    raise ValueError(f"unknown flag -{body[0]}")
                body = body[1:]
                if name in takes:
                    value, body = body.removeprefix("="), ""
                    if not value:
                        if not queue:
                            raise ValueError(f"--{name} needs a value")
                        value = queue.pop(0)
                    apply(name, value)
                else:
                    apply(name, None)
        else:
            plain.append(arg)
    if not lists["patterns"] and set_to.get("mode") not in NO_PATTERN:
        if not plain:
            raise ValueError("no pattern")
        lists["patterns"].append(plain.pop(0))
    return SearchQuery(**set_to, **{k: tuple(v) for k, v in lists.items()}, unknown=other), plain
