"""The search query: what to look for and what to return. The counterpart of a command line."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from textlode.functions.dialect import BytesNeeded, Compiled, Flags, compile_patterns


@dataclass(frozen=True)
class SearchQuery:
    """Options of a search; every default is that of a plain line search."""

    patterns: tuple[str, ...] = ()
    fixed: bool = False
    case: str = "sensitive"  # sensitive, insensitive, smart
    word: bool = False
    line: bool = False
    invert: bool = False
    unicode: bool = True
    crlf: bool = False
    null_data: bool = False
    multiline: bool = False
    dotall: bool = False
    engine: str = "default"  # default, auto, pcre2
    before: int | None = None
    after: int | None = None
    context: int = 0
    passthru: bool = False
    max_count: int | None = None
    stop_on_nonmatch: bool = False
    only_matching: bool = False
    replacement: str | None = None
    include_zero: bool = False
    binary: str = "quit"  # quit, convert, text
    trim: bool = False
    max_columns: int | None = None
    preview: bool = False
    line_number: bool = False
    column: bool = False
    byte_offset: bool = False
    with_filename: bool = True
    match_separator: str = ":"
    context_field_separator: str = "-"
    context_separator: str | None = "--"
    globs: tuple[str, ...] = ()
    iglobs: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    types_not: tuple[str, ...] = ()
    mode: str = "standard"  # standard, count, count_matches, files_with_matches, files_without_match, json, files, quiet, vimgrep, type_list
    sort: str = "none"
    sort_reverse: bool = False
    unknown: dict = field(default_factory=dict)

    @property
    def lines_before(self) -> int:
        return self.context if self.before is None else self.before

    @property
    def lines_after(self) -> int:
        return self.context if self.after is None else self.after

    @property
    def terminator(self) -> str:
        return "\0" if self.null_data else "\n"

    def compiled(self, of_bytes: bool = False) -> Compiled:
        """The pattern for texts, or for the Latin-1 view of bytes."""
        flags = Flags(unicode=self.unicode, dot_all=self.dotall and self.multiline, crlf=self.crlf)
        options = dict(fixed=self.fixed, case=self.case, word=self.word, line=self.line, flags=flags, whole_buffer=self.multiline, of_bytes=of_bytes, terminator=self.terminator)
        if self.engine == "auto":
            try:
                return compile_patterns(list(self.patterns), **options)
            except BytesNeeded:
                raise
            except ValueError as first:
                try:
                    return compile_patterns(list(self.patterns), **options, look_around=True)
                except ValueError as second:
                    raise ValueError(f"neither engine takes the pattern; default: {first}; pcre2: {second}") from None
        return compile_patterns(list(self.patterns), **options, look_around=self.engine == "pcre2")

    def where(self, **changes) -> SearchQuery:
        return replace(self, **changes)
