"""Results as lines of text: fields and separators, headings, contexts with a line between groups, colours, links, long lines,
the blocks of multi-line searches.

A file's output is made in its row, over Arrow batches: each line of it is a row with its place (`seq`), so that a file's text
is its rows in that order. With headings the path is the first row of a file and an empty row is the last.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textlode.functions import replacement
from textlode.functions.engines import Engine
from textlode.operators.links import CLOSE, Links
from textlode.operators.search import Search, byte_places, expanded, shown_blocks, shown_lines
from textlode.plans.query import SearchQuery
from textlode.session import bounded_batches

#: Colours by name, in the order of their codes.
COLOURS = ("black", "red", "green", "yellow", "blue", "magenta", "cyan", "white")
#: What is coloured by default.
DEFAULTS = {"path": "35", "line": "32", "column": "", "match": "1;31"}
STYLES = {"bold": "1", "nobold": "22", "intense": "1", "nointense": "22", "underline": "4", "nounderline": "24", "italic": "3", "noitalic": "23"}
#: What is said of a binary file, by how it is searched.
SAID = {
    "quit": 'WARNING: stopped searching binary file after match (found "\\0" byte around offset {})',
    "convert": 'binary file matches (found "\\0" byte around offset {})',
}
BLANKS = "\t\n\x0b\f\r "


def colour_code(value: str, ground: int) -> str:
    """The code of a colour by name, by number, or by its red, green and blue parts."""
    if value in COLOURS:
        return str(ground + COLOURS.index(value))
    parts = value.split(",")
    numbers = [int(p, 16) if p.startswith("0x") else int(p) for p in parts if re.fullmatch("0x[0-9a-fA-F]+|[0-9]+", p)]
    if len(numbers) != len(parts) or len(parts) not in (1, 3) or not all(0 <= n < 256 for n in numbers):
        raise ValueError(f"unknown colour {value!r}")
    return f"{ground + 8};{'5' if len(numbers) == 1 else '2'};" + ";".join(map(str, numbers))


def styles(specs: list[str]) -> dict[str, str]:
    """The codes of path, line, column and match after `type:fg:colour`, `type:bg:colour`, `type:style:name`, `type:none`."""
    parts: dict[str, dict[str, str]] = {k: {"own": v} for k, v in DEFAULTS.items()}
    for spec in specs:
        kind, _, rest = spec.partition(":")
        what, _, value = rest.partition(":")
        if kind not in parts or what not in ("fg", "bg", "style", "none") or (what == "none") == bool(value):
            raise ValueError(f"unknown colour rule {spec!r}")
        if what == "none":
            parts[kind] = {}
        elif what == "style":
            if value not in STYLES:
                raise ValueError(f"unknown style {value!r}")
            parts[kind] |= {value.removeprefix("no"): STYLES[value]}
        else:
            kept = {k: v for k, v in parts[kind].items() if k != "own" or kind == "match" and what == "bg"}
            if kind == "match" and "own" in parts[kind] and what == "fg":
                kept["bold"] = STYLES["bold"]
            parts[kind] = kept | {what: colour_code(value, 30 if what == "fg" else 40)}
    return {k: ";".join(v for v in p.values() if v) for k, p in parts.items()}


@dataclass
class Look:
    """How results look."""

    path: bool = True
    heading: bool = False
    colours: dict[str, str] = field(default_factory=dict)  # none: no colours
    path_end: str = ""  # what follows a path in place of the separator
    path_separator: str = ""
    links: Links | None = None  # only where there are colours

    @classmethod
    def of(cls, query: SearchQuery) -> Look:
        other = query.unknown
        pretty, colour = bool(other.get("pretty")), other.get("color", "")
        if colour not in ("", "never", "auto", "always", "ansi"):
            raise ValueError(f"unknown choice of colour {colour!r}")
        on = colour in ("always", "ansi") or pretty and not colour
        heading = (bool(other.get("heading")) or pretty) and not other.get("no-heading") and query.mode != "vimgrep"
        links = Links.of(str(other.get("hyperlink-format", "")), str(other.get("hostname-bin", "")))
        return cls(query.with_filename, heading, styles(list(other.get("colors", ()))) if on else {}, "\0" if other.get("null") else "", str(other.get("path-separator", "")), links if on else None)

    def painted(self, kind: str, text: str) -> str:
        codes = self.colours.get(kind)
        return "\x1b[0m" + "".join(f"\x1b[{c}m" for c in ([codes] if "5;" in codes or "2;" in codes else codes.split(";"))) + f"{text}\x1b[0m" if codes else text

    def named(self, path: str) -> str:
        return self.painted("path", path.replace("/", self.path_separator) if self.path_separator else path)

    def label(self, path: str) -> str:
        """A path that stands alone."""
        return f"{self.links.opened(path)}{self.named(path)}{CLOSE}" if self.links else self.named(path)


class Printer:
    """The output lines of one file after another."""

    def __init__(self, found: Engine, query: SearchQuery, template: list[str | int] | None, look: Look, view: bool) -> None:
        self.found, self.q, self.template, self.look, self.view = found, query, template, look, view
        self.numbers = query.line_number or query.column or query.mode == "vimgrep" or bool(query.unknown.get("pretty"))
        self.columns = query.column or query.mode == "vimgrep"
        #: Whether a line's matches are known to what prints it, beyond that it has some.
        self.exact = self.columns or template is not None or query.only_matching or bool(look.colours)

    def head(self, path: str, number: int, column: int | None, offset: int, sep: str) -> str:
        """The fields before a line; a link goes from the path to the last of them."""
        q, look = self.q, self.look
        fields, ends = [], []
        if named := look.path and not look.heading:
            fields.append(look.named(path))
            ends.append(look.path_end or sep)
        for on, kind, value in ((self.numbers, "line", number), (self.columns and column is not None, "column", column), (q.byte_offset, "", offset)):
            if on:
                fields.append(look.painted(kind, str(value)))
                ends.append(sep)
        if named and look.links:
            fields[0] = look.links.opened(path, number, column) + fields[0]
            fields[-1] += CLOSE
        return "".join(f + e for f, e in zip(fields, ends, strict=True))

    def body(self, line: str, spans: list[tuple[int, int]], context: bool) -> str:
        """A line with its matches (characters), trimmed and limited in width."""
        q = self.q
        if q.trim:
            cut = len(line) - len(line.lstrip(BLANKS))
            line, spans = line[cut:], [(max(0, a - cut), b - cut) for a, b in spans if b > cut]
        size = len if self.view else lambda t: len(t.encode())
        if q.max_columns and size(line) > q.max_columns:
            exact = self.exact and bool(spans)
            if not q.preview:
                if exact and not q.only_matching:
                    return f"[Omitted long line with {len(spans)} matches]"
                return "[Omitted long context line]" if context else "[Omitted long matching line]"
            kept = line.encode("latin-1" if self.view else "utf-8")[: q.max_columns].decode("latin-1" if self.view else "utf-8", "ignore")
            rest = sum(a >= len(kept) for a, _ in spans)
            said = f" [... {rest} more {'match' if rest == 1 else 'matches'}]" if exact else " [... omitted end of long line]"
            return self.coloured(kept, [(a, min(b, len(kept))) for a, b in spans if a < len(kept)]) + said
        return self.coloured(line, spans)

    def coloured(self, line: str, spans: list[tuple[int, int]]) -> str:
        if not self.look.colours:
            return line
        out, at = [], 0
        for a, b in spans:
            if b > a:
                out += [line[at:a], self.look.painted("match", line[a:b])]
                at = b
        return "".join([*out, line[at:]])

    def replaced(self, line: str, found: list) -> tuple[str, list[tuple[int, int]]]:
        """A line with its matches replaced, and where the replacements are."""
        out, spans, at, size = [], [], 0, 0
        for m in found:
            new = expanded(m, self.template)
            size += m.start() - at
            out += [line[at : m.start()], new]
            spans.append((size, size + len(new)))
            size, at = size + len(new), m.end()
        return "".join([*out, line[at:]]), spans

    def lines(self, path: str, text: str, nul: int = 0, nul_at: int | None = None) -> list[str]:
        """What is printed for a file. Of a binary one (the first NUL is its character `nul`, after `nul_at` bytes), it is the
        lines before that of the NUL; then, if anything matches, why no more follow."""
        shown = text[: text.rfind("\n", 0, nul - 1) + 1] if nul and self.q.binary == "convert" else text
        out = self.blocks(path, shown) if self.q.multiline else self.single_lines(path, shown)
        if nul and self.q.binary in SAID and (out or self.q.binary == "convert") and self.matched(shown if self.q.binary == "quit" else text):
            out.append(f"{self.look.label(path)}: " * self.look.path + SAID[self.q.binary].format(nul_at))
        return [self.look.label(path), *out, ""] if out and self.look.heading and self.look.path else out

    def matched(self, text: str) -> bool:
        q = self.q.where(before=None, after=None, context=0, passthru=False, max_count=1)
        return bool(shown_blocks(self.found, text, q)[2] if q.multiline else shown_lines(self.found, text, q, self.view))

    def blocks(self, path: str, text: str) -> list[str]:
        """The lines of a multi-line search. A replaced block, or match, may have other lines than before: they are numbered
        from its first one on. The column of a line is that of its first match: within the line where colours show it, else
        within the line where the match starts."""
        q, out, last, done = self.q, [], None, None
        lines, starts, rows = shown_blocks(self.found, text, q)
        at, around = byte_places(text, self.view), (q.lines_before or q.lines_after) and not q.passthru
        sep = q.match_separator

        def column(m) -> int:
            return at(m.start()) - at(starts[bisect.bisect_right(starts, m.start()) - 1]) + 1

        for k, kind, group, _, found, block in rows:
            if around and last is not None and group != last and q.context_separator is not None:
                out.append(q.context_separator)
            last = group
            low, line = starts[k], lines[k].removesuffix("\n")
            if kind == "context" or not found:
                out.append(self.head(path, k + 1, None, at(low), sep if kind == "match" else q.context_field_separator) + self.body(line, [], kind == "context"))
                continue
            spans = [(max(0, m.start() - low), min(m.end() - low, len(line))) for m in found]
            new = [m for m in found if m.start() >= low]
            if q.only_matching and self.template is None:
                for a, b in spans:
                    out.append(self.head(path, k + 1, at(low + a) - at(low) + 1, at(low + a), sep) + self.body(line[a:b], [(0, b - a)], False))
            elif q.only_matching:
                for m in new:
                    for n, piece in enumerate(expanded(m, self.template).split("\n")):
                        out.append(self.head(path, k + 1 + n, column(m), at(m.start()), sep) + self.body(piece, [(0, len(piece))], False))
            elif self.template is not None:
                if block is not done:
                    out += self.replaced_block(path, text, starts, lines, block, column(found[0]), at)
                    done = block
            elif q.mode == "vimgrep":
                out += [self.head(path, k + 1, column(m), at(m.start()), sep) + self.body(line, spans, False) for m in new]
            else:
                where = at(low + spans[0][0]) - at(low) + 1 if self.look.colours else column(found[0])
                out.append(self.head(path, k + 1, where, at(low), sep) + self.body(line, spans, False))
        return out

    def replaced_block(self, path: str, text: str, starts: list[int], lines: list[str], block: tuple, column: int, at) -> list[str]:
        """The lines of a block with its matches replaced."""
        first, last, found = block
        low, high = starts[first], starts[last] + len(lines[last])
        body, spans, seen, size = [], [], low, 0
        for m in found:
            new = expanded(m, self.template)
            body += [text[seen : m.start()], new]
            size += m.start() - seen
            spans.append((size, size + len(new)))
            size, seen = size + len(new), m.end()
        shown = "".join([*body, text[seen:high]]).removesuffix("\n")
        out, start, offset, k = [], 0, at(low), 0
        for n, line in enumerate(shown.split("\n")):
            own = []
            while k < len(spans) and spans[k][0] <= start + len(line):
                own.append((max(0, spans[k][0] - start), min(spans[k][1] - start, len(line))))
                if spans[k][1] > start + len(line):
                    break  # it goes on in the next line
                k += 1
            out.append(self.head(path, first + 1 + n, column, offset, self.q.match_separator) + self.body(line, own, False))
            start += len(line) + 1
            offset += (len(line) if self.view else len(line.encode(errors="surrogateescape"))) + 1
        return out

    def single_lines(self, path: str, text: str) -> list[str]:
        q, out, last = self.q, [], None
        for number, offset, line, kind, found, group in shown_lines(self.found, text, q, self.view):
            if last is not None and group != last and q.context_separator is not None:
                out.append(q.context_separator)
            last = group
            if kind == "context" or not found:
                out.append(self.head(path, number, None, offset, q.match_separator if kind == "match" else q.context_field_separator) + self.body(line, [], kind == "context"))
                continue
            at = byte_places(line, self.view)
            if q.only_matching:
                for m in found:
                    said = m[0] if self.template is None else expanded(m, self.template)
                    out.append(self.head(path, number, at(m.start()) + 1, offset + at(m.start()), q.match_separator) + self.body(said, [(0, len(said))], False))
                continue
            shown, spans = (line, [m.span() for m in found]) if self.template is None else self.replaced(line, found)
            for m in found if q.mode == "vimgrep" else found[:1]:
                out.append(self.head(path, number, at(m.start()) + 1, offset + (at(m.start()) if q.mode == "vimgrep" else 0), q.match_separator) + self.body(shown, spans, False))
        return out


def printed(search: Search) -> DataFrame:
    """(keys, seq, output): the lines that a command prints for each file; of lists and counts one line a file."""
    q, look = search.query, Look.of(search.query)
    path = F.concat_ws("/", *(F.col(k).cast("string") for k in search.keys))
    if q.mode in ("count", "count_matches", "files_with_matches", "files_without_match"):
        from textlode.plans.run import searched

        rows = searched(search)
        name = F.replace(path, F.lit("/"), F.lit(look.path_separator)) if look.path_separator else path
        shown = F.concat(F.lit(look.painted("path", "\1").split("\1")[0]), name, F.lit(look.painted("path", "\1").split("\1")[1]))
        if look.links:

            @F.arrow_udf("string")
            def linked(names: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for batch in names:
                    yield pa.array([look.label(n) for n in batch.to_pylist()], pa.string())

            shown = linked(path)
        if q.mode.startswith("count"):
            output = F.concat(shown, F.lit(look.path_end or q.match_separator), F.col("n").cast("string")) if look.path else F.col("n").cast("string")
        else:
            output = F.concat(shown, F.lit(look.path_end))
        return rows.select(*search.keys, F.lit(0).alias("seq"), output.alias("output"))
    if q.mode not in ("standard", "vimgrep"):
        raise ValueError("other modes have no text output")
    schema = StructType([*(search.df.schema[k] for k in search.keys), *StructType.fromDDL("seq int, output string").fields])
    arrow, n, pattern, view = to_arrow_schema(schema), len(search.keys), search.pattern, search.of_bytes
    template = replacement.parts(q.replacement, pattern) if q.replacement is not None and not q.invert else None
    bounded_batches(search.df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(Engine(pattern), q, template, look, view)
        for batch in batches:
            names = ["/".join(str(v) for v in row if v is not None) for row in zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True)]
            at, seq, lines = [], [], []
            for k, (text, *nul) in enumerate(zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True)):
                own = printer.lines(names[k], text, *nul) if text or any(nul) else []
                at += [k] * len(own)
                seq += range(len(own))
                lines += own
            yield pa.RecordBatch.from_arrays([*batch.select(range(n)).take(pa.array(at, pa.int64())).columns, pa.array(seq, pa.int32()), pa.array(lines, pa.string())], schema=arrow)

    return search.files(not (q.invert or q.passthru), nul=not q.null_data).mapInArrow(run, schema)
