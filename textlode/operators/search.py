"""Search operators over a corpus: one row a file, with key columns and its text.

All lines of a file are in its row: limits, context, offsets and counts are array expressions there, and only what is
selected leaves the row, so that no search shuffles and files with equal or null keys stay apart. Patterns that can match
nothing, multi-line searches and absent groups have rules that built-in functions don't know: those run over Arrow batches
of bounded bytes. Before lines are cut, a text that can't hold a match is dropped by the strings that every match needs,
and that test reaches the Parquet reader.
"""

from __future__ import annotations

import base64
import bisect
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from textlode.functions import replacement
from textlode.functions.dialect import Compiled
from textlode.functions.engines import Engine
from textlode.operators.patterns import contains_any
from textlode.operators.rows import any_of, let, running, total
from textlode.plans.query import SearchQuery
from textlode.session import bounded_batches

#: Strings up to which a prefilter is an expression; more are looked for by an automaton.
EXPRESSION_LITERALS = 256
LEADING = r"^[\t\n\x0B\f\r ]+"


class Search:
    """A query over `df`; `keys` name a file, `text` its text. Where that column is binary, bytes are searched: each is a
    character of a Latin-1 view, lines and matches come back in that view, and `to_bytes` gives them as they were."""

    def __init__(self, df: DataFrame, query: SearchQuery, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> None:
        self.df, self.query, self.keys, self.text = df, query, list(keys), text
        self.of_bytes = isinstance(df.schema[text].dataType, BinaryType)
        if self.of_bytes and query.replacement:
            self.query = query.where(replacement=query.replacement.encode().decode("latin-1"))
        self.pattern: Compiled = query.compiled(self.of_bytes)

        #: Whether matches are found over Arrow batches: rules for empty ones, and patterns that aren't for Java's engine.
        self.outside = self.pattern.can_be_empty or self.pattern.outside

    def size_of(self, text: Column) -> Column:
        """Bytes of a text; of a view, its characters."""
        return F.char_length(text) if self.of_bytes else F.octet_length(text)

    @staticmethod
    def to_bytes(text: Column) -> Column:
        """The bytes of what a search of bytes returns."""
        return F.encode(text, "ISO-8859-1")

    def _needs(self, what: str, *fields: str) -> None:
        """Refuse options that `what` would leave out of account."""
        given = [f for f in fields if (value := getattr(self.query, f)) not in (None, False, 0) or value == 0 and f == "max_count"]
        if given:
            raise ValueError(f"{what} can't be combined with {', '.join(given)}")

    # What may match at all.
    def possible(self, text: Column) -> Column:
        """True for every text with a match; a cheap test for most others."""
        found = self.pattern.literals
        if not found or any(set(p) & {"\n", "\0"} for p in found) or "" in found:
            return F.lit(True)
        if len(found) > EXPRESSION_LITERALS:
            bounded_batches(self.df.sparkSession)
            return contains_any(text, found)
        return any_of([F.contains(text, F.lit(p)) for p in found])

    def hit(self, line: Column) -> Column:
        few = len(self.pattern.literals or ()) <= 8  # more cost as much as the pattern itself on one line
        return self.possible(line) & line.rlike(self.pattern.java) if few else line.rlike(self.pattern.java)

    def selected(self, line: Column) -> Column:
        return ~self.hit(line) if self.query.invert else self.hit(line)

    def files(self, prune: bool = False, whole: bool = False, nul: bool = False) -> DataFrame:
        """Files whose text is searched: binary ones (with a NUL) are cut before the line of the first one or converted, as the
        query says. `prune` leaves out files that can't match, by a test on the column as it is stored; `whole` leaves
        out files that would be cut; `nul` adds where the first NUL is: its character from 1 on (0: none), and the bytes before."""
        q = self.query
        text = F.decode(F.col(self.text), "ISO-8859-1") if self.of_bytes else F.col(self.text)
        stored = self.df.filter(self.possible(text)) if prune else self.df
        if q.max_count == 0:  # nothing is searched
            stored = stored.filter(F.lit(False))
        at = F.instr(text, "\0")
        where = [F.coalesce(at, F.lit(0)).cast("int").alias("_nul"), F.when(at > 0, self.size_of(F.substring(text, F.lit(1), at - 1))).cast("long").alias("_nul_at")] if nul else []
        if q.binary == "quit" and not q.null_data:
            if whole:
                stored = stored.filter(F.coalesce(at == 0, F.lit(True)))
            else:
                text = F.when(at > 0, F.regexp_extract(F.substring(text, F.lit(1), at - 1), r"(?s)\A(.*\n)?", 0)).otherwise(text)
        elif q.binary == "convert" and not q.null_data:
            text = F.translate(text, "\0", "\n")
        return stored.select(*self.keys, text.alias("_text"), *where)

    def raw_lines(self, text: Column) -> Column:
        """The records of a text with a carriage return that ends them: no empty one after the last terminator."""
        self._needs("a search by lines", "multiline")
        parts = F.split(text, "\\x00" if self.query.null_data else "\n", -1)
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    def stripped(self, line: Column) -> Column:
        return F.regexp_replace(line, "\r$", "") if self.query.crlf else line

    def lines_of(self, text: Column) -> Column:
        """The records of a text without their terminators."""
        return F.transform(self.raw_lines(text), self.stripped) if self.query.crlf else self.raw_lines(text)

    def records(self, prune: bool = False) -> DataFrame:
        """(keys, line_number, line), pruned to files that may match if `prune`."""
        rows = self.files(prune and not self.query.invert).select(*self.keys, F.posexplode(self.lines_of(F.col("_text"))).alias("_at", "line"))
        return rows.select(*self.keys, (F.col("_at") + 1).cast("long").alias("line_number"), "line")

    def _marked(self, lines: Column) -> Column:
        """(at, line, hit) of every line."""
        return F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"), self.selected(x).alias("hit")))

    def _chosen(self, lines: Column) -> Column:
        """The selected (at, line, hit): the first ones up to the limit; of the first run alone with stop_on_nonmatch."""
        found = F.filter(self._marked(lines), lambda s: s["hit"])
        if self.query.stop_on_nonmatch:
            found = let(found, lambda h: F.transform(F.filter(F.transform(h, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["s"]["at"] - F.get(h, F.lit(0))["at"] == x["k"]), lambda x: x["s"]))
        return F.slice(found, 1, self.query.max_count) if self.query.max_count is not None else found

    def _limited(self) -> bool:
        return self.query.stop_on_nonmatch or self.query.max_count is not None

    def lines(self) -> DataFrame:
        """Selected lines; with a limit, the first ones of each file; stop_on_nonmatch ends a file after its first run."""
        if self.query.multiline:
            return self.multiline_lines()
        return self.chosen().select(*self.keys, "line_number", self.shaped(F.col("line")).alias("line"))

    def chosen(self) -> DataFrame:
        """(keys, line_number, line): the selected lines as they are. Every mode starts from these lines, so that limits,
        stop_on_nonmatch and invert hold in all of them."""
        if self.pattern.outside:
            q, view = self.query, self.of_bytes
            return self._by_text("line_number long, line string", lambda found, text: [(n, body) for n, _, body, _ in chosen_lines(found, text, q, view)])
        if not self._limited():
            return self.records(prune=True).filter(self.selected(F.col("line")))
        rows = self.files(not self.query.invert).select(*self.keys, F.explode(self._chosen(self.lines_of(F.col("_text")))).alias("_s"))
        return rows.select(*self.keys, (F.col("_s.at") + 1).cast("long").alias("line_number"), F.col("_s.line").alias("line"))

    def shaped(self, line: Column, context: bool = False) -> Column:
        """Trimmed and limited in width, as the query says. Widths are bytes; a preview ends with the last whole character
        within them."""
        q = self.query
        out = F.regexp_replace(line, LEADING, "") if q.trim else line
        if q.max_columns:
            data = F.encode(out, "ISO-8859-1" if self.of_bytes else "UTF-8")
            cut = F.substring(out, 1, q.max_columns) if self.of_bytes else F.coalesce(*(F.try_validate_utf8(F.substring(data, 1, n).cast("string")) for n in range(q.max_columns, max(0, q.max_columns - 4), -1)), F.lit(""))
            short = F.concat(cut, F.lit(" [... omitted end of long line]")) if q.preview else F.lit("[Omitted long context line]" if context else "[Omitted long matching line]")
            out = F.when(self.size_of(out) > q.max_columns, short).otherwise(out)
        return out

    def _sizes(self, raw: Column) -> Column:
        """Bytes of each record with its terminator."""
        return F.transform(raw, lambda x: self.size_of(x).cast("long") + 1)

    def _offset_rows(self) -> DataFrame:
        """Selected lines with byte_offset, and whether a terminator ends them."""
        text = F.col("_text")
        if self.pattern.outside:
            q, view = self.query, self.of_bytes
            size = lambda t: len(t if view else t.encode())
            return self._by_text("line_number long, byte_offset long, line string, ended boolean", lambda found, text: [(n, at, body, at + size(body) < size(text)) for n, at, body, _ in chosen_lines(found, text, q, view)])
        placed = lambda upto, raw: lambda s: F.struct(s["at"].alias("at"), s["line"].alias("line"), upto(s["at"]).alias("byte_offset"), (upto(s["at"]) + self.size_of(F.get(raw, s["at"])) < self.size_of(text)).alias("ended"))
        chosen = let(self.raw_lines(text), lambda raw: let(self._chosen(F.transform(raw, self.stripped)), lambda found: running(self._sizes(raw), lambda upto: F.transform(found, placed(upto, raw)))))
        rows = self.files(not self.query.invert).select(*self.keys, F.explode(chosen).alias("_s"))
        return rows.select(*self.keys, (F.col("_s.at") + 1).cast("long").alias("line_number"), *(F.col(f"_s.{c}").alias(c) for c in ("byte_offset", "line", "ended")))

    def with_offsets(self) -> DataFrame:
        """Selected lines with byte_offset, the bytes before the line in its file."""
        return self._offset_rows().select(*self.keys, "line_number", "byte_offset", "line")

    # Counts, within the row of a file.
    def count_lines(self, zero: bool | None = None) -> DataFrame:
        """Selected lines by file; a binary file whose search would end early has no count."""
        files = self.files(not (self.query.invert or zero or self.query.include_zero), whole=True)
        n = self.n_lines(F.col("_text"))
        out = files.select(*self.keys, n.alias("n"))
        return out if (self.query.include_zero if zero is None else zero) else out.filter("n > 0")

    def n_lines(self, text: Column) -> Column:
        """Chosen lines of a text."""
        if self.pattern.outside:
            pattern, q, view = self.pattern, self.query, self.of_bytes
            bounded_batches(self.df.sparkSession)

            @F.arrow_udf("long")
            def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                found = Engine(pattern)
                for texts in batches:
                    if pattern.exact:
                        yield linear_counts(texts, pattern.linear, q)
                        continue
                    yield pa.array([sum(1 for _ in chosen_lines(found, t, q, view)) if t else 0 for t in texts.to_pylist()], pa.int64())

            return once(count)(text)
        lines = self.lines_of(text)
        return F.coalesce(F.size(self._chosen(lines) if self._limited() else F.filter(lines, self.selected)), F.lit(0)).cast("long")

    def count_matches(self) -> DataFrame:
        """Matches by file; lines where the query inverts or wants whole lines."""
        if self.query.invert or self.query.line:
            return self.count_lines()
        out = self.files(not self.query.include_zero, whole=True).select(*self.keys, F.coalesce(self.n_matches(F.col("_text")), F.lit(0)).alias("n"))
        return out if self.query.include_zero else out.filter("n > 0")

    def n_matches(self, text: Column) -> Column:
        """Matches in the lines of a text (with a limit, in the chosen ones); an empty one right after another match is none."""
        if not self.outside:
            lines = self.lines_of(text)
            lines = F.transform(self._chosen(lines), lambda s: s["line"]) if self._limited() else lines
            return total(F.transform(lines, lambda x: F.regexp_count(x, F.lit(self.pattern.java)).cast("long")))
        if not self.pattern.outside and r"\G" not in self.pattern.java:
            return let(self.lines_of(text), lambda lines: self._n_with_empty(text, lines))
        pattern, q, view = self.pattern, self.query, self.of_bytes
        bounded_batches(self.df.sparkSession)

        @F.arrow_udf("long")
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            found = Engine(pattern)
            for texts in batches:
                yield pa.array([None if t is None else sum(len(kept) for *_, kept in chosen_lines(found, t, q, view)) for t in texts.to_pylist()], pa.int64())

        return once(count)(text)

    def _n_with_empty(self, text: Column, lines: Column) -> Column:
        """`n_matches` in Java's engine for a pattern that can be empty. There `\\G` is where the last match ended, at first the
        start, so that a match that ends at it is an empty one right after another; an empty one at the start is good. None begins
        within a surrogate pair, and none is empty at the end of a last line without a terminator."""
        count = lambda line, before="": F.coalesce(F.regexp_count(line, F.lit(rf"{before}(?!\p{{Cs}})(?>{self.pattern.java})(?:(?!\G)|\A)")), F.lit(0)).cast("long")
        numbered = self._chosen(lines) if self._limited() else F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line")))

        def counted(chosen: Column) -> Column:
            last = F.get(chosen, F.size(chosen) - 1)
            opened = (last["at"] == F.size(lines) - 1) & (last["line"] != "") & ~F.endswith(text, F.lit(self.query.terminator))
            return total(F.transform(chosen, lambda s: count(s["line"]))) - F.when(opened, count(last["line"]) - count(last["line"], r"(?!\z)")).otherwise(0)

        return let(numbered, counted)

    def any_hit(self) -> Column:
        if self.query.multiline:
            return self.multiline_any(F.col("_text"))
        if self.pattern.outside:
            return self.n_lines(F.col("_text")) > 0
        return F.coalesce(F.exists(self.lines_of(F.col("_text")), self.selected), F.lit(False))

    def files_with_matches(self) -> DataFrame:
        return self.files(not self.query.invert).filter(self.any_hit()).select(*self.keys)

    def files_without_match(self) -> DataFrame:
        return self.files(whole=True).filter(~self.any_hit()).select(*self.keys)

    def quiet(self) -> DataFrame:
        """One row: whether anything matches."""
        return self.files_with_matches().limit(1).agg((F.count("*") > 0).alias("found"))

    # Context.
    def context(self) -> DataFrame:
        """Matching and context lines with kind, and group_id, which grows where lines are not adjacent."""
        if self.query.multiline:
            return self.multiline_context()
        if self.pattern.outside:
            return self._context_outside()
        rows = self.files(prune=not (self.query.invert or self.query.passthru)).select(*self.keys, F.explode(self._context(F.col("_text"))).alias("_s"))
        kind, line, q = F.col("_s.kind"), F.col("_s.line"), self.query
        other = self.shaped(line, context=True)
        if q.only_matching and not q.invert:
            self._needs("matches that can be empty, with context,", *(("only_matching",) if self.outside else ()))
            found = F.regexp_extract_all(line, F.lit(self.pattern.java), 0) if q.replacement is None else self._expansions(line, replacement.parts(q.replacement, self.pattern))
            body = F.explode(F.when(kind == "match", found).otherwise(F.array(other)))
        else:
            body = F.when(kind == "match", self.shaped(self._replaced(line))).otherwise(other)
        return rows.select(*self.keys, (F.col("_s.at") + 1).cast("long").alias("line_number"), kind.alias("kind"), body.alias("line"), F.col("_s.group_id").alias("group_id"))

    def _context_outside(self) -> DataFrame:
        self._needs("a pattern outside of the engine, with context,", *(("only_matching",) if self.query.only_matching else ()))
        q, view = self.query, self.of_bytes
        rows = self._by_text("line_number long, kind string, line string, group_id long", lambda found, text: context_rows(found, text, q, view))
        body = F.when(F.col("kind") == "match", self.shaped(self._replaced(F.col("line")))).otherwise(self.shaped(F.col("line"), context=True))
        return rows.select(*self.keys, "line_number", "kind", body.alias("line"), "group_id")

    def _context(self, text: Column) -> Column:
        """(at, line, kind, group_id) of the matching lines of a text and those around them."""
        q = self.query

        def around(marked: Column) -> Column:
            hits = F.filter(marked, lambda s: s["hit"])
            # beyond the limit no line opens context; in a context it is still a match
            last = F.coalesce(F.get(hits, F.lit(q.max_count - 1))["at"], F.lit(1 << 30)) if q.max_count else F.lit(-1 if q.max_count == 0 else 1 << 30)
            return let(last, lambda limit: let(F.transform(marked, lambda s: s["hit"] & (s["at"] <= limit)), lambda opens: near(marked, opens)))

        def near(marked: Column, opens: Column) -> Column:
            kind = lambda s: F.when(F.get(opens, s["at"]) if q.passthru else s["hit"], "match").otherwise("context")
            inside = lambda s: F.lit(True) if q.passthru else F.exists(F.slice(opens, F.greatest(s["at"] - q.lines_after, F.lit(0)) + 1, F.least(s["at"], F.lit(q.lines_after)) + q.lines_before + 1), lambda o: o)
            kept = F.transform(F.filter(marked, inside), lambda s: F.struct(s["at"].alias("at"), s["line"].alias("line"), kind(s).alias("kind")))
            return let(kept, numbered)

        def numbered(kept: Column) -> Column:
            jumps = F.transform(kept, lambda s, k: F.when((k > 0) & (s["at"] - F.get(kept, k - 1)["at"] > 1), 1).otherwise(0).cast("long"))
            return running(jumps, lambda upto: F.transform(kept, lambda s, k: F.struct(s["at"].alias("at"), s["line"].alias("line"), s["kind"].alias("kind"), upto(k + 1).alias("group_id"))))

        marked = self._marked(self.lines_of(text))
        if q.stop_on_nonmatch:  # the line that ends the first run is the last one that can be context
            whole = marked
            hits = F.transform(whole, lambda s: s["hit"])
            first = F.array_position(hits, True)
            run = F.array_position(F.slice(hits, F.greatest(first, F.lit(1)), F.size(hits)), False)
            marked = F.when((first > 0) & (run > 0), F.slice(whole, F.lit(1), (first + run - 1).cast("int"))).otherwise(whole)
        return let(marked, around)

    # Matches.
    def only_matching(self) -> DataFrame:
        """(keys, line_number, match_index, match) of every match."""
        if self.query.invert:  # lines without a match stand for themselves
            return self.chosen().select(*self.keys, "line_number", F.lit(0).alias("match_index"), F.col("line").alias("match"))
        if self.outside:
            return self.spans().select(*self.keys, "line_number", "match_index", "match")
        rows = self.chosen()
        return rows.select(*self.keys, "line_number", F.posexplode(F.regexp_extract_all("line", F.lit(self.pattern.java), 0)).alias("match_index", "match"))

    def _starts(self, line: Column, found: Column) -> Column:
        """(match, start) of each match in a line: its bytes, from the lengths of what stands between matches."""
        gaps = F.transform(F.split(line, self.pattern.java, -1), lambda x: self.size_of(x).cast("long"))
        return let(found, lambda m: let(gaps, lambda g: running(F.transform(m, lambda x, k: self.size_of(x) + F.get(g, k)), lambda upto: F.transform(m, lambda x, k: F.struct(x.alias("match"), (upto(k) + F.get(g, k)).alias("start"))))))

    def match_spans(self) -> DataFrame:
        """(keys, line_number, match_index, column, start, stop, abs_offset, match, line) of every match, as `spans` gives
        them; in the engine where no match can be empty."""
        if self.outside:
            return self.spans().drop("groups")
        rows = self.with_offsets().select(*self.keys, "line_number", "byte_offset", "line")
        rows = rows.select("*", F.posexplode(self._starts(F.col("line"), F.regexp_extract_all("line", F.lit(self.pattern.java), 0))).alias("match_index", "_m"))
        start, stop = F.col("_m.start"), F.col("_m.start") + self.size_of(F.col("_m.match"))
        return rows.select(*self.keys, "line_number", "match_index", (start + 1).alias("column"), start.alias("start"), stop.alias("stop"), (F.col("byte_offset") + start).alias("abs_offset"), F.col("_m.match").alias("match"), "line")

    def vimgrep(self) -> DataFrame:
        """One row a match: line number, byte column and the line; under invert one row a line, without a column."""
        if self.query.invert:
            return self.lines().select(*self.keys, "line_number", F.lit(None).cast("long").alias("column"), "line")
        return self.match_spans().select(*self.keys, "line_number", "column", self.shaped(F.col("line")).alias("line"))

    def captures(self, every: bool = False) -> DataFrame:
        """The first match (every match, with match_index) of each selected line and its groups; a group that took no part
        is null."""
        self._needs("a search for groups", "invert")
        names = {v: k for k, v in self.pattern.names.items()}
        named = [(k, names.get(k, f"group_{k}")) for k in range(1, self.pattern.n_groups + 1)]
        if self.outside or len(self.pattern.sure_groups) < self.pattern.n_groups:
            rows = self.spans()
            rows = rows if every else rows.filter("match_index = 0")
            return rows.select(*self.keys, "line_number", *(["match_index"] if every else []), "match", *(F.get("groups", F.lit(k))["text"].alias(name) for k, name in named))
        rows = self.chosen()
        java = F.lit(self.pattern.java)
        if not every:
            return rows.select(*self.keys, "line_number", *(F.regexp_extract("line", self.pattern.java, k).alias(name) for k, name in [(0, "match"), *named]))
        found = F.arrays_zip(*(F.regexp_extract_all("line", java, F.lit(k)).alias(f"g{k}") for k in range(len(named) + 1)))
        rows = rows.select(*self.keys, "line_number", F.posexplode(found).alias("match_index", "_m"))
        return rows.select(*self.keys, "line_number", "match_index", *(F.col(f"_m.g{k}").alias(name) for k, name in [(0, "match"), *named]))

    def count_captures(self) -> DataFrame:
        """Groups that took part in matches, the whole match included, by file."""
        self._needs("a search for groups", "invert")
        if self.outside or len(self.pattern.sure_groups) < self.pattern.n_groups:
            q, view = self.query, self.of_bytes
            taking = lambda m: 1 + sum(m.start(g) >= 0 for g in range(1, m.re.groups + 1))
            return self._by_text("n long", lambda found, text: [(n,)] if (n := sum(taking(m) for *_, kept in chosen_lines(found, text, q, view) for m in kept)) else [])
        n = self.n_matches(F.col("_text")) * (self.pattern.n_groups + 1)
        return self.files(prune=True).select(*self.keys, n.alias("n")).filter("n > 0")

    def replaced(self) -> DataFrame:
        """Selected lines with every match replaced by the template."""
        return self.chosen().select(*self.keys, "line_number", self.shaped(self._replaced(F.col("line"))).alias("line"))

    def _replaced(self, line: Column) -> Column:
        if self.query.invert or self.query.replacement is None:
            return line
        if not self.outside:
            return F.regexp_replace(line, F.lit(self.pattern.java), F.lit(replacement.java(self.query.replacement or "", self.pattern)))
        pattern, template = self.pattern, replacement.parts(self.query.replacement or "", self.pattern)
        bounded_batches(self.df.sparkSession)

        @F.arrow_udf("string")
        def expand(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            found = Engine(pattern)
            for lines in batches:
                yield pa.array([None if x is None else with_replacements(found, x, template) for x in lines.to_pylist()], pa.string())

        return expand(line)

    def replaced_matches(self) -> DataFrame:
        """Only the expansions: one row a match."""
        if self.query.invert:
            return self.only_matching()
        template = replacement.parts(self.query.replacement or "", self.pattern)
        if self.outside:
            rows = self.spans()
            parts = [F.coalesce(F.get("groups", F.lit(p))["text"], F.lit("")) if isinstance(p, int) else F.lit(p) for p in template]
            return rows.select(*self.keys, "line_number", "match_index", F.concat(F.lit(""), *parts).alias("match"))
        return self.chosen().select(*self.keys, "line_number", F.posexplode(self._expansions(F.col("line"), template)).alias("match_index", "match"))

    def _expansions(self, line: Column, template: list[str | int]) -> Column:
        """The template for each match of a line."""
        every = [F.regexp_extract_all(line, F.lit(self.pattern.java), F.lit(p)) if isinstance(p, int) else None for p in template]
        whole = F.regexp_extract_all(line, F.lit(self.pattern.java), F.lit(0))
        return F.transform(whole, lambda _, i: F.concat(F.lit(""), *(F.lit(p) if e is None else F.get(e, i) for p, e in zip(template, every, strict=True))))

    def _by_text(self, columns: str, rows_of: Callable[[object, str], list[tuple]], prune: bool = True, whole: bool = False) -> DataFrame:
        """(keys, columns) from a function of the compiled pattern and a text, over Arrow batches of bounded bytes."""
        schema = StructType([*(self.df.schema[k] for k in self.keys), *StructType.fromDDL(columns).fields])
        arrow, pattern, n = to_arrow_schema(schema), self.pattern, len(self.keys)
        bounded_batches(self.df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Engine(pattern)
            for batch in batches:
                at, out = [], []
                for k, text in enumerate(batch.column(n).to_pylist()):
                    rows = rows_of(found, text) if text else []
                    at += [k] * len(rows)
                    out += rows
                keys = batch.select(range(n)).take(pa.array(at, pa.int64())).columns
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array([r[i] for r in out], f.type) for i, f in enumerate(list(arrow)[n:]))], schema=arrow)

        return self.files(prune and not self.query.invert and not self.query.passthru, whole).mapInArrow(run, schema)

    def spans(self) -> DataFrame:
        """(keys, line_number, match_index, column, start, stop, abs_offset, match, groups, line): 1-based byte column,
        byte span within the line, byte offset in the file, and the byte spans of all groups (null if absent)."""
        self._needs("a search by lines", "multiline")
        self._needs("a search for spans", "invert")
        q, view = self.query, self.of_bytes
        columns = "line_number long, match_index int, column long, start long, stop long, abs_offset long, match string, groups array<struct<start:bigint,stop:bigint,text:string>>, line string"
        return self._by_text(columns, lambda found, text: spans_of(found, text, q, view))

    # Multi-line searches: matches over whole texts; the lines that they touch form blocks.
    def multiline(self) -> DataFrame:
        """(keys, match_index, start_line, stop_line, start, match) of every match; the first ones up to the limit."""
        self._needs("the matches of a multi-line search", "invert", "context", "before", "after", "passthru", "stop_on_nonmatch", "replacement")
        most, view = self.query.max_count, self.of_bytes

        def rows_of(found, text: str) -> list[tuple]:
            out, at, seen, line = [], byte_places(text, view), 0, 1
            for n, m in enumerate(distinct_matches(found, text)):
                if n == most:
                    break
                line += text.count("\n", seen, m.start())
                seen = m.start()
                out.append((n, line, line + text.count("\n", seen, max(seen, m.end() - 1)), at(seen), m[0]))
            return out

        return self._by_text("match_index int, start_line long, stop_line long, start long, match string", rows_of)

    def count_multiline(self) -> DataFrame:
        """Matches over whole texts by file (lines under invert), without leaving the engine where no match can be empty."""
        if self.query.invert or self.query.max_count is not None:
            q = self.query.where(context=0, before=None, after=None, passthru=False)
            return self._by_text("n long", lambda found, text: [(n,)] if (n := sum(opens for *_, opens in block_rows(found, text, q))) else [], whole=True)
        if self.outside:
            return self._by_text("n long", lambda found, text: [(n,)] if (n := sum(1 for _ in distinct_matches(found, text))) else [], whole=True)
        return self.files(prune=True, whole=True).select(*self.keys, F.regexp_count("_text", F.lit(self.pattern.java)).cast("long").alias("n")).filter("n > 0")

    def multiline_lines(self) -> DataFrame:
        """The lines that matches touch (under invert the others)."""
        q = self.query.where(context=0, before=None, after=None, passthru=False)
        rows = self._by_text("line_number long, line string", lambda found, text: [(n, line) for n, line, kind, *_ in block_rows(found, text, q) if kind == "match"])
        return rows.select(*self.keys, "line_number", self.shaped(F.col("line")).alias("line"))

    def multiline_any(self, text: Column) -> Column:
        """Whether a multi-line search finds anything in a text."""
        if not (self.query.invert or self.outside):
            return F.coalesce(text.rlike(self.pattern.java), F.lit(False))
        pattern, q = self.pattern, self.query.where(context=0, before=None, after=None, passthru=False)
        bounded_batches(self.df.sparkSession)

        @F.arrow_udf("boolean")
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            compiled = Engine(pattern)
            for texts in batches:
                yield pa.array([bool(t and block_rows(compiled, t, q)) for t in texts.to_pylist()], pa.bool_())

        return found(text)

    def multiline_context(self) -> DataFrame:
        """The lines of blocks and those around them, as `context` gives them for single lines."""
        q = self.query
        rows = self._by_text("line_number long, kind string, line string, group_id long", lambda found, text: [(n, kind, line, group) for n, line, kind, group, _ in block_rows(found, text, q)])
        body = F.when(F.col("kind") == "match", self.shaped(F.col("line"))).otherwise(self.shaped(F.col("line"), context=True))
        return rows.select(*self.keys, "line_number", "kind", body.alias("line"), "group_id")

    def multiline_replaced(self) -> DataFrame:
        """Each block, from its first line on, with its matches replaced."""
        template, most = replacement.parts(self.query.replacement or "", self.pattern), self.query.max_count

        def rows_of(found, text: str) -> list[tuple]:
            lines, starts = cut(text)
            out = []
            for first, last, matches in blocks_of(found, text, starts, len(lines))[:most]:
                low, high = starts[first], starts[last] + len(lines[last])
                body, at = [], low
                for m in matches:
                    body += [text[at : m.start()], expanded(m, template)]
                    at = m.end()
                out.append((first + 1, "".join([*body, text[at:high]]).removesuffix("\n")))
            return out

        return self._by_text("line_number long, line string", rows_of)

    # Output.
    def rendered(self) -> DataFrame:
        """Lines as text: path, line number, column, offset and body, joined by the query's separators."""
        q = self.query
        path = [F.concat_ws("/", *(F.col(k).cast("string") for k in self.keys))] if q.with_filename else []
        if q.lines_before or q.lines_after or q.passthru:
            rows = self.context()
            head = lambda sep: F.concat_ws(sep, *path, *([F.col("line_number").cast("string")] if q.line_number else []), F.col("line"))
            return rows.select(*self.keys, "line_number", F.when(F.col("kind") == "match", head(q.match_separator)).otherwise(head(q.context_field_separator)).alias("output"))
        rows = self.with_offsets() if q.byte_offset else self.lines()
        parts = [*path, *([F.col("line_number").cast("string")] if q.line_number or q.column else [])]
        if q.column:
            at = F.regexp_instr(F.col("line"), F.lit(self.pattern.java))
            parts.append((self.size_of(F.substring(F.col("line"), F.lit(1), at - 1)) + 1).cast("string"))
        if q.byte_offset:
            parts.append(F.col("byte_offset").cast("string"))
        return rows.select(*self.keys, "line_number", F.concat_ws(q.match_separator, *parts, F.col("line")).alias("output"))

    def json_events(self) -> DataFrame:
        """One JSON `match` message a selected line, with its submatches in byte offsets."""
        self._needs("single JSON events", "multiline", "context", "before", "after", "passthru", "replacement")
        if self.outside or self.query.invert:
            found = self.json_messages().filter(F.get_json_object("event", "$.type") == "match")
            data = lambda path: F.get_json_object("event", f"$.data.{path}")
            subs = F.coalesce(F.json_array_length(data("submatches")), F.lit(0))
            return found.select(*self.keys, data("line_number").cast("long").alias("line_number"), subs.cast("long").alias("n_submatches"), data("absolute_offset").cast("long").alias("absolute_offset"), "event")
        one = lambda m: F.struct(F.struct(m["match"].alias("text")).alias("match"), m["start"].alias("start"), (m["start"] + self.size_of(m["match"])).alias("end"))
        subs = F.transform(self._starts(F.col("line"), F.regexp_extract_all("line", F.lit(self.pattern.java), 0)), one)
        rows = self._offset_rows().select(*self.keys, "line_number", F.col("byte_offset").alias("absolute_offset"), F.concat("line", F.when(F.col("ended"), "\n").otherwise("")).alias("line"), subs.alias("submatches"))
        path = F.struct(F.concat_ws("/", *(F.col(k).cast("string") for k in self.keys)).alias("text")).alias("path")
        data = F.struct(path, F.struct(F.col("line").alias("text")).alias("lines"), "line_number", "absolute_offset", "submatches")
        return rows.select(*self.keys, "line_number", F.size("submatches").cast("long").alias("n_submatches"), "absolute_offset", F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data"))).alias("event"))

    def json_messages(self) -> DataFrame:
        """(keys, seq, event): the messages begin, match, context and end of every file with a match, in their order. Times
        are zero: they say nothing about a distributed search. Binary files are searched to their end, and the last message
        says where their first NUL is."""
        if self.query.binary == "quit":
            return Search(self.df, self.query.where(binary="convert"), tuple(self.keys), self.text).json_messages()
        q, template = self.query, replacement.parts(self.query.replacement, self.pattern) if self.query.replacement is not None else None
        n, view = len(self.keys), self.of_bytes
        schema = StructType([*(self.df.schema[k] for k in self.keys), *StructType.fromDDL("seq int, event string").fields])
        arrow, pattern = to_arrow_schema(schema), self.pattern
        bounded_batches(self.df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Engine(pattern)
            for batch in batches:
                at, seq, events = [], [], []
                names = ["/".join(str(v) for v in row if v is not None) for row in zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True)]
                for k, (text, nul) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 2).to_pylist() if batch.num_columns > n + 2 else [None] * batch.num_rows, strict=True)):
                    made = messages_of(found, text, names[k], q, template, view, nul) if text else []
                    at += [k] * len(made)
                    seq += range(len(made))
                    events += made
                yield pa.RecordBatch.from_arrays([*batch.select(range(n)).take(pa.array(at, pa.int64())).columns, pa.array(seq, pa.int32()), pa.array(events, pa.string())], schema=arrow)

        return self.files(not (q.invert or q.passthru), nul=q.binary == "convert" and not q.null_data).mapInArrow(run, schema)

    def json_summary(self) -> DataFrame:
        """The one `summary` message of all files."""
        total_of = lambda c: F.coalesce(F.sum(F.get_json_object("event", f"$.data.stats.{c}").cast("long")), F.lit(0)).cast("long").alias(c)
        ends = self.json_messages().filter(F.get_json_object("event", "$.type") == "end").agg(total_of("bytes_printed"), total_of("matched_lines"), total_of("matches"), F.count("*").alias("searches_with_match"))
        every = self.files().agg(F.count("*").alias("searches"), F.coalesce(F.sum(self.size_of(F.col("_text"))), F.lit(0)).cast("long").alias("bytes_searched"))
        zero = F.struct(F.lit(0).alias("secs"), F.lit(0).alias("nanos"), F.lit("0s").alias("human"))
        stats = F.struct(zero.alias("elapsed"), "searches", "searches_with_match", "bytes_searched", "bytes_printed", "matched_lines", "matches")
        return ends.crossJoin(every).select(F.to_json(F.struct(F.struct(zero.alias("elapsed_total"), stats.alias("stats")).alias("data"), F.lit("summary").alias("type"))).alias("event"))  # one row each

    def bytes_printed(self) -> DataFrame:
        """One row: the bytes of all rendered lines with their line feeds."""
        return self.rendered().agg(F.coalesce(F.sum(self.size_of(F.col("output")).cast("long") + 1), F.lit(0)).cast("long").alias("bytes_printed"))

    def stats_report(self) -> DataFrame:
        """One row: the totals as lines of text. Times are left out: they say nothing about a distributed search."""
        both = self.stats().crossJoin(self.bytes_printed())  # one row each
        said = [("matches", "matches"), ("matched_lines", "matched lines"), ("searches_with_match", "files contained matches"), ("searches", "files searched"), ("bytes_printed", "bytes printed"), ("bytes_searched", "bytes searched")]
        return both.select(F.concat_ws("\n", *(F.concat_ws(" ", F.col(c).cast("string"), F.lit(text)) for c, text in said)).alias("report"))

    def stats(self) -> DataFrame:
        """One row of totals over all files. Under invert lines are selected, and no matches counted."""
        matches = F.lit(0).cast("long") if self.query.invert else self.n_matches(F.col("_text"))
        per = self.files().select(self.size_of(F.col("_text")).alias("bytes"), self.n_lines(F.col("_text")).alias("lines"), matches.alias("matches"))
        total_of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return per.agg(F.count("*").alias("searches"), F.count_if(F.col("lines") > 0).alias("searches_with_match"), total_of("bytes").alias("bytes_searched"), total_of("lines").alias("matched_lines"), total_of("matches").alias("matches"))


def once(function: Callable) -> Callable:
    """A function that runs once a row, by one worker a task. Spark copies one that it takes for deterministic into the filter
    on its result, so that each task searches its texts twice, in two workers."""
    return function.asNondeterministic()


def distinct_matches(compiled, text: str):
    """Non-overlapping matches: each search goes on where the last match ended; an empty match right there is none, and the
    search goes on a character later."""
    at, last = 0, -1
    while at <= len(text) and (m := compiled.search(text, at)):
        if m.start() == m.end() == last:
            at, last = last + 1, -1
            continue
        yield m
        at = last = m.end()


def expanded(match, template: list[str | int]) -> str:
    """A replacement template for one match."""
    return "".join((match[p] or "") if isinstance(p, int) else p for p in template)


def with_replacements(compiled, text: str, template: list[str | int]) -> str:
    out, at = [], 0
    for m in distinct_matches(compiled, text):
        out += [text[at : m.start()], expanded(m, template)]
        at = m.end()
    return "".join([*out, text[at:]])


def line_matches(compiled, text: str, end: str, crlf: bool, view: bool = False):
    """(number, body, bytes with the terminator, matches) of each line of a text."""
    parts = text.split(end)
    terminated = parts[-1] == ""
    for number, line in enumerate(parts[:-1] if terminated else parts, 1):
        body = line.removesuffix("\r") if crlf else line
        last = not terminated and number == len(parts)
        yield number, body, len(line if view else line.encode()) + 1, [m for m in distinct_matches(compiled, body) if not (last and m.start() == m.end() == len(body) and len(body))]


def chosen_lines(compiled, text: str, q: SearchQuery, view: bool = False):
    """(number, bytes before the line, body, matches) of the lines that a search selects, up to its limit."""
    offset = chosen = 0
    for number, body, size, kept in line_matches(compiled, text, q.terminator, q.crlf, view):
        if chosen == q.max_count:
            return
        if (bool(kept) or compiled.search(body) is not None) != q.invert:
            yield number, offset, body, kept
            chosen += 1
        elif chosen and q.stop_on_nonmatch:
            return
        offset += size


def linear_counts(texts: pa.Array, expression: str, q: SearchQuery) -> pa.Array:
    """How many lines of each text `chosen_lines` has, by Arrow's linear-time matcher for all lines of the texts at once."""
    if not len(texts):
        return pa.array([], pa.int64())
    parts = pc.split_pattern(pc.fill_null(texts, ""), q.terminator)
    bounds, lines = parts.offsets.to_numpy(), parts.values
    there = np.ones(len(lines), bool)
    there[bounds[1:] - 1] = pc.binary_length(lines.take(pa.array(bounds[1:] - 1))).to_numpy() > 0  # no line after the last terminator
    if q.crlf:
        lines = pc.replace_substring_regex(lines, r"\r\z", "")
    hits = (pc.match_substring_regex(lines, expression).to_numpy(zero_copy_only=False) != q.invert) & there
    if q.stop_on_nonmatch:  # the first run of each text is left
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            first = a + int(hits[a:b].argmax())
            misses = np.flatnonzero(~hits[first:b])
            hits[first + int(misses[0]) if len(misses) else b : b] = False
    n = np.add.reduceat(hits, bounds[:-1], dtype=np.int64)
    return pa.array(n if q.max_count is None else np.minimum(n, q.max_count), pa.int64())


def shown_lines(compiled, text: str, q: SearchQuery, view: bool = False) -> list[tuple[int, int, str, str, list, int]]:
    """(number, bytes before the line, body, kind, matches, group) of the lines that a search shows, context included."""
    marked, offset = [], 0
    for number, body, size, kept in line_matches(compiled, text, q.terminator, q.crlf, view):
        marked.append((number, offset, body, (bool(kept) or compiled.search(body) is not None) != q.invert, [] if q.invert else kept))
        offset += size
    if q.stop_on_nonmatch:
        first = next((k for k, row in enumerate(marked) if row[3]), len(marked))
        marked = marked[: next((k + 1 for k in range(first, len(marked)) if not marked[k][3]), len(marked))]
    opens = [k for k, row in enumerate(marked) if row[3]][: q.max_count]
    near = set(range(len(marked))) if q.passthru else {j for k in opens for j in range(max(0, k - q.lines_before), min(len(marked), k + q.lines_after + 1))}
    opened, out, group, last, around = set(opens), [], 0, None, q.lines_before or q.lines_after
    for k in sorted(near):
        group += bool(around) and last is not None and k - last > 1
        last = k
        number, offset, body, hit, kept = marked[k]
        selected = k in opened if q.passthru else hit
        out.append((number, offset, body, "match" if selected else "context", kept if selected else [], group))
    return out


def context_rows(compiled, text: str, q: SearchQuery, view: bool = False) -> list[tuple[int, str, str, int]]:
    """(number, kind, line, group) as `Search.context` gives them, for patterns outside of the engine."""
    return [(number, kind, body, group) for number, _, body, kind, _, group in shown_lines(compiled, text, q, view)]


def byte_places(text: str, view: bool = False) -> Callable[[int], int]:
    """The bytes before each character of a text, for places that mostly ascend: only what lies between two is measured."""
    if view or text.isascii():
        return lambda k: k
    known = [0, 0]

    def at(k: int) -> int:
        if k >= known[0]:
            known[:] = k, known[1] + len(text[known[0] : k].encode(errors="surrogateescape"))
            return known[1]
        return known[1] - len(text[k : known[0]].encode(errors="surrogateescape"))

    return at


def spans_of(compiled, text: str, q: SearchQuery, view: bool = False) -> list[tuple]:
    """The rows of `Search.spans` of one text."""
    out = []
    for number, offset, body, kept in chosen_lines(compiled, text, q, view):
        at = byte_places(body, view)
        for n, m in enumerate(kept):
            low = at(m.start())
            groups = [{"start": at(m.start(g)), "stop": at(m.end(g)), "text": m[g]} if m.start(g) >= 0 else None for g in range(compiled.groups + 1)]
            out.append((number, n, low + 1, low, at(m.end()), offset + low, m[0], groups, body))
    return out


def cut(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text with their terminators, and where each starts."""
    lines = text.split("\n")
    lines = [f"{line}\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line)
    return lines, starts


def blocks_of(compiled, text: str, starts: list[int], n: int) -> list[tuple[int, int, list]]:
    """(first line, last line, matches) of the blocks that matches form; blocks that touch are one."""
    out: list[tuple[int, int, list]] = []
    for m in distinct_matches(compiled, text):
        if m.start() >= len(text) and m.start() == m.end():
            continue
        first = bisect.bisect_right(starts, m.start()) - 1
        last = max(first, bisect.bisect_right(starts, max(m.start(), m.end() - 1)) - 1)
        if out and first <= out[-1][1] + 1:
            low, high, found = out[-1]
            found.append(m)
            out[-1] = (low, max(high, last), found)
        elif first < n:
            out.append((first, last, [m]))
    return out


def shown_blocks(compiled, text: str, q: SearchQuery) -> tuple[list[str], list[int], list[tuple]]:
    """The lines of a text, where they start, and (line, kind, group, whether it opens a block, the matches that touch it, its
    block) of what a multi-line search shows."""
    lines, starts = cut(text)
    blocks = blocks_of(compiled, text, starts, len(lines))
    if q.invert:
        covered = {k for a, b, _ in blocks for k in range(a, b + 1)}
        blocks = [(k, k, []) for k in range(len(lines)) if k not in covered]
    limited = blocks[: q.max_count]
    opened = {a for a, _, _ in limited}
    shown = set(range(len(lines))) if q.passthru else {k for a, b, _ in limited for k in range(max(0, a - q.lines_before), min(len(lines), b + 1 + q.lines_after))}
    touched: dict[int, list] = {}
    held = {}
    for block in limited if q.passthru else blocks:
        for k in range(block[0], min(block[1] + 1, len(lines))):
            held[k] = block
        for m in block[2]:
            first = bisect.bisect_right(starts, m.start()) - 1
            for k in range(first, bisect.bisect_right(starts, max(m.start(), m.end() - 1), first)):
                touched.setdefault(k, []).append(m)
    out, group, last = [], 0, None
    for k in sorted(shown):
        group += last is not None and k - last > 1
        last = k
        out.append((k, "match" if k in held else "context", group, k in opened, touched.get(k, []), held.get(k)))
    return lines, starts, out


def block_rows(compiled, text: str, q: SearchQuery) -> list[tuple[int, str, str, int, bool]]:
    """(line number, line, kind, group, whether it opens a block) of a multi-line search's output lines."""
    lines, _, rows = shown_blocks(compiled, text, q)
    return [(k + 1, lines[k].removesuffix("\n"), kind, group, opens) for k, kind, group, opens, *_ in rows]


def _told(text: str, view: bool = False) -> dict:
    """A JSON value of a text, or of a view of bytes: base64 where they are no UTF-8."""
    data = text.encode("latin-1") if view else text.encode(errors="surrogateescape")
    try:
        return {"text": data.decode()}
    except UnicodeDecodeError:
        return {"bytes": base64.b64encode(data).decode()}


def messages_of(compiled, text: str, path: str, q: SearchQuery, template: list[str | int] | None, view: bool = False, nul: int | None = None) -> list[str]:
    """The JSON messages of one file; none without a selected line. `nul`: where the file is binary."""
    size = len if view else lambda s: len(s.encode(errors="surrogateescape"))
    lines, starts = cut(text)
    dump = lambda kind, data: json.dumps({"type": kind, "data": data}, ensure_ascii=False, separators=(",", ":"))

    def submatches(body: str, found: list) -> list[dict]:
        at = byte_places(body, view)
        return [{"match": _told(m[0], view), **({"replacement": _told(expanded(m, template), view)} if template is not None else {}), "start": at(m.start()), "end": at(m.end())} for m in found]

    if q.multiline:
        blocks = [(a, b, list(found)) for a, b, found in blocks_of(compiled, text, starts, len(lines))]
        if q.invert:
            covered = {k for a, b, _ in blocks for k in range(a, b + 1)}
            blocks = [(k, k, []) for k in range(len(lines)) if k not in covered]
    else:
        kept = [(number - 1, found) for number, _, _, found in line_matches(compiled, text, "\n", q.crlf, view)]
        blocks = [(k, k, [] if q.invert else found) for k, found in kept if bool(found) != q.invert]
    if q.max_count is not None:
        blocks = blocks[: q.max_count]
    if not blocks:
        return []
    inside = {k for a, b, _ in blocks for k in range(a, b + 1)}
    near = set(range(len(lines))) if q.passthru else {k for a, b, _ in blocks for k in range(max(0, a - q.lines_before), min(len(lines), b + 1 + q.lines_after))}
    told, offsets, at = _told(path), [], 0
    for line in lines:
        offsets.append(at)
        at += size(line)
    events = [(-1, dump("begin", {"path": told}))]
    counted = 0
    for a, b, found in blocks:
        body = "".join(lines[a : b + 1])
        if q.multiline and found:
            low, at = starts[a], byte_places(body, view)
            subs = [{"match": _told(m[0], view), **({"replacement": _told(expanded(m, template), view)} if template is not None else {}), "start": at(m.start() - low), "end": at(m.end() - low)} for m in found]
        else:
            subs = submatches(body, found)
        counted += len(subs)
        events.append((a, dump("match", {"path": told, "lines": _told(body, view), "line_number": a + 1, "absolute_offset": offsets[a], "submatches": subs})))
    events += [(k, dump("context", {"path": told, "lines": _told(lines[k], view), "line_number": k + 1, "absolute_offset": offsets[k], "submatches": []})) for k in near - inside]
    events.sort(key=lambda e: e[0])
    made = [e for _, e in events]
    stats = {"elapsed": {"secs": 0, "nanos": 0, "human": "0s"}, "searches": 1, "searches_with_match": 1, "bytes_searched": size(text), "bytes_printed": sum(len(e.encode(errors="surrogateescape")) + 1 for e in made), "matched_lines": len(inside), "matches": counted}
    return [*made, dump("end", {"path": told, "binary_offset": nul, "stats": stats})]


class PatternSet:
    """Several patterns with ids: which of them match, and the first match of all.

    Up to `EXPRESSIONS` patterns are expressions on the text. Of more, each task builds one automaton over the strings that
    they need, so that only those whose strings a text holds, and those that need none, are tried on it."""

    EXPRESSIONS = 32

    def __init__(self, patterns: list[str], **options) -> None:
        self.compiled = [SearchQuery(patterns=(p,), **options).compiled() for p in patterns]

    def _tried(self, text: Column, kind: str, answer: Callable[[int, object], object]) -> Column:
        """An array of the answers of the patterns that match, in the order of their ids."""
        compiled, arrow = self.compiled, to_arrow_schema(StructType.fromDDL(f"v array<{kind}>"))[0].type
        bounded_batches(SparkSession.active())

        @F.arrow_udf(f"array<{kind}>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = NeedIndex(compiled)
            for texts in batches:
                yield pa.array([None if t is None else [answer(k, m) for k, m in index.matches(t)] for t in texts.to_pylist()], arrow)

        return once(run)(text)

    def ids(self, text: Column) -> Column:
        """Ascending ids of the patterns that match."""
        if len(self.compiled) > self.EXPRESSIONS or any(c.outside for c in self.compiled):
            return self._tried(text, "int", lambda k, m: k)
        return F.array_compact(F.array(*(F.when(text.rlike(c.java), F.lit(k)) for k, c in enumerate(self.compiled))))

    def first(self, text: Column) -> Column:
        """(start, pattern_id) of the earliest match; the lowest id on ties; 1-based characters."""
        if len(self.compiled) > self.EXPRESSIONS or any(c.outside for c in self.compiled):
            return F.array_min(self._tried(text, "struct<start:int,pattern_id:int>", lambda k, m: {"start": m.start() + 1, "pattern_id": k}))
        found = F.array_compact(F.array(*(F.when(F.regexp_instr(text, F.lit(c.java)) > 0, F.struct(F.regexp_instr(text, F.lit(c.java)).alias("start"), F.lit(k).alias("pattern_id"))) for k, c in enumerate(self.compiled))))
        return F.array_min(found)

    def captures(self, text: Column) -> Column:
        """(pattern_id, groups) of the first match of each pattern that matches; group 0 is the whole match, and a group that
        took no part is null."""
        if len(self.compiled) > self.EXPRESSIONS or any(c.outside or len(c.sure_groups) < c.n_groups for c in self.compiled):
            return self._tried(text, "struct<pattern_id:int,groups:array<string>>", lambda k, m: {"pattern_id": k, "groups": [m[0], *m.groups()]})
        one = lambda k, c: F.when(text.rlike(c.java), F.struct(F.lit(k).alias("pattern_id"), F.array(*(F.regexp_extract(text, c.java, g) for g in range(c.n_groups + 1))).alias("groups")))
        return F.array_compact(F.array(*(one(k, c) for k, c in enumerate(self.compiled))))

    def capture_counts(self, text: Column) -> Column:
        """(pattern_id, n) of each pattern that matches: the groups that took part in its first match, the whole included."""
        return self._tried(text, "struct<pattern_id:int,n:int>", lambda k, m: {"pattern_id": k, "n": 1 + sum(g is not None for g in m.groups())})

    def count(self, text: Column) -> Column:
        """Matches of the ordered alternation of all patterns; an empty one right after another match is none."""
        if not any(c.can_be_empty for c in self.compiled):
            return F.regexp_count(text, F.lit("(?:" + "|".join(c.java for c in self.compiled) + ")"))
        pattern = "(?V1)(?:" + "|".join(c.python.removeprefix("(?V1)") for c in self.compiled) + ")"

        @F.arrow_udf("int")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            found = Engine(pattern)
            for texts in batches:
                yield pa.array([None if t is None else sum(1 for _ in distinct_matches(found, t)) for t in texts.to_pylist()], pa.int32())

        return counted(text)


class NeedIndex:
    """Patterns by the strings that they need: an automaton finds those that a text may match. Patterns are compiled when they
    are first tried."""

    def __init__(self, compiled: list[Compiled]) -> None:
        import ahocorasick

        self.compiled, self.engines = compiled, {}
        needs: dict[str, list[int]] = {}
        self.always = []
        for k, c in enumerate(compiled):
            if c.literals and "" not in c.literals:
                for literal in c.literals:
                    needs.setdefault(literal, []).append(k)
            else:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton() if needs else None
        for literal, ids in needs.items():
            self.automaton.add_word(literal, ids)
        if needs:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, object]]:
        """(id, first match) of the patterns that match."""
        tried = set(self.always)
        if self.automaton is not None:
            for _, ids in self.automaton.iter(text):
                tried.update(ids)
        for k in sorted(tried):
            if k not in self.engines:
                self.engines[k] = Engine(self.compiled[k])
            if (m := self.engines[k].search(text)) is not None:
                yield k, m
