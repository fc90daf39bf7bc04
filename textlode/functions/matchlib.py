"""Matches as column functions: strings and bytes in the engine, many literals by an automaton, expressions as rows.

Offsets are bytes of the UTF-8 text, from 0. Null texts give null (no rows from `MatchesOf`); an empty needle is refused.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textlode.functions.dialect import compile_patterns, quoted
from textlode.session import ship

#: How matches of several literals are chosen: in the order of their ends; the first start and then the first literal; the
#: first start and then the longest literal; or all of them, also where they overlap.
KINDS = ("standard", "leftmost_first", "leftmost_longest", "overlapping")


def _needle(text: str) -> str:
    if not text:
        raise ValueError("an empty string is found everywhere")
    return text


def _bytes_before(text: Column, chars: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), chars)).cast("long")


def find(text: Column, needle: str) -> Column:
    """Offset of the first occurrence; null if there is none."""
    at = F.instr(text, _needle(needle))
    return F.when(at > 0, _bytes_before(text, at - 1))


def find_last(text: Column, needle: str) -> Column:
    """Offset of the last occurrence; null if there is none."""
    at = F.instr(F.reverse(text), _needle(needle)[::-1])
    return F.when(at > 0, _bytes_before(text, F.char_length(text) - at - len(needle) + 1))


def find_any(text: Column, characters: str) -> Column:
    """Offset of the first of some characters; null if there is none."""
    at = F.regexp_instr(text, F.lit(f"[{''.join(map(quoted, _needle(characters)))}]"))
    return F.when(at > 0, _bytes_before(text, at - 1))


def count_character(text: Column, character: str) -> Column:
    """How often a character occurs."""
    if len(character) != 1:
        raise ValueError("one character is counted at a time")
    return (F.char_length(text) - F.char_length(F.translate(text, character, ""))).cast("long")


def chosen(found: list[tuple[int, int, int]], kind: str) -> list[tuple[int, int, int]]:
    """Of all (literal, start, stop), in the order of their ends, those that `kind` reports."""
    if kind == "overlapping":
        return found
    order = {"standard": lambda m: (m[2], m[1]), "leftmost_first": lambda m: (m[1], m[0]), "leftmost_longest": lambda m: (m[1], -m[2], m[0])}[kind]
    out, free = [], 0
    for m in sorted(found, key=order):
        if m[1] >= free:
            out.append(m)
            free = m[2]
    return out


def literal_matches(text: Column, literals: list[str], kind: str = "leftmost_first") -> Column:
    """(literal, start, stop) of the matches of several literals, numbered in their order; of equal ones the first."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    numbers = {_needle(p): k for k, p in reversed(list(enumerate(literals)))}
    from textlode.operators.search import byte_places

    ship(SparkSession.active())
    schema = pa.list_(pa.struct([("literal", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))

    @F.arrow_udf("array<struct<literal:int,start:bigint,stop:bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p, k in numbers.items():
            automaton.add_word(p, (k, len(p)))
        automaton.make_automaton()
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                if t is None:
                    out.append(None)
                    continue
                found = chosen([(k, end + 1 - n, end + 1) for end, (k, n) in automaton.iter(t)], kind)
                ends = sorted({p for _, a, b in found for p in (a, b)})
                at = dict(zip(ends, map(byte_places(t), ends), strict=True))  # ascending, so that each stretch is measured once
                out.append([{"literal": k, "start": at[a], "stop": at[b]} for k, a, b in found])
            yield pa.array(out, schema)

    return run(text)


@functools.cache
def _expression(pattern: str):
    import regex

    return regex.compile(compile_patterns([pattern], whole_buffer=True).python)


class MatchesOf:
    """Rows (match_index, start, stop, match) of the matches of an expression in a text; for `LATERAL` in SQL."""

    def eval(self, text: str, pattern: str):
        from textlode.operators.search import byte_places, distinct_matches

        if text is not None and pattern is not None:
            at = byte_places(text)
            for n, m in enumerate(distinct_matches(_expression(pattern), text)):
                yield n, at(m.start()), at(m.end()), m[0]


def register(spark: SparkSession, name: str = "matches_of") -> None:
    """Make `MatchesOf` a table function of the session's SQL."""
    ship(spark)
    spark.udtf.register(name, F.udtf(MatchesOf, returnType="match_index int, start long, stop long, match string", useArrow=True))
