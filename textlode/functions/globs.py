"""Globs: `?`, `*`, `**` as a whole component, classes, nested alternates and escapes, as anchored regular expressions."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlode.functions.dialect import to_python, quoted


class GlobError(ValueError):
    """UnclosedClass, InvalidRange, UnopenedAlternates, UnclosedAlternates or DanglingEscape, as the message."""


@dataclass(frozen=True)
class GlobOptions:
    literal_separator: bool = False
    backslash_escape: bool = True
    ignore_case: bool = False
    basename: bool = False
    empty_alternates: bool = False


def escape(text: str) -> str:
    return "".join(f"[{c}]" if c in "?*[]{}" else c for c in text)


def to_regex(glob: str, options: GlobOptions = GlobOptions()) -> str:
    """Java text that matches a whole path."""
    any_char = "[^/]" if options.literal_separator else r"[\x{0}-\x{10ffff}]"
    out, depth, at, n = "", 0, 0, len(glob)
    while at < n:
        c = glob[at]
        if c == "?":
            out += any_char
        elif c == "*":
            end = at
            while end < n and glob[end] == "*":
                end += 1
            whole = end - at >= 2 and (at == 0 or glob[at - 1] == "/") and (end == n or glob[end] == "/")
            if whole and at == 0 and end == n:
                out += r"[\x{0}-\x{10ffff}]*"
            elif whole and at == 0:
                out += r"(?:/?|[\x{0}-\x{10ffff}]*/)"
                end += 1
            elif whole and end == n:
                out += r"[\x{0}-\x{10ffff}]*" if out.endswith("/") else ""
                out = out[:-1] + r"[\x{0}-\x{10ffff}]+" if not out else out
            elif whole:
                out = out.removesuffix("/") + r"(?:/|/[\x{0}-\x{10ffff}]*/)"
                end += 1
            else:
                out += f"{any_char}*"
            at = end - 1
        elif c == "[":
            end = at + 1
            negated = end < n and glob[end] in "!^"
            end += negated
            items, first = "", True
            while True:
                if end >= n:
                    raise GlobError("UnclosedClass")
                if glob[end] == "]" and not first:
                    break
                first = False
                low = glob[end]
                if end + 2 < n and glob[end + 1] == "-" and glob[end + 2] != "]":
                    high = glob[end + 2]
                    if high < low:
                        raise GlobError("InvalidRange")
                    items += f"{quoted(low)}-{quoted(high)}"
                    end += 3
                else:
                    items += quoted(low)
                    end += 1
            out += f"[{'^' if negated else ''}{items}]" if not options.literal_separator else f"(?!/)[{'^' if negated else ''}{items}]"
            at = end
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}":
            if not depth:
                raise GlobError("UnopenedAlternates")
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and options.backslash_escape:
            if at + 1 >= n:
                raise GlobError("DanglingEscape")
            at += 1
            out += quoted(glob[at])
        else:
            out += "/" if c == "/" else quoted(c)
        at += 1
    if depth:
        raise GlobError("UnclosedAlternates")
    return rf"\A{'(?iu:' if options.ignore_case else '(?:'}{out})\z"


def matches(path: Column, glob: str, options: GlobOptions = GlobOptions()) -> Column:
    """Whether a path (its base name, for such globs) matches."""
    subject = F.substring_index(path, "/", -1) if options.basename else path
    if not options.ignore_case and (options.basename or not options.literal_separator) and glob.startswith("*.") and not set(glob[2:]) & set("?*[]{}\\/"):
        return F.endswith(subject, F.lit(glob[1:]))
    return subject.rlike(to_regex(glob, options))


def matching_indexes(path: Column, globs: list[str], options: GlobOptions = GlobOptions()) -> Column:
    """Ascending positions (from 0) of the globs that match."""
    hits = [F.when(matches(path, g, options), F.lit(k)) for k, g in enumerate(globs)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")


def any_match(path: Column, globs: list[str], options: GlobOptions = GlobOptions()) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | matches(path, g, options)
    return out


def all_match(path: Column, globs: list[str], options: GlobOptions = GlobOptions()) -> Column:
    out = F.lit(True)
    for g in globs:
        out = out & matches(path, g, options)
    return out


def last_index(path: Column, globs: list[str], options: GlobOptions = GlobOptions()) -> Column:
    return F.array_max(matching_indexes(path, globs, options))


def override(path: Column, globs: list[str], ignore_case: bool = False) -> Column:
    """-g semantics: the last glob that matches decides (`!` excludes); with any including glob, other files are out."""
    admitted = F.lit(not any(not g.startswith("!") for g in globs))
    for g in globs:
        negated, body = g.startswith("!"), g.removeprefix("!")
        anchored = "/" in body.strip("/") or body.startswith("/")
        options = GlobOptions(literal_separator=True, ignore_case=ignore_case, basename=not anchored)
        admitted = F.when(matches(path, body.removeprefix("/"), options), F.lit(not negated)).otherwise(admitted)
    return admitted


@functools.lru_cache(maxsize=100_000)
def expression(glob: str, options: GlobOptions):
    """The glob for Python's engine, for code that has one path at a time (a walk)."""
    import regex

    return regex.compile(to_python(to_regex(glob, options)).replace(r"\z", r"\Z"))


def hits(path: str, glob: str, options: GlobOptions = GlobOptions()) -> bool:
    """`matches` for one path."""
    return expression(glob, options).search(path.rpartition("/")[2] if options.basename else path) is not None


def overridden(path: str, globs: tuple[str, ...], ignore_case: bool = False) -> bool:
    """`override` for one path."""
    admitted = not any(not g.startswith("!") for g in globs)
    for g in globs:
        negated, body = g.startswith("!"), g.removeprefix("!")
        anchored = "/" in body.strip("/") or body.startswith("/")
        if hits(path, body.removeprefix("/"), GlobOptions(literal_separator=True, ignore_case=ignore_case, basename=not anchored)):
            admitted = not negated
    return admitted
