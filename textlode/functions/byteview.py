"""Patterns over bytes: each byte is one character of a Latin-1 view, and an expression over that view matches bytes.

A parsed pattern is rewritten node by node. What is Unicode becomes the UTF-8 bytes of it: a character its bytes, a class an
alternation of byte ranges by leading byte, a word boundary look-around over such a class. What is not stays a class of
bytes. The result is a tree of the same kind, so that everything known of patterns (required strings, groups, emptiness)
is found on it as before, and offsets in the view are byte offsets without any encoding.
"""

from __future__ import annotations

import functools
from dataclasses import replace

from textlode.functions.dialect import ASCII_WORD, WORD, Flags, Node, emit, to_python

#: The last code point of each length in UTF-8.
LENGTHS = (0x7F, 0x7FF, 0xFFFF, 0x10FFFF)
Ranges = tuple[tuple[int, int], ...]


@functools.cache
def _every_character() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@functools.lru_cache(maxsize=256)
def code_points(bracket: str, ignore_case: bool) -> Ranges:
    """Ranges of the code points in a class."""
    import regex

    found = regex.finditer(to_python(f"(?i:[{bracket}])" if ignore_case else f"[{bracket}]") + "+", _every_character())
    at = lambda k: k if k < 0xD800 else k + 0x800
    out: list[tuple[int, int]] = []
    for m in found:
        low, high = at(m.start()), at(m.end() - 1)
        out += [(low, 0xD7FF), (0xE000, high)] if low < 0xD800 <= high else [(low, high)]
    return tuple(out)


def byte_sequences(low: int, high: int) -> list[Ranges]:
    """A range of code points as sequences of byte ranges."""
    for last in LENGTHS:
        if low <= last < high:
            return byte_sequences(low, last) + byte_sequences(last + 1, high)
    if high < 0x80:
        return [((low, high),)]
    for bits in (18, 12, 6):  # both ends in one block of continuation bytes, or whole blocks of them
        mask = (1 << bits) - 1
        if low >> bits != high >> bits and bits < (5 + 6 * (len(chr(low).encode()) - 1)):
            if low & mask:
                return byte_sequences(low, low | mask) + byte_sequences((low | mask) + 1, high)
            if high & mask != mask:
                return byte_sequences(low, (high & ~mask) - 1) + byte_sequences(high & ~mask, high)
    return [tuple(zip(chr(low).encode(), chr(high).encode(), strict=True))]


def _bracket(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if a < b else f"\\x{{{a:x}}}" for a, b in sorted(ranges))


def _tree(sequences: list[Ranges]) -> str:
    """An expression for sequences of byte ranges: those that go on in the same way share one class of first bytes."""
    by_rest: dict[tuple, list[tuple[int, int]]] = {}
    by_first: dict[tuple[int, int], list[Ranges]] = {}
    for s in sequences:
        by_first.setdefault(s[0], []).append(s[1:])
    for first, rest in by_first.items():
        by_rest.setdefault(tuple(sorted(rest)), []).append(first)
    parts = [f"[{_bracket(firsts)}]" + ("" if rest == ((),) else _tree(list(rest))) for rest, firsts in sorted(by_rest.items(), key=lambda x: min(x[1]))]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


@functools.lru_cache(maxsize=256)
def class_expression(bracket: str, ignore_case: bool = False) -> str:
    """A class of characters as an expression over bytes; a class that holds nothing matches nothing."""
    sequences = [s for low, high in code_points(bracket, ignore_case) for s in byte_sequences(low, high)]
    return _tree(sequences) if sequences else r"[^\x{0}-\x{10ffff}]"


def _byte_class(bracket: str, ignore_case: bool) -> str:
    """A class of bytes with ASCII case folding spelled out."""
    held = {c for low, high in code_points(bracket, False) for c in range(low, min(high, 255) + 1)}
    if ignore_case:
        held |= {ord(chr(c).swapcase()) for c in held if chr(c).isascii() and chr(c).isalpha()}
    ranges: list[tuple[int, int]] = []
    for c in sorted(held):
        ranges = [*ranges[:-1], (ranges[-1][0], c)] if ranges and ranges[-1][1] == c - 1 else [*ranges, (c, c)]
    return _bracket(ranges) or r"^\x{0}-\x{10ffff}"


def view(node: Node) -> Node:
    """The tree over the Latin-1 view of bytes that matches what `node` matches."""
    plain: Flags = replace(node.flags, ignore_case=False, unicode=False)
    if node.kind == "byte":
        return Node("lit", plain, chr(node.value))
    if node.kind == "lit" and not (node.flags.ignore_case and (node.flags.unicode or node.value.isascii()) and node.value.isalpha()):
        letters = [Node("lit", plain, chr(b)) for b in node.value.encode()]
        return letters[0] if len(letters) == 1 else Node("cat", plain, parts=letters)
    if node.kind in ("lit", "set"):
        bracket = node.value if node.kind == "set" else f"\\x{{{ord(node.value):x}}}"
        if not node.flags.unicode:
            return Node("set", plain, _byte_class(bracket, node.flags.ignore_case))
        ranges = code_points(bracket, node.flags.ignore_case)
        if all(high < 128 for _, high in ranges) and ranges:
            return Node("set", plain, _bracket(list(ranges)))
        return Node("chars", plain, class_expression(bracket, node.flags.ignore_case))
    if node.kind == "anchor" and node.flags.unicode and node.value not in ("^", "$", "A", "z"):
        # the anchor's own expression, with the word class put in as bytes
        return Node("raw", plain, emit(Node("anchor", node.flags, node.value)).replace(f"[{WORD}]", class_expression(WORD)))
    if node.kind == "anchor":
        return Node("anchor", plain, node.value)
    return Node(node.kind, plain, node.value, [view(p) for p in node.parts])


def as_bytes(text: str) -> bytes:
    return text.encode("latin-1")


__all__ = ["ASCII_WORD", "as_bytes", "byte_sequences", "class_expression", "code_points", "view"]
