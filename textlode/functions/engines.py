"""Which engine runs a pattern, and the one outside of the JVM: Python's `regex`, with a limit of time for each search.

Java's engine runs what it knows; conditionals, recursion and `\\K` are not known to it. It backtracks, so that an unbounded
repetition of something that can itself be cut in many ways takes exponential time on a text that doesn't match. Such patterns
run outside too, behind a test by Arrow's linear-time matcher for an expression that accepts at least the same: a text that
can't match is rejected in linear time, and only others are searched, until the limit. Where that expression accepts just the
same, it alone says which lines match.
"""

from __future__ import annotations

from textlode.functions.byteview import code_points
from textlode.functions.dialect import Compiled, Node, empty

#: Seconds that one search of one text or line may take.
SEARCH_SECONDS = 60.0


def stripped(node: Node) -> Node:
    while node.kind in ("group", "cat") and len(node.parts) == 1:
        node = node.parts[0]
    return node


def unbounded(node: Node) -> bool:
    """A repetition without an upper bound (or a high one) that gives back what it took."""
    return node.kind == "rep" and (node.value[1] is None or node.value[1] > 32) and not node.value[3:]


def literal(node: Node) -> str | None:
    node = stripped(node)
    if node.kind == "cat":
        parts = [literal(p) for p in node.parts]
        return None if None in parts else "".join(parts)
    return f"{node.kind}{node.value}" if node.kind in ("lit", "set", "chars") else None


def many_ways(node: Node) -> bool:
    """Whether repetitions of the node can share out a text in many ways."""
    node = stripped(node)
    if node.kind == "rep":
        return unbounded(node) or many_ways(node.parts[0])
    if node.kind == "alt":
        texts = [t for p in node.parts if (t := literal(p)) is not None]
        return any(map(many_ways, node.parts)) or any(a is not b and b.startswith(a) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j)
    if node.kind == "cat":
        return any(many_ways(p) and all(empty(q) for q in node.parts if q is not p) for p in node.parts)
    return False


def hostile(node: Node) -> bool:
    """Whether a backtracking engine may take exponential time: an unbounded repetition of what has many ways."""
    return (unbounded(node) and many_ways(node.parts[0])) or any(map(hostile, node.parts))


def linear(node: Node) -> str:
    """An expression for a linear-time engine that accepts a text if the node does (and perhaps others: what it doesn't know
    is left out)."""
    kind = node.kind
    if kind in ("lit", "set"):
        bracket = node.value if kind == "set" else f"\\x{{{ord(node.value):x}}}"
        ranges = code_points(bracket, node.flags.ignore_case)
        return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]" if ranges else "[^\\x{0}-\\x{10ffff}]"
    if kind == "cat":
        return "(?:" + "".join(map(linear, node.parts)) + ")"
    if kind == "alt":
        return "(?:" + "|".join(map(linear, node.parts)) + ")"
    if kind == "group":
        return f"(?:{linear(node.parts[0])})"
    if kind == "rep":
        least, most = node.value[:2]
        if least > 100 or (most or 0) > 100:
            return f"(?:{linear(node.parts[0])}){'*' if not least else '+'}"
        return f"(?:{linear(node.parts[0])}){{{least},{'' if most is None else most}}}"
    if kind == "look":
        return f"(?:{linear(node.parts[0])})" if node.value == ">" else "(?:)"
    if kind in ("back", "recurse", "cond", "raw", "chars"):
        return r"[\x{0}-\x{10ffff}]*"
    if kind == "anchor" and not node.flags.crlf and (node.value in "Az" or node.value in "^$"):
        own = {"^": "(?m:^)", "$": "(?m:$)"} if node.flags.multi_line else {"^": r"\A", "$": r"\z"}
        return {"A": r"\A", "z": r"\z", **own}[node.value]
    return "(?:)"


def exact(node: Node) -> bool:
    """Whether `linear` accepts what the node does and nothing else."""
    kind = node.kind
    if kind in ("cat", "alt", "group"):
        return all(map(exact, node.parts))
    if kind == "rep":
        return not node.value[3:] and node.value[0] <= 100 and (node.value[1] or 0) <= 100 and exact(node.parts[0])
    if kind == "anchor":
        return not node.flags.crlf and node.value in tuple("Az^$")
    return kind in ("lit", "set") and not node.flags.ignore_case


class Engine:
    """A pattern in Python's engine: searches end by a limit, and those that must fail end in linear time if it is hostile."""

    def __init__(self, pattern: Compiled | str) -> None:
        import regex

        text, self.linear = (pattern, None) if isinstance(pattern, str) else (pattern.python, pattern.linear)
        self.found = regex.compile(text)
        self.groups = self.found.groups

    def search(self, text: str, at: int = 0):
        if self.linear and at == 0:
            import pyarrow as pa
            import pyarrow.compute as pc

            if not pc.match_substring_regex(pa.array([text]), self.linear)[0].as_py():
                return None
        try:
            return self.found.search(text, at, timeout=SEARCH_SECONDS)
        except TimeoutError:
            raise ValueError(f"a search took more than {SEARCH_SECONDS:g} seconds: {self.found.pattern[:200]!r}") from None
