"""The pattern dialect: parser, and translation to Java's and Python's regular expressions.

The dialect is that of a linear-time engine: Unicode classes by default, no look-around or backreferences, `$` only at
the end or before a line feed, set operators in classes, named groups, inline flags `i m s R U u x`. Every class, anchor
and boundary is spelled out in the target, because Java gives most of them another meaning.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace

WORD = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
ASCII_WORD = "0-9A-Za-z_"
#: POSIX class names.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7f", "blank": r"\t ", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0b\f\r ", "upper": "A-Z", "word": ASCII_WORD, "xdigit": "0-9A-Fa-f",
}
#: Long names of general categories.
CATEGORIES = {
    "letter": "L", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo", "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me",
    "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No", "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe",
    "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So",
    "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
BOOLEANS = {"alphabetic": "IsAlphabetic", "uppercase": "IsUppercase", "lowercase": "IsLowercase", "whitespace": "IsWhite_Space", "ideographic": "IsIdeographic", "emoji": "IsEmoji"}
SHORT = frozenset({v for v in CATEGORIES.values()})
META = frozenset("\\.+*?()|[]{}^$#&-~/ ")
BOUNDS = {"start": "start", "end": "end", "start-half": "start-half", "end-half": "end-half"}


class PatternError(ValueError):
    """The pattern is not valid in the dialect."""


#: Horizontal and vertical white space, as class bodies.
HORIZONTAL = r"\t\x{20}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
VERTICAL = r"\n\x0b\f\r\x{85}\x{2028}\x{2029}"


class BytesNeeded(PatternError):
    """The pattern asks for bytes by their values, which a text column doesn't show."""


@dataclass(frozen=True)
class Flags:
    ignore_case: bool = False
    multi_line: bool = True
    dot_all: bool = False
    crlf: bool = False
    swap: bool = False
    unicode: bool = True
    verbose: bool = False


@dataclass
class Node:
    """kind: lit, set, cat, alt, rep, group, anchor, empty, raw. Nodes carry the flags they were read under."""

    kind: str
    flags: Flags
    value: object = None
    parts: list = field(default_factory=list)


@dataclass
class Compiled:
    """A translated pattern and what the planner needs to know of it."""

    java: str
    python: str
    names: dict[str, int]
    n_groups: int
    can_be_empty: bool
    can_match_newline: bool
    literals: list[str] | None  # every match holds one of these; None: unknown
    sure_groups: frozenset[int] = frozenset()  # groups that take part in every match
    of_bytes: bool = False  # an expression over the Latin-1 view of bytes
    outside: bool = False  # not for Java's engine: it doesn't know the syntax, or would take exponential time
    linear: str | None = None  # for those that would: what a linear-time engine may reject a text by
    exact: bool = False  # whether that expression accepts just the same


class Parser:
    def __init__(self, pattern: str, flags: Flags, look_around: bool = False) -> None:
        self.text, self.at, self.flags, self.look_around = pattern, 0, flags, look_around
        self.names: dict[str, int] = {}
        self.groups = 0
        self.outside = False  # whether Java's engine doesn't know the syntax
        self.calls: list[str] = []  # groups that are called
        self.bytes = False  # whether a byte above 127 is asked for by its value

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        out = self.text[self.at : self.at + n]
        if len(out) < n:
            raise PatternError(f"unexpected end of pattern: {self.text!r}")
        self.at += n
        return out

    def parse(self) -> Node:
        out = self.alternatives()
        if self.at < len(self.text):
            raise PatternError(f"unopened group at {self.at}: {self.text!r}")
        return out

    def alternatives(self) -> Node:
        kept = self.flags
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        flags, self.flags = self.flags, kept
        return branches[0] if len(branches) == 1 else Node("alt", flags, parts=branches)

    def sequence(self) -> Node:
        parts: list[Node] = []
        while self.at < len(self.text) and self.peek() not in ("|", ")"):
            if self.flags.verbose and self.peek().isspace():
                self.take()
                continue
            if self.flags.verbose and self.peek() == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end + 1
                continue
            if self.peek() in ("*", "+", "?") or (self.peek() == "{" and self.counted(dry=True)):
                if not parts or parts[-1].kind == "flags":
                    raise PatternError(f"repetition without an expression at {self.at}: {self.text!r}")
                parts[-1] = self.repeated(parts[-1])
                continue
            parts.append(self.atom())
        parts = [p for p in parts if p.kind != "flags"]
        return Node("cat", self.flags, parts=parts) if len(parts) != 1 else parts[0]

    def counted(self, dry: bool = False) -> tuple[int, int | None] | None:
        start, end = self.at, self.text.find("}", self.at)
        body = self.text[start + 1 : end].replace(" ", "") if end > 0 else ""
        low, comma, high = body.partition(",")
        if not (low.isdigit() and (not high or high.isdigit())):
            raise PatternError(f"invalid repetition at {start}: {self.text!r}")
        if not dry:
            self.at = end + 1
        least, most = int(low), (int(high) if high else None) if comma else int(low)
        if most is not None and most < least:
            raise PatternError(f"repetition range out of order: {self.text!r}")
        return least, most

    def repeated(self, node: Node) -> Node:
        c = self.peek()
        if c == "{":
            least, most = self.counted()
        else:
            self.take()
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        lazy = self.flags.swap
        if self.peek() == "?":
            self.take()
            lazy = not lazy
        elif self.peek() == "+" and self.look_around:
            self.take()
            return Node("rep", self.flags, (least, most, False, "possessive"), [node])
        return Node("rep", self.flags, (least, most, lazy), [node])

    def atom(self) -> Node:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return Node("set", self.flags, self.bracket())
        if c == ".":
            f = self.flags
            return Node("set", f, r"\x{0}-\x{10ffff}" if f.dot_all else r"^\r\n" if f.crlf else r"^\n")
        if c in "^$":
            return Node("anchor", self.flags, c)
        if c == "\\":
            return self.escape()
        return Node("lit", self.flags, c)

    def group(self) -> Node:
        if self.peek() != "?":
            self.groups += 1
            number = self.groups
            return self.close(Node("group", self.flags, number, [self.alternatives()]))
        self.take()
        if self.look_around and (node := self.backtracking_group()):
            return node
        for head in ("P<", "<"):
            if self.peek(len(head)) == head and not (head == "<" and self.peek(2) in ("<=", "<!")):
                self.take(len(head))
                end = self.text.find(">", self.at)
                name = self.text[self.at : end]
                if end < 0 or not name or name[0].isdigit() or not name.replace("_", "a").replace(".", "a").replace("[", "a").replace("]", "a").isalnum():
                    raise PatternError(f"invalid group name: {self.text!r}")
                if name in self.names:
                    raise PatternError(f"duplicate group name {name!r}")
                self.at = end + 1
                self.groups += 1
                self.names[name] = number = self.groups
                return self.close(Node("group", self.flags, number, [self.alternatives()]))
        for look in ("=", "!", "<=", "<!", ">"):
            if self.peek(len(look)) == look:
                if not self.look_around:
                    raise PatternError(f"look-around is not supported: {self.text!r}")
                self.take(len(look))
                return self.close(Node("look", self.flags, look, [self.alternatives()]))
        flags, on = self.flags, True
        keys = {"i": "ignore_case", "m": "multi_line", "s": "dot_all", "R": "crlf", "U": "swap", "u": "unicode", "x": "verbose"}
        if self.peek() == ")":
            raise PatternError(f"no flags: {self.text!r}")
        while (c := self.take()) not in (":", ")"):
            if c == "-":
                on = False
            elif c in keys:
                flags = replace(flags, **{keys[c]: on})
            else:
                raise PatternError(f"unknown flag {c!r}: {self.text!r}")
        if c == ")":
            self.flags = flags
            return Node("flags", flags)
        kept, self.flags = self.flags, flags
        inner = self.alternatives()
        self.flags = kept
        return self.close(Node("group", flags, None, [inner]))

    def close(self, node: Node) -> Node:
        if self.peek() != ")":
            raise PatternError(f"unclosed group: {self.text!r}")
        self.take()
        return node

    def codepoint(self, c: str) -> str | None:
        """The character of a hexadecimal escape that starts with c."""
        digits = {"x": 2, "u": 4, "U": 8}.get(c)
        if digits is None:
            return None
        if self.peek() == "{":
            end = self.text.find("}", self.at)
            body, self.at = self.text[self.at + 1 : end], end + 1
        else:
            body = self.take(digits)
        try:
            return chr(int(body, 16))
        except (ValueError, OverflowError):
            raise PatternError(f"invalid escape: {self.text!r}") from None

    def simple_escape(self, c: str) -> str | None:
        plain = {"a": "\x07", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\v"}
        if c in plain:
            return plain[c]
        if (found := self.codepoint(c)) is not None:
            return found
        return c if not c.isalnum() and c not in "<>" and ord(c) < 128 else None

    def perl(self, c: str) -> str | None:
        u = self.flags.unicode
        sets = {"d": r"\p{Nd}" if u else "0-9", "s": r"\p{IsWhite_Space}" if u else r"\t\n\x0b\f\r ", "w": WORD if u else ASCII_WORD}
        body = sets.get(c.lower())
        return body and (f"^{body}" if c.isupper() else body)

    def property(self, negated: bool) -> str:
        if self.peek() == "{":
            end = self.text.find("}", self.at)
            if end < 0:
                raise PatternError(f"unclosed property: {self.text!r}")
            name, self.at = self.text[self.at + 1 : end], end + 1
        else:
            name = self.take()
        if name.startswith("^"):
            name, negated = name[1:], not negated
        if "!=" in name:
            name, negated = name.replace("!=", "="), not negated
        key, _, value = name.replace(":", "=").rpartition("=")
        plain = value.lower().replace("_", "").replace("-", "").replace(" ", "")
        key = key.lower().replace("_", "")
        if plain in ("casedletter", "lc"):
            body = r"\p{Lu}\p{Ll}\p{Lt}"
        elif plain in ("any", "ascii", "assigned") and not key:
            body = {"any": r"\x{0}-\x{10ffff}", "ascii": r"\x00-\x7f", "assigned": r"\P{Cn}"}[plain]
        elif plain in BOOLEANS and not key:
            body = rf"\p{{{BOOLEANS[plain]}}}"
        elif plain in CATEGORIES or value.capitalize() in SHORT and key in ("", "gc", "generalcategory"):
            body = rf"\p{{{CATEGORIES.get(plain, value.capitalize())}}}"
        elif key in ("", "sc", "script", "scx", "scriptextensions") and property_ranges(f"Script={value}") is not None:
            body = rf"\p{{Is{value.replace(' ', '_').title()}}}"
        elif (found := property_ranges(f"{key}={value}" if key else value)) is not None:
            body = found
        else:
            raise PatternError(f"unknown property {name!r}")
        return f"^{body}" if negated else body

    def escape(self) -> Node:
        c = self.take()
        f = self.flags
        if self.look_around and (node := self.backtracking_escape(c)):
            return node
        if c in "pP":
            return Node("set", f, self.property(c == "P"))
        if body := self.perl(c):
            return Node("set", f, body)
        if c in "AzZGbB<>":
            if c == "b" and self.peek() == "{":
                end = self.text.find("}", self.at)
                name = self.text[self.at + 1 : end]
                if name in BOUNDS:
                    self.at = end + 1
                    return Node("anchor", f, name)
            if c in "ZG":
                raise PatternError(f"unknown escape \\{c}: {self.text!r}")
            return Node("anchor", f, {"<": "start", ">": "end"}.get(c, c))
        if c.isdigit():
            if self.look_around and c != "0":
                return Node("back", f, int(c))
            raise PatternError(f"backreferences are not supported: {self.text!r}")
        found = self.simple_escape(c)
        if found is None:
            raise PatternError(f"unknown escape \\{c}: {self.text!r}")
        if self.is_byte(c, found):
            return Node("byte", f, ord(found))
        return Node("lit", f, found)

    def backtracking_escape(self, c: str) -> Node | None:
        """Escapes that only the backtracking dialect has."""
        f = self.flags
        if c in "hHvVN":
            body = {"h": HORIZONTAL, "v": VERTICAL, "n": r"\n"}[c.lower()]
            return Node("set", f, f"^{body}" if c.isupper() else body)
        if c == "R":
            return Node("raw", f, rf"(?>\r\n|[{VERTICAL}])")
        if c == "K":
            self.outside = True
            return Node("raw", f, r"\K")
        if c == "G":
            return Node("raw", f, r"\G")
        if c == "Z":
            return Node("raw", f, r"(?=\n?(?![\x{0}-\x{10ffff}]))")
        if c == "Q":
            end = self.text.find("\\E", self.at)
            body, self.at = (self.text[self.at :], len(self.text)) if end < 0 else (self.text[self.at : end], end + 2)
            return Node("cat", f, parts=[Node("lit", f, x) for x in body])
        if c in "kg" and self.peek() in ("{", "<", "'") or c == "g" and (self.peek().isdigit() or self.peek() == "-"):
            if self.peek() in ("{", "<", "'"):
                end = self.text.find({"{": "}", "<": ">", "'": "'"}[self.take()], self.at)
                name, self.at = self.text[self.at : end], end + 1
            else:
                name = self.take()
                while self.peek().isdigit() or name == "-":
                    name += self.take()
            return Node("back", f, self.group_number(name))
        return None

    def group_number(self, name: str) -> int:
        """The number of a group by its name, its number, or its distance back."""
        if name.lstrip("-").isdigit():
            n = int(name)
            return n if n > 0 else self.groups + 1 + n
        if name not in self.names:
            raise PatternError(f"unknown group {name!r}: {self.text!r}")
        return self.names[name]

    def backtracking_group(self) -> Node | None:
        """Groups after `(?` that only the backtracking dialect has."""
        f, rest = self.flags, self.text[self.at :]
        if rest.startswith("P="):
            end = rest.find(")")
            self.at += end + 1
            return Node("back", f, self.group_number(rest[2:end]))
        for head in ("R", "0", "&", "P>", *"123456789"):
            if rest.startswith(head) and (end := rest.find(")")) > 0:
                name = rest[len(head) if head in ("&", "P>") else 0 : end]
                if head in ("&", "P>"):
                    name = f"&{name}"
                elif name not in ("R", "0") and not name.isdigit():
                    continue
                self.outside = True
                self.calls.append(name.removeprefix("&"))
                self.at += end + 1
                return Node("recurse", f, name)
        if rest.startswith("("):
            end = rest.find(")")
            name = rest[1:end].strip("<>'")
            self.at += end + 1
            self.outside = True
            inner = self.alternatives()
            branches = inner.parts if inner.kind == "alt" else [inner]
            if len(branches) > 2:
                raise PatternError(f"a condition has two branches at most: {self.text!r}")
            return self.close(Node("cond", f, self.group_number(name), branches))
        return None

    def is_byte(self, c: str, found: str) -> bool:
        """Whether an escape is one byte of any value: a two-digit one with Unicode off."""
        of_bytes = c == "x" and not self.flags.unicode and 128 <= ord(found) < 256
        self.bytes = self.bytes or of_bytes
        return of_bytes

    # Bracket classes. A set is text that may stand between brackets in Java; a leading ^ negates it.
    def bracket(self) -> str:
        negated = False
        if self.peek() == "^":
            self.take()
            negated = True
        left, items = None, []
        operator = None
        first = True

        def union() -> str:
            return items[0] if len(items) == 1 else "".join(f"[{i}]" if i.startswith("^") else i for i in items) if items else r"^\x{0}-\x{10ffff}"

        def combined() -> str:
            own = union()
            if operator is None:
                return own
            if operator == "&&":
                return f"[{left}]&&[{own}]"
            minus = lambda a, b: f"[{a}]&&[\\x{{0}}-\\x{{10ffff}}&&[^{b}]]" if not b.startswith("^") else f"[{a}]&&[{b[1:]}]"
            nested = own if "&&" not in own else f"[{own}]"
            inner = left if "&&" not in left else f"[{left}]"
            return minus(inner, nested) if operator == "--" else f"[{minus(inner, nested)}][{minus(nested, inner)}]"

        while True:
            if not self.peek():
                raise PatternError(f"unclosed class: {self.text!r}")
            if self.peek() == "]" and not (first and not items):
                self.take()
                break
            if self.peek(2) in ("&&", "--", "~~"):
                left, operator_next, = combined(), self.take(2)
                operator, items = operator_next, []
                first = False
                continue
            first = False
            items.append(self.item())
        body = combined()
        if not negated:
            return body
        return body[1:] if body.startswith("^") else f"^{body}" if "&&" not in body else rf"\x{{0}}-\x{{10ffff}}&&[^{body}]"

    def item(self) -> str:
        if self.peek(2) == "[:":
            end = self.text.find(":]", self.at)
            name = self.text[self.at + 2 : end]
            if end > 0 and name.removeprefix("^") in POSIX:
                self.at = end + 2
                body = POSIX[name.removeprefix("^")]
                return f"^{body}" if name.startswith("^") else body
        if self.peek() == "[":
            self.take()
            return f"[{self.bracket()}]"
        low = self.class_char()
        if len(low) > 1 and low[0] == "\0":
            return low[1:]
        if self.peek() == "-" and self.peek(2) not in ("--", "-]"):
            self.take()
            high = self.class_char()
            if len(high) > 1 or high < low:
                raise PatternError(f"invalid class range: {self.text!r}")
            return f"{quoted(low)}-{quoted(high)}"
        return quoted(low)

    def class_char(self) -> str:
        """A character, or NUL and a set."""
        c = self.take()
        if c != "\\":
            if not self.flags.unicode and not c.isascii():
                raise PatternError(f"a class of bytes can't hold the character {c!r}: {self.text!r}")
            return c
        c = self.take()
        if c in "pP":
            return "\0" + self.property(c == "P")
        if body := self.perl(c):
            return "\0" + body
        found = self.simple_escape(c)
        if found is None:
            raise PatternError(f"unknown escape \\{c}: {self.text!r}")
        self.is_byte(c, found)
        return found


@functools.lru_cache(maxsize=256)
def property_ranges(name: str) -> str | None:
    """A property that Java doesn't name (break properties, other binary ones, blocks) as ranges, from the tables of Python's
    engine; None if that doesn't know it either."""
    import regex

    try:
        found = regex.compile(f"(?V1)[\\p{{{name}}}]+")
    except regex.error:
        return None
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = ""
    for m in found.finditer(every):
        low, high = ord(every[m.start()]), ord(every[m.end() - 1])
        parts = [(low, 0xD7FF), (0xE000, high)] if low < 0xD800 <= high else [(low, high)]
        out += "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in parts)
    return out or r"^\x{0}-\x{10ffff}"


def quoted(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"


def _folds(node: Node, text: str) -> str:
    return f"(?iu:{text})" if node.flags.ignore_case and node.flags.unicode else f"(?i:{text})" if node.flags.ignore_case else text


def emit(node: Node) -> str:
    """Java text of a node; it can be repeated and joined as it is."""
    kind, f = node.kind, node.flags
    if kind == "lit":
        return _folds(node, quoted(node.value))
    if kind == "set":
        return _folds(node, f"[{node.value}]")
    if kind in ("raw", "chars"):
        return node.value
    if kind == "cat":
        return "(?:" + "".join(map(emit, node.parts)) + ")" if len(node.parts) != 1 else emit(node.parts[0])
    if kind == "alt":
        return "(?:" + "|".join(map(emit, node.parts)) + ")"
    if kind == "group":
        return f"({'' if node.value else '?:'}{emit(node.parts[0])})"
    if kind == "look":
        return f"(?{node.value}{emit(node.parts[0])})"
    if kind == "back":
        return f"\\{node.value}"
    if kind == "rep":
        least, most, lazy = node.value[:3]
        count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or f"{{{least}{'' if most == least else ',' if most is None else f',{most}'}}}"
        return f"(?:{emit(node.parts[0])}){count}{'+' if node.value[3:] else '?' if lazy else ''}"
    if kind == "recurse":
        return f"(?{node.value})"
    if kind == "cond":
        return f"(?({node.value}){'|'.join(map(emit, node.parts))})"
    w = WORD if f.unicode else ASCII_WORD
    before, not_before, after, not_after = f"(?<=[{w}])", f"(?<![{w}])", f"(?=[{w}])", f"(?![{w}])"
    start, end = r"(?<![\x{0}-\x{10ffff}])", r"(?![\x{0}-\x{10ffff}])"
    # with crlf a carriage return ends a line too, and nothing is between it and its line feed
    line_start = rf"(?:(?<=\n)|(?<=\r)(?!\n)|{start})" if f.crlf else rf"(?:(?<=\n)|{start})"
    line_end = rf"(?:(?=\r)|(?<!\r)(?=\n)|{end})" if f.crlf else rf"(?:(?=\n)|{end})"
    return {
        "^": line_start if f.multi_line else start,
        "$": line_end if f.multi_line else end,
        "A": start,
        "z": end,
        "b": f"(?:{before}{not_after}|{not_before}{after})",
        "B": f"(?:{before}{after}|{not_before}{not_after})",
        "start": f"(?:{not_before}{after})",
        "end": f"(?:{before}{not_after})",
        "start-half": not_before,
        "end-half": not_after,
    }[node.value]


def empty(node: Node) -> bool:
    """Whether the node can match the empty string."""
    if node.kind in ("lit", "set", "chars", "byte"):
        return False
    if node.kind == "rep":
        return node.value[0] == 0 or empty(node.parts[0])
    if node.kind == "alt":
        return any(map(empty, node.parts))
    return all(map(empty, node.parts)) if node.kind in ("cat", "group") else True


def newline(node: Node) -> bool:
    """Whether a match can hold a line feed (sets are asked by Python's engine)."""
    if node.kind == "lit":
        return node.value == "\n"
    if node.kind in ("set", "chars"):
        import regex

        return bool(regex.match(to_python(f"[{node.value}]" if node.kind == "set" else node.value), "\n"))
    if node.kind in ("back", "look"):
        return node.kind == "back"
    return any(map(newline, node.parts))


def says(node: Node, character: str) -> bool:
    """Whether the pattern spells out a character."""
    return node.kind == "lit" and node.value == character or any(says(p, character) for p in node.parts)


def sure(node: Node) -> set[int]:
    """Numbers of the groups that take part in every match."""
    if node.kind == "alt" or node.kind in ("look", "back") or (node.kind == "rep" and not node.value[0]):
        return set()
    own = {node.value} if node.kind == "group" and isinstance(node.value, int) else set()
    return own.union(*map(sure, node.parts)) if node.parts else own


def required(node: Node, limit: int = 100_000) -> list[str] | None:
    """Strings of which every match holds at least one; None if none is known (or more than `limit`). Case-insensitive text
    gives none."""
    if node.flags.ignore_case and node.kind in ("lit", "set"):
        return None
    if node.kind == "lit":
        return [node.value]
    if node.kind == "cat":
        best: list[str] | None = None
        run = ""
        runs: list[list[str]] = []
        for p in [*node.parts, Node("end", node.flags)]:
            if p.kind == "lit" and not p.flags.ignore_case:
                run += p.value
                continue
            if run:
                runs.append([run])
                run = ""
            if p.kind in ("alt", "group", "rep", "cat") and (inner := required(p, limit)):
                runs.append(inner)
        for r in runs:
            if best is None or min(map(len, r)) > min(map(len, best)):
                best = r
        return best
    if node.kind == "group" or (node.kind == "look" and node.value == ">"):
        return required(node.parts[0], limit)
    if node.kind == "rep":
        return required(node.parts[0], limit) if node.value[0] else None
    if node.kind == "alt":
        out: list[str] = []
        for p in node.parts:
            found = required(p, limit)
            if not found:
                return None
            out += found
        return list(dict.fromkeys(out)) if len(out) <= limit else None
    return None


def to_python(java: str) -> str:
    """The same expression for Python's `regex` module."""
    import re

    text = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U" + m[1].rjust(8, "0"), java)
    return "(?V1)" + text.replace("(?iu:", "(?i:")


def with_names(expression: str, names: dict[str, int]) -> str:
    """Calls by name as calls by number."""
    for name, number in names.items():
        expression = expression.replace(f"(?&{name})", f"(?{number})")
    return expression


FIXED_META = frozenset("\\.[](){}*+?^$|")


def escape_fixed(pattern: str) -> str:
    """A literal as a pattern."""
    return "".join(f"\\{c}" if c in FIXED_META else c for c in pattern)


def smart_case(patterns: list[str]) -> bool:
    """Whether smart case means case-insensitive: no ASCII capital in any pattern, escapes included."""
    return not any("A" <= c <= "Z" for p in patterns for c in p)


def compile_patterns(patterns: list[str], *, fixed: bool = False, case: str = "sensitive", word: bool = False, line: bool = False, flags: Flags | None = None, look_around: bool = False, whole_buffer: bool = False, of_bytes: bool = False, terminator: str = "\n") -> Compiled:
    """One ordered alternation of all patterns. No pattern at all matches nothing. With `of_bytes` the expressions are for
    the Latin-1 view of bytes; without, a pattern that asks for bytes is refused."""
    flags = flags or Flags()
    texts = [escape_fixed(p) for p in patterns] if fixed else list(patterns)
    if case == "insensitive" or (case == "smart" and smart_case(texts)):
        flags = replace(flags, ignore_case=True)
    if not texts:
        return Compiled(r"[^\x{0}-\x{10ffff}]", to_python(r"[^\x{0}-\x{10ffff}]"), {}, 0, False, False, None, of_bytes=of_bytes)
    for p in texts:
        Parser(p, flags, look_around).parse()  # each alone must be valid
    text = "|".join(f"(?:{p}\n)" if flags.verbose else f"(?:{p})" for p in texts) if len(texts) > 1 else texts[0]
    if line:
        text = f"^(?:{text})$"
    elif word:
        text = rf"\b{{start-half}}(?:{text})\b{{end-half}}"
    parser = Parser(text, flags, look_around)
    tree = parser.parse()
    if terminator == "\0" and not whole_buffer and says(tree, terminator):
        raise PatternError("the literal \\0 is not allowed in a pattern where it ends records")
    if of_bytes:
        from textlode.functions.byteview import view

        tree = view(tree)
    elif parser.bytes:
        raise BytesNeeded(f"a pattern of bytes needs a binary column: {text!r}")
    crosses = newline(tree)
    if terminator == "\n" and not whole_buffer and any("\n" in p or "\\n" in p.replace("\\\\", "") for p in texts) and crosses and required(tree) and any("\n" in r for r in required(tree)):
        raise PatternError("the literal \\n is not allowed in a pattern unless multi-line search is on")
    java = emit(tree)
    from textlode.functions.engines import exact, hostile, linear

    slow = not of_bytes and hostile(tree)
    if parser.calls:  # a called group is one by name or number; its name must be known to Python's engine
        java = with_names(java, parser.names)
    for name in parser.calls:
        if name not in ("R", "0"):
            if parser.group_number(name) > parser.groups:
                raise PatternError(f"unknown group {name!r}: {text!r}")
    return Compiled(java, to_python(java), parser.names, parser.groups, empty(tree), crosses, required(tree), frozenset(sure(tree)), of_bytes, parser.outside or slow, linear(tree) if slow else None, slow and not parser.outside and exact(tree))
