"""Personal data: emails, IP addresses, payment cards and phone numbers.

Base spans are fixed patterns with validators. High-recall generators propose further, overlapping spans (spelled-out
emails, numbers with other separators or without a plus sign, IPv6 addresses); boosted trees score each from its format
and its context (a number also from the digits that stand beside it), and a calibrated threshold for each kind, set for
precision on held-out rows, selects redactions. Base spans always stay; an added span never overlaps another span.

`train` fits the trees on candidates from the texts themselves: of the kind are their base spans, rewritten in formats
that no base pattern has; look-alikes are candidates that a validator refuses, and wrong stretches of the rewritten ones.
At most `REAL_ROWS` of each kind and truth are used (a bounded sample of labelled rows, chosen by a hash over all texts),
beside `TRAINING_ROWS` generated ones of each kind; thresholds are set on held-out rows of both. Texts without any
personal data leave the generated ones alone.

Rows: null text has no spans; repeated rows and null ids pass through one by one; offsets count code points; other
columns are left alone.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.batches import arrow_map
from textlode.llm.boosting import Boosted, held_out
from textlode.session import drop_path, materialise, workspace

KINDS = ("email", "ip", "card", "phone")
TRAINING_ROWS, REAL_ROWS, SEED, PRECISION, CONTEXT = 1200, 1500, 7, 0.98, 40
#: Candidates that are scored at once.
BLOCK = 4000

# Base patterns. A run of characters is left where it started or not at all, so that long runs are read once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> list[Span]:
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = max(free, m.start())
    return out


def _ips(text: str) -> list[Span]:
    out, at = [], 0
    while m := _IP.search(text, at):
        at = m.end()
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans in the order start, kind."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += _ips(text)
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Generators: as much as may be personal data, in windows of bounded length around rare anchors.
_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}| at ", re.IGNORECASE)
_NAME_BACK = re.compile(r"\s?[\w.+-]{1,64}")
_HOST = re.compile(r"\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot )\s?[\w-]{1,63}){1,4}", re.IGNORECASE)
_RUN = re.compile(r"[0-9]++(?:[ ().:/\-]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_LEAD = re.compile(r"\(?\+?")
LEAST_DIGITS, MOST_DIGITS = 7, 19
_SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_SPACED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9])")


def _numbers(text: str) -> Iterator[Span]:
    """Of each run of digit groups, every stretch of whole groups with as many digits as a card or a phone number has."""
    for run in _RUN.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, run.start(), run.end())]
        for i, (a, _) in enumerate(groups):
            start, n = a - _LEAD.match(text[max(0, a - 2) : a][::-1]).end(), 0
            for x, b in groups[i : i + MOST_DIGITS]:  # a group has a digit at least
                n += b - x
                if n > MOST_DIGITS:
                    break
                if n >= 13:
                    yield "card", start, b
                if LEAST_DIGITS <= n <= 15:
                    yield "phone", start, b


def candidates(text: str) -> Iterator[Span]:
    """In proportion to the text, one after another: a run of numbers alone has up to 16 for each of its groups."""
    for m in _AT.finditer(text):
        left = _NAME_BACK.match(text[max(0, m.start() - 66) : m.start()][::-1])
        right = _HOST.match(text, m.end(), m.end() + 200)
        if left and right:
            a = m.start() - left.end()
            a += len(text[a : m.start()]) - len(text[a : m.start()].lstrip())
            yield "email", a, right.end()
    if _DIGIT.search(text):
        yield from (("ip", m.start(), m.end()) for m in _SPACED_IP.finditer(text))
        if text.count(":") >= 3:
            yield from (("ip", m.start(), m.end()) for m in _SIX.finditer(text))
        yield from _numbers(text)


#: Words that stand near personal data.
_NEAR = [re.compile(p, re.IGNORECASE) for p in (r"e-?mail|mailto|contact|write", r"\bip\b|host|server|address|ping", r"card|visa|master|amex|credit|paid|pay", r"phone|tel\b|tel[.:]|call|fax|mobile|cell|dial", r"order|invoice|isbn|version|\bv\b|date|ref|serial|part|id\b")]
_TLD = re.compile(r"(?<![^\W_])(?:com|org|net|edu|gov|io|info|co|uk|de|fr|es|example)$", re.IGNORECASE)
_DIGITS_BEFORE, _DIGITS_AFTER = re.compile(r"([0-9]+)([ ().:/\-]{1,3}\+?)$"), re.compile(r"[ ().:/\-]{1,3}([0-9]+)")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ](?:0?[1-9]|1[0-2])[-/. ]|(?:0?[1-9]|[12][0-9]|3[01])[-/. ](?:0?[1-9]|1[0-2])[-/. ](?:19|20)[0-9]{2}")


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    _, a, b = span
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    near = f"{before} {after}"
    left, right = _DIGITS_BEFORE.search(before), _DIGITS_AFTER.match(after)
    return [
        len(s), len(digits), len(groups), min(sizes), max(sizes), float(sizes == [3, 3, 4] or sizes[-3:] == [3, 3, 4]),
        float(len(set(sizes)) == 1), float(luhn(digits)) if digits else 0.0, float(all(len(g) <= 3 and int(g) <= 255 for g in groups)) if len(groups) == 4 else 0.0,
        float(s.startswith(("+", "00"))), float("(" in s and ")" in s), float("@" in s), float(bool(re.search(r"[(\[{](?:at|dot)[)\]}]", s, re.I))), float(bool(re.search(r" at .* dot ", s, re.I))),
        float(bool(_TLD.search(s))), float(bool(_DATE.search(s))), s.count(":"), s.count("/"), s.count("."), s.count("-"), s.count(" "), len(set(re.findall(r"[^\w]", s))),
        float(a > 0 and (text[a - 1].isalnum() or text[a - 1] in "-./_")), float(b < len(text) and text[b].isalnum()), float(digits[:1] in ("3", "4", "5", "6")) if digits else 0.0,
        *(float(bool(p.search(near))) for p in _NEAR),
        float(len(left[1])) if left else 0.0, float(left[2] != " ") if left else 0.0, float("+" in before[max(0, left.start() - 1) : left.start()]) if left else 0.0,
        float(len(right[1])) if right else 0.0, float(not right[0].startswith(" ")) if right else 0.0, sizes[0], sizes[-1], float(bool(re.search(r"[0-9] [0-9]", s))), float(bool(re.search(r"[0-9][-./:][0-9]", s))), float(bool(re.search(r"[0-9] ?[(+]", s[2:]))),
    ]


def _card_number(rnd: random.Random, n: int, valid: bool) -> str:
    body = rnd.choice("3456") + "".join(rnd.choice("0123456789") for _ in range(n - 2))
    check = next(c for c in "0123456789" if luhn(body + c))
    return body + (check if valid else rnd.choice([c for c in "0123456789" if c != check]))


def _example(rnd: random.Random, kind: str, real: bool) -> str:
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(2, 8)))
    num = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    octet = lambda: str(rnd.randint(0, 255))
    if kind == "email":
        host, tld = word(), rnd.choice(["com", "org", "net", "de", "io", "co.uk"])
        if real:
            return rnd.choice([f"{word()}@{host}.{tld}", f"{word()}.{word()} (at) {host} (dot) {tld}", f"{word()}[at]{host}[dot]{tld}", f"{word()} at {host} dot {tld}", f"{word()} @ {host}.{tld}", f"{word()} [at] {host}.{tld}"])
        return rnd.choice([f"{word()} at {word()}.{word().capitalize()}", f"{word()} at {word()}. {word().capitalize()}", f"{word()} @ {word()}. {word()}", f"{word()} at {num(1)}.{num(2)}", f"{word()} at {word()}. The"])
    if kind == "ip":
        if real:
            return rnd.choice([".".join(octet() for _ in range(4)), " . ".join(octet() for _ in range(4)), ":".join("".join(rnd.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))])
        return rnd.choice([f"{num(1)}.{num(1)}.{num(1)}.{num(1)}", f"{num(1)}. {num(1)}. {num(1)}. {num(1)}", f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", ".".join(str(rnd.randint(256, 999)) for _ in range(4)), f"{num(2)}. {num(3)}. {num(2)}. {num(3)}"])
    if kind == "card":
        c = _card_number(rnd, 16, real)
        if real:
            return rnd.choice([c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}", f"{c[:4]}/{c[4:8]}/{c[8:12]}/{c[12:]}"])
        return rnd.choice([c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", num(13), f"20{num(2)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)} {num(2)}:{num(2)}:{num(2)}", f"{num(5)}-{num(5)}-{num(5)}"])
    if real:
        a, b, c = num(3), num(3), num(4)
        return rnd.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"0049 {num(3)} {num(7)}", f"00{num(2)} {num(2)} {num(4)} {num(4)}", f"+{num(2)} {num(3)} {num(7)}"])
    return rnd.choice([f"20{num(2)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}", f"20{num(2)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)} {num(2)}:{num(2)}:{num(2)}", f"{num(2)}/{num(2)}/20{num(2)} {num(2)}:{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", num(8), num(10), f"{num(4)}-{num(4)}", f"{num(1)}.{num(2)}.{num(4)}", f"{num(3)} {num(4)}", f"{num(2)}:{num(2)}:{num(2)}.{num(3)}", f"{num(5)}-{num(4)}"])


def _neighbour(rnd: random.Random) -> str:
    """A number that stands beside another one."""
    num = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    return rnd.choice([".".join(str(rnd.randint(0, 255)) for _ in range(4)), _card_number(rnd, 16, True), f"{num(4)} {num(4)} {num(4)} {num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"20{num(2)}", num(rnd.randint(1, 5)), " ".join(num(rnd.randint(1, 4)) for _ in range(rnd.randint(2, 5)))])


def examples(kind: str, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of generated candidates of one kind."""
    rnd = random.Random(f"{seed}-{kind}")
    words = lambda: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(2, 6)))
    hints = {"email": ["email", "contact", "write to"], "ip": ["host", "server", "ip"], "card": ["card", "visa", "paid with"], "phone": ["phone", "call", "tel."]}
    x, y = [], []
    number = kind in ("card", "phone")
    while len(x) < n:
        real = len(x) % 2 == 0
        apart = number and not real and rnd.random() < 0.5  # of a real one, a wrong stretch
        piece = _example(rnd, kind, real or apart)
        hint = rnd.choice(hints[kind]) if rnd.random() < (0.35 if real or apart else 0.05) else rnd.choice(["order", "version", "ref", "date"]) if rnd.random() < (0.02 if real or apart else 0.35) else ""
        shown = piece
        if number and rnd.random() < (0.9 if apart else 0.3):
            other = _neighbour(rnd)
            shown = f"{other} {piece}" if rnd.random() < 0.5 else f"{piece} {other}"
        text = f"{words()} {hint} {shown} {words()}" if hint else f"{words()} {shown} {words()}"
        start = text.index(shown) + shown.index(piece)
        whole = (kind, start, start + len(piece))
        found = [c for c in candidates(text) if c[0] == kind and c[1] < whole[2] and c[2] > start]
        if number:
            wrong = [c for c in found if c != whole or not (real or apart)]
            if not real and not wrong:
                continue
            found = [whole] if real else [rnd.choice(wrong)]
        for c in found[:1] or [whole]:
            x.append(features(text, c))
            y.append(float(real))
    return np.array(x), np.array(y)


class Taken:
    """Disjoint stretches of a text, to ask whether another one meets any of them."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.stops and a < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], b)
            else:
                self.starts.append(a)
                self.stops.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.stops, a)
        return k < len(self.starts) and self.starts[k] < b

    def add(self, a: int, b: int) -> None:
        k = bisect.bisect_right(self.stops, a)
        self.starts.insert(k, a)
        self.stops.insert(k, b)


@dataclass
class Selector:
    """The trees and the threshold of each kind."""

    models: dict[str, Boosted]
    cutoffs: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        return self.added_to([text], [base])[0]

    def added_to(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        """Selected candidates beside the base spans of each text, best first where they overlap (then the longest).
        Candidates of all texts are scored together, `BLOCK` at a time."""
        taken = [Taken(base) for base in bases]
        waiting: dict[str, list[tuple[int, Span]]] = {kind: [] for kind in KINDS}
        scored: list[list[tuple]] = [[] for _ in texts]

        def score(kind: str) -> None:
            part, waiting[kind] = waiting[kind], []
            if part:
                # what a candidate and its context look like decides, so that equal ones are scored once
                looks = [(texts[i][a:b], texts[i][max(0, a - CONTEXT) : a], texts[i][b : b + CONTEXT]) for i, (_, a, b) in part]
                first = {look: k for k, look in reversed(list(enumerate(looks)))}
                place = {k: n for n, k in enumerate(sorted(first.values()))}
                p = self.models[kind].probability(np.array([features(texts[part[k][0]], part[k][1]) for k in place])).tolist()
                for look, (i, c) in zip(looks, part, strict=True):
                    q = p[place[first[look]]]
                    if q >= self.cutoffs[kind]:
                        scored[i].append((-q, c[1] - c[2], c[1], KINDS.index(kind), c))

        for i, text in enumerate(texts):
            for c in candidates(text):  # one that comes twice meets itself below
                if not taken[i].meets(c[1], c[2]):
                    waiting[c[0]].append((i, c))
                    if len(waiting[c[0]]) == BLOCK:
                        score(c[0])
        for kind in KINDS:
            score(kind)
        out: list[list[Span]] = [[] for _ in texts]
        for i, found in enumerate(scored):
            for *_, c in sorted(found):
                if not taken[i].meets(c[1], c[2]):
                    taken[i].add(c[1], c[2])
                    out[i].append(c)
        return out


#: Features, truth and weight (how many such rows of all texts one row stands for) by kind.
Rows = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def fitted(real: Rows, rows: int = TRAINING_ROWS, seed: int = SEED, precision: float = PRECISION) -> Selector:
    """The trees on generated and real examples, and the least threshold of each kind that reaches `precision` on the
    held-out ones."""
    models, cutoffs = {}, {}
    for kind in KINDS:
        x, y = examples(kind, rows, seed)
        weight = np.ones(len(x))
        if kind in real:
            x, y, weight = (np.concatenate([a, b]) for a, b in zip((x, y, weight), real[kind], strict=True))
        models[kind] = Boosted.fit(x, y)
        held = held_out(len(x))
        cutoffs[kind] = models[kind].cutoff(x[held], y[held], precision, weight[held])
    return Selector(models, cutoffs)


@functools.cache
def selector() -> Selector:
    """Trained on generated examples alone."""
    return fitted({})


def rewritten(kind: str, value: str, rnd: random.Random) -> str:
    """A base span in a format that no base pattern has."""
    digits = _digits(value)
    if kind == "email":
        name, host = value.split("@")
        at, dot = rnd.choice([(" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", "."), (" @ ", ".")])
        return f"{name}{at}{host.replace('.', dot)}"
    if kind == "ip":
        return value.replace(".", rnd.choice([" . ", ". "]))
    if kind == "card":
        return rnd.choice("./").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    last = digits[-10:]
    return rnd.choice([f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"{last[:3]}.{last[3:6]}.{last[6:]}", f"00{digits[:2]} {digits[2:5]} {digits[5:]}"])


def refused(text: str, span: Span) -> bool:
    """Whether a validator says that a candidate is not of its kind (many others are not either, but may be)."""
    kind, a, b = span
    s = text[a:b]
    groups = _GROUP.findall(s)
    if kind == "email":
        return not _TLD.search(s)
    if kind == "ip":
        return ":" not in s and any(int(g) > 255 for g in groups) or " " in s
    if kind == "card":
        return not luhn("".join(groups))
    return not s.startswith(("+", "00")) and [len(g) for g in groups][-3:] != [3, 3, 4] and len(groups) < 4


def real_examples(text: str, rnd: random.Random) -> list[tuple[str, bool, list[float]]]:
    """(kind, of the kind, features) of what one text teaches."""
    base = base_spans(text)
    taken = Taken(base)
    out = [(c[0], False, features(text, c)) for c in dict.fromkeys(candidates(text)) if not taken.meets(c[1], c[2]) and refused(text, c)]
    for kind, a, b in base:
        low = max(0, a - 2 * CONTEXT)
        piece = rewritten(kind, text[a:b], rnd)
        near = f"{text[low:a]}{piece}{text[b : b + 2 * CONTEXT]}"
        whole = (kind, a - low, a - low + len(piece))
        found = [c for c in dict.fromkeys(candidates(near)) if c[0] == kind and c[1] < whole[2] and c[2] > whole[1]]
        if whole in found:
            out.append((kind, True, features(near, whole)))
            wrong = [c for c in found if c != whole]
            out += [(kind, False, features(near, c)) for c in rnd.sample(wrong, min(2, len(wrong)))]
    return out


def train(df: DataFrame, text_col: str = "text") -> Selector:
    """The trees for the texts of `df`."""

    def make():
        def run(batch: pa.RecordBatch) -> list:
            kinds, truth, place, values = [], [], [], []
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rnd = random.Random(key)
                for kind, real, x in real_examples(text, rnd) if text else ():
                    kinds.append(kind)
                    truth.append(real)
                    place.append(rnd.random())
                    values.append(x)
            return [kinds, truth, place, pa.array(values, pa.list_(pa.float64()))]

        return run

    made = arrow_map(df.select(text_col, F.xxhash64(text_col)), make, "kind string, real boolean, place double, x array<double>")
    path = workspace(df.sparkSession, "pii-examples")
    made = materialise(made, path)
    counts = {(r.kind, r.real): r.n for r in made.groupBy("kind", "real").agg(F.count("*").alias("n")).collect()}
    chosen = functools.reduce(lambda a, b: a | b, [(F.col("kind") == kind) & (F.col("real") == real) & (F.col("place") < 1.1 * REAL_ROWS / n) for (kind, real), n in counts.items()], F.lit(False))
    by_kind: dict[str, list[tuple[float, bool, list[float]]]] = {}
    for r in made.filter(chosen).collect():  # about 1.1 * REAL_ROWS of each kind and truth at most
        by_kind.setdefault(r.kind, []).append((r.place, r.real, list(r.x)))
    drop_path(df.sparkSession, path)
    rows = {}
    for kind, found in by_kind.items():
        found.sort()
        used = {truth: sum(real == truth for _, real, _ in found) for truth in (False, True)}
        rows[kind] = np.array([x for *_, x in found]), np.array([float(real) for _, real, _ in found]), np.array([counts[kind, real] / used[real] for _, real, _ in found])
    return fitted(rows)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Selector | None = None) -> DataFrame:
    """(id, base, added): arrays of (kind, start, stop) of every row; without a model, one is trained on `df`."""
    kind = df.schema[id_col].dataType.simpleString()
    model = model or train(df, text_col)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def make():
        def run(batch: pa.RecordBatch) -> list:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = [sorted(more, key=lambda s: (s[1], KINDS.index(s[0]))) for more in model.added_to(texts, base)]
            as_rows = lambda spans: pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in s] for s in spans], struct)
            return [batch.column(0), as_rows(base), as_rows(added)]

        return run

    spans = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return arrow_map(df.select(id_col, text_col), make, f"`{id_col}` {kind}, base {spans}, added {spans}")


def redacted(text: str) -> str:
    """`text` with every span replaced by its kind in angle brackets."""
    base = base_spans(text)
    out, at = [], 0
    for kind, a, b in sorted(base + selector().added(text, base), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans as text."""
    line = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = lambda col: F.transform(col, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    both = F.array_sort(F.concat(keyed(F.col("base")), keyed(F.col("added"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col,
        *map(count, KINDS),
        F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        line(both).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
