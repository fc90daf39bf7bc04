"""Runs (maximal repetitions) of words, by Kolpakov and Kucherov's method.

A run is a stretch of words with smallest period q, `least` words and two periods long at least, that no neighbouring word
extends keeping period q. A suffix automaton gives the factors of a Lempel-Ziv factorisation: each is the longest stretch
that occurs earlier, or one new word. Main's algorithm finds every run that crosses or touches the border of two factors,
from the longest common extensions on both sides of it; such a run begins less than 2 * |factor before| + |factor| words
before the border. All other runs lie strictly inside a factor and are copied from its earlier occurrence.

Every word of a run occurs twice in it. So texts are first cut at words that occur once in their stretch, again and again,
for whole slices by numpy; only stretches of `least` words and more that remain are factorised, each for itself. Nothing is
lost: no run holds such a word. Memory grows with the longest of these stretches alone, and the work is linear in the words.

Rows: each row is judged for itself and comes back once, so that repeated rows repeat; null and empty texts, and those of
white space alone, have no words and no runs; null ids pass through; of runs of equal length the one that starts first
counts as the longest, then the one of smaller period; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.batches import arrow_map
from textlode.llm.suffix_automaton import SuffixAutomaton

LEAST = 12


def factors(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1) of each factor; the occurrence may reach into the factor."""
    automaton = SuffixAutomaton()
    automaton.add(words)
    after, first_end = automaton.after, automaton.first_end
    out, start, n = [], 0, len(words)
    while start < n:
        state, end = 0, start
        while end < n and first_end[to := after[state][words[end]]] < end:
            state = to
            end += 1
        out.append((start, end, first_end[state] - (end - start) + 1) if end > start else (start, start + 1, -1))
        start = max(end, start + 1)
    return out


def common_prefixes(words: list[int]) -> list[int]:
    """At each place, the length of the longest common prefix of what begins there and the whole (the Z function)."""
    n = len(words)
    out = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        if i + k >= right:
            k = max(k, 0)
            while i + k < n and words[k] == words[i + k]:
                k += 1
            left, right = i, i + k
        out[i] = k
    return out


def border_runs(words: list[int], border: int, before: int, end: int, least: int) -> dict[tuple[int, int], int]:
    """{(start, end): period} of the runs that cross or touch `border` and end in the factor that begins there; `before` is
    the length of the factor before it."""
    left, right = words[max(0, border - 2 * before - (end - border)) : border], words[border:end]
    backward = common_prefixes([*left[::-1], -1, *right[::-1], *left[::-1]])  # suffixes, against all that ends at the border
    forward = common_prefixes([*right, -1, *left, *right])  # prefixes, against all that begins at the border
    a, b, out = len(left), len(right), {}
    longest = before + b
    found = [(border - s, border + p + forward[p], p) for p in range(1, min(b, longest) + 1) if (s := backward[a + 1 + b - p]) + forward[p] >= p]
    found += [(border - p - backward[p], border + f, p) for p in range(1, min(a, longest) + 1) if backward[p] + (f := forward[b + 1 + a - p]) >= p]
    for start, stop, p in found:
        if stop - start < least or (start and words[start - 1] == words[start - 1 + p]) or (stop < len(words) and words[stop] == words[stop - p]):
            continue  # too short, or cut by what was looked at: it is found whole at its own border
        out[start, stop] = min(p, out.get((start, stop), p))
    return out


def maximal_runs(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of `least` words or more, by start, then period."""
    cuts = factors(words)
    known: dict[int, dict[int, int]] = {}  # by start: {end: period}
    for k, (start, end, source) in enumerate([*cuts, (len(words), len(words), -1)]):
        before = cuts[k - 1][1] - cuts[k - 1][0] if k else 0
        if before and 2 * (before + end - start) > least:
            for (a, b), p in border_runs(words, start, before, end, least).items():
                known.setdefault(a, {}).setdefault(b, p)
        if source >= 0 and end - start >= least + 2:
            shift, stop = start - source, source + end - start
            for a in range(source + 1, stop):
                for b, p in list(known.get(a, {}).items()):
                    if b < stop:
                        known.setdefault(a + shift, {})[b + shift] = p
    return sorted((a, b - a, p) for a, ends in known.items() for b, p in ends.items())


def repeated_stretches(words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of `least` words and more that hold all runs: pieces of the texts (from bound to bound)
    without words that occur once in their piece."""
    place, part = np.arange(len(words)), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    kinds = np.int64(words.max() + 1) if len(words) else 1
    while True:
        fits = np.bincount(part)[part] >= least if len(part) else np.zeros(0, bool)
        place, part = place[fits], part[fits]
        key = part * kinds + words[place]
        order = np.argsort(key)
        change = np.flatnonzero(np.diff(key[order])) + 1
        edges = np.concatenate([[0], change, [len(key)]]) if len(key) else np.zeros(1, np.int64)
        alone = order[edges[:-1][np.diff(edges) == 1]]
        held = np.ones(len(place), bool)
        held[alone] = False
        place, part = place[held], part[held]
        fresh = np.append(True, (np.diff(place) != 1) | (np.diff(part) != 0))[: len(place)]
        part = np.cumsum(fresh) - 1
        if 100 * len(alone) <= len(held):  # what little is left to cut is factorised
            break
    fits = np.bincount(part)[part] >= least if len(part) else np.zeros(0, bool)
    place, fresh = place[fits], np.flatnonzero(np.diff(part[fits], prepend=-1))
    return place[fresh], place[np.append(fresh[1:], len(place)) - 1] + 1 if len(place) else place


def tail_repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For every tenth id by its checksum, the words from some place on replaced by repetitions of the first of them."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, runs, collapsed): the runs of each text as (start, length, period) by start, then period, and the text with one
    period of each run, its words joined by one space. `prepare` may replace the words of a row first."""
    field = docs.schema[id_col]

    def make():
        def run(batch: pa.RecordBatch) -> list:
            codes: defaultdict[bytes, int] = defaultdict()
            codes.default_factory = codes.__len__
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            if prepare:
                texts = [prepare(i, t) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            bounds = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) for t in texts], out=bounds[1:])
            numbers = np.fromiter((codes[w] for t in texts for w in t), np.int64, bounds[-1])
            found: dict[int, list[tuple[int, int, int]]] = {}
            for a, b in zip(*repeated_stretches(numbers, bounds, least), strict=True):
                if own := maximal_runs(numbers[a:b].tolist(), least):
                    row = int(np.searchsorted(bounds, a, "right")) - 1
                    found.setdefault(row, []).extend((s + int(a - bounds[row]), size, p) for s, size, p in own)
            for row, own in found.items():
                cover = np.zeros(len(texts[row]) + 1, np.int64)
                for start, size, p in own:
                    cover[start + p] += 1
                    cover[start + size] -= 1
                texts[row] = [w for w, c in zip(texts[row], np.cumsum(cover).tolist(), strict=False) if not c]
            runs = [[{"start": s, "length": n, "period": p} for s, n, p in found.get(k, [])] for k in range(len(texts))]
            return [batch.column(0), pa.array(runs, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string())]

        return run

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, make, f"id {field.dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, the longest run, digests of all runs and of the collapsed text) from `find`."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("low"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.back"), F.col("best.length"), -F.col("best.low")
    return best.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.low").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
