"""Document quality rules as a short-circuit cascade.

Base quantities are counted for every document. The further rules run one after another over the documents that are
still accepted, in the order of rejections per cost, both estimated on a sample of about `SAMPLE_ROWS` rows. A document
is kept if no rule rejects it, so the order decides the work and never the verdict.

Rows: null text has no words and fails the base rule; repeated rows and null ids are judged row by row; an empty table
gives an empty result. One output row for each input row; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textlode.llm.batches import arrow_map, chunks, small_batches, trim
from textlode.llm.words import Words, text_windows

SAMPLE_ROWS = 400
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
MIN_WORDS, MAX_REPEAT = 50, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER = re.compile(rb"[A-Z]+")
_LETTERS = re.compile(rb"[^\x20\x09-\x0D]*[A-Za-z\x80-\xff][^\x20\x09-\x0D]*")


@dataclass
class Document:
    """What the rules look at: the text, its bytes, the hashes of its words and the base quantities."""

    text: str
    data: bytes
    words: np.ndarray
    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int


def repeated_words(grams: np.ndarray, n: int) -> int:
    """Of n words, those in windows of three that occur twice or more."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measure(texts: pa.Array) -> list[Document]:
    """The base quantities of each text."""
    found, out = Words.of(texts), []
    hashes, bounds = found.hashes(), found.offsets.tolist()
    for text, grams, a, b in zip(texts.to_pylist(), text_windows(hashes, found.offsets, 3), bounds[:-1], bounds[1:], strict=True):
        text = text or ""
        seen: set[str] = set()
        lines = duplicates = 0
        for line in text.split("\n"):
            if line in seen:
                lines += 1
                duplicates += 1
            elif line.strip(BLANK):
                lines += 1
                seen.add(line)
        out.append(Document(text, text.encode(), hashes[a:b], b - a, len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), lines, duplicates, repeated_words(grams, b - a)))
    return out


def base_failed(d: Document) -> bool:
    return d.n_words < MIN_WORDS or 100 * d.n_repeat_words > MAX_REPEAT * d.n_words


Rule = Callable[[Document], bool]
#: Rules by name; True rejects. Percentages are integers, so that SQL decides them alike.
RULES: dict[str, Rule] = {
    "symbols": lambda d: 100 * d.n_symbols > 20 * d.n_words,
    "dup_lines": lambda d: 100 * d.n_dup_lines > 50 * d.n_lines,
    "word_length": lambda d: 2 * d.word_chars < 5 * d.n_words or d.word_chars > 12 * d.n_words,
    "exclamations": lambda d: 100 * d.data.count(b"!") > 50 * d.n_words,
    "capitals": lambda d: 100 * sum(map(len, _UPPER.findall(d.data))) > 40 * d.word_chars,
    "letters": lambda d: 100 * len(_LETTERS.findall(d.data)) < 60 * d.n_words,
}


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    rejected: float


def estimates(documents: list[Document], rules: dict[str, Rule] | None = None) -> list[Estimate]:
    """Cost (seconds a document) and selectivity of each rule over documents that the base rule accepts."""
    out = []
    for name, rule in (rules or RULES).items():
        began = time.perf_counter()
        hits = sum(map(rule, documents))
        out.append(Estimate(name, (time.perf_counter() - began) / max(1, len(documents)), hits / max(1, len(documents))))
    return out


def cascade(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The order of the rules for `df`: best rejection per cost first, on about `sample_rows` rows that a hash of the text
    chooses from the whole table. Executors time and count; the driver gets numbers."""
    n = df.count()
    if not n:
        return list(RULES)
    share = min(1.0, sample_rows / n)
    sample = df.select(text_col).filter(F.pmod(F.xxhash64(text_col, F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def make():
        def run(batch: pa.RecordBatch) -> list:
            accepted = [d for d in measure(batch.column(0)) if not base_failed(d)]
            found = estimates(accepted)
            return [[e.name for e in found], [e.cost * len(accepted) for e in found], [round(e.rejected * len(accepted)) for e in found]]

        return run

    sums = arrow_map(sample, make, "rule string, cost double, hits long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits")).collect()
    rate = {r.rule: r.hits / max(r.cost, 1e-9) for r in sums}
    return sorted(RULES, key=lambda name: (-rate.get(name, 0.0), name))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """(id, base quantities, base_failed, kept) of every row."""
    order = order or cascade(df, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        rules = [RULES[name] for name in order]

        def run(batch: pa.RecordBatch) -> list:
            documents = measure(batch.column(1))
            failed = [base_failed(d) for d in documents]
            accepted = [not f for f in failed]
            for rule in rules:  # each rule sees only what is left
                accepted = [a and not rule(d) for a, d in zip(accepted, documents, strict=True)]
            return [batch.column(0), *([getattr(d, name) for d in documents] for name in BASE), failed, accepted]

        return run

    return arrow_map(df.select(id_col, text_col), make, f"`{id_col}` {kind}, " + ", ".join(f"{name} long" for name in BASE) + ", base_failed boolean, kept boolean")


def kept(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `df` (all columns) whose text the cascade keeps. The verdict is made in the same task as the row is
    read: nothing is joined or shuffled."""
    order = cascade(df, text_col)
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        rules = [RULES[name] for name in order]
        for batch in (part for whole in batches for part in chunks(whole)):
            accepted = [not base_failed(d) and not any(rule(d) for rule in rules) for d in measure(batch.column(at))]
            yield batch.filter(pa.array(accepted, pa.bool_()))
        trim()

    return df.mapInArrow(run, StructType(df.schema.fields))


#: The same rules for one document, in DuckDB's SQL; `{rows}` is a relation (doc_id, text).
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {rows}),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat FROM t, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY rid),
q AS (SELECT w.rid, doc_id, text, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
 length(regexp_replace(text, '[^!]', '', 'g')) AS n_excl, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10ffff}}]'))) AS n_letters
 FROM w LEFT JOIN r ON w.rid = r.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words
 OR 100 * n_excl > 50 * n_words OR 100 * n_upper > 40 * word_chars OR 100 * n_letters < 60 * n_words) AS kept
FROM f
"""
