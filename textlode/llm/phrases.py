"""Phrases of two to four words that stand together more often than their parts suggest, by language.

Texts are lower-cased (A-Z) and cut at punctuation and line ends into pieces; words are runs of other characters than space
and tab. Everything is counted within a language, whose hash is mixed into that of each word. Three passes over the texts,
each in proportion to them, whatever the number of candidates:

1. A sketch of words and word pairs: one row of counters, one for 16 bytes up to `MOST_CELLS`, that tasks send as sparse blocks
   and add up by block. A counter is an upper bound of the count of everything that falls on it. Tasks look up which counters
   reach the least count as one bit each.
2. The same for phrases of three and four words, of those whose pairs may all be frequent.
3. Phrases whose bounds reach the least count are candidates. Tasks compile those of some texts at a time (`GROUP` words) into
   pyahocorasick automata over the digits of word numbers and count all their matches in these texts, overlapping ones too. A
   delimiter stands between pieces and for words that no candidate has, so that no match crosses a border or begins within a word.
   Counts are sent in blocks by phrase and added up by the words of each phrase; no task and no driver holds the candidates of
   all texts. They are exact; thresholds, scores and the ranking are DataFrame operations on them.

Rows: null and empty texts have no words; a null language is `und`; repeated rows count each time, whatever their ids; ties
are ranked by count, then by the phrase's bytes; other columns, whatever their names, are left alone. No words, no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textlode.llm.batches import chunks, small_batches, trim
from textlode.llm.words import LOWER, Words, byte_class, mixed, windows
from textlode.session import drop_path, materialise, workspace

LEAST, LONGEST, CONTAINED, TOP = 30, 4, 80, 2000
#: Counters of a sketch (a bit of each is sent to the tasks) and phrases of an automaton, at most; grams that are gathered before
#: their counters are sent; cells of a block; words whose candidates are counted together.
MOST_CELLS, MOST_PHRASES, FLUSH, BLOCK, GROUP = 1 << 28, 1_500_000, 2_000_000, 1 << 16, 2_000_000
#: Digits of word numbers in the automata, and the character between pieces.
BASE, DELIMITER = 16, " "
BREAKS = byte_class(b".,;:!?\n\v\f\r")
WORD = ~(BREAKS | byte_class(b" \t"))


class Slice:
    """The words of some texts as hashes mixed with their language's, and where a phrase can't go on."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        self.found = Words.of(texts, WORD, LOWER)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.found.offsets))
        self.langs = [v or b"und" for v in langs.cast(pa.binary()).to_pylist()]
        own = np.array([xxhash.xxh3_64_intdigest(v) for v in self.langs], np.uint64)
        self.words = mixed(self.found.hashes() ^ own[self.row]) if len(self.row) else np.zeros(0, np.uint64)
        marks = np.concatenate([[0], np.cumsum(BREAKS[self.found.data])])
        self.frequent: np.ndarray | None = None  # by first word, whether a pair may be frequent
        self.ends_piece = np.ones(len(self.words), bool)
        if len(self.words):
            self.ends_piece[:-1] = (marks[self.found.starts[1:]] > marks[self.found.ends[:-1]]) | (self.row[1:] != self.row[:-1])

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the phrases of `size` words."""
        whole = np.ones(max(0, len(self.words) - size + 1), bool)
        for k in range(size - 1):
            whole &= ~self.ends_piece[k : k + len(whole)]
        at = np.flatnonzero(whole)
        return at, windows(self.words, size)[at]

    def word(self, k: int) -> bytes:
        return self.found.data[self.found.starts[k] : self.found.ends[k]].tobytes()


def by_task(rows: DataFrame, make: Callable[[], Callable[[Iterator[Slice]], Iterator[list]]], ddl: str) -> DataFrame:
    """Run a generator over the slices of each task."""
    small_batches(rows.sparkSession)
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (Slice(part.column(0), part.column(1)) for batch in batches for part in chunks(batch))
        for columns in make()(slices):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        trim()

    return rows.mapInArrow(run, schema)


class Cells:
    """Which counters reach the least count, a bit each, as the tasks look them up."""

    def __init__(self, spark: SparkSession, heavy: DataFrame, bits: int) -> None:
        own = np.zeros(1 << bits - 3, np.uint8)
        for row in heavy.toLocalIterator():
            at = row.block * (BLOCK // 8)
            own[at : at + len(row.marks)] = np.frombuffer(row.marks, np.uint8)
        self.held, self.bits = spark.sparkContext.broadcast(own), bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes fall on such a counter."""
        cells = cell(hashes, self.bits)
        return (self.held.value[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)


def cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def likely(part: Slice, size: int, pairs: Cells | None) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of `size` words of which every pair may be frequent."""
    at, hashes = part.grams(size)
    if pairs is None or not len(at):
        return at, hashes
    if part.frequent is None:
        first, pair = part.grams(2)
        part.frequent = np.zeros(len(part.words) + 1, bool)
        part.frequent[first] = pairs.has(pair)
    kept = np.all([part.frequent[at + k] for k in range(size - 1)], axis=0)
    return at[kept], hashes[kept]


def heavy_cells(rows: DataFrame, sizes: tuple[int, ...], pairs: Cells | None, bits: int, least: int, path: str) -> DataFrame:
    """(block, marks): a bit for each counter of a sketch of the phrases of these sizes, set where it reaches `least`."""

    def make():
        def run(slices: Iterator[Slice]) -> Iterator[list]:
            held: list[np.ndarray] = []

            def sent() -> list:
                cells, counts = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                first = np.flatnonzero(np.diff(cells // BLOCK, prepend=-1))
                bounds = np.append(first, len(cells))
                low, few = (cells % BLOCK).astype("<u2"), np.minimum(counts, 255).astype("u1")  # 255 is above any need: least is below it
                return [(cells[first] // BLOCK).astype(np.int64), *(_binary(v, bounds) for v in (low, few))]

            for part in slices:
                for size in sizes:
                    held.append(cell(likely(part, size, pairs)[1], bits))
                if sum(map(len, held)) >= FLUSH:
                    yield sent()
            if any(map(len, held)):
                yield sent()

        return run

    def added(block: pa.Table) -> pa.Table:
        where = np.frombuffer(b"".join(block.column("cells").to_pylist()), "<u2")
        counts = np.bincount(where, np.frombuffer(b"".join(block.column("counts").to_pylist()), "u1"), BLOCK)
        marks = [np.packbits(counts >= least, bitorder="little").tobytes()] if (counts >= least).any() else []
        return pa.table({"block": pa.array([block.column("block")[0].as_py()] * len(marks), pa.int64()), "marks": pa.array(marks, pa.binary())})

    if least > 255:
        raise ValueError("the least count is at most 255")
    return materialise(by_task(rows, make, "block long, cells binary, counts binary").groupBy("block").applyInArrow(added, "block long, marks binary"), path)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an array as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


class Phrases:
    """Some candidates as an automaton. A word is written as the digits of its number, each place with characters of its own,
    so that a match begins and ends with a word, and no state has more than `BASE` ways on besides the delimiter's."""

    def __init__(self, grams: list[np.ndarray]) -> None:
        """From one array of word hashes for each number of words, a row a phrase."""
        self.bounds = np.concatenate([[0], np.cumsum(np.repeat([g.shape[1] for g in grams], [len(g) for g in grams]))]).astype(np.int64)
        self.words, self.numbers = np.unique(np.concatenate([g.ravel() for g in grams]), return_inverse=True)
        self.digits = 1
        while BASE**self.digits < len(self.words):
            self.digits += 1

    def spelled(self, numbers: np.ndarray) -> str:
        """Words by number from 0 as characters; a delimiter for -1."""
        out = np.full((len(numbers), self.digits), ord(DELIMITER), "<u4")
        there, rest = numbers >= 0, numbers[numbers >= 0]
        for k in range(self.digits):
            out[there, k] = ord(DELIMITER) + 1 + BASE * k + rest % BASE
            rest = rest // BASE
        flat = np.ones(out.shape, bool)
        flat[~there, 1:] = False  # one character is enough of a delimiter
        return out[flat].tobytes().decode("utf-32-le")

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        text, bounds = self.spelled(self.numbers), (self.bounds * self.digits).tolist()
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            out.add_word(text[a:b], k)
        out.make_automaton()
        return out

    def read(self, words: np.ndarray, ends_piece: np.ndarray) -> str:
        """The text to scan, with a delimiter wherever a match must end."""
        place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        numbers = np.where(self.words[place] == words, place + 1, 0)
        guarded = np.zeros(len(numbers) + int(ends_piece.sum()), np.int64)
        guarded[np.arange(len(numbers)) + np.cumsum(ends_piece) - ends_piece] = numbers
        kept = (guarded != 0) | (np.append(guarded[1:], 0) != 0)
        return self.spelled(guarded[kept] - 1)

    def counts(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """How often each phrase occurs in texts given as words and where pieces end."""
        automaton, n = self.automaton(), len(self.bounds) - 1
        out = np.zeros(n, np.int64)
        for words, ends_piece in texts:
            out += np.bincount(np.fromiter((k for _, k in automaton.iter(self.read(words, ends_piece))), np.int64), minlength=n)
        return out


def distinct(grams: np.ndarray) -> np.ndarray:
    """The distinct rows."""
    if not len(grams):
        return grams
    grams = grams[np.lexsort(grams.T)]
    return grams[np.append(True, (grams[1:] != grams[:-1]).any(1))]


class Group:
    """Some texts of a task: their words, the candidates in them, and how often their possibly frequent words occur."""

    def __init__(self) -> None:
        self.texts: list[tuple[np.ndarray, np.ndarray]] = []
        self.grams: dict[int, list[np.ndarray]] = {size: [] for size in range(2, LONGEST + 1)}
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.names: dict[int, tuple[str, str]] = {}
        self.totals: dict[str, int] = {}
        self.n = 0

    def add(self, part: Slice, pairs: Cells, longer: Cells) -> None:
        self.texts.append((part.words, part.ends_piece))
        self.n += len(part.words)
        for size, grams in self.grams.items():
            at, hashes = likely(part, size, pairs if size > 2 else None)
            at = at[(pairs if size == 2 else longer).has(hashes)]
            grams.append(distinct(part.words[at[:, None] + np.arange(size)]))
        own = np.flatnonzero(pairs.has(part.grams(1)[1]))
        words, first, n = np.unique(part.words[own], return_index=True, return_counts=True)
        self.words.append((words, n))
        for word, k in zip(words.tolist(), own[first].tolist(), strict=True):
            if word not in self.names:
                self.names[word] = part.langs[part.row[k]].decode(), part.word(k).decode()
        for row, size in enumerate(np.diff(part.found.offsets).tolist()):
            if size:
                lang = part.langs[row].decode()
                self.totals[lang] = self.totals.get(lang, 0) + size

    def counted(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates and their counts, for each number of words and part of the candidates."""
        every = [distinct(np.concatenate(g)) for g in self.grams.values() if g]
        self.grams.clear()
        for grams in every:
            for k in range(0, len(grams), MOST_PHRASES):
                own = grams[k : k + MOST_PHRASES]
                yield own, Phrases([own]).counts(self.texts)


def counted(rows: DataFrame, pairs: Cells, longer: Cells, least: int, blocks: int) -> DataFrame:
    """(kind, g, n, lang, word): counts of candidates (kind 0), of words, with language and the word itself (kind 1), those
    that reach `least`, and of all words of a language (kind 2). Tasks send counts packed into blocks by hash, and one task adds
    up a block."""

    def make():
        def blocked(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
            """Order of the rows by block, the blocks in this order, and where each begins and ends."""
            block = (mixed(words.sum(1, dtype=np.uint64)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            first = np.flatnonzero(np.diff(block[order], prepend=-1))
            return order, block[order], list(zip(first.tolist(), np.append(first, len(order))[1:].tolist(), strict=True))

        def sent(group: Group) -> Iterator[list]:
            for grams, n in group.counted():
                order, block, spans = blocked(grams)
                grams, n = grams[order], n[order]
                yield [[0] * len(spans), [int(block[a]) for a, _ in spans], [grams.shape[1]] * len(spans), [grams[a:b].tobytes() for a, b in spans], [n[a:b].tobytes() for a, b in spans], [[]] * len(spans), [[]] * len(spans)]
            words, where = np.unique(np.concatenate([w for w, _ in group.words]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in group.words]), len(words)).astype(np.int64)
            order, block, spans = blocked(words[:, None])
            words, n = words[order], n[order]
            told = [[group.names[w] for w in words[a:b].tolist()] for a, b in spans]
            yield [[1] * len(spans), [int(block[a]) for a, _ in spans], [1] * len(spans), [words[a:b].tobytes() for a, b in spans], [n[a:b].tobytes() for a, b in spans], [[x for x, _ in t] for t in told], [[x for _, x in t] for t in told]]
            yield [[2], [0], [0], [b""], [np.array(list(group.totals.values()), np.int64).tobytes()], [list(group.totals)], [[]]]

        def run(slices: Iterator[Slice]) -> Iterator[list]:
            group = Group()
            for part in slices:
                group.add(part, pairs, longer)
                if group.n >= GROUP:
                    yield from sent(group)
                    group = Group()
            if group.n:
                yield from sent(group)

        return run

    def table(kind: int, grams: list[list[int]], n: list[int], langs: list, words: list) -> pa.Table:
        return pa.table({"kind": pa.array([kind] * len(n), pa.int32()), "g": pa.array(grams, pa.list_(pa.int64())), "n": pa.array(n, pa.int64()), "lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.string())})

    def added(block: pa.Table) -> pa.Table:
        kind, size = block.column("kind")[0].as_py(), block.column("size")[0].as_py()
        counts = np.frombuffer(b"".join(block.column("counts").to_pylist()), np.int64)
        langs, words = ([x for row in block.column(c).to_pylist() for x in row] for c in ("langs", "words"))
        if kind == 2:
            sums: dict[str, int] = {}
            for lang, n in zip(langs, counts.tolist(), strict=True):
                sums[lang] = sums.get(lang, 0) + n
            return table(2, [None] * len(sums), list(sums.values()), list(sums), [None] * len(sums))
        grams = np.frombuffer(b"".join(block.column("grams").to_pylist()), np.int64).reshape(-1, size)
        order = np.lexsort(grams.T)
        grams = grams[order]
        first = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]).any(1)))
        n = np.add.reduceat(counts[order], first)
        first, n = first[n >= least], n[n >= least]
        told = [[v[k] for k in order[first].tolist()] if kind else [None] * len(n) for v in (langs, words)]
        return table(kind, grams[first].tolist(), n.tolist(), *told)

    found = by_task(rows, make, "kind int, block long, size int, grams binary, counts binary, langs array<string>, words array<string>")
    return found.groupBy("kind", "size", "block").applyInArrow(added, "kind int, g array<long>, n long, lang string, word string")


def mined(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language that occur `least` times or more.

    A phrase is cut where floor(2000000 * a / (l + r)) is least, a, l and r being the counts of the phrase and its parts. It
    is dropped if it lies inside a longer candidate that has at least `contained` percent of its count."""
    spark = docs.sparkSession
    small_batches(spark)
    root = workspace(spark, "phrases")
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(20, min(int(size // 16).bit_length(), MOST_CELLS.bit_length() - 1))

    pairs = Cells(spark, heavy_cells(rows, (1, 2), None, bits, least, f"{root}/pairs"), bits)
    longer = Cells(spark, heavy_cells(rows, tuple(range(3, LONGEST + 1)), pairs, bits, least, f"{root}/longer"), bits)
    found = materialise(counted(rows, pairs, longer, least, int(size >> 24) + 64), f"{root}/counted")
    grams, totals = found.filter("kind = 0").select("g", "n"), found.filter("kind = 2").select("lang", "n")
    words = found.filter("kind = 1").select(F.get("g", F.lit(0)).alias("word"), "n", "lang", F.col("word").alias("text"))
    ranked = _ranked(grams, words, totals, contained, top)
    out = materialise(ranked, f"{root}/ranked")
    for step in ("pairs", "longer", "counted"):
        drop_path(spark, f"{root}/{step}")
    return out


def _ranked(grams: DataFrame, words: DataFrame, totals: DataFrame, contained: int, top: int) -> DataFrame:
    frequent = grams.select("g", F.col("n").alias("a"))
    parts = frequent.select("g", "a").unionByName(words.select(F.array("word").alias("g"), F.col("n").alias("a")))
    cuts = frequent.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    cuts = cuts.select("g", "a", "k", F.expr("slice(g, 1, k)").alias("head"), F.expr("slice(g, k + 1, size(g))").alias("tail"))
    both = cuts.join(parts.select(F.col("g").alias("head"), F.col("a").alias("l")), "head").join(parts.select(F.col("g").alias("tail"), F.col("a").alias("r")), "tail")
    score = F.expr("CAST(a AS DECIMAL(20,0)) * 2000000 div (CAST(l AS DECIMAL(20,0)) + r)")
    cut = both.groupBy("g", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(g) - 1), s -> transform(sequence(1, size(g) - s + 1), i -> slice(g, i, s))))")
    longer = frequent.filter(F.size("g") > 2).select(F.explode(inner).alias("g"), "a").groupBy("g").agg(F.max("a").alias("longer"))
    left = cut.join(longer, "g", "left").filter(F.coalesce(100 * F.col("longer") < contained * F.col("a"), F.lit(True)))
    spelled = left.select("g", F.posexplode("g").alias("i", "word")).join(words.select("word", "lang", "text"), "word")
    phrase = spelled.groupBy("g").agg(F.min("lang").alias("lang"), F.expr("array_join(transform(array_sort(collect_list(struct(i, text))), x -> x.text), ' ')").alias("phrase"))
    best = left.join(phrase, "g").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM {rows})
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, g, count(*) AS a FROM (SELECT lang, w[i : i + k - 1] AS g FROM starts, range(1, 5) s(k) WHERE i + k - 1 <= len(w)) GROUP BY lang, g
), totals AS (
  SELECT lang, sum(a) AS n FROM grams WHERE len(g) = 1 GROUP BY lang
), often AS (
  SELECT * FROM grams WHERE len(g) > 1 AND a >= 30
), cut AS (
  SELECT o.lang, o.g, o.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * o.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM often) o
  JOIN grams l ON l.lang = o.lang AND l.g = o.g[1:k] JOIN grams r ON r.lang = o.lang AND r.g = o.g[k + 1 : len(o.g)]
  QUALIFY row_number() OVER (PARTITION BY o.lang, o.g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, g[i : i + s - 1] AS g, max(a) AS longer FROM often, range(2, 4) x(s), range(1, 4) y(i) WHERE len(g) > s AND i + s - 1 <= len(g) GROUP BY 1, 2
), ranked AS (
  SELECT c.lang, array_to_string(c.g, ' ') AS phrase, c.a, c.l, c.r, c.score, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, array_to_string(c.g, ' ')) AS rank
  FROM cut c LEFT JOIN inside i ON i.lang = c.lang AND i.g = c.g WHERE i.longer IS NULL OR 100 * i.longer < 80 * c.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
