"""Removal of passages that occur more than once, by suffix automata of reference shards.

A window is `least` consecutive words of one text; every word of a window whose words also stand anywhere else goes. To
find the places that an automaton must see, each window picks an anchor: of its runs of `GRAM` words the one with the least
hash, the leftmost among equals. Equal windows pick equal anchors at equal offsets. The windows of one text that pick the
same anchor in a row form a passage, so that each window lies in one passage and each occurrence counts once. Passages with
an anchor that occurs once are done. All others with one anchor form a reference shard (small ones share a shard): equal
passages count as one with a weight, a suffix automaton is built of the shard, and the passages are streamed through it.
Their matching statistics, the length at each word of the longest suffix that the shard holds twice or more, give the
windows that repeat. An automaton stays on the task of its shard, which is where all texts that can match it are sent;
sending every automaton to every text would be quadratic in the corpus. So the largest automaton has a bound: `SHARD_WORDS`
or, where that is more, the passages of one anchor. An anchor in more than `HOT` texts is split: its windows become passages
of their own, dealt by their own words, of which only those that occur twice go on.

Equal texts are one text with a weight from the start, so that groups of copies cost as much as one of them. Texts are
stored in buckets by key, so that later joins move keys and numbers, not texts.

Rows: equal rows are occurrences of their own, so that a text of `least` words that is there twice loses all of them; null
and empty texts have no words; texts under `least` words lose none; null ids pass through; other columns, whatever their
names, are left alone. Keys of texts are two hashes of 64 bits each, as are those of passages.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.llm.batches import arrow_map, small_batches, trim
from textlode.llm.suffix_automaton import SuffixAutomaton
from textlode.llm.words import Words, mixed, windows
from textlode.session import drop_path, materialise, release, workspace

LEAST = 35
#: Words that an anchor is made of; texts with one anchor from which on it is split; words of a shard that holds several anchors.
GRAM, HOT, SHARD_WORDS = 12, 4000, 100_000
_STEPS = np.cumprod(np.full(4096, 0xD1342543DE82EF95, np.uint64))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` values in a row is, the leftmost one of equals."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        if len(values) <= step:
            return at[:0]
        less = values[step:] < values[:-step]
        values, at = np.where(less, values[step:], values[:-step]), np.where(less, at[step:], at[:-step])
        size += step
    return at


def stretch_hashes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each stretch of words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inner = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    return mixed(np.add.reduceat(words[np.repeat(starts, sizes) + inner] * _STEPS[inner], first) + sizes.astype(np.uint64))


def passages(texts: pa.Array, least: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts and, for each passage in order, its row, anchor, hash, first window and number of windows."""
    found = Words.of(texts)
    words, gram = found.hashes(), min(GRAM, least)
    anchors = windows(words, gram)
    where = leftmost_least(anchors, least - gram + 1)
    row = np.searchsorted(found.offsets, np.arange(len(where)), "right") - 1
    window = np.flatnonzero(np.arange(len(where)) + least <= found.offsets[row + 1]) if len(where) else np.zeros(0, np.int64)
    where = where[window]
    first = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(where)))
    start = window[first]
    return found, row[start], anchors[where[first]], stretch_hashes(words, start, count + least - 1), start - found.offsets[row[start]], count


def _grouped(row: np.ndarray, n: int, fields: dict[str, np.ndarray]) -> pa.Array:
    """A column of lists of structs from rows in order."""
    bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))


class Repeats:
    """The stored texts of a table, and what is found in them step by step."""

    def __init__(self, docs: DataFrame, text_col: str, least: int) -> None:
        self.spark, self.least = docs.sparkSession, least
        small_batches(self.spark)
        self.root, self.name = workspace(self.spark, "substrings"), f"substring_texts_{uuid.uuid4().hex[:12]}"
        self.texts = self._stored(docs.select(F.coalesce(text_col, F.lit("")).alias("text")))

    def _stored(self, rows: DataFrame) -> DataFrame:
        """(k1, k2, n, text, passages): each distinct text once, in buckets by key."""
        least = self.least

        def make():
            def run(batch: pa.RecordBatch) -> list:
                _, row, anchor, digest, start, count = passages(batch.column(3), least)
                fields = {"anchor": anchor.view(np.int64), "hash": digest.view(np.int64), "start": start.astype(np.int32), "size": count.astype(np.int32)}
                return [*batch.columns, _grouped(row, batch.num_rows, fields)]

            return run

        texts = rows.groupBy(*key_of("text")).agg(F.count("*").alias("n"), F.first("text").alias("text"))
        schema = "k1 long, k2 long, n long, text string, passages array<struct<anchor:long,hash:long,start:int,size:int>>"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        arrow_map(texts, make, schema).write.bucketBy(buckets, "k1", "k2").option("path", f"{self.root}/texts").saveAsTable(self.name)
        release(self.spark)
        return self.spark.table(self.name)

    def _occurrences(self) -> DataFrame:
        return self.texts.filter(F.size("passages") > 0).select("k1", "k2", "n", F.explode("passages").alias("p")).select("k1", "k2", "n", "p.*")

    def distinct(self) -> DataFrame:
        """(anchor, hash, n, k1, k2, start, size, hot): passages whose anchor occurs twice or more, each once with one of
        its places."""
        seen = self._occurrences()
        anchors = materialise(seen.groupBy("anchor").agg(F.sum("n").alias("n"), (F.count("*") > HOT).alias("hot")).filter("n > 1").select("anchor", "hot"), f"{self.root}/anchors")
        one = seen.groupBy("anchor", "hash").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "start", "size")))
        return materialise(one.join(anchors, "anchor"), f"{self.root}/distinct")

    def _at_places(self, wanted: DataFrame, make, schema: str) -> DataFrame:
        """Run Python on (text, list of wanted passages) of each text that has some."""
        lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "hash", "n", "start", "size")).alias("wanted"))
        return arrow_map(self.texts.select("k1", "k2", "text").join(lists, ["k1", "k2"]).select("k1", "k2", "text", "wanted"), make, schema)

    def windows_of(self, hot: DataFrame) -> DataFrame:
        """(anchor, hash, bit, window, n, k1, k2, start) of each window of some passages."""
        least = self.least

        def make():
            def run(batch: pa.RecordBatch) -> list:
                found = Words.of(batch.column(2))
                words, lists = found.hashes(), batch.column(3)
                flat = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(("anchor", "hash", "n", "start", "size"), lists.flatten().flatten(), strict=True)}
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                of = np.repeat(np.arange(len(row)), flat["size"])
                bit = np.arange(len(of)) - np.repeat(np.cumsum(flat["size"]) - flat["size"], flat["size"])
                start = flat["start"][of].astype(np.int64) + bit
                digest = stretch_hashes(words, found.offsets[row[of]] + start, np.full(len(of), least))
                keys = [batch.column(k).take(pa.array(row[of])) for k in (0, 1)]
                return [flat["anchor"][of], flat["hash"][of], bit.astype(np.int32), digest.view(np.int64), flat["n"][of], *keys, start.astype(np.int32)]

            return run

        return self._at_places(hot, make, "anchor long, hash long, bit int, window long, n long, k1 long, k2 long, start int")

    def words_of(self, wanted: DataFrame) -> DataFrame:
        """(anchor, hash, n, words) of some passages."""
        least = self.least

        def make():
            def run(batch: pa.RecordBatch) -> list:
                out: list[tuple] = []
                for text, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    words = text.encode().split()
                    out += [(p["anchor"], p["hash"], p["n"], b" ".join(words[p["start"] : p["start"] + p["size"] + least - 1])) for p in places]
                return [list(c) for c in zip(*out, strict=True)] if out else [[]] * 4

            return run

        return self._at_places(wanted, make, "anchor long, hash long, n long, words binary")

    def repeated(self) -> DataFrame:
        """(anchor, hash, mask): the passages with windows that repeat; bit k of the mask is the passage's window k."""
        distinct = self.distinct()
        split = materialise(self.windows_of(distinct.filter("hot")), f"{self.root}/windows")
        single = split.groupBy("window").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "start"))).filter("n > 1")
        whole = distinct.filter("NOT hot").select("anchor", "hash", "n", "k1", "k2", "start", "size", F.lit(False).alias("hot"))
        single = single.select(F.col("window").alias("anchor"), F.col("window").alias("hash"), "n", "k1", "k2", "start", F.lit(1).alias("size"), F.lit(True).alias("hot"))
        marks = materialise(self._marked(whole.unionByName(single)), f"{self.root}/marks")
        hot = split.join(marks.filter("hot").select(F.col("hash").alias("window")), "window").groupBy("anchor", "hash").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
        return marks.filter("NOT hot").select("anchor", "hash", "mask").unionByName(hot)

    def _marked(self, pieces: DataFrame) -> DataFrame:
        """(anchor, hash, hot, mask) by the automata of the shards; pieces of both kinds never share an anchor's shard row."""
        total = pieces.agg(F.sum(F.col("size") + (self.least - 1))).first()[0] or 0
        shards = int(total // SHARD_WORDS + 1)
        kinds = [self.words_of(pieces.filter(c)).withColumn("hot", F.lit(h)) for c, h in (("NOT hot", False), ("hot", True))]
        dealt = kinds[0].unionByName(kinds[1]).withColumn("shard", F.pmod(F.xxhash64("anchor", "hot"), F.lit(shards)))
        least = self.least

        def judge(shard: pa.Table) -> pa.Table:
            numbers: dict[bytes, int] = {}
            anchors, keys, hot = (shard.column(c).combine_chunks() for c in ("anchor", "hash", "hot"))
            rows = [[numbers.setdefault(w, len(numbers)) for w in text.split(b" ")] for text in shard.column("words").to_pylist()]
            automaton = SuffixAutomaton()
            for words, n in zip(rows, shard.column("n").to_pylist(), strict=True):
                automaton.add(words, n)
            repeated, masks = automaton.repeated_suffix(), []
            for words in rows:
                mask = 0
                for k, size in enumerate(automaton.matching_statistics(words, repeated)):
                    if size >= least:
                        mask |= 1 << (k - least + 1)
                masks.append(mask)
            out = pa.table({"anchor": anchors, "hash": keys, "hot": hot, "mask": pa.array(masks, pa.int64())})
            del automaton, rows, numbers
            trim()
            return out.filter(np.array(masks, np.int64) != 0)

        return dealt.groupBy("shard").applyInArrow(judge, "anchor long, hash long, hot boolean, mask long")

    def kept(self) -> DataFrame:
        """(k1, k2, n_words, n_removed, kept): each distinct text without its repeated passages."""
        places = self._occurrences().select("k1", "k2", "anchor", "hash", "start").join(self.repeated(), ["anchor", "hash"])
        lists = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
        least = self.least

        def make():
            def run(batch: pa.RecordBatch) -> list:
                sizes, removed, kept = [], [], []
                for text, marks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    words = text.encode().split()
                    sizes.append(len(words))
                    if marks:
                        edges = np.zeros(len(words) + 1, np.int64)
                        start, mask = (np.array([m[c] for m in marks], np.int64) for c in ("start", "mask"))
                        for bit in range(int(mask.max()).bit_length()):
                            first = start[mask >> bit & 1 == 1] + bit
                            np.add.at(edges, first, 1)
                            np.add.at(edges, first + least, -1)
                        words = [w for w, c in zip(words, np.cumsum(edges).tolist(), strict=False) if not c]
                    removed.append(sizes[-1] - len(words))
                    kept.append(b" ".join(words))
                return [batch.column(0), batch.column(1), sizes, removed, pa.array(kept, pa.binary()).cast(pa.string())]

            return run

        both = self.texts.select("k1", "k2", "text").join(lists, ["k1", "k2"], "left").select("k1", "k2", "text", "marks")
        return arrow_map(both, make, "k1 long, k2 long, n_words long, n_removed long, kept string")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        for step in ("texts", "anchors", "distinct", "windows", "marks"):
            drop_path(self.spark, f"{self.root}/{step}")


def key_of(text: str) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(35), text).alias("k2")]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept): each row's text without the passages of `least` words and more that occur more than
    once; `digest` gives kept_sha256 in place of kept. A mask has 64 bits, so that `least` is at most 63 + GRAM."""
    if not GRAM <= least <= 62 + GRAM:
        raise ValueError(f"windows have {GRAM} to {62 + GRAM} words")
    steps = Repeats(docs, text_col, least)
    found = steps.kept()
    if digest:
        found = found.select("k1", "k2", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    found = materialise(found, f"{steps.root}/found")
    steps.close()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).select("_id", *key_of("_text"))
    return rows.join(found, ["k1", "k2"]).drop("k1", "k2").withColumnRenamed("_id", id_col)


#: DuckDB SQL for windows of 35 words.
SQL = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT row_number() OVER () AS rowid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM {rows})
), windows AS (
  SELECT r, i, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h, n FROM words
), repeated AS (
  SELECT r, i FROM windows WHERE i + 34 <= n QUALIFY count(*) OVER (PARTITION BY h) > 1
), marked AS (
  SELECT w.r, w.i, w.word, max(d.i) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN repeated d ON w.r = d.r AND w.i = d.i
), kept AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY r
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT row_number() OVER () AS r, doc_id FROM {rows}) d LEFT JOIN kept USING (r)
"""
