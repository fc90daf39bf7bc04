"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased runs of ASCII letters and digits and of non-ASCII characters. Fixed masks, laid on every window
of a text, hash some of its tokens and ignore the others, so that a window still matches where ignored tokens were
replaced. The seeds of documents and benchmark items join on their hash; a hit fixes how item and document lie on each
other, and the tokens there are compared: an item leaks if, in some stretch of `STRETCH` tokens (the whole item if it is
shorter), at least `PERCENT` of 100 tokens are equal. The masks meet every such stretch: of 13 tokens with at most two
replaced ones, any pattern leaves one of `MASKS` whole; an item shorter than that is cut in one run more than tokens of it
may differ, and each run is a seed. Inserted tokens end a stretch; both sides are still seen.

A document emits its seeds that the benchmark has. While the benchmark has at most `KNOWN` distinct seeds (8 bytes each),
tasks get them as a sorted list and look them up; beyond that documents emit all their seeds, and the join alone decides.
Where a document and an item share a seed so often that listing the places would be quadratic (more than `MANY` pairs of
places), all places of the item on the document are compared instead.

Rows: null and empty texts hold nothing; items under five tokens leak by exact copies alone; repeated documents are
reported one by one, repeated items once for each item id and text; null ids pass through; other columns, whatever their
names, are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.batches import arrow_map, free_name, list_array
from textlode.llm.words import Words, byte_class, mixed
from textlode.session import drop_path, materialise, workspace

#: The masks; 1 takes a token, 0 ignores it.
MASKS = ("1110111", "110100111", "1100101011", "10110010111")
STRETCH, PERCENT = 13, 80
#: Distinct seeds up to which tasks get a list of them, and rows up to which a side of a join is broadcast.
KNOWN, BROADCAST_ROWS = 2_000_000, 200_000
#: Pairs of places from which on all alignments are compared; alignments that are compared at once.
MANY, AT_ONCE = 4096, 1 << 20
TOKEN = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
_ODD = 0x9E3779B97F4A7C15


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, and the offset of each text's first."""
    found = Words.of(pc.utf8_lower(pc.fill_null(texts, "")), TOKEN)
    return found.hashes(), found.offsets


def seeds(held: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask at every position of some tokens."""
    n = len(held) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += held[k : k + n] * np.uint64(((k + 1) * _ODD | 1) & 0xFFFFFFFFFFFFFFFF)
    return mixed(out)


def runs(n: int) -> list[tuple[int, int]]:
    """A short item of n tokens in one run more than tokens of it may differ, so that one run is left as it is."""
    parts = n * (100 - PERCENT) // 100 + 1
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]


def item_seeds(held: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(mask, hashes, places) of an item; masks beyond the fixed ones are runs of that many tokens."""
    if len(held) >= STRETCH:
        return [(m, s := seeds(held, mask), np.arange(len(s))) for m, mask in enumerate(MASKS)]
    return [(len(MASKS) + b - a, seeds(held[a:b], "1" * (b - a)), np.array([a])) for a, b in runs(len(held)) if b > a]


def _mask(number: int) -> str:
    return MASKS[number] if number < len(MASKS) else "1" * (number - len(MASKS))


class Items:
    """The benchmark as tables: its items with their tokens, and its seeds with their places."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, root: str) -> None:
        spark, kind = benchmark.sparkSession, benchmark.schema[id_col].dataType.simpleString()

        def make():
            def run(batch: pa.RecordBatch) -> list:
                held, offsets = tokens(batch.column(2))
                own = [held[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                found = [[{"mask": m, "hash": int(h.view(np.int64)), "place": int(p)} for m, hs, ps in item_seeds(x) for h, p in zip(hs, ps, strict=True)] for x in own]
                return [batch.column(0), batch.column(1), list_array([x.view(np.int64) for x in own], np.int64), pa.array(found, pa.list_(pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("place", pa.int32())])))]

            return run

        rows = benchmark.select(F.xxhash64(id_col, text_col).alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").dropDuplicates(["item"])
        table = materialise(arrow_map(rows, make, f"item long, item_id {kind}, tokens array<long>, seeds array<struct<mask:int,hash:long,place:int>>"), f"{root}/items")
        self.items = table.select("item", "item_id", "tokens")
        exploded = table.select("item", F.explode("seeds").alias("s")).select("item", "s.mask", "s.hash", "s.place")
        self.seeds = materialise(exploded.groupBy("hash", "item").agg(F.min("mask").alias("mask"), F.collect_list("place").alias("places")), f"{root}/seeds")
        self.masks = sorted(r.mask for r in self.seeds.select("mask").distinct().collect())  # a dozen or so of fixed values
        self.n_seeds = self.seeds.count()
        self.known = None
        if self.n_seeds <= KNOWN:
            hashes = self.seeds.select("hash").distinct().toArrow().column("hash").to_numpy()
            self.known = spark.sparkContext.broadcast(np.sort(hashes.view(np.uint64)))


def hits(docs: DataFrame, items: Items) -> DataFrame:
    """(row, hash, places) of the seeds of `docs` (row, text) that the benchmark has or may have."""
    masks, known = [_mask(m) for m in items.masks], items.known

    def make():
        keys = known.value if known else None
        table = np.zeros(1 << 20, bool)
        if keys is not None:
            table[(keys >> np.uint64(44)).astype(np.int64)] = True

        def run(batch: pa.RecordBatch) -> list:
            held, offsets = tokens(batch.column(1))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for mask in masks:
                own = seeds(held, mask)
                at = np.arange(len(own)) if keys is None else np.flatnonzero(table[(own >> np.uint64(44)).astype(np.int64)])
                if keys is not None and len(at):
                    at = at[keys[np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)] == own[at]]
                row = np.searchsorted(offsets, at, "right") - 1
                inside = at + len(mask) <= offsets[row + 1]
                at, row = at[inside], row[inside]
                found.append((row, own[at], at - offsets[row]))
            row, hashes, place = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((place, hashes, row))
            row, hashes, place = row[order], hashes[order], place[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))) if len(row) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(place.astype(np.int32)))
            return [batch.column(0).take(pa.array(row[first])), pa.array(hashes[first].view(np.int64)), lists]

        return run

    return arrow_map(docs, make, "row long, hash long, places array<int>")


def best_place(item: np.ndarray, held: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int] | None:
    """(equal tokens, most of them in a stretch, start in the document) of the best alignment, if the item leaks there."""
    width, best = min(STRETCH, len(item)), None
    for at in range(0, len(shifts), max(1, AT_ONCE // len(item))):
        part = shifts[at : at + max(1, AT_ONCE // len(item))]
        where = part[:, None] + np.arange(len(item))[None, :]
        inside = (where >= 0) & (where < len(held))
        same = inside & (held[np.clip(where, 0, len(held) - 1)] == item[None, :])
        sums = np.concatenate([np.zeros((len(part), 1), np.int64), np.cumsum(same, 1)], 1)
        most = (sums[:, width:] - sums[:, :-width]).max(1)
        for k in np.flatnonzero(100 * most >= PERCENT * width):
            found = int(sums[k, -1]), int(most[k]), max(0, int(part[k]))
            if best is None or (*found[:2], -found[2]) > (*best[:2], -best[2]):
                best = found
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(row, item_id, n_equal, n_stretch, start_token, n_tokens): row is `row_key` of a document, once however often it
    occurs; one row for each item that leaks into it."""
    spark = docs.sparkSession
    root = workspace(spark, "decontaminate")
    items = Items(benchmark, item_col, item_text_col, root)
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    small = F.broadcast if items.n_seeds <= BROADCAST_ROWS else lambda df: df
    met = hits(rows, items).join(small(items.seeds.select("hash", "item", F.col("places").alias("own"))), "hash")
    pairs = F.flatten(F.transform("places", lambda p: F.transform("own", lambda q: p - q)))
    listed = F.size("places").cast("long") * F.size("own") <= MANY
    shift = F.when(listed, F.array_distinct(pairs)).otherwise(F.array(F.lit(None).cast("int")))
    placed = materialise(met.select("row", "item", F.explode(shift).alias("shift")).distinct(), f"{root}/placed")
    wanted = placed.select("row").distinct()
    few = wanted.count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "row", "left_semi").dropDuplicates(["row"])

    def token_lists():
        def run(batch: pa.RecordBatch) -> list:
            held, offsets = tokens(batch.column(1))
            return [batch.column(0), pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(held.view(np.int64))).cast(pa.list_(pa.int64()))]

        return run

    held = materialise(arrow_map(texts, token_lists, "row long, held array<long>"), f"{root}/tokens")
    both = placed.join(held, "row").join(small(items.items.select("item", "tokens")), "item")
    a, n = F.greatest(F.lit(0), "shift"), F.size("tokens")
    window = F.when(F.col("shift").isNull(), F.col("held")).otherwise(F.slice("held", a + 1, F.greatest(F.lit(0), F.least(F.size("held"), F.col("shift") + n) - a)))  # what lies under the item
    both = both.select("row", "item", "shift", window.alias("held"), "tokens")

    def verify():
        def run(batch: pa.RecordBatch) -> list:
            out: list[tuple] = []
            for k, (row, item, shift) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                under, own = batch.column(3)[k].values.to_numpy(), batch.column(4)[k].values.to_numpy()
                shifts = np.arange(1 - len(own), len(under)) if shift is None else np.array([min(shift, 0)])
                found = best_place(own, under, shifts)
                if found:
                    out.append((row, item, *found[:2], found[2] if shift is None else max(0, shift), len(own)))
            return [list(c) for c in zip(*out, strict=True)] if out else [[]] * 6

        return run

    found = arrow_map(both, verify, "row long, item long, n_equal long, n_stretch long, start_token long, n_tokens long")
    best = found.groupBy("row", "item", "n_tokens").agg(F.max(F.struct("n_equal", "n_stretch", (-F.col("start_token")).alias("back"))).alias("best"))
    named = best.join(small(items.items.select("item", "item_id")), "item")
    out = materialise(named.select("row", "item_id", "best.n_equal", "best.n_stretch", (-F.col("best.back")).alias("start_token"), "n_tokens"), f"{root}/leaks")
    for name in ("items", "seeds", "placed", "tokens"):
        drop_path(spark, f"{root}/{name}")
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_equal, n_stretch, start_token, n_tokens) of every leaked item of every document."""
    found = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("row"))
    right = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return rows.join(right, "row").select(F.col("_id").alias(id_col), F.col("item_id").alias(item_col), "n_equal", "n_stretch", "start_token", "n_tokens")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` (all columns) in which no item leaks."""
    found = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select("row").distinct()
    key = free_name(docs.columns, "row")
    right = found.withColumnRenamed("row", key)
    return docs.withColumn(key, F.xxhash64(id_col, text_col)).join(F.broadcast(right) if found.count() <= BROADCAST_ROWS else right, key, "left_anti").select(docs.columns)
