"""Exact Jaccard join of documents on word shingles, with adaptive multi-match prefixes, and its components.

Shingles are put in one order for all documents: those that a sketch of the whole corpus shows as frequent come last, by
frequency, and the hash decides otherwise. In that order, if two sets share at least o shingles, the first |r| - o + l
of the one and |s| - o + l of the other have at least l in common. A document's l is chosen by cost: where its prefix
meets frequent shingles, a longer prefix that asks for more shared shingles leaves fewer candidates to verify.

Documents with equal sets are one class, held by its smallest doc_id. Frequent prefix shingles first link their classes
to one pivot each, the class with the fewest rarer shingles; what that connects is one component already, so that only
pairs across components are looked at further. Every remaining pair whose prefixes match often enough is verified on the
whole sets. Nothing is capped, and no pair that may link two components is left out.

Rows: null texts and texts without words are linked with nothing; equal texts are linked; null doc_ids take part and
stand behind all others when a smallest doc_id is named; repeated rows stay separate output rows. A class is known by a
64-bit hash of its set. Columns beside id and text are left alone, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.batches import arrow_map, chunks, free_name, list_array, small_batches, trim
from textlode.llm.components import components
from textlode.llm.words import mixed, shingle_sets
from textlode.session import drop_path, materialise, release, workspace

#: Least and most counters of the sketch (one for `CHARS_A_COUNTER` characters of input), and how many of the most frequent are kept.
SKETCH, MOST_SKETCH, CHARS_A_COUNTER, HEAVY = 1 << 20, 1 << 22, 64, 100_000
#: Postings of one shingle that one task pairs with others at most; a longer list is split by size and by a hash.
BLOCK = 512
#: Postings from which on a shingle links to a pivot before pairs are formed.
BIG = 32
LONGEST_MATCH, VERIFY_WEIGHT = 4, 8.0
#: Documents that a shingle which the sketch doesn't show as frequent is taken to be in, on average.
LIGHT = 1.5
#: Rows up to which a list of ids (24 bytes each), and keys up to which a list of them (8 bytes each) is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS, BROADCAST_KEYS = 200_000, 1_000_000


def overlap_needed(n: int, m: int, percent: int) -> int:
    """Shared shingles that two sets need: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int, match: int) -> int:
    return min(n, n - -(-percent * n // 100) + match)


def frequent(df: DataFrame, text_col: str, size: int) -> np.ndarray:
    """For each counter of the sketch, its frequency level: 0 where no task found it frequent, else 1 + log2 of the
    documents counted. Every document is counted; tasks report counters that stand out from their own mean."""
    chars = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_counters = min(MOST_SKETCH, max(SKETCH, 1 << (chars // CHARS_A_COUNTER).bit_length()))

    def make_run(batches):
        counts = np.zeros(n_counters, np.int32)
        for batch in (part for whole in batches for part in chunks(whole)):
            held = shingle_sets(batch.column(0), size)
            if held:
                at, n = np.unique(np.concatenate(held) & np.uint64(n_counters - 1), return_counts=True)
                counts[at.astype(np.int64)] += n.astype(np.int32)
        mean = counts.mean()
        at = np.flatnonzero(counts > mean + 8 * np.sqrt(mean) + 8)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64) - int(mean))], names=["counter", "n"])
        trim()

    small_batches(df.sparkSession)
    found = df.select(text_col).mapInArrow(make_run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    levels = np.zeros(n_counters, np.uint8)
    for r in found.orderBy(F.desc("n"), "counter").limit(HEAVY).collect():
        levels[r.counter] = 1 + int(np.log2(max(1, r.n)))
    return levels


def ordered(held: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in the order of all documents, and each shingle's level."""
    level = levels[(held & np.uint64(len(levels) - 1)).astype(np.int64)]
    if not level.any():
        return held, level
    order = np.argsort(level, kind="stable")  # by level, then by hash, as `held` ascends
    return held[order], level[order]


def best_match(level: np.ndarray, n: int, percent: int) -> int:
    """The l with the least estimated cost: postings read plus candidates verified."""
    longest = prefix_length(n, percent, LONGEST_MATCH)
    listed = np.cumsum(np.where(level[:longest] > 0, np.exp2(level[:longest].astype(float)), LIGHT))
    best, least = 1, float("inf")
    for match in range(1, LONGEST_MATCH + 1):
        p = prefix_length(n, percent, match)
        cost = listed[p - 1] + VERIFY_WEIGHT * (listed[p - 1] - p) / match**2
        if cost < least:
            best, least = match, cost
    return best


def prefixes(df: DataFrame, levels: np.ndarray, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(doc_id, row, n, cls, match, tokens): row is a hash of id and text, cls the set's 64-bit hash; tokens, the prefix,
    are empty where the task has given them for the class already."""
    shared = df.sparkSession.sparkContext.broadcast(levels)  # one byte a counter

    def make():
        seen: set[int] = set()

        def run(batch: pa.RecordBatch) -> list:
            n, cls, match, tokens = [], [], [], []
            if len(seen) > 200_000:
                seen.clear()
            for held in shingle_sets(batch.column(1), size):
                n.append(len(held))
                if not len(held):
                    cls.append(None)
                    match.append(0)
                    tokens.append(None)
                    continue
                key = int((np.bitwise_xor.reduce(mixed(held)) + np.uint64(len(held))).view(np.int64))
                cls.append(key)
                ranked, level = ordered(held, shared.value)
                chosen = best_match(level, len(held), percent)
                match.append(chosen)
                if key in seen:
                    tokens.append(None)
                else:
                    seen.add(key)
                    tokens.append(ranked[: prefix_length(len(held), percent, chosen)].view(np.int64))
            lists = list_array([t if t is not None else np.zeros(0, np.int64) for t in tokens], np.int64)
            return [batch.column(0), batch.column(2), n, cls, match, lists]

        return run

    return arrow_map(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row")), make, "doc_id long, row long, n long, cls long, match int, tokens array<long>")


def sets_of(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(cls, held) of the wanted classes (cls, rep): their sets as bytes, once unless rows with one id and text repeat."""
    few = wanted.count() <= BROADCAST_ROWS
    right = wanted.select(F.col("rep").alias("_rep")).distinct()
    docs = df.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(right) if few else right, F.col("_doc").eqNullSafe(F.col("_rep")), "left_semi")

    def make():
        def run(batch: pa.RecordBatch) -> list:
            held = shingle_sets(batch.column(0), size)
            keys = [int((np.bitwise_xor.reduce(mixed(h)) + np.uint64(len(h))).view(np.int64)) if len(h) else None for h in held]
            return [keys, pa.array([h.tobytes() for h in held], pa.binary())]

        return run

    made = arrow_map(docs.select("_text"), make, "cls long, held binary")
    return made.join(F.broadcast(wanted.select("cls")) if few else wanted.select("cls"), "cls", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""

    def make():
        def run(batch: pa.RecordBatch) -> list:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [[], []]
            for x, y, s, t in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(p) + len(q) - shared):
                    out[0].append(x)
                    out[1].append(y)
            return out

        return run

    left = sets.select(F.col("cls").alias("a"), F.col("held").alias("held_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("held").alias("held_b"))
    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "held_a", "held_b"), make, "a long, b long")


def _within(n: Column, pos: Column, other: Column, match: Column, percent: int) -> Column:
    """Whether a position is in the prefix that a pair of these sizes needs."""
    need = F.floor((F.lit(percent) * (n + other) + F.lit(99 + percent)) / F.lit(100 + percent))
    return pos < n - need + F.least(match, need)


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _spread(told: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join on shingles, with the further keys `band` and `block`. A list of up to `BLOCK` postings is one
    block. Of a longer one, the right side is split by size, in bands that only neighbours of can fit, and each band by a
    hash; the left side goes to every block of its band and the two beside it, so that no pair is lost."""
    long = F.col("listed") > BLOCK
    blocks = F.when(long, F.ceil(F.col("listed") / BLOCK)).otherwise(1).cast("int")
    band = F.when(long, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(max(100 / percent, 1.01))) - F.lit(1e-9))).otherwise(0).cast("int")
    right = told.withColumn("band", band).withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    bands = F.when(long, F.array(band - 2, band - 1, band, band + 1, band + 2)).otherwise(F.array(F.lit(0)))
    left = told.filter("minor").withColumn("band", F.explode(bands)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return left, right


def linked(df: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return grouped(df, size, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def one_of_each(df: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` (all columns), one of each component: that with the smallest id (null last; of equal ids one by a
    hash of the text). Rows without words all stay. Texts are shuffled only where the kept rows are too many to
    broadcast their keys, and where rows with equal id and text repeat."""
    rows = grouped(df, size, percent, id_col, text_col)
    first = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first"))
    counted = rows.groupBy("row").agg(F.count("*").alias("n"), F.max(F.col("component").isNull()).alias("apart"))
    kept = counted.join(first.select("first.row"), "row", "left_semi").unionByName(counted.filter("apart")).select("row", ((F.col("n") > 1) & ~F.col("apart")).alias("many"))
    kept = materialise(kept, workspace(df.sparkSession, "jaccard-kept"))
    key = free_name(df.columns, "row")
    keyed = df.withColumn(key, F.xxhash64(id_col, text_col))

    def held(many: bool) -> DataFrame:
        keys = kept.filter("many" if many else "NOT many").select(F.col("row").alias(key))
        return keyed.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_semi")

    return held(False).unionByName(held(True).dropDuplicates([key])).select(df.columns)


def grouped(df: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n_shingles, component, component_id) of every row: row is a hash of id and text, component a number of
    the component (null without words), component_id its smallest doc_id."""
    spark = df.sparkSession
    root = workspace(spark, "jaccard")
    levels = frequent(df, text_col, size)
    rows = materialise(prefixes(df, levels, id_col, text_col, size, percent), f"{root}/rows")
    classes = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").cast("int").alias("n"), F.max("match").alias("match"), F.max_by("tokens", F.size("tokens")).alias("tokens"))
    classes = materialise(classes, f"{root}/classes")
    postings = classes.select("cls", "n", "match", F.posexplode("tokens").alias("pos", "token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("listed")).filter("listed > 1")
    shared = materialise(postings.join(lists, "token"), f"{root}/postings")
    release(spark)

    def edges_of(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialise(pairs, f"{root}/{name}-pairs")
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        wanted = materialise(ends.join(classes.select("cls", "rep"), "cls"), f"{root}/{name}-wanted")
        sets = materialise(sets_of(df, wanted, id_col, text_col, size), f"{root}/{name}-sets")
        if sets.count() > wanted.count():
            sets = materialise(sets.groupBy("cls").agg(F.first("held").alias("held")), f"{root}/{name}-single-sets")
        edges = materialise(verified(pairs, sets, percent), f"{root}/{name}-edges")
        drop_path(spark, f"{root}/{name}-sets")
        release(spark)
        return edges

    n, m = F.col("n"), F.col("pivot.n")
    match = F.least("match", "pivot.match")
    pivots = materialise(shared.filter(F.col("listed") > BIG).groupBy("token").agg(F.min(F.struct("pos", "n", "cls", "match")).alias("pivot")), f"{root}/pivots")
    shared = shared.join(pivots, "token", "left")
    star = (
        shared.filter((F.col("cls") != F.col("pivot.cls")) & _sizes_fit(n, m, percent))
        .filter(_within(n, F.col("pos"), m, match, percent) & _within(m, F.col("pivot.pos"), n, match, percent))
        .groupBy(F.col("cls").alias("a"), F.col("pivot.cls").alias("b"))
        .agg(F.count("*").alias("met"))
        .filter("met > 1")  # one common shingle says little, and the pairs that are left out here are looked at below
        .select("a", "b")
    )
    edges = edges_of(star, "star")
    labels = components(edges)
    mine, theirs = labels.select(F.col("id").alias("cls"), F.col("root").alias("_mine")), labels.select(F.col("id").alias("_pivot"), F.col("root").alias("_theirs"))
    told = (
        shared.withColumn("_pivot", F.col("pivot.cls"))
        .join(mine, "cls", "left")
        .join(theirs, "_pivot", "left")
        .select("token", "cls", "n", "match", "pos", "listed", F.coalesce("_mine", "cls").alias("comp"), ((F.col("listed") <= BIG) | (F.coalesce("_mine", "cls") != F.coalesce("_theirs", "_pivot"))).alias("minor"))
    )
    told = materialise(told, f"{root}/told")
    left, right = _spread(told, percent)
    left, right = left.alias("l"), right.alias("r")
    both = F.least("l.match", "r.match")
    pairs = (
        left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.block") == F.col("r.block")))
        .filter((F.col("l.comp") != F.col("r.comp")) & (~F.col("r.minor") | (F.col("l.cls") < F.col("r.cls"))))
        .filter(_sizes_fit(F.col("l.n"), F.col("r.n"), percent) & _within(F.col("l.n"), F.col("l.pos"), F.col("r.n"), both, percent) & _within(F.col("r.n"), F.col("r.pos"), F.col("l.n"), both, percent))
        .groupBy(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b"))
        .agg(F.count("*").alias("met"), F.first(F.least("l.match", "r.match", F.floor((F.lit(percent) * (F.col("l.n") + F.col("r.n")) + F.lit(99 + percent)) / F.lit(100 + percent)))).alias("need"))
        .filter("met >= need")
        .select("a", "b")
    )
    more = edges_of(pairs, "cross")
    final = components(labels.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    for name in ("postings", "pivots", "told", *(f"{part}-{kind}" for part in ("star", "cross") for kind in ("pairs", "wanted", "single-sets", "edges"))):
        drop_path(spark, f"{root}/{name}")
    named = classes.select("cls", "rep").join(final.select(F.col("id").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    owner = named.join(least, "root").select("cls", F.col("root").alias("component"), "component_id")
    return rows.select("doc_id", "row", F.col("n").alias("n_shingles"), "cls").join(owner, "cls", "left").select("doc_id", "row", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))
