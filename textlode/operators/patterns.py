"""Many literal patterns at once, by an automaton over Arrow batches or by a join on hashed grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textlode.session import bounded_batches, materialise, workspace

#: Bytes of all patterns up to which each task builds an automaton of them; beyond that they join on grams.
AUTOMATON_BYTES = 8 << 20
#: Characters of a gram; shorter patterns always go to the automaton.
GRAM = 12


def _automaton(patterns: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        found.add_word(p, k)
    found.make_automaton()
    return found


def contains_any(text: Column, patterns: list[str]) -> Column:
    """Whether a text holds any of the (not empty) patterns."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(patterns)
        for values in batches:
            yield pa.array([t is not None and next(automaton.iter(t), None) is not None for t in values.to_pylist()], pa.bool_())

    return run(text)


def literal_hits(corpus: DataFrame, patterns: DataFrame, keys: list[str], text: str = "text", pattern: str = "pattern") -> DataFrame:
    """(keys, pattern) of every row and each distinct pattern that its text holds. Null and empty patterns hit nothing."""
    known = patterns.select(F.col(pattern).alias("pattern")).filter("pattern <> ''").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()[0]
    rows = corpus.select(*keys, F.col(text).alias("_text")).filter("_text IS NOT NULL")
    if size <= AUTOMATON_BYTES:
        return _by_automaton(rows, [r.pattern for r in known.collect()], keys)
    short = [r.pattern for r in known.filter(F.char_length("pattern") < GRAM).collect()]  # few: distinct strings under GRAM characters
    return by_grams(rows, known.filter(F.char_length("pattern") >= GRAM), keys).unionByName(_by_automaton(rows, short, keys))


def gram_hashes(text: str, size: int) -> np.ndarray:
    """Distinct hashes of all runs of `size` bytes of a text: polynomials of their bytes, for all places at once."""
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    n = len(data) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(size if n > 0 else 0):
        out = (out + data[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out).view(np.int64)


def grams_of(text: Column) -> Column:
    bounded_batches(SparkSession.active())
    size = GRAM

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [gram_hashes(t, size) for t in texts.to_pylist()]
            bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    return run(text)


def by_grams(rows: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and patterns meet on one gram of each pattern, the one that fewest texts have. Only hashes are shuffled for that;
    texts join once, with the candidates that they are compared with."""
    spark = rows.sparkSession
    place = workspace(spark, "grams")
    key = [F.xxhash64("_text").alias("_k1"), F.xxhash64(F.lit(GRAM), "_text").alias("_k2")]
    wanted = patterns.select("pattern", F.explode(grams_of(F.col("pattern"))).alias("gram"))
    there = rows.filter(F.char_length("_text") >= GRAM).select(*key, F.explode(grams_of(F.col("_text"))).alias("gram"))
    there = materialise(there.join(wanted.select("gram").distinct(), "gram", "left_semi").distinct(), f"{place}/there")
    counts = there.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("pattern").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min_by("gram", "n").alias("gram")).filter("absent = 0")
    met = there.join(rarest.select("pattern", "gram"), "gram").select("_k1", "_k2", "pattern")
    return rows.select(*keys, "_text", *key).join(met, ["_k1", "_k2"]).filter(F.contains("_text", F.col("pattern"))).select(*keys, "pattern")


def _by_automaton(rows: DataFrame, patterns: list[str], keys: list[str]) -> DataFrame:
    schema = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL("pattern string").fields])
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(patterns)  # at most AUTOMATON_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value) if shared.value else None
        for batch in batches:
            at, found = [], []
            for k, value in enumerate(batch.column(len(keys)).to_pylist() if automaton else []):
                ids = sorted({i for _, i in automaton.iter(value)})
                at += [k] * len(ids)
                found += [shared.value[i] for i in ids]
            taken = batch.select(range(len(keys))).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], names=[*keys, "pattern"])

    return rows.mapInArrow(run, schema)
