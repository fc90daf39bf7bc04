"""Files that are larger than a row: the search runs in the splits that Spark cuts, and a file's limits, stops and context
are decided from sums over its splits.

Each task passes once over the lines of a split. It keeps the selected lines, those near them, and as many first and last
lines of the split as the context is wide, each with its place in the split and the places of the selected lines before and
after it; of the split itself one row of counts and places. Prefix sums over these rows, which are taken in blocks of splits
so that no task holds all splits of a file, turn places in a split into line numbers and offsets of the file, ordinals of
selected lines, and the nearest selected lines beyond a border. What is shown is then an expression on each kept line: no
task holds a file or its results.

Rows: empty files have no lines, and no record follows the last terminator; with a NUL, a file ends before its record unless
it is searched as text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textlode.operators.search import Search
from textlode.plans.query import SearchQuery
from textlode.session import bounded_batches, materialise, workspace

#: Splits of a file whose prefix sums one task takes.
BLOCK = 4096
#: A kept line (at is its place) or, with `line` null, a split's summary: at is its number of lines, start its bytes, n_hit
#: its selected lines, before and after its last and first selected line, gap its first line that isn't selected, gap_after
#: the first such line after the first selected one, nul its first line with a NUL.
ROWS = "path string, split long, at long, start long, line string, hit boolean, before long, after long, n_hit long, gap long, gap_after long, nul long"


def scanned(spark: SparkSession, path: str, query: SearchQuery) -> DataFrame:
    """ROWS of all files below `path`."""
    if query.multiline or query.binary == "convert":
        raise ValueError("multi-line searches and conversion of NULs are not available on large files")
    search = Search(spark.createDataFrame([], "path string, text string"), query, ("path",))
    line = F.col("value")
    near = max(query.lines_before, query.lines_after)
    body = search.stripped(line)
    rows = spark.read.option("lineSep", query.terminator).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.octet_length(line).cast("long").alias("size"), search.selected(body).alias("hit"), F.contains(line, F.lit("\0")).alias("nul"), body.alias("line")
    )
    if not near and not query.passthru:
        rows = rows.withColumn("line", F.when(F.col("hit"), F.col("line")))  # other lines are only counted
    bounded_batches(spark)
    schema = StructType.fromDDL(ROWS)
    arrow = to_arrow_schema(schema)
    marks = query.binary == "quit" and not query.null_data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[str, int], Split] = {}
        for batch in batches:
            out: list[tuple] = []
            for name, split, size, hit, nul, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, split) not in parts:
                    parts[name, split] = Split(query)
                out += [(name, split, *row) for row in parts[name, split].read(size, hit, nul and marks, value)]
            yield _batch(out, arrow)
        for (name, split), part in parts.items():
            yield _batch([(name, split, *row) for row in part.ended()], arrow)

    return rows.mapInArrow(run, schema)


class Split:
    """The state of one split: counts, and the last lines that a selected line may still want to show."""

    def __init__(self, query: SearchQuery) -> None:
        self.before, self.after, self.all = query.lines_before, query.lines_after, query.passthru
        self.limit, self.stop = query.max_count, query.stop_on_nonmatch
        self.at = self.start = self.hits = 0
        self.first = self.last = self.gap = self.gap_after = self.nul = None
        self.waiting: deque[list] = deque()

    def read(self, size: int, hit: bool, nul: bool, line: str | None) -> list[tuple]:
        """The lines that are decided now."""
        at, out = self.at, []
        if nul and self.nul is None:
            self.nul = at
        if hit:
            self.hits += 1
            self.first = at if self.first is None else self.first
            self.last = at
            for row in self.waiting:
                row[5] = at if row[5] is None else row[5]
        else:
            self.gap = at if self.gap is None else self.gap
            self.gap_after = at if self.gap_after is None and self.first is not None else self.gap_after
        shown = hit or self.all or at < self.after or (self.last is not None and at - self.last <= self.after)
        self.waiting.append([at, self.start, line, hit, self.last, at if hit else None, shown])
        while self.waiting and self.waiting[0][0] <= at - self.before:
            row = self.waiting.popleft()
            if row[6] or row[5] is not None:
                out.append((*row[:6], None, None, None, None))
        self.at += 1
        self.start += size + 1
        return out

    def ended(self) -> list[tuple]:
        rest = [(*row[:6], None, None, None, None) for row in self.waiting if row[0] >= self.at - self.before or row[6] or row[5] is not None]
        return [*rest, (self.at, self.start, None, None, self.last, self.first, self.hits, self.gap, self.gap_after, self.nul)]


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)


def prefixed(parts: DataFrame, sums: list[str], lasts: list[str], firsts: list[str]) -> DataFrame:
    """For each split of (path, split, ...): sums of earlier splits (`x_sum`), the greatest value in earlier ones (`x_last`)
    and the least in later ones (`x_first`). First within blocks of `BLOCK` splits, then over the blocks."""
    earlier = Window.partitionBy("path", "block").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("path", "block").orderBy("split").rowsBetween(1, Window.unboundedFollowing)
    inner = parts.select("*", *(F.sum(c).over(earlier).alias(f"{c}_sum") for c in sums), *(F.max(c).over(earlier).alias(f"{c}_last") for c in lasts), *(F.min(c).over(later).alias(f"{c}_first") for c in firsts))
    blocks = parts.groupBy("path", "block").agg(*(F.sum(c).alias(f"{c}_all") for c in sums), *(F.max(c).alias(f"{c}_most") for c in lasts), *(F.min(c).alias(f"{c}_least") for c in firsts))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy("path").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    outer = blocks.select("path", "block", *(F.sum(f"{c}_all").over(before).alias(f"{c}_all") for c in sums), *(F.max(f"{c}_most").over(before).alias(f"{c}_most") for c in lasts), *(F.min(f"{c}_least").over(beyond).alias(f"{c}_least") for c in firsts))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    both = inner.join(outer, ["path", "block"])
    return both.select(*parts.columns, *((zero(f"{c}_sum") + zero(f"{c}_all")).alias(f"{c}_sum") for c in sums), *(F.greatest(f"{c}_last", f"{c}_most").alias(f"{c}_last") for c in lasts), *(F.least(f"{c}_first", f"{c}_least").alias(f"{c}_first") for c in firsts))


class LargeFiles:
    """A search by lines over the files below a path."""

    def __init__(self, spark: SparkSession, path: str, query: SearchQuery) -> None:
        self.query = query
        found = materialise(scanned(spark, path, query), workspace(spark, "large-files"))
        parts = found.filter("line IS NULL AND n_hit IS NOT NULL").select("path", "split", F.col("at").alias("lines"), F.col("start").alias("bytes"), "before", "after", "n_hit", "gap", "gap_after", "nul")
        # splits start at multiples of a size that is the same for a file, so that blocks of them are ranges of bytes
        step = parts.groupBy("path").agg((F.greatest(F.max("split") / F.greatest(F.count("*") - 1, F.lit(1)), F.lit(1)) * BLOCK).cast("long").alias("step"))
        parts = parts.join(step, "path").withColumn("block", F.floor(F.col("split") / F.col("step"))).drop("step")
        placed = prefixed(parts, ["lines", "bytes", "n_hit"], [], [])
        at = lambda c: (F.col(c) + F.col("lines_sum")).alias(c)
        placed = placed.select("path", "split", "block", "lines_sum", "bytes_sum", "n_hit_sum", "n_hit", *(at(c) for c in ("before", "after", "gap", "gap_after", "nul")))
        self.parts = materialise(prefixed(placed, [], ["before"], ["after"]), workspace(spark, "large-files"))
        self.rows = found.filter("line IS NOT NULL")
        self.ends = self._ends()

    def _ends(self) -> DataFrame:
        """(path, end): the first line of each file that is not searched any more, for a NUL or after the non-match that ends
        the first run (which may still be context)."""
        first = self.parts.groupBy("path").agg(F.min("after").alias("first_hit"), F.min("nul").alias("nul"))
        if not self.query.stop_on_nonmatch:
            return first.select("path", F.col("nul").alias("end"))
        gaps = self.parts.join(first, "path").select("path", F.explode(F.array("gap", "gap_after")).alias("gap"), "first_hit").filter("gap > first_hit").groupBy("path").agg(F.min("gap").alias("gap"))
        return first.join(gaps, "path", "left").select("path", F.least("nul", F.col("gap") + 1).alias("end"))

    def _numbered(self, kept: DataFrame) -> DataFrame:
        """Lines with places in their file, and the nearest selected lines on both sides, across borders."""
        place = lambda c: F.col(c) + F.col("lines_sum")
        parts = self.parts.select("path", "split", "lines_sum", "bytes_sum", "n_hit_sum", F.col("before_last"), F.col("after_first"))
        rows = kept.join(parts, ["path", "split"]).join(self.ends, "path")
        rows = rows.select("path", "split", place("at").alias("at"), (F.col("start") + F.col("bytes_sum")).alias("byte_offset"), "line", "hit", F.coalesce(place("before"), "before_last").alias("before"), F.coalesce(place("after"), "after_first").alias("after"), "n_hit_sum", "end")
        return rows.filter("end IS NULL OR at < end")

    def _limits(self) -> DataFrame | None:
        """(path, last): the last line that opens context or is shown as selected, in files that have more than the limit."""
        if self.query.max_count is None:
            return None
        n = self.query.max_count
        there = self.parts.filter(F.col("n_hit_sum").between(n - self.parts.n_hit, n - 1) & (F.col("n_hit") > 0)) if n else None
        if there is None:
            return self.parts.select("path").distinct().select("path", F.lit(-1).cast("long").alias("last"))
        hits = self.rows.filter("hit").join(there.select("path", "split", "lines_sum", (F.lit(n) - F.col("n_hit_sum")).alias("nth")), ["path", "split"])
        nth = Window.partitionBy("path", "split").orderBy("at")
        return hits.withColumn("k", F.row_number().over(nth)).filter("k = nth").select("path", (F.col("at") + F.col("lines_sum")).alias("last"))

    def shown(self) -> DataFrame:
        """(path, line_number, byte_offset, kind, line, group_id): selected lines and those around them."""
        q, rows = self.query, self._numbered(self.rows)
        limits = self._limits()
        rows = rows.join(limits, "path", "left") if limits is not None else rows.withColumn("last", F.lit(None).cast("long"))
        last = F.coalesce("last", F.lit((1 << 62)))
        opener = F.least("before", last)  # the last line at or before this one that opens context
        opener = F.when(opener <= F.col("at"), opener)
        after = F.coalesce(F.col("at") - opener <= q.lines_after, F.lit(False))
        before = F.coalesce((F.col("after") - F.col("at") <= q.lines_before) & (F.col("after") <= last) & (F.col("end").isNull() | (F.col("after") < F.col("end"))), F.lit(False))
        opens = F.col("hit") & (F.col("at") <= last)
        inside: Column = F.lit(True) if q.passthru else opens | after | before
        kind = F.when(opens if q.passthru else F.col("hit"), "match").otherwise("context")
        kept = rows.filter(inside).select("path", "split", (F.col("at") + 1).alias("line_number"), "byte_offset", kind.alias("kind"), "line")
        return self._grouped(kept)

    def _grouped(self, kept: DataFrame) -> DataFrame:
        """group_id grows where shown lines are not adjacent: first within a split, then over the splits of a file."""
        own = Window.partitionBy("path", "split").orderBy("line_number")
        jump = F.coalesce((F.col("line_number") - F.lag("line_number").over(own) > 1).cast("long"), F.lit(0).cast("long"))
        rows = kept.withColumn("jump", jump)
        parts = rows.groupBy("path", "split").agg(F.min("line_number").alias("low"), F.max("line_number").alias("high"), F.sum("jump").alias("jumps"))
        parts = parts.join(self.parts.select("path", "split", "block"), ["path", "split"])
        sides = prefixed(parts, [], ["high"], [])
        border = F.coalesce((F.col("low") - F.col("high_last") > 1).cast("long"), F.lit(0).cast("long"))
        sides = prefixed(sides.withColumn("all_jumps", F.col("jumps") + border), ["all_jumps"], [], [])
        sides = sides.select("path", "split", (F.col("all_jumps_sum") + F.col("all_jumps") - F.col("jumps")).alias("groups"))
        total = F.sum("jump").over(own.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("own", total).join(sides, ["path", "split"]).select("path", "line_number", "byte_offset", "kind", "line", (F.col("own") + F.col("groups")).alias("group_id"))

    def lines(self) -> DataFrame:
        """(path, line_number, byte_offset, line) of the selected lines, up to the limit."""
        rows = self._numbered(self.rows.filter("hit"))
        limits = self._limits()
        if limits is not None:
            rows = rows.join(limits, "path", "left").filter("last IS NULL OR at <= last")
        return rows.select("path", (F.col("at") + 1).alias("line_number"), "byte_offset", "line")

    def count_lines(self) -> DataFrame:
        """(path, n) of the files with selected lines; a binary file whose search would end early has no count."""
        if not self.query.stop_on_nonmatch and self.query.binary == "text":  # the splits' own counts say it
            n = F.sum("n_hit") if self.query.max_count is None else F.least(F.sum("n_hit"), F.lit(self.query.max_count))
            return self.parts.groupBy("path").agg(n.alias("n")).filter("n > 0")
        cut = self.parts.filter("nul IS NOT NULL").select("path").distinct()
        return self.lines().join(cut, "path", "left_anti").groupBy("path").agg(F.count("*").alias("n"))


def search_large(spark: SparkSession, path: str, query: SearchQuery) -> DataFrame:
    """(path, line_number, byte_offset, line) of the selected lines of the files below `path`; with context also kind and
    group_id, for the lines around them."""
    files = LargeFiles(spark, path, query)
    return files.shown() if query.lines_before or query.lines_after or query.passthru else files.lines()
