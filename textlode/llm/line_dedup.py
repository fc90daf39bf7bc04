"""Near-duplicate lines across documents, by deletion neighbourhoods, in DataFrame operations only.

Lines are cut at line feeds. Of equal lines the earliest stays (smallest doc_id, then line number), and so it is of
lines that are within one edit (a code point inserted, deleted or substituted), however short they are: a line goes if
any earlier line is within one edit of it. Blank lines are left alone.

Two lines are within one edit only if deleting at most one character of each gives equal strings. Each line therefore
emits its variants as hashed keys, and equal variants join. Two substituted lines meet in the variant with the deleted
position; an inserted character meets the shorter line itself. In either case it suffices to compare each member with
the earliest of its key (all members of one variant and position are within one edit of each other), so that no key ever
gives pairs of all its lines. Levenshtein distance verifies every link.

Variants are emitted where a partner can be: one edit leaves a half of the line as it is, and all of it but one piece of
`PIECE` characters, so lines (and then pieces) whose rest no other line shares emit none. Both tests lose nothing. The
variants of a piece hash the piece without one character along with the rest, so that a line costs its length and not
its square.

Rows: null text has no lines and stays null; repeated rows with equal id and text count as one document and are treated
alike; null ids come after all others; columns beside id and text pass through, whatever their names, but those named
n_lines and n_removed, which the counts replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.batches import free_name
from textlode.session import materialise, workspace

PIECE = 64
#: Keys up to which a list of them is broadcast (8 bytes each); beyond it the same join shuffles.
BROADCAST_KEYS = 1_000_000


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def occurrences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(dk, doc, at, line) of every line that isn't blank."""
    rows = df.select(_row_key(id_col, text_col).alias("dk"), F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "line"))
    return rows.filter(F.col("line").rlike(r"\S"))


def _known(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` is among `keys`, by broadcast where their number allows it."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, column, "left_semi")


def _halves(line: Column, m: Column) -> Column:
    """Keys of the halves that stay as they are if the longer line of a pair has m or m + 1 characters."""
    keys = []
    for n in (m, m + F.lit(1)):
        h = F.floor(n / 2).cast("int")
        keys += [F.xxhash64(F.lit("p"), n, F.substring(line, F.lit(1), h)), F.xxhash64(F.lit("s"), n, F.substring(line, -(n - h).cast("int"), (n - h).cast("int")))]
    return F.array(*keys)


def pieces(lines: DataFrame) -> DataFrame:
    """(k1, n, q, hole, rest): each piece of a line as the one that an edit may be in; n is the length of the longer
    line, `rest` hashes all but the piece."""
    m, line = F.char_length("line"), F.col("line")
    sized = lines.select("k1", "line", m.alias("m"), F.explode(F.array(F.lit(0), F.lit(1))).alias("more")).withColumn("n", F.col("m") + F.col("more"))
    cut = sized.withColumn("q", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PIECE).cast("int") - 1)))
    start = F.col("q") * PIECE
    size = F.lit(PIECE) - F.col("more")
    rest = F.xxhash64("n", "q", F.substring(line, F.lit(1), start), F.substring(line, start + size + 1, F.col("m")))
    return cut.select("k1", "n", "q", "more", F.substring(line, start + 1, size).alias("hole"), rest.alias("rest"))


def variants(holes: DataFrame) -> DataFrame:
    """(key, pos, k1): the hashed variants of each piece; pos is the deleted position, -1 for the line as it is."""
    hole = F.col("hole")
    whole = holes.filter("more = 1").select(F.xxhash64("rest", hole).alias("key"), F.lit(-1).alias("pos"), "k1")
    cut = holes.filter("more = 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.char_length("hole") - 1)))
    shorter = F.concat(F.substring(hole, F.lit(1), F.col("i")), F.substring(hole, F.col("i") + 2, F.lit(PIECE)))
    return whole.unionByName(cut.select(F.xxhash64("rest", shorter).alias("key"), (F.col("q") * PIECE + F.col("i")).alias("pos"), "k1"))


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)


def near_duplicates(distinct: DataFrame, lines: DataFrame, root: str) -> DataFrame:
    """(k1) of the distinct lines that have an earlier line within one edit."""
    halves = distinct.select("k1", F.explode("halves").alias("half"))
    possible = materialise(_known(halves, materialise(_repeated(halves, "half"), f"{root}/halves"), "half").select("k1").distinct(), f"{root}/possible")
    texts = materialise(_known(lines, possible, "k1").groupBy("k1").agg(F.first("line").alias("line")), f"{root}/texts")
    holes = pieces(texts)
    holes = _known(holes, materialise(_repeated(holes, "rest"), f"{root}/rests"), "rest")
    emitted = materialise(variants(holes), f"{root}/variants")
    met = _known(emitted, materialise(_repeated(emitted, "key"), f"{root}/keys"), "key")
    met = materialise(met.join(distinct.select("k1", "first"), "k1"), f"{root}/met")
    cut = met.filter("pos >= 0")
    earliest = cut.groupBy("key", "pos").agg(F.min(F.struct("first", "k1")).alias("e"))
    same_place = cut.join(earliest, ["key", "pos"]).filter(F.col("k1") != F.col("e.k1")).select(F.col("k1").alias("later"), F.col("e.k1").alias("earlier"))
    plain = met.filter("pos < 0").select("key", F.col("k1").alias("y"), F.col("first").alias("fy"))
    indel = cut.join(plain, "key").filter(F.col("k1") != F.col("y"))
    late = F.col("first") > F.col("fy")
    inserted = indel.select(F.when(late, F.col("k1")).otherwise(F.col("y")).alias("later"), F.when(late, F.col("y")).otherwise(F.col("k1")).alias("earlier"))
    pairs = same_place.unionByName(inserted).distinct()
    a, b = texts.select(F.col("k1").alias("later"), F.col("line").alias("la")), texts.select(F.col("k1").alias("earlier"), F.col("line").alias("lb"))
    distance = F.levenshtein("la", "lb", 1)
    return pairs.join(a, "later").join(b, "earlier").filter((distance >= 0) & (distance <= 1)).select(F.col("later").alias("k1")).distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with the duplicate lines taken out of its texts, and n_lines (before) and n_removed."""
    spark = df.sparkSession
    root = workspace(spark, "line-dedup")
    lines = occurrences(df, id_col, text_col).withColumn("k1", F.xxhash64("line"))
    place = F.struct(F.col("doc").isNull().alias("unknown"), "doc", "at", "dk").alias("place")
    told = materialise(lines.select("k1", place, F.hash("line").alias("k2"), _halves(F.col("line"), F.char_length("line")).alias("halves")), f"{root}/lines")
    distinct = told.groupBy("k1", "k2").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    distinct = materialise(distinct, f"{root}/distinct")
    near = materialise(near_duplicates(distinct, lines, root), f"{root}/near")
    judged = distinct.join(near.withColumn("near", F.lit(True)), "k1", "left").filter("n > 1 OR near").select("k1", "k2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    removed = told.select("k1", "k2", "place").join(judged, ["k1", "k2"]).filter((F.col("place") != F.col("first")) | F.col("near"))
    key, dk, doc, gone = (free_name(df.columns, name) for name in ("key", "dk", "doc", "gone"))
    by_row = removed.groupBy(F.col("place.dk").alias(dk), F.col("place.doc").alias(doc)).agg(F.collect_set("place.at").alias(gone))
    keyed = df.withColumn(key, _row_key(id_col, text_col))
    joined = keyed.join(by_row, (F.col(key) == F.col(dk)) & F.col(id_col).eqNullSafe(F.col(doc)), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(keep, lambda i: F.get(parts, i)), "\n"))
    counts = [F.coalesce(F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in df.columns if c.lower() not in ("n_lines", "n_removed")), *counts)


#: The same in DuckDB's SQL; `{rows}` is a relation (doc_id, text) without repeated rows or null ids.
SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {rows}),
o AS (SELECT doc_id, i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS u(i) WHERE regexp_matches(ls[i], '[^\t-\r ]')),
u AS (SELECT line, min(doc_id * 1000000 + i) AS ord FROM o GROUP BY line),
f AS (SELECT line, ord, length(line) AS m FROM u),
v AS (SELECT ord, m, p, hash(substr(line, 1, p - 1) || substr(line, p + 1)) AS h FROM f, unnest(range(1, m + 1)) AS x(p)),
w AS (SELECT ord, m, h, ord > min(ord) OVER (PARTITION BY h, m, p) AS late FROM v),
y AS (SELECT ord, m, hash(line) AS h FROM f),
c AS (SELECT ord FROM w WHERE late UNION SELECT greatest(w.ord, y.ord) FROM w JOIN y ON w.h = y.h AND w.m = y.m + 1),
g AS (SELECT o.doc_id, o.i FROM o JOIN u ON o.line = u.line WHERE o.doc_id * 1000000 + o.i <> u.ord OR u.ord IN (SELECT ord FROM c)),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(gone, i)], chr(10)), '') END AS text, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
