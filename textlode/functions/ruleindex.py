"""Rules by index: what a glob asks of a path becomes a key, and paths join rules on keys.

A glob that is a whole path, a base name, a suffix of base names (`*.rs`), all below a folder (`out/**`) or the last parts of a
path (`**/a/b`) is decided by its key alone. Other globs are keyed by the folder that they must lie in and are tried as
expressions on the paths there. A path has as many keys as it has folders and dots, whatever the number of rules, which is
not limited. Of the rules that match, the one of the highest rank decides.

Rows: repeated paths are decided once and keep their rows; a null path is decided by nothing; rules of equal rank would tie,
so that ranks are to be distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions.globs import GlobOptions, to_regex
from textlode.functions.ignore import IgnoreRule, ranked

RULES = "key string, regex string, dir_only boolean, include boolean, rank long"
SPECIAL = frozenset("*?[]{}\\")


def plain(text: str) -> bool:
    return bool(text) and not set(text) & SPECIAL


def key_of(glob: str, base: str = "", basename: bool = False) -> tuple[str, str | None]:
    """(key, expression or None) of a glob below `base`."""
    top = f"{base}/" if base else ""
    if basename:
        if plain(glob):
            return f"name|{base}|{glob}", None
        if glob.startswith("*.") and plain(glob[1:]):
            return f"dots|{base}|{glob[1:]}", None
    elif plain(glob):
        return f"path|{top}{glob}", None
    elif glob.endswith("/**") and plain(glob[:-3]):
        return f"below|{top}{glob[:-3]}", None
    elif glob.startswith("**/") and plain(glob[3:]):
        return f"last|{base}|{glob[3:]}", None
    folders = [] if basename else glob.split("/")[:-1]
    known = next((k for k, part in enumerate(folders) if not plain(part)), len(folders))
    body = to_regex(glob, GlobOptions(literal_separator=True)).removeprefix(r"\A").removesuffix(r"\z")
    prefix = "".join(c if c.isalnum() or c == "/" else f"\\x{{{ord(c):x}}}" for c in top)
    return f"in|{'/'.join([*([base] if base else []), *folders[:known]])}", rf"\A{prefix}{'(?:.*/)?' if basename else ''}{body}\z"


def rule_table(spark: SparkSession, rules: list[IgnoreRule]) -> DataFrame:
    """Parsed rules as a table, ranked by their precedence."""
    return spark.createDataFrame([(*key_of(r.glob, r.base, r.basename), r.dir_only, r.include, k) for k, r in enumerate(ranked(rules))], RULES)


def glob_table(spark: SparkSession, globs: list[str]) -> DataFrame:
    """Globs over whole paths, ranked by their places in the list."""
    return spark.createDataFrame([(*key_of(g), False, True, k) for k, g in enumerate(globs)], RULES)


def keys(path: Column) -> Column:
    """All keys by which a rule can be about a path."""
    parts = F.split(path, "/")
    depth, name = F.size(parts), F.element_at(parts, -1)
    upto = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    folders = F.transform(F.sequence(F.lit(0), depth - 1), upto)  # the root is the empty one
    below = F.slice(folders, 2, F.size(folders))
    dots = F.transform(F.filter(F.sequence(F.lit(1), F.length(name)), lambda k: F.substring(name, k, F.lit(1)) == "."), lambda k: F.substring(name, k, F.length(name)))
    lasts = lambda k: F.transform(F.sequence(k + 1, depth), lambda j: F.array_join(F.slice(parts, j, depth), "/"))
    by_folder = lambda head, values: F.flatten(F.transform(folders, lambda b, k: F.transform(values(k), lambda v: F.concat(F.lit(f"{head}|"), b, F.lit("|"), v))))
    return F.concat(
        F.array(F.concat(F.lit("path|"), path)),
        F.transform(below, lambda b: F.concat(F.lit("below|"), b)),
        F.transform(folders, lambda b: F.concat(F.lit("in|"), b)),
        by_folder("name", lambda k: F.array(name)),
        by_folder("dots", lambda k: dots),
        by_folder("last", lasts),
    )


def matched(entries: DataFrame, rules: DataFrame, path: str = "path", is_dir: str | None = None) -> DataFrame:
    """(path, is_dir, rank, include) of each distinct path and each rule that matches it."""
    rows = entries.select(F.col(path).alias("path"), (F.col(is_dir) if is_dir else F.lit(False)).alias("is_dir")).filter("path IS NOT NULL").distinct()
    found = rows.select("path", "is_dir", F.explode(keys(F.col("path"))).alias("key")).join(rules, "key")
    return found.filter("(regex IS NULL OR path RLIKE regex) AND (is_dir OR NOT dir_only)").select("path", "is_dir", "rank", "include")


def decisions(entries: DataFrame, rules: DataFrame, path: str = "path", is_dir: str | None = None) -> DataFrame:
    """`entries` with `decision`: ignore, whitelist or none, by the rule of the highest rank that matches the path itself."""
    kind = (F.col(is_dir) if is_dir else F.lit(False)).alias("_is_dir")
    best = matched(entries, rules, path, is_dir).groupBy(F.col("path").alias("_path"), F.col("is_dir").alias("_is_dir")).agg(F.max_by("include", "rank").alias("_include"))
    said = F.when(F.col("_include").isNull(), "none").when(F.col("_include"), "whitelist").otherwise("ignore")
    rows = entries.select("*", F.col(path).alias("_path"), kind)
    return rows.join(best, ["_path", "_is_dir"], "left").select(*entries.columns, said.alias("decision"))


def not_ignored(entries: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """The files that are ignored neither by themselves nor with a folder above them. Each folder is decided once."""
    parts = F.split("_file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("place"), (k < F.size(parts)).alias("folder")))
    steps = entries.select(F.col(path).alias("_file")).distinct().select("_file", F.explode(above).alias("s")).select("_file", "s.place", "s.folder")
    lost = decisions(steps.select("place", "folder").distinct(), rules, "place", "folder").filter("decision = 'ignore'")
    files = steps.join(lost, ["place", "folder"]).select(F.col("_file").alias(path)).distinct()
    return entries.join(files, path, "left_anti")


def matching_globs(entries: DataFrame, globs: DataFrame, path: str = "path") -> DataFrame:
    """(path, found): the ascending places of the globs that match each distinct path that some glob matches."""
    return matched(entries, globs, path).groupBy("path").agg(F.sort_array(F.collect_set("rank")).alias("found"))
