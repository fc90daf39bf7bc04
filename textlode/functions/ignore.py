"""Ignore rules: the gitignore grammar, and the decision of a stack of rule files for a path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlode.functions.globs import GlobOptions, hits, matches

#: Precedence of rule sources, strongest first.
SOURCES = ("custom", "ignore", "gitignore", "exclude", "global", "explicit")


@dataclass(frozen=True)
class IgnoreRule:
    """A parsed rule: its glob relative to `base`, whether it re-includes, and whether it is for directories only."""

    glob: str
    base: str
    include: bool
    dir_only: bool
    basename: bool
    source: str = "gitignore"


def parse_rules(text: str, base: str = "", source: str = "gitignore") -> list[IgnoreRule]:
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        include = line.startswith("!")
        if include:
            line = line[1:]
        if line[:2] in ("\\#", "\\!"):
            line = line[1:]
        dir_only = line.endswith("/")
        line = line.rstrip("/") if dir_only else line
        rooted = line.startswith("/")
        body = line.removeprefix("/")
        if body:
            out.append(IgnoreRule(body, base.strip("/"), include, dir_only, not rooted and "/" not in body, source))
    return out


def _hit(rule: IgnoreRule, path: Column, is_dir: Column, ignore_case: bool) -> Column:
    under = F.lit(True) if not rule.base else F.startswith(path, F.lit(f"{rule.base}/"))
    relative = path if not rule.base else F.substring(path, F.lit(len(rule.base) + 2), F.length(path))
    hit = under & matches(relative, rule.glob, GlobOptions(literal_separator=True, ignore_case=ignore_case, basename=rule.basename))
    return hit & is_dir if rule.dir_only else hit


def ranked(rules: list[IgnoreRule]) -> list[IgnoreRule]:
    """Weakest first: by source, then by depth of the rule file, then by place in it."""
    return [r for _, _, _, r in sorted((-SOURCES.index(r.source), r.base.count("/") + bool(r.base), k, r) for k, r in enumerate(rules))]


def decision(path: Column, is_dir: Column, rules: list[IgnoreRule], ignore_case: bool = False) -> Column:
    """`ignore`, `whitelist` or `none`: the strongest matching rule, the last of a file first."""
    out = F.lit("none")
    for rule in ranked(rules):
        out = F.when(_hit(rule, path, is_dir, ignore_case), F.lit("whitelist" if rule.include else "ignore")).otherwise(out)
    return out


def decided(path: str, is_dir: bool, strongest_first: list[IgnoreRule], ignore_case: bool = False) -> str:
    """`decision` for one path."""
    for rule in strongest_first:
        if rule.dir_only and not is_dir or rule.base and not path.startswith(f"{rule.base}/"):
            continue
        if hits(path[len(rule.base) + 1 :] if rule.base else path, rule.glob, GlobOptions(literal_separator=True, ignore_case=ignore_case, basename=rule.basename)):
            return "whitelist" if rule.include else "ignore"
    return "none"


def ignored(path: Column, rules: list[IgnoreRule], ignore_case: bool = False) -> Column:
    """Whether a file is ignored by itself or with one of the directories above it (which no rule can re-enter)."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    parents = F.transform(F.sequence(F.lit(1), depth), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("p"), (k < depth).alias("d")))
    return F.exists(parents, lambda x: decision(x["p"], x["d"], rules, ignore_case) == "ignore")
