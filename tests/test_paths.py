import random

import pytest
import regex
from pyspark.sql import functions as F

from textlode.functions import globs as G
from textlode.functions import replacement, ruleindex
from textlode.functions.dialect import compile_patterns, to_python
from textlode.functions.filetypes import FileTypes
from textlode.functions.globs import GlobError, GlobOptions, escape, to_regex
from textlode.functions.ignore import decision, ignored, parse_rules
from textlode.plans.flags import config_args, parse
from textlode.sources.files import WalkOptions, byte_size, decode_bytes, read_corpus, rules_of, sort_entries, walk


def glob(pattern, path, **options):
    return bool(regex.search(to_python(to_regex(pattern, GlobOptions(**options))).replace(r"\z", r"\Z"), path))


@pytest.mark.parametrize(
    ("pattern", "path", "options", "expected"),
    [
        ("maps/**/reef.svg", "maps/reef.svg", {}, True),
        ("maps/**/reef.svg", "maps/north/cape/reef.svg", {}, True),
        ("maps/**/reef.svg", "maps/north/oldreef.svg", {}, False),
        ("**/log", "log", {}, True),
        ("**/log", "ship/log", {}, True),
        ("ship/**", "ship/log/1", {}, True),
        ("*.svg", "maps/a.svg", {}, True),
        ("*.svg", "maps/a.svg", {"literal_separator": True}, False),
        ("q[!0-9]z", "qyz", {}, True),
        ("q[!0-9]z", "q7z", {}, False),
        ("{tea,{map,cape}}.log", "cape.log", {}, True),
        (r"sea\*way", "sea*way", {}, True),
        ("CAPE*", "cape horn", {"ignore_case": True}, True),
    ],
)
def test_globs(pattern, path, options, expected):
    assert glob(pattern, path, **options) is expected


@pytest.mark.parametrize(("bad", "kind"), [("[a", "UnclosedClass"), ("[z-a]", "InvalidRange"), ("a}", "UnopenedAlternates"), ("{a", "UnclosedAlternates"), ("a\\", "DanglingEscape")])
def test_bad_globs(bad, kind):
    with pytest.raises(GlobError, match=kind):
        to_regex(bad)


def test_small_parts():
    assert glob(escape("a[b]*"), "a[b]*") and not glob(escape("a*"), "ab")
    assert [(r.glob, r.include, r.dir_only) for r in parse_rules("# c\n!a/\n\\#b\nc  \n\n/d")] == [("a", True, True), ("#b", False, False), ("c", False, False), ("d", False, False)]
    assert byte_size("2K") == 2048
    assert FileTypes().add("x:*.x").of("x") == ["*.x"]
    assert FileTypes().of("md") == FileTypes().of("markdown") and "bashrc" in FileTypes().of("sh") and FileTypes().of("nix") == ["*.nix"]
    assert FileTypes.from_text("# own\na:*.a\na:*.b\n").of("a") == ["*.a", "*.b"]
    assert decode_bytes(b"\xff\xfea\0", "sjis") == "a" and decode_bytes("日".encode("cp932"), "sjis") == "日"
    compiled = compile_patterns(["(?P<a>x)(y)"])
    assert replacement.parts("$$-$2-${a}-$nope-${-$1z", compiled)[:4] == ["$-", 2, "-", 1]


def test_flags():
    assert parse([*config_args("# ours\n\n--smart-case\n-C\n2\n"), "-C1", "x"])[0].context == 1
    query, paths = parse(["-inw", "-C2", "-A", "1", "--", "needle", "src"])
    assert (query.patterns, paths, query.case, query.word, query.line_number, query.lines_before, query.lines_after) == (("needle",), ["src"], "insensitive", True, True, 2, 1)
    assert parse(["-x", "-w", "a"])[0].line is False
    assert parse(["-m=3", "--no-unicode", "a"])[0].max_count == 3
    with pytest.raises(ValueError):
        parse(["--nope", "a"])
    with pytest.raises(ValueError):
        parse(["-uuuu", "a"])


def test_walk(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "b.txt": "needle\n", "sub/c.txt": "needle", ".hid": "h", "sub/skip.log": "l", ".gitignore": "*.log\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".git").mkdir()
    options = WalkOptions()
    assert rules_of(str(tmp_path), options)
    found = walk(spark, [str(tmp_path)], options)
    assert [r.path for r in sort_entries(found, "path").collect()] == ["a.py", "b.txt", "sub/c.txt"]
    only = walk(spark, [str(tmp_path)], WalkOptions(globs=["*.txt"], max_depth=1))
    assert {(r.path, r.text) for r in read_corpus(spark, only).collect()} == {("b.txt", "needle\n")}


def test_rule_index_equals_expressions(spark):
    rng = random.Random(7)
    names = ["a", "b", "c.rs", "d.tar.gz", ".e", "f"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(300)})
    globs = ["a", "*.rs", "*.tar.gz", "*.gz", "/a/b", "a/b", "b/**", "**/c.rs", "**/b/f", "a/*/c.rs", "*/f", ".*", "[ab]", "a/", "b/a/", "{a,b}/f", "?"]
    rules = []
    for base in ("", "a", "a/b", "f"):
        rules += parse_rules("\n".join(("!" if rng.random() < 0.3 else "") + rng.choice(globs) for _ in range(6)), base)
    rows = spark.createDataFrame([(p, d) for p in paths for d in (True, False)] + [(None, False)], "path string, folder boolean")
    want = sorted((tuple(r) for r in rows.filter("path IS NOT NULL").select("path", "folder", decision(F.col("path"), F.col("folder"), rules).alias("decision")).collect()))
    got = ruleindex.decisions(rows, ruleindex.rule_table(spark, rules), is_dir="folder").collect()
    assert sorted(tuple(r) for r in got if r.path is not None) == want and [r.decision for r in got if r.path is None] == ["none"]
    assert len({d for *_, d in want}) == 3
    files = rows.filter("path IS NOT NULL AND NOT folder").select("path")
    kept = {r.path for r in files.filter(~ignored(F.col("path"), rules)).collect()}
    assert {r.path for r in ruleindex.not_ignored(files, ruleindex.rule_table(spark, rules)).collect()} == kept
    whole = [g.removeprefix("/") for g in globs if not g.endswith("/")]
    found = {r.path: r.found for r in ruleindex.matching_globs(files, ruleindex.glob_table(spark, whole)).collect()}
    listed = {r.path: r.hits for r in files.select("path", G.matching_indexes(F.col("path"), whole, G.GlobOptions(literal_separator=True)).alias("hits")).collect()}
    assert {p: h for p, h in listed.items() if h} == found


def test_indexed_rules_need_no_python_and_no_limit(spark, capsys):
    rules = spark.range(200_000).select(F.concat(F.lit("path|d/"), F.col("id").cast("string")).alias("key"), F.lit(None).cast("string").alias("regex"), F.lit(False).alias("dir_only"), F.lit(False).alias("include"), F.col("id").alias("rank"))
    out = ruleindex.decisions(spark.createDataFrame([("d/199999",), ("d/x",)], "path string"), rules)
    assert {tuple(r) for r in out.collect()} == {("d/199999", "ignore"), ("d/x", "none")}
    out.explain()
    assert "Python" not in capsys.readouterr().out
