"""Walks, the data source, byte patterns and files that are cut into many splits."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from textlode.functions.byteview import class_expression
from textlode.functions.dialect import WORD, BytesNeeded, to_python
from textlode.operators.search import Search
from textlode.plans.query import SearchQuery
from textlode.plans.run import run, run_rows
from textlode.sources import corpus, large
from textlode.sources.files import WalkOptions, exclude_file, read_corpus, walk
from textlode.sources.parallel_walk import CONTINUE, QUIT, SKIP, walk_parallel


def put(top, files):
    for path, text in files.items():
        place = top / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    put(top, {".git/info/exclude": "private*\n", ".gitignore": "*.log\n/out/\n!kept.log\n", "a/.gitignore": "!b.log\n", "a/b.log": "x", "a/c.log": "", "kept.log": "", "out/x.txt": "", "a/out/y.txt": "", ".dots/z.txt": "", "a/.h.txt": "", "private.txt": "", "a/d/e/f/deep.py": "12345", "a/d/.ignore": "e/\n", "m.py": "", "n/private/k.txt": "", "n/q.md": ""})
    os.symlink(top / "a", top / "n/link")
    os.symlink(top, top / "n/loop")
    os.symlink(top / "m.py", top / "n/m2.py")
    return str(top)


@pytest.mark.parametrize("options", [{}, {"hidden": True}, {"follow": True}, {"max_depth": 2}, {"globs": ["*.log"]}, {"globs": ["!a/**"]}, {"types": [("py", True)]}, {"ignore": False, "hidden": True}, {"ignore_vcs": False}, {"max_filesize": 2}])
def test_parallel_walk_equals_serial_walk(spark, tree, options):
    options = WalkOptions(**options)
    paths = lambda df: sorted(r.path for r in df.select("path").collect())
    assert paths(walk_parallel(spark, [tree], options)) == paths(walk(spark, [tree], options))


def test_visitor_skips_and_quits(spark, tree):
    paths = lambda visitor: {r.path for r in walk_parallel(spark, [tree], visitor=visitor, folders=True).collect()}
    assert paths(lambda e: SKIP if e["path"] == "a" else CONTINUE) == {"a", "n", "n/q.md", "m.py", "kept.log"}
    assert paths(lambda e: QUIT if e["path"] == "m.py" else CONTINUE) == {"a", "n", "m.py", "kept.log"}


def test_worktrees_share_the_exclude_file(tmp_path):
    put(tmp_path, {"main/.git/info/exclude": "x\n", "main/.git/worktrees/w/commondir": "../..\n", "w/.git": f"gitdir: {tmp_path}/main/.git/worktrees/w\n"})
    assert exclude_file(str(tmp_path / "w")) == str(tmp_path / "main/.git/info/exclude")
    assert exclude_file(str(tmp_path)) is None


def test_data_source_decides_filters_on_the_listing(spark, tree):
    corpus.register(spark)
    rows = spark.read.format("textlode").load(tree).filter("size > 0 AND path LIKE 'a/%' AND modified > timestamp'2020-01-01'")
    assert {r.path: r.text for r in rows.collect()} == {"a/.gitignore": "!b.log\n", "a/b.log": "x", "a/d/.ignore": "e/\n", "a/d/e/f/deep.py": "12345"}
    reader = corpus.CorpusReader(corpus.Reading({"path": tree}))
    left = list(reader.pushFilters([corpus.EqualTo(("path",), "m.py"), corpus.EqualTo(("text",), "x"), corpus.IsNotNull(("size",))]))
    assert [f.attribute for f in left] == [("text",)] and [f for p in reader.partitions() for f in p.files][0][0] == "m.py"
    assert spark.read.format("textlode").load(tree).filter("path = 'none'").count() == 0


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    put(tmp_path, {f"f{k}": "x" * 1000 for k in range(10)} | {"big": "y" * 50_000})
    reading = corpus.Reading({"path": str(tmp_path), "batchBytes": "2500", "partitionBytes": "20000"})
    parts = corpus.CorpusReader(reading).partitions()
    sizes = [sum(b.column(2).to_pylist()) for p in parts for b in reading.batches(p)]
    assert len(parts) > 1 and sum(sizes) == 60_000 and sorted(sizes)[-1] <= 52_000 and all(s <= 4000 for s in sizes if s < 50_000)
    entries = walk(spark, [str(tmp_path)])
    assert read_corpus(spark, entries).agg(F.sum(F.length("text"))).first()[0] == 60_000


def test_stream_reads_files_once(spark, tmp_path):
    corpus.register(spark)
    put(tmp_path, {"in/a": "one", "in/b": "two"})
    stream = spark.readStream.format("textlode").load(str(tmp_path / "in")).select("path", "text")
    query = stream.writeStream.format("memory").queryName("files_read").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        query.processAllAvailable()
        time.sleep(0.05)
        put(tmp_path, {"in/c": "three"})
        query.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("files_read").collect()) == [("a", "one"), ("b", "two"), ("c", "three")]
    finally:
        query.stop()


# Bytes.
@pytest.mark.parametrize("bracket", [r"\p{Nd}", WORD, r"^\n", r"\x{80}-\x{10ffff}", r"\x{7f}-\x{801}", r"\x{d7ff}-\x{e001}"])
def test_classes_as_bytes(bracket):
    import regex

    rng, found, held = random.Random(1), regex.compile(to_python(class_expression(bracket))), regex.compile(to_python(f"[{bracket}]"))
    edges = [0x7F, 0x80, 0x7FF, 0x800, 0x801, 0xD7FF, 0xE000, 0xE001, 0xE002, 0xFFFF, 0x10000, 0x10FFFF]
    for c in [*range(0x300), *edges, *(rng.randrange(0xE000, 0x110000) for _ in range(500))]:
        assert bool(found.fullmatch(chr(c).encode().decode("latin-1"))) == bool(held.fullmatch(chr(c)))


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([("f1", bytearray(b"quux\xffbaz")), ("f2", bytearray("ÿ é\nÀ日本x\n".encode())), ("f3", bytearray(b"a\xe9b\n\xc3\xa9")), ("f4", None)], "path string, content binary")


def test_byte_patterns_match_bytes(raw):
    search = lambda p, **q: Search(raw, SearchQuery(patterns=(p,), **q), ("path",), "content")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(search(r"(?-u)\xFF").match_spans().select("path", "start", "stop", "abs_offset")) == [("f1", 4, 5, 4)]
    assert rows(search("é").lines().select("path", Search.to_bytes(F.col("line")))) == [("f2", bytearray("ÿ é".encode())), ("f3", bytearray(b"\xc3\xa9"))]
    assert rows(search("(?-u:[\\x80-\\xFF])").count_matches()) == [("f1", 1), ("f2", 12), ("f3", 3)]
    assert rows(search("(?i)à").count_matches()) == [("f2", 1)]
    assert rows(search(r"\bx|本\B").spans().select("path", "start")) == [("f2", 5)]
    assert rows(search("é", replacement="日").replaced().filter("path = 'f2'").select(Search.to_bytes(F.col("line")))) == [(bytearray("ÿ 日".encode()),)]
    with pytest.raises(BytesNeeded):
        Search(raw.select("path", F.lit("x").alias("text")), SearchQuery(patterns=(r"(?-u)\xFF",)), ("path",))


def test_json_shows_bytes_in_base64(spark, tmp_path):
    put(tmp_path, {"foo": b"quux\xffbaz"})
    events = [r.event for r in run(spark, ["--json", r"(?-u)\xFF", str(tmp_path)]).orderBy("seq").collect()]
    assert events[0] == '{"type":"begin","data":{"path":{"text":"foo"}}}'
    assert events[1] == '{"type":"match","data":{"path":{"text":"foo"},"lines":{"bytes":"cXV1eP9iYXo="},"line_number":1,"absolute_offset":0,"submatches":[{"match":{"bytes":"/w=="},"start":4,"end":5}]}}'


# Large files.
@pytest.fixture(scope="module")
def cut_files(tmp_path_factory):
    rng, top, texts = random.Random(5), tmp_path_factory.mktemp("large"), {}
    for k in range(5):
        texts[f"f{k}"] = "\n".join(rng.choice(["a", "hit", "xhitx é", "long line " * rng.randrange(3), "hit hit", ""]) for _ in range(rng.choice([0, 1, 30, 60]))) + rng.choice(["\n", ""])
    texts["f3"] = texts["f3"][:200] + "\0" + texts["f3"][200:]
    texts["f5"] = "\n".join(["hit"] * 20 + ["no"] * 50 + ["hit"] * 3)
    put(top, texts)
    return str(top), texts


@pytest.mark.parametrize("options", [{"max_count": 2}, {"max_count": 5, "after": 2}, {"before": 3, "after": 40}, {"stop_on_nonmatch": True}, {"stop_on_nonmatch": True, "context": 2}, {"invert": True, "context": 1, "max_count": 4}, {"passthru": True, "max_count": 3}, {"max_count": 0}])
def test_splits_of_a_file_give_what_its_row_gives(spark, cut_files, options, monkeypatch):
    folder, texts = cut_files
    monkeypatch.setattr(large, "BLOCK", 3)
    query = SearchQuery(patterns=("hit",), **options)
    name = lambda path: path.rpartition("/")[2]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "97")
    try:
        files, row = large.LargeFiles(spark, folder, query), Search(spark.createDataFrame(list(texts.items()), "path string, text string"), query, ("path",))
        assert files.parts.filter("path LIKE '%f5'").count() > 2
        if query.lines_before or query.lines_after or query.passthru:
            got = [(name(r.path), r.line_number, r.kind, r.line, r.group_id) for r in files.shown().collect()]
            assert sorted(got) == sorted(tuple(r) for r in row.context().collect())
        else:
            got = [(name(r.path), r.line_number, r.byte_offset, r.line) for r in files.lines().collect()]
            assert sorted(got) == sorted(tuple(r) for r in row.with_offsets().collect())
            assert sorted((name(r.path), r.n) for r in files.count_lines().collect()) == sorted(tuple(r) for r in row.count_lines().collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_that_end_with_nul(spark, tmp_path):
    put(tmp_path, {"z": "foo\nbar\0x\0foo\0"})
    got = large.search_large(spark, str(tmp_path), SearchQuery(patterns=("foo",), null_data=True)).collect()
    assert [(r.line_number, r.byte_offset, r.line) for r in got] == [(1, 0, "foo\nbar"), (3, 10, "foo")]
    with pytest.raises(ValueError, match="multi-line"):
        large.search_large(spark, str(tmp_path), SearchQuery(patterns=("foo",), multiline=True))


# Options in one command.
@pytest.mark.parametrize(
    ("args", "want"),
    [
        (["--count-matches", "-m", "2", "foo"], [("f1", 3), (None, 1)]),
        (["-o", "-m1", "foo"], [("f1", 1, 0, "foo"), (None, 1, 0, "foo")]),
        (["-r", "X", "-m1", "foo"], [("f1", 1, "X"), (None, 1, "X")]),
        (["-c", "--stop-on-nonmatch", "foo"], [("f1", 2), (None, 1)]),
        (["-r", "X", "-A1", "-m1", "foo"], [("f1", 1, "match", "X", 0), ("f1", 2, "match", "X X", 0), (None, 1, "match", "X", 0), (None, 2, "context", "bar", 0)]),
        (["-o", "-v", "foo"], [("f1", 3, 0, "bar"), ("f2", 1, 0, "bar"), (None, 2, 0, "bar")]),
        (["--vimgrep", "-v", "foo"], [("f1", 3, None, "bar"), ("f2", 1, None, "bar"), (None, 2, None, "bar")]),
        (["-l", "-m0", "foo"], []),
        (["-c", "-o", "foo"], [("f1", 4), (None, 1)]),
        (["-U", "--files-without-match", "foo"], [("f2",)]),
        (["-U", "-c", "-m1", "foo"], [("f1", 1), (None, 1)]),
    ],
)
def test_options_hold_in_every_mode(spark, args, want):
    rows = spark.createDataFrame([("f1", "foo\nfoo foo\nbar\nfoo\n"), ("f2", "bar\n"), (None, "foo\nbar\n")], "path string, text string")
    assert sorted((tuple(r) for r in run_rows(rows, args).collect()), key=str) == sorted(want, key=str)


def test_results_in_the_order_of_times(spark, tmp_path):
    put(tmp_path, {"a": "x\nx\n", "b": "x\n"})
    os.utime(tmp_path / "a", (2000, 2000))
    os.utime(tmp_path / "b", (1000, 1000))
    assert [tuple(r) for r in run(spark, ["--sort", "modified", "x", str(tmp_path)]).collect()] == [("b", 1, "x"), ("a", 1, "x"), ("a", 2, "x")]
    assert [r.path for r in run(spark, ["--sortr", "modified", "-l", "x", str(tmp_path)]).collect()] == ["a", "b"]


def test_many_matches_of_a_line_take_linear_time():
    import regex

    from textlode.operators.search import spans_of

    began = time.time()
    assert len(spans_of(regex.compile("a"), "éa " * 200_000, SearchQuery(patterns=("a",)))) == 200_000
    assert time.time() - began < 10
