import json

import duckdb
import pytest
from pyspark.sql import functions as F

from textlode import search_queries
from textlode.functions.engines import Engine
from textlode.operators.patterns import literal_hits
from textlode.operators.search import PatternSet, Search, chosen_lines
from textlode.plans.flags import parse
from textlode.plans.query import SearchQuery
from textlode.plans.run import run, run_rows
from textlode.sources.files import decompressed, sort_entries
from textlode.sources.large import search_large
from textlode.streaming.search import stream_lines

SF = "/root/testdata/sf0.001"
#: Six lines: two names on line 3, one on line 1; "harbour" on lines 2 and 5; accents on line 4.
LOG = """Anna Berg wrote the first entry, before the ship had left
the harbour, and the second one a week later on the open sea.
Off the cape Anna Berg met Carl Holm, who had a map of reefs;
déjà vu, said the cook, and poured the tea, as he always did,
until the harbour of the south came into sight at long last.
"""
CHECKED = ["search_literal", "search_word", "search_class_algebra", "count_lines_zero", "count_matches", "only_matching_column", "replace_groups", "context_both", "stop_on_nonmatch", "set_first_match", "glob_last_wins", "ignore_rules", "stats_summary", "multiline_span", "empty_match_suppression", "binary_quit"]


def same(rows, columns, sql):
    db = duckdb.connect()
    for name in ("documents", "pages", "conversations", "events", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = db.sql(sql)
    order = sorted(columns)
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    assert sorted(found.columns) == order
    expected = sorted((tuple(plain(r[found.columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr) == expected


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    df = search_queries.queries()[name](spark, SF)
    same(df.collect(), df.columns, search_queries.oracle_sql()[name])


def test_zero_counts_group_lines_by_id(spark, tmp_path):
    """Documents without a line have no count, rows of one id have one, null ids too; a line feed alone ends an empty line."""
    texts = [(1, ""), (2, None), (3, "\n"), (4, "x queai\nx"), (4, "queai\n\nqueai"), (5, "x"), (5, ""), (None, "queai"), (None, "x\n"), (6, " ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = search_queries.queries()["count_lines_zero"](spark, str(tmp_path))
    expected = duckdb.sql(search_queries.oracle_sql()["count_lines_zero"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert rows(found, *found.columns) == sorted(expected, key=lambda row: (row[0] is not None, row)) == [(None, 1), (3, 0), (4, 3), (5, 0), (6, 0)]


def test_trim_covers_all_lines_of_all_pages(spark):
    df = search_queries.queries()["trim"](spark, SF)
    found = df.collect()
    same(found, df.columns, search_queries.oracle_sql()["trim"])
    assert max(r.line_number for r in found) > 1


def test_pattern_file_takes_whole_items(spark, tmp_path):
    head = "h" * 40
    spark.createDataFrame([(1, f"{head} one"), (2, f"{head} two"), (3, f"{head} one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"x {head} one y {head} two"), (2, f"{head} two"), (3, f"{head} three")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in search_queries.queries()["pattern_file"](spark, str(tmp_path)).collect()} == {(1, 2), (2, 1)}


def haystack(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts or (LOG,), 1)), "doc_id long, text string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda row: [(v is not None, v) for v in row])


def test_options_that_would_lose_matches_are_refused(spark):
    search = Search(haystack(spark), SearchQuery(patterns=("a\nb",), multiline=True))
    for act in (search.spans, search.stats, search.with_offsets):
        with pytest.raises(ValueError, match="by lines"):
            act()
    with pytest.raises(ValueError, match="combined"):
        Search(haystack(spark), SearchQuery(patterns=("a",), multiline=True, invert=True)).multiline()
    with pytest.raises(ValueError, match="sorted"):
        sort_entries(haystack(spark), "size")


def test_decompression():
    import shutil
    import subprocess

    import pyarrow as pa

    data = ("some text of the log, again and again; " * 4000 + "".join(chr(33 + k * k % 90) for k in range(30000))).encode()
    for name, codec in (("a.lz4", "lz4"), ("a.br", "brotli")):
        out = pa.BufferOutputStream()
        with pa.CompressedOutputStream(out, codec) as f:
            f.write(data)
        assert decompressed(name, out.getvalue().to_pybytes()) == data
    if shutil.which("gzip"):  # reads the format too
        assert subprocess.run(["gzip", "-dc"], input=lzw(data), capture_output=True, check=False).stdout == data
    assert decompressed("a.Z", lzw(data)) == data
    for name in ("a.Z", "a.lz4", "a.br", "a.gz"):
        assert decompressed(name, b"not packed") == b"not packed"


def lzw(data):
    """A `.Z` file of some bytes, without resets."""
    table, bits, n, width, in_group = {bytes([k]): k for k in range(256)}, 0, 0, 9, 0
    size = 257
    now = b""

    def put(code):
        nonlocal bits, n, in_group
        bits |= code << n
        n += width
        in_group += 1

    for c in (data[k : k + 1] for k in range(len(data))):
        if now + c in table:
            now += c
            continue
        put(table[now])
        if size < 1 << 16:
            table[now + c] = size
            size += 1
        if size > (1 << width) and width < 16:
            while in_group % 8:
                put(0)
            width, in_group = width + 1, 0
        now = c
    put(table[now])
    return b"\x1f\x9d\x90" + bits.to_bytes(-(-n // 8), "little")


def test_preprocessor_and_large_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n")
    (tmp_path / "in" / "b.log").write_text("two\n")
    command = tmp_path / "shout"
    command.write_text('#!/bin/sh\ntr a-z A-Z < "$1"\n')
    command.chmod(0o755)
    assert rows(run(spark, ["--pre", str(command), "--pre-glob", "*.txt", "-i", "one|two", str(tmp_path / "in")]), "path", "line") == [("a.txt", "ONE"), ("b.log", "two")]
    (tmp_path / "big").mkdir()
    text = "".join(f"line {k} é\r\n" if k % 7 else f"hit {k}\r\n" for k in range(5000))
    (tmp_path / "big" / "x.txt").write_bytes(text.encode())
    (tmp_path / "big" / "y.txt").write_bytes(b"no\nhit\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    found = search_large(spark, str(tmp_path / "big"), SearchQuery(patterns=("hit",), crlf=True)).collect()
    assert spark.read.text(str(tmp_path / "big")).rdd.getNumPartitions() > 5
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = text.encode().split(b"\n")
    expected = [(k + 1, sum(len(x) + 1 for x in lines[:k]), f"hit {k}") for k in range(0, 5000, 7)]
    assert sorted((r.line_number, r.byte_offset, r.line) for r in found if r.path.endswith("x.txt")) == expected
    assert [(r.line_number, r.byte_offset) for r in found if r.path.endswith("y.txt")] == [(2, 3)]


def test_goldens(spark):
    context = Search(haystack(spark), SearchQuery(patterns=("first|at long",), context=1)).context()
    assert rows(context, "line_number", "kind", "group_id") == [(1, "match", 0), (2, "context", 0), (4, "context", 1), (5, "match", 1)]
    named = Search(haystack(spark), SearchQuery(patterns=("(?P<first>[A-Z][a-z]+) (?P<last>[A-Z][a-z]+)",), replacement="$last, $first")).replaced().orderBy("line_number").collect()
    assert named[0].line.startswith("Berg, Anna wrote") and "Berg, Anna met Holm, Carl" in named[1].line
    third = len(LOG.split("Off")[0].encode())
    for find in (Search.spans, Search.match_spans):
        assert rows(find(Search(haystack(spark), SearchQuery(patterns=("Anna Berg",)))), "line_number", "start", "stop", "abs_offset") == [(1, 0, 9, 0), (3, 13, 22, third + 13)]
    before, line = len(LOG.split("déjà")[0].encode()), LOG.splitlines()[3].encode()
    at = [line.index(b"the"), line.rindex(b"the")]
    assert rows(Search(haystack(spark), SearchQuery(patterns=("the",))).match_spans().filter("line_number = 4"), "column", "abs_offset") == [(k + 1, before + k) for k in at]


def test_files_with_equal_or_null_keys_stay_apart(spark):
    text = "xan\nb\nan\nc"
    twice = spark.createDataFrame([(7, text), (7, text), (None, text), (None, text)], "doc_id long, text string")
    query = SearchQuery(patterns=("an",))
    offsets = Search(twice, query).with_offsets()
    assert rows(offsets, "line_number", "byte_offset") == [(1, 0)] * 4 + [(3, 6)] * 4
    assert Search(twice, query.where(max_count=1)).lines().count() == 4
    assert Search(twice, query.where(stop_on_nonmatch=True)).lines().count() == 4
    context = Search(twice, query.where(after=1)).context()
    assert rows(context, "line_number", "line", "kind") == sorted([(1, "xan", "match"), (2, "b", "context"), (3, "an", "match"), (4, "c", "context")] * 4)
    for df in (offsets, Search(twice, query.where(max_count=1)).lines(), context, Search(twice, query).json_events(), Search(twice, query).match_spans()):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_offsets_count_carriage_returns(spark):
    search = Search(haystack(spark, "ab\r\ncd\r\nab"), SearchQuery(patterns=("[ad]",), crlf=True))
    assert rows(search.with_offsets(), "line_number", "byte_offset", "line") == [(1, 0, "ab"), (2, 4, "cd"), (3, 8, "ab")]
    assert rows(search.match_spans(), "line_number", "abs_offset") == rows(search.spans(), "line_number", "abs_offset")


def test_running_sums_over_many_blocks(spark):
    text = "\n".join(f"line é{k}" if k % 3 else f"hit {k}" for k in range(1000))
    got = rows(Search(haystack(spark, text), SearchQuery(patterns=("hit",))).with_offsets(), "line_number", "byte_offset")
    parts = text.split("\n")
    assert got == [(k + 1, len("".join(f"{p}\n" for p in parts[:k]).encode())) for k in range(0, 1000, 3)]
    context = Search(haystack(spark, text), SearchQuery(patterns=("hit",), max_count=100, before=1)).context().orderBy("line_number").collect()
    assert [r.line_number for r in context if r.kind == "match"] == list(range(1, 299, 3)) and context[-1].group_id == 99


def test_empty_matches(spark):
    star = lambda **o: Search(haystack(spark, "abc\n-"), SearchQuery(patterns=("b*",), **o))
    assert rows(star(replacement="-").replaced(), "line_number", "line") == [(1, "-a-c-"), (2, "---")]
    assert rows(star(replacement="<$0>").replaced(), "line_number", "line")[0] == (1, "<>a<b>c<>")
    assert star().stats().first().matches == star().spans().count() == star().count_matches().first().n
    assert rows(Search(haystack(spark, "ab cd"), SearchQuery(patterns=(r"\b",), replacement="|")).replaced(), "line") == [("|ab| |cd|",)]
    assert PatternSet(["b*", "x"]) and haystack(spark, "abc").select(PatternSet(["b*", "x"]).count(F.col("text")).alias("n")).first().n == 3


def test_empty_matches_are_counted_in_the_engine(spark):
    """As the matches found one by one say, with all limits and line ends, and without Python."""
    texts = ["", "n", "\n", "nn\nxn\nx", "anb\nnna\n\n", "a\U0001f600n\U0001f600", "\U0001f600", "xnnx\r\nn\r", "n\0nx\0x", "ab cd\nabab ", None]
    for pattern in ("n*", "n*?", "|n", "n|", r"\b", "(n|x)*", "^", "$", "(?i)N?", "[^n]*"):
        for options in ({}, {"max_count": 1}, {"max_count": 2}, {"stop_on_nonmatch": True}, {"crlf": True}, {"null_data": True}, {"include_zero": True}, {"binary": "convert"}):
            search = Search(haystack(spark, *texts), SearchQuery(patterns=(pattern,), **options))
            q, engine = search.query, Engine(search.pattern)
            files = search.files(whole=True).collect()
            want = sorted((r.doc_id, n) for r in files if (n := sum(len(m) for *_, m in chosen_lines(engine, r._text or "", q))) or q.include_zero)
            got = search.count_matches()
            assert sorted((r.doc_id, r.n) for r in got.collect()) == want, (pattern, options)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["set_thousands", "set_captures", "hostile_pattern"])
def test_texts_are_searched_by_one_worker_a_task(spark, name):
    """A filter on what a search found must not search again."""
    plan = search_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_captures(spark):
    search = Search(haystack(spark, "ac bc\nbc"), SearchQuery(patterns=("(a)?(?P<name>b)?c",)))
    assert rows(search.captures(), "line_number", "match", "group_1", "name") == [(1, "ac", "a", None), (2, "bc", None, "b")]
    assert rows(search.captures(every=True), "line_number", "match_index", "group_1", "name") == [(1, 0, "a", None), (1, 1, None, "b"), (2, 0, None, "b")]
    sure = Search(haystack(spark, "a1 b2"), SearchQuery(patterns=("([a-z])([0-9])",))).captures(every=True)
    assert rows(sure, "match_index", "match", "group_1", "group_2") == [(0, "a1", "a", "1"), (1, "b2", "b", "2")]


def test_stats_under_invert(spark):
    found = Search(haystack(spark, "a\nb\naa"), SearchQuery(patterns=("a",), invert=True)).stats().first()
    assert (found.matched_lines, found.matches, found.searches_with_match) == (1, 0, 1)


def test_previews_are_cut_in_bytes(spark):
    search = Search(haystack(spark, "é" * 10, "x" * 10, "x" * 9 + "日"), SearchQuery(patterns=(".",), max_columns=10, preview=True))
    assert rows(search.lines(), "doc_id", "line") == [(1, "ééééé [... omitted end of long line]"), (2, "x" * 10), (3, "x" * 9 + " [... omitted end of long line]")]


def test_multiline(spark):
    text = "xxx\nabc\ndefabc\ndefxxx\nxxx\nend\nabc\ndef\nend"
    query = SearchQuery(patterns=("abc\ndef",), multiline=True)
    assert rows(Search(haystack(spark, text), query).lines(), "line_number") == [(2,), (3,), (4,), (7,), (8,)]
    assert rows(Search(haystack(spark, text), query.where(max_count=1)).lines(), "line_number") == [(2,), (3,), (4,)]
    assert rows(Search(haystack(spark, text), query.where(invert=True)).lines(), "line_number") == [(1,), (5,), (6,), (9,)]
    context = Search(haystack(spark, text), query.where(before=1)).context()
    assert rows(context, "line_number", "kind", "group_id") == [(1, "context", 0), (2, "match", 0), (3, "match", 0), (4, "match", 0), (6, "context", 1), (7, "match", 1), (8, "match", 1)]
    assert rows(Search(haystack(spark, text), query.where(replacement="[$0$0]", patterns=("c\nd",))).multiline_replaced(), "line_number", "line") == [(2, "ab[c\ndc\nd]efab[c\ndc\nd]efxxx"), (7, "ab[c\ndc\nd]ef")]
    assert rows(Search(haystack(spark, text), query).count_multiline(), "n") == [(3,)] and rows(Search(haystack(spark, text), query.where(invert=True)).count_multiline(), "n") == [(4,)]
    dot = SearchQuery(patterns=("first.+second",), multiline=True)
    assert Search(haystack(spark), dot).lines().count() == 0 and Search(haystack(spark), dot.where(dotall=True)).lines().count() == 2
    assert Search(haystack(spark, "a\n"), SearchQuery(patterns=("^",), multiline=True)).lines().count() == 1


def test_json_messages(spark):
    made = [json.loads(r.event) for r in Search(haystack(spark), SearchQuery(patterns=("cook",), before=1, replacement="chef")).json_messages().orderBy("seq").collect()]
    assert [e["type"] for e in made] == ["begin", "context", "match", "end"]
    lines = LOG.splitlines(keepends=True)
    assert made[1]["data"] == {"path": {"text": "1"}, "lines": {"text": lines[2]}, "line_number": 3, "absolute_offset": len("".join(lines[:2]).encode()), "submatches": []}
    start = len(lines[3].split("cook")[0].encode())
    assert made[2]["data"]["submatches"] == [{"match": {"text": "cook"}, "replacement": {"text": "chef"}, "start": start, "end": start + 4}]
    events = Search(haystack(spark), SearchQuery(patterns=("cook",), before=1, replacement="chef")).json_messages().orderBy("seq").collect()
    assert made[3]["data"]["stats"]["bytes_printed"] == sum(len(r.event.encode()) + 1 for r in events[:3]) and made[3]["data"]["stats"]["bytes_searched"] == len(LOG.encode())
    block = [json.loads(r.event) for r in Search(haystack(spark, "a\nb\nc\n"), SearchQuery(patterns=("a\nb",), multiline=True)).json_messages().orderBy("seq").collect()]
    assert block[1]["data"]["lines"] == {"text": "a\nb\n"} and block[1]["data"]["submatches"][0]["end"] == 3
    both = haystack(spark, "one\ntwo", "two two", "none")
    summary = json.loads(Search(both, SearchQuery(patterns=("two",))).json_summary().first().event)
    assert summary["type"] == "summary" and {k: summary["data"]["stats"][k] for k in ("searches", "searches_with_match", "matches", "matched_lines", "bytes_searched")} == {"searches": 3, "searches_with_match": 2, "matches": 3, "matched_lines": 2, "bytes_searched": 18}
    one = Search(both, SearchQuery(patterns=("two",))).json_events()
    full = Search(both, SearchQuery(patterns=("two",))).json_messages().filter("event LIKE '{\"type\":\"match\"%'")
    assert sorted(json.loads(r.event)["data"]["submatches"][0]["start"] for r in one.collect()) == sorted(json.loads(r.event)["data"]["submatches"][0]["start"] for r in full.collect()) == [0, 0]


def test_many_literals(spark, monkeypatch):
    patterns = [f"needle{k}x" for k in range(400)]
    texts = haystack(spark, "a needle7x b\nneedle399x", "needle400x", "needle3", None)
    assert rows(Search(texts, SearchQuery(patterns=tuple(patterns))).lines(), "doc_id", "line_number") == [(1, 1), (1, 2)]
    listed = spark.createDataFrame([(p,) for p in [*patterns, "dle3", "", None]], "pattern string")
    expected = [(1, "dle3"), (1, "needle399x"), (1, "needle7x"), (3, "dle3")]
    assert rows(literal_hits(texts, listed, ["doc_id"]), "doc_id", "pattern") == expected
    monkeypatch.setattr("textlode.operators.patterns.AUTOMATON_BYTES", 0)
    monkeypatch.setattr("textlode.operators.patterns.GRAM", 8)
    assert rows(literal_hits(texts, listed, ["doc_id"]), "doc_id", "pattern") == expected


def test_run(spark, tmp_path):
    for name, text in {"a.py": "Needle one\nx\nneedle", "b/c.txt": "needle\n", "b/d.md": "hay\n", ".e.py": "needle\n", "b/f.log": "needle\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".ignore").write_text("*.log\n")
    call = lambda *args: run(spark, [*args, str(tmp_path)])
    assert rows(call("needle"), "path", "line_number") == [("a.py", 3), ("b/c.txt", 1)]
    assert rows(call("-i", "needle", "--sort", "path"), "path", "line_number") == [("a.py", 1), ("a.py", 3), ("b/c.txt", 1)]
    assert rows(call("-l", "needle", "-uu"), "path") == [(".e.py",), ("a.py",), ("b/c.txt",), ("b/f.log",)]
    assert rows(call("-l", "needle", "--no-ignore"), "path") == [("a.py",), ("b/c.txt",), ("b/f.log",)]
    assert rows(call("-c", "needle", "--iglob", "*.TXT"), "path", "n") == [("b/c.txt", 1)]
    assert rows(call("--files", "-tpy"), "path") == [("a.py",)] and rows(call("--files", "-Tpy", "-d1"), "path") == []
    assert rows(call("--files", "--type-add", "note:*.md", "-tnote"), "path") == [("b/d.md",)]
    assert rows(call("--files-without-match", "needle"), "path") == [("b/d.md",)] and call("-q", "needle").first().found
    assert rows(call("-o", "-r", "<$0>", "[Nn]eedle"), "path", "match") == [("a.py", "<Needle>"), ("a.py", "<needle>"), ("b/c.txt", "<needle>")]
    assert call("--stats", "needle").first().searches == 3 and {r.path for r in call("--json", "needle").collect()} == {"a.py", "b/c.txt"}
    assert rows(call("-U", "one\nx"), "path", "line_number") == [("a.py", 1), ("a.py", 2)]
    assert rows(call("--vimgrep", "e"), "path", "line_number", "column")[0] == ("a.py", 1, 2)
    assert run(spark, ["--type-list"]).count() > 40
    with pytest.raises(ValueError):
        parse(["--regex-size-limit", "x", "a"])
    corpus = spark.createDataFrame([("x/a.md", "needle"), ("x/b.py", "needle")], "path string, text string")
    assert rows(run_rows(corpus, ["needle", "-g", "*.md"]), "path") == [("x/a.md",)]


def test_parent_and_global_ignore_files(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo" / "sub"
    root.mkdir(parents=True)
    (tmp_path / "repo" / ".git").mkdir()
    for name in ("a.txt", "b.log", "c.tmp", "d.bak"):
        (root / name).write_text("needle\n")
    (tmp_path / "repo" / ".gitignore").write_text("*.log\n/sub/c.tmp\n")
    (tmp_path / ".gitignore").write_text("a.txt\n")  # beyond the repository
    (tmp_path / "config" / "git").mkdir(parents=True)
    (tmp_path / "config" / "git" / "ignore").write_text("*.bak\n")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    monkeypatch.setenv("HOME", str(tmp_path / "nobody"))
    assert rows(run(spark, ["--files", "--no-require-git", str(root)]), "path") == [("a.txt",)]
    assert rows(run(spark, ["--files", "--no-require-git", "--no-ignore-global", str(root)]), "path") == [("a.txt",), ("d.bak",)]
    assert rows(run(spark, ["--files", "--no-require-git", "--no-ignore-parent", str(root)]), "path") == [("a.txt",), ("b.log",), ("c.tmp",)]


def test_null_and_empty(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    search = Search(texts, SearchQuery(patterns=("a",), include_zero=True))
    assert {tuple(r) for r in search.count_lines().collect()} == {(1, 0), (2, 0), (3, 1)}
    assert Search(texts.limit(0), SearchQuery(patterns=("a",))).lines().count() == 0
    assert {r.doc_id for r in search.files_without_match().collect()} == {1, 2}


def test_prefilter_reaches_the_reader(spark):
    df = Search(spark.read.parquet(f"{SF}/documents.parquet"), SearchQuery(patterns=("needle[0-9]",))).lines()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,needle)" in plan and "Exchange" not in plan


def test_stream(spark):
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{SF}/documents.parquet*")
    query = stream_lines(stream, SearchQuery(patterns=("an",))).writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("found").count() == search_queries.queries()["search_literal"](spark, SF).count()


def test_numbered_rows(spark):
    from textlode.operators.order import numbered

    names = spark.createDataFrame([(f"n{k % 300:03d}", k) for k in range(900)] + [(None, -1)], "name string, place_before long")
    made = sorted((r.place, r.name) for r in numbered(names.repartition(6), F.col("name")).collect())
    assert [p for p, _ in made] == list(range(1, 902)) and made[0][1] is None
    assert [n for _, n in made[1:]] == sorted(n for _, n in made[1:])
    assert numbered(names.limit(0), F.col("name")).count() == 0


def test_thousands_of_patterns_by_index(spark):
    import re

    from textlode.operators.search import PatternSet

    patterns = [f"{a}{b}{c}x?" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"] + [r"\d+", "(?i)ZZ", "(q)?u(v)?"]
    texts = ["abcx defg", "12 and hhh", "zZ", "uv qu", "", None, "nothing"]
    sets = PatternSet(patterns)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    got = {r.id: r for r in rows.select("id", sets.ids(F.col("text")).alias("ids"), sets.first(F.col("text")).alias("first"), sets.captures(F.col("text")).alias("groups"), sets.capture_counts(F.col("text")).alias("n")).collect()}
    for k, text in enumerate(texts):
        if text is None:
            assert got[k].ids is None
            continue
        found = {i: m for i, p in enumerate(patterns) if (m := re.search(p, text))}
        assert got[k].ids == sorted(found)
        assert got[k].first == (min((m.start() + 1, i) for i, m in found.items()) if found else None)
        assert [(g.pattern_id, g.groups) for g in got[k].groups] == [(i, [m[0], *m.groups()]) for i, m in sorted(found.items())]
    assert [(x.pattern_id, x.n) for x in got[3].n] == [(len(patterns) - 1, 2)]


def test_patterns_and_texts_meet_on_rare_grams(spark, capsys):
    from textlode.operators.patterns import by_grams

    texts = [(1, "a common head of many patterns: one"), (1, "a common head of many patterns: one"), (2, "a common head of many patterns: two, été"), (None, "short"), (3, "of many patterns: two, été")]
    rows = spark.createDataFrame(texts, "id long, _text string")
    patterns = spark.createDataFrame([("a common head of many patterns: one",), ("many patterns: two, été",), ("many patterns: three",)], "pattern string")
    got = by_grams(rows, patterns, ["id"])
    assert sorted((r.id, r.pattern[:6]) for r in got.collect()) == [(1, "a comm"), (1, "a comm"), (2, "many p"), (3, "many p")]
