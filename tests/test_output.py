"""What commands print, and which engine runs a pattern."""

import json
import socket
import time

import pyarrow as pa
import pytest
import regex

from textlode.functions.dialect import compile_patterns
from textlode.operators.render import styles
from textlode.operators.search import chosen_lines, linear_counts
from textlode.plans.query import SearchQuery
from textlode.plans.run import print_rows, run, run_rows

TEXT = "one apple\ntwo pears\nthree apples, four apples\nfive\nsix\nseven\nan apple\n"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("dir/f", TEXT)], "path string, text string")


def shown(rows, *args):
    return [r.output for r in print_rows(rows, list(args)).orderBy("path", "seq").collect()]


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (["-n", "apples"], ["dir/f:3:three apples, four apples"]),
        (["-I", "-C1", "five|an"], ["three apples, four apples", "five", "six", "seven", "an apple"]),
        (["-I", "-n", "-C1", "one|seven"], ["1:one apple", "2-two pears", "--", "5-six", "6:seven", "7-an apple"]),
        (["-I", "--no-context-separator", "-A1", "one|seven"], ["one apple", "two pears", "seven", "an apple"]),
        (["-I", "--context-separator", "<>", "-A1", "one|seven"], ["one apple", "two pears", "<>", "seven", "an apple"]),
        (["--column", "-b", "apples"], ["dir/f:3:7:20:three apples, four apples"]),
        (["--vimgrep", "apples"], ["dir/f:3:7:three apples, four apples", "dir/f:3:20:three apples, four apples"]),
        (["-o", "-b", "-n", "apples"], ["dir/f:3:26:apples", "dir/f:3:39:apples"]),
        (["--heading", "-n", "pears"], ["dir/f", "2:two pears", ""]),
        (["-0", "pears"], ["dir/f\0two pears"]),
        (["--path-separator", "\\", "pears"], ["dir\\f:two pears"]),
        (["-I", "-M20", "apples?$"], ["one apple", "[Omitted long matching line]", "an apple"]),
        (["-I", "-M20", "-r", "pie", "apples"], ["three pie, four pie"]),
        (["-I", "-M8", "-r", "pie", "apples"], ["[Omitted long line with 2 matches]"]),
        (["-I", "-M14", "--max-columns-preview", "--column", "apples"], ["3:7:three apples,  [... 1 more match]"]),
        (["-I", "-M14", "--max-columns-preview", "apples"], ["three apples,  [... omitted end of long line]"]),
        (["-I", "--color", "always", "-n", "pears"], ["\x1b[0m\x1b[32m2\x1b[0m:two \x1b[0m\x1b[1m\x1b[31mpears\x1b[0m"]),
        (["-v", "-I", "e"], ["six"]),
        (["-c", "apple"], ["dir/f:3"]),
        (["-l", "-0", "apple"], ["dir/f\0"]),
        (["--field-match-separator", "|", "-n", "pears"], ["dir/f|2|two pears"]),
    ],
)
def test_printed_lines(rows, args, want):
    assert shown(rows, *args) == want


BLOCKS = "xxx\nabc\ndefxxxabc\ndefxxx\nxxx\nlast é abc\ndef é\n"


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (["-n", "abc\\ndef"], ["2:abc", "3:defxxxabc", "4:defxxx", "6:last é abc", "7:def é"]),
        (["-n", "-m1", "abc\\ndef"], ["2:abc", "3:defxxxabc", "4:defxxx"]),
        (["-n", "-A1", "abc\\ndefx"], ["2:abc", "3:defxxxabc", "4:defxxx", "5-xxx"]),
        (["-n", "-C1", "^xxx\\nabc|é$"], ["1:xxx", "2:abc", "3-defxxxabc", "--", "6-last é abc", "7:def é"]),
        (["-n", "-v", "abc\\ndef"], ["1:xxx", "5:xxx"]),
        (["-n", "-v", "-B1", "--no-context-separator", "abc\\ndef"], ["1:xxx", "4-defxxx", "5:xxx"]),
        (["-n", "--passthru", "-m1", "c\\ndefxxxa"], ["1-xxx", "2:abc", "3:defxxxabc", "4-defxxx", "5-xxx", "6-last é abc", "7-def é"]),
        (["-n", "-o", "--column", "-b", "abc\\ndef"], ["2:1:4:abc", "3:1:8:def", "3:7:14:abc", "4:1:18:def", "6:9:37:abc", "7:1:41:def"]),
        (["-n", "--column", "bc\\nd"], ["2:2:abc", "3:2:defxxxabc", "4:8:defxxx", "6:10:last é abc", "7:10:def é"]),
        (["--vimgrep", "abc\\ndef"], ["2:1:abc", "3:7:defxxxabc", "6:9:last é abc"]),
        (["-n", "-r", "<$0>", "c\\nd"], ["2:ab<c", "3:d>efxxxab<c", "4:d>efxxx", "6:last é ab<c", "7:d>ef é"]),
        (["-n", "-r", "-", "abc\\ndef"], ["2:-xxx-xxx", "6:last é - é"]),
        (["-n", "-o", "-r", "$1\n$1", "(a)bc\\ndef"], ["2:a", "3:a", "3:a", "4:a", "6:a", "7:a"]),
        (["-M4", "--max-columns-preview", "-r", "+", "bc\\ndef"], ["a+xx [... 1 more match]", "last [... 1 more match]"]),
        (["--trim", "--color=always", "--colors=match:none", "-M6", "--max-columns-preview", "t é"], ["last  [... 0 more matches]"]),
        (["--color=always", "--colors=line:none", "-n", "--column", "c\\nd"], ["2:3:ab\x1b[0m\x1b[1m\x1b[31mc\x1b[0m", "3:1:\x1b[0m\x1b[1m\x1b[31md\x1b[0mefxxxab\x1b[0m\x1b[1m\x1b[31mc\x1b[0m", "4:1:\x1b[0m\x1b[1m\x1b[31md\x1b[0mefxxx", "6:11:last é ab\x1b[0m\x1b[1m\x1b[31mc\x1b[0m", "7:1:\x1b[0m\x1b[1m\x1b[31md\x1b[0mef é"]),
        (["nothing"], []),
    ],
)
def test_printed_blocks(spark, args, want):
    rows = spark.createDataFrame([("f", BLOCKS), ("empty", ""), ("none", None)], "path string, text string")
    assert shown(rows, "-U", "-I", *args) == want


def test_printed_blocks_with_path_and_heading(spark):
    rows = spark.createDataFrame([("f", "a\nb\nc\na\nb\nc")], "path string, text string")
    assert shown(rows, "-U", "-I", "-m1", "--passthru", "-r", "B", "b") == ["a", "B", "c", "a", "b", "c"]
    assert shown(rows, "-U", "--heading", "-n", "b\\nc") == ["f", "2:b", "3:c", "5:b", "6:c", ""]
    assert shown(rows, "-U", "a\\nb") == ["f:a", "f:b", "f:a", "f:b"]
    assert shown(rows, "-U", "-c", "a\\nb") == ["f:2"]


def test_many_blocks_in_one_text(spark):
    """In proportion to the text, however many matches a block has."""
    rows = spark.createDataFrame([("f", "é a\nb " * 40_000)], "path string, text string")
    began = time.time()
    assert len(shown(rows, "-U", "-n", "--column", "a\\nb")) == 40_001
    assert len(shown(rows, "-U", "-r", "x", "a\\nb")) == 1
    assert time.time() - began < 30


def test_links(rows, spark):
    always = ["--color", "always", "--colors", "path:none", "--colors", "line:none", "--colors", "match:none", "--colors", "column:none"]
    made = spark.createDataFrame([("/no/such file", "x\nab\n")], "path string, text string")
    link = lambda form, *args: shown(made, *always, "--hyperlink-format", form, *args)
    begin, end = "\x1b]8;;{}\x1b\\", "\x1b]8;;\x1b\\"
    assert link("x://{path}", "b") == [begin.format("x:///no/such%20file") + f"/no/such file{end}:ab"]
    assert link("vscode", "-n", "b") == [begin.format("vscode://file/no/such%20file:2:2") + f"/no/such file:2{end}:ab"]
    assert link("grep+", "-n", "--column", "-b", "b") == [begin.format("grep+:///no/such%20file:2") + f"/no/such file:2:2:2{end}:ab"]
    assert link("x:{{{line}}}{wslprefix}{path}", "-A1", "x") == [begin.format("x:{1}/no/such%20file") + f"/no/such file{end}:x", begin.format("x:{2}/no/such%20file") + f"/no/such file{end}-ab"]
    assert link("x:{line}{path}", "--heading", "-n", "b") == [begin.format("x:1/no/such%20file") + f"/no/such file{end}", "2:ab", ""]
    assert link("x:{path}", "-l", "b") == [begin.format("x:/no/such%20file") + f"/no/such file{end}"]
    assert link("x:{path}", "-c", "b") == [begin.format("x:/no/such%20file") + f"/no/such file{end}:1"]
    assert link("x:{host}{path}", "--hostname-bin", "/no/program", "b")[0].startswith(begin[:5] + "x:" + socket.gethostname())
    assert link("none", "b") == link("", "b") == ["/no/such file:ab"]
    assert shown(made, "--hyperlink-format", "vscode", "b") == ["/no/such file:ab"]  # without colours
    for wrong in ("{path}", "x:{line}", "x:{path}{column}", "x:{other}{path}", "x:{path", "x:path}", "x:{}{path}", "word"):
        with pytest.raises(ValueError, match="hyperlink format"):
            link(wrong, "b")


STOPPED, MATCHES = 'WARNING: stopped searching binary file after match (found "\\0" byte around offset 12)', 'binary file matches (found "\\0" byte around offset 12)'


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (["-n", "hit"], ["b:1:é hit", f"b: {STOPPED}", "c:1:hit"]),
        (["-n", "last"], []),
        (["-I", "-A1", "hit"], ["é hit", "two", STOPPED, "hit"]),
        (["-v", "-n", "hit"], ["b:2:two", f"b: {STOPPED}"]),
        (["-U", "-n", "hit\\ntwo"], ["b:1:é hit", "b:2:two", f"b: {STOPPED}"]),
        (["--heading", "two"], ["b", "two", f"b: {STOPPED}", ""]),
        (["-n", "--binary", "hit"], ["b:1:é hit", f"b: {MATCHES}", "c:1:hit"]),
        (["-n", "--binary", "last"], [f"b: {MATCHES}"]),
        (["-I", "-U", "--binary", "last"], [MATCHES]),
        (["--binary", "nothing"], []),
        (["-n", "-a", "last"], ["b:4:last hit"]),
        (["-c", "hit"], ["c:1"]),
        (["-c", "--binary", "hit"], ["b:2", "c:1"]),
        (["-c", "-U", "hit"], ["c:1"]),
        (["--count-matches", "-a", "hit"], ["b:2", "c:1"]),
        (["-l", "hit"], ["b", "c"]),
        (["--files-without-match", "two"], ["c"]),
        (["--files-without-match", "--binary", "hit"], []),
    ],
)
def test_binary_files(spark, args, want):
    rows = spark.createDataFrame([("b", "é hit\ntwo\nx\0y\nlast hit\n"), ("c", "hit\n"), ("d", "\0"), ("e", None)], "path string, text string").filter("path IN ('b', 'c')" if "--files-without-match" in args else "true")
    assert shown(rows, *args) == want


def test_json_of_binary_files(spark):
    for kind, text in (("string", "é hit\ntwo\nx\0y\nlast hit\n"), ("binary", bytearray("é hit\ntwo\nx\0y\nlast hit\n".encode()))):
        rows = spark.createDataFrame([("b", text)], f"path string, text {kind}")
        said = [json.loads(r.event) for r in run_rows(rows, ["--json", "last|^y"]).orderBy("seq").collect()]
        assert [e["data"].get("line_number") for e in said] == [None, 4, 5, None] and said[-1]["data"]["binary_offset"] == 12
        assert said[1]["data"]["absolute_offset"] == 13


def test_colour_rules():
    assert styles(["path:fg:blue", "match:bg:yellow", "line:style:bold", "column:fg:200"]) == {"path": "34", "line": "32;1", "column": "38;5;200", "match": "1;31;43"}
    assert styles(["match:none", "match:fg:0x10,20,30"])["match"] == "38;2;16;20;30"
    for wrong in ("path", "path:fg:pink", "other:fg:red", "path:style:wavy"):
        with pytest.raises(ValueError, match="unknown"):
            styles([wrong])


def test_a_command_prints_files(spark, tmp_path):
    (tmp_path / "a").write_text("x\n")
    (tmp_path / "b").write_text("y\nx\n")
    got = run(spark, ["--sort", "path", "-n", "x", str(tmp_path)], text=True).collect()
    assert [r.output for r in got] == ["a:1:x", "b:2:x"]


# Engines.
BACKTRACKING = "aaa\nfoobar\n(a(b)c)\nfoo\r\nxyxy a.b\n12 21\nab c\n"


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (["a++a"], []),
        (["(?>a+)b"], ["ab c"]),
        (["-o", r"foo\Kbar"], ["bar"]),
        (["-o", r"\((?:[^()]|(?R))*\)"], ["(a(b)c)"]),
        ([r"foo\R"], ["foo\r"]),
        ([r"\Qa.b\E"], ["xyxy a.b"]),
        ([r"(?<n>xy)\k<n>"], ["xyxy a.b"]),
        ([r"(?P<n>xy)(?P=n)"], ["xyxy a.b"]),
        (["-o", r"(\d)(\d) \g{-1}\g1"], ["12 21"]),
        ([r"^(\()?a(?(1)\(|aa)"], ["aaa", "(a(b)c)"]),
        (["-o", r"(?<w>[a-c]+)\.(?&w)"], ["a.b"]),
        ([r"\w\h\w$"], ["ab c"]),
        (["-c", r"foo\Kbar"], [1]),
        (["-A1", r"foo\Kbar"], [0, 0]),
    ],
)
def test_backtracking_syntax(spark, args, want):
    rows = spark.createDataFrame([("f", BACKTRACKING)], "path string, text string")
    assert [r[-1] for r in run_rows(rows, ["-P", *args]).collect()] == want


def test_hostile_patterns_end(spark):
    rows = spark.createDataFrame([("f", "a" * 5000 + "b\naaaa\n")], "path string, text string")
    began = time.time()
    for pattern in ("(a+)+$", "(a|aa)+$", "(?:a*b?)*$|aaaa$"):
        assert compile_patterns([pattern]).outside
        assert [r.n for r in run_rows(rows, ["-c", pattern]).collect()][0] >= 1
    assert time.time() - began < 60
    assert not compile_patterns([r"(\w+\s+)+x|(foo|bar)*"]).outside


def test_hostile_patterns_are_counted_in_linear_time():
    """Lines that the linear-time matcher decides are not searched by the other engine, which fails at the second of these."""
    texts = ["ab.\ncd\n", "a" * 60 + "! ab.\n", "", "ab.", "x.\r\ny\r\nz.\r\n", "\n\nno\n", "q.\nq.\nq\nq.", None, "é.\nzé.\n"]
    for pattern in (r"([a-z]+)+\.$", r"(a|ab|aa)+", "(x+)+$|q"):
        for options in ({}, {"invert": True}, {"max_count": 1}, {"stop_on_nonmatch": True}, {"crlf": True}, {"null_data": True}, {"invert": True, "stop_on_nonmatch": True, "max_count": 2}):
            q = SearchQuery(patterns=(pattern,), **options)
            made = q.compiled()
            if made.exact:
                reference = regex.compile(made.python.replace("+)+", "+)"))  # the same language, read in linear time
                want = [sum(1 for _ in chosen_lines(reference, t, q)) if t else 0 for t in texts]
                assert linear_counts(pa.array(texts), made.linear, q).to_pylist() == want, (pattern, options)
            else:
                assert options.get("crlf")
    for pattern in (r"((a+)+)\1$", r"(?i)(k+)+$", r"(?=a)(a+)+"):
        assert not compile_patterns([pattern], look_around=True).exact


def test_both_engines_are_named_when_neither_takes_a_pattern(spark):
    rows = spark.createDataFrame([("f", "x")], "path string, text string")
    with pytest.raises(ValueError, match=r"default: .*pcre2: "):
        run_rows(rows, ["--engine", "auto", "(?<=a+*"])
    with pytest.raises(ValueError, match="unknown group"):
        run_rows(rows, ["-P", r"(?<a>x)\k<b>"])


def test_help_version_and_configuration(spark, tmp_path):
    assert "--only-matching" in run(spark, ["--help"]).first().output
    assert run(spark, ["-V"]).first().output.startswith("textlode ")
    assert "regex" in run(spark, ["--pcre2-version"]).first().output
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("Needle\n")
    (tmp_path / "conf").write_text("# always\n--ignore-case\n")
    args = ["needle", str(tmp_path / "in")]
    assert run(spark, args, config=str(tmp_path / "conf")).count() == 1
    assert run(spark, ["--no-config", *args], config=str(tmp_path / "conf")).count() == 0
