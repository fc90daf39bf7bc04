import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from textlode.functions.dialect import PatternError, compile_patterns, escape_fixed
from textlode.operators.search import distinct_matches


def spans(pattern, text, **options):
    found = regex.compile(compile_patterns([pattern], **options).python)
    return [m.span() for m in distinct_matches(found, text)]


@pytest.mark.parametrize(
    ("pattern", "text", "expected"),
    [
        (r"b*", "abc", [(0, 0), (1, 2), (3, 3)]),
        (r"[a-z--[aeiou]]+", "hello", [(0, 1), (2, 4)]),
        (r"[[:alpha:]&&[^x]]", "axb1", [(0, 1), (2, 3)]),
        (r"[a-g~~c-k]+", "abcdefghijk", [(0, 2), (7, 11)]),
        (r"a$", "a\nba", [(0, 1), (3, 4)]),
        (r"\bfoo\b", "foo éfoo foo", [(0, 3), (9, 12)]),
        (r"(?i)É", "é", [(0, 1)]),
        (r"(?U)a+", "aaa", [(0, 1), (1, 2), (2, 3)]),
        (r"(?x) a b # c", "ab", [(0, 2)]),
        (r"\p{Greek}+", "xαβ", [(1, 3)]),
        (r"\x{41}B", "AB", [(0, 2)]),
        (r"a.b", "a\nb a\rb", [(4, 7)]),
        (r"[]a]+", "]a", [(0, 2)]),
        (r"|y", "xyz", [(0, 0), (1, 1), (2, 2), (3, 3)]),
        (r"xy|.*?", "xyzzxy", [(0, 2), (3, 3), (4, 6)]),
        (r"(?:^|x)+", "x\nxx", [(0, 0), (2, 2), (3, 4)]),
        (r"(?R)$", "a\r\nb\rc", [(1, 1), (4, 4), (6, 6)]),
        (r"(?R)^", "a\r\nb\rc", [(0, 0), (3, 3), (5, 5)]),
        (r"(?R).$", "ZZ\r", [(1, 2)]),
        (r"\p{Cased_Letter}+", "1aB2", [(1, 3)]),
    ],
)
def test_matches(pattern, text, expected):
    assert spans(pattern, text) == expected


@pytest.mark.parametrize("bad", ["(", "a)", "(?=a)", r"\1", "[z-a]", "*a", "(?P<a>x)(?P<a>y)", "[a", r"\p{Nope-1}", "a{3,1}", "(?)"])
def test_rejected(bad):
    with pytest.raises(PatternError):
        compile_patterns([bad])


def test_options():
    assert spans("-2", "x -2 a-2", word=True) == [(2, 4)]
    assert spans("ab", "ab\nabc", line=True) == [(0, 2)]
    assert spans("abc", "ABC", case="smart") == [(0, 3)]
    assert spans(r"a\S", "AB", case="smart") == []  # the S of an escape counts
    assert compile_patterns(["(foo|bar)baz"]).literals == ["foo", "bar"] or compile_patterns(["(foo|bar)baz"]).literals == ["baz"]
    assert compile_patterns([]).java
    assert spans(r"a(?!b)", "abac", look_around=True) == [(2, 3)]


@settings(max_examples=150, deadline=None)
@given(st.text("ab.*+?()[]{}|^$\\-# ", max_size=8), st.text("ab.*+?()[]{}|^$\\-# ", max_size=20))
def test_fixed_strings(needle, text):
    if needle:
        assert spans(escape_fixed(needle), text) == [m.span() for m in re.finditer(re.escape(needle), text)]


@settings(max_examples=150, deadline=None)
@given(st.from_regex(r"(a|b|ab|[ab]c|a\*|\(a\)){1,4}", fullmatch=True), st.text("abc*()", max_size=12))
def test_literals_are_needed(pattern, text):
    compiled = compile_patterns([pattern])
    if compiled.literals and regex.search(compiled.python, text):
        assert any(p in text for p in compiled.literals)


def test_kinds_of_literal_matches():
    from textlode.functions.matchlib import chosen

    literals = ["append", "appendage", "app", "end"]
    text = "append the app to the appendage"
    found = sorted(((k, m, m + len(p)) for k, p in enumerate(literals) for m in range(len(text)) if text.startswith(p, m)), key=lambda m: (m[2], m[1]))
    said = lambda kind: [(literals[k], a) for k, a, _ in chosen(found, kind)]
    assert said("overlapping") == [("app", 0), ("append", 0), ("end", 3), ("app", 11), ("app", 22), ("append", 22), ("end", 25), ("appendage", 22)]
    assert said("standard") == [("app", 0), ("end", 3), ("app", 11), ("app", 22), ("end", 25)]
    assert said("leftmost_first") == [("append", 0), ("app", 11), ("append", 22)]
    assert said("leftmost_longest") == [("append", 0), ("app", 11), ("appendage", 22)]


def test_literal_matches(spark):
    from pyspark.sql import functions as F

    from textlode.functions import matchlib

    rows = spark.createDataFrame([("é the there",), ("",), (None,)], "text string")
    made = rows.select(matchlib.literal_matches(F.col("text"), ["the", "there"], "leftmost_longest").alias("m"), matchlib.find(F.col("text"), "the").alias("a"), matchlib.find_last(F.col("text"), "the").alias("b"), matchlib.find_any(F.col("text"), "^h]").alias("c")).collect()
    assert [tuple(x) for x in made[0].m] == [(0, 3, 6), (1, 7, 12)] and tuple(made[0])[1:] == (3, 7, 4)
    assert made[1].m == [] and made[2].m is None and tuple(made[1])[1:] == (None, None, None)
    with pytest.raises(ValueError):
        matchlib.find(F.col("text"), "")


def test_properties_from_ranges():
    import regex as engine

    for name, yes, no in ((r"\p{Word_Break=MidNum}", ",;", "a."), (r"\p{Grapheme_Cluster_Break=CR}", "\r", "\n"), (r"\p{Sentence_Break=STerm}", "!?", "a,"), (r"\p{White_Space}", " \u00a0", "x"), (r"\p{Hex_Digit}", "aF9", "g"), (r"\P{Hex_Digit}", "g", "a")):
        found = engine.compile(compile_patterns([name]).python)
        assert all(found.fullmatch(c) for c in yes) and not any(found.fullmatch(c) for c in no), name
    with pytest.raises(ValueError, match="unknown property"):
        compile_patterns([r"\p{NoSuchThing}"])


def test_a_terminator_is_no_part_of_a_pattern():
    from textlode.plans.query import SearchQuery

    with pytest.raises(ValueError, match="not allowed"):
        SearchQuery(patterns=(r"a\x00b",), null_data=True).compiled()
    assert SearchQuery(patterns=("a\nb",), null_data=True).compiled().can_match_newline
    with pytest.raises(ValueError, match="not allowed"):
        SearchQuery(patterns=("a\nb",)).compiled()
