"""Runs of words, passages that occur twice, and phrases: against brute force, SQL, and on odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlode.llm import periodic_runs, phrases, slots, substring_dedup
from textlode.llm.suffix_automaton import SuffixAutomaton

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, repeated rows and columns whose names the operators use themselves."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "no id here " * 20), (4, "word " * 3000), (5, "the same text " * 15), (5, "the same text " * 15), (6, "a b c d"), (7, "é \0 日本 x")]
    return spark.createDataFrame([(i, t, None if i == 6 else "en", "k", 1, i) for i, t in rows], "doc_id long, text string, lang string, runs string, k1 int, n long")


def duck(sql, df):
    connection = duckdb.connect()
    connection.register("documents", df.toArrow())
    return connection.execute(sql.format(rows="documents")).fetchall()


def all_runs(words, least):
    """Every stretch with a period, by trying each period; of equal stretches the smallest period."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=50), st.integers(0, 30), st.integers(1, 9), st.sampled_from([2, 5, 12]))
def test_runs_are_those_of_brute_force(words, at, period, least):
    words = words + [words[(at + k % period) % len(words)] for k in range(25)] + words[: at // 2] if words else words
    assert periodic_runs.maximal_runs(words, least) == all_runs(words, least)


def test_factors_are_longest_earlier_stretches():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.randrange(3) for _ in range(rng.randrange(40))]
        cuts = periodic_runs.factors(words)
        assert [c for a, b, _ in cuts for c in range(a, b)] == list(range(len(words)))
        for a, b, source in cuts:
            longest = max((k for s in range(a) for k in range(len(words) - a + 1) if words[s : s + k] == words[a : a + k]), default=0)
            assert b - a == max(1, longest)
            assert source < a and (source < 0 or words[source : source + b - a] == words[a:b])


def test_automaton_counts_occurrences_over_sequences():
    rng = random.Random(4)
    for _ in range(100):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        weights = [rng.randrange(1, 3) for _ in texts]
        automaton = SuffixAutomaton()
        for t, w in zip(texts, weights, strict=True):
            automaton.add(t, w)
        count = lambda s: sum(w for t, w in zip(texts, weights, strict=True) for i in range(len(t)) if t[i : i + len(s)] == s)  # noqa: E731, B023
        repeated = automaton.repeated_suffix()
        probe = [rng.randrange(4) for _ in range(15)]
        for k, size in enumerate(automaton.matching_statistics(probe, repeated)):
            assert size == max(n for n in range(k + 2) if n == 0 or count(probe[k + 1 - n : k + 1]) >= 2)


def expected_runs(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    codes = {}
    runs = all_runs([codes.setdefault(w, len(codes)) for w in words], 12)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_run_query_equals_brute_force(docs, odd):
    small = docs.filter("n_chars < 8000")
    for table in (small.select("doc_id", "text"), odd):
        got = [tuple(r) for r in periodic_runs.digests(periodic_runs.find(table, prepare=periodic_runs.tail_repeated)).collect()]
        assert sorted(got, key=str) == sorted((expected_runs(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()), key=str)
    assert periodic_runs.digests(periodic_runs.find(odd.limit(0))).count() == 0


def test_runs_and_text_of_the_operator(spark):
    table = spark.createDataFrame([("x", "start " + "a b c " * 5 + "end")], "name string, body string")
    row = periodic_runs.find(table, "name", "body").first()
    assert [tuple(r) for r in row.runs] == [(1, 15, 3)] and row.collapsed == "start a b c end" and row.name == "x"


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeated_passages_equal_sql(docs, odd, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 2000)
    for table in (docs, odd, odd.limit(0)):
        got = [tuple(r) for r in substring_dedup.without_repeats(table, digest=True).collect()]
        assert sorted(got, key=str) == sorted(duck(substring_dedup.SQL, table.select("doc_id", "text")), key=str)


def test_passages_are_judged_on_the_input(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words[:60])), (2, " ".join(["x", *words[20:55], "y"])), (3, " ".join(words[100:134])), (4, " ".join(words[100:134]))]
    got = {r.doc_id: r for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 35 and got[1].kept == " ".join(words[:20] + words[55:60])
    assert got[2].kept == "x y"
    assert got[3].n_removed == got[4].n_removed == 0  # 34 words


def test_own_window_length_and_columns(spark):
    rows = [("a", "p q r s t u v w x y z a b c d", 1), ("b", "0 p q r s t u v w x y z a b", 2)]
    got = {r.name: r.kept for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "name string, body string, n long"), "name", "body", 12).collect()}
    assert got == {"a": "c d", "b": "0"}
    with pytest.raises(ValueError, match="windows"):
        substring_dedup.without_repeats(spark.createDataFrame(rows, "name string, body string, n long"), "name", "body", 90)


@pytest.mark.parametrize(("cells", "held"), [(4_000_000, 500_000), (40, 25)])
def test_phrases_equal_sql(spark, docs, cells, held, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_CELLS", cells)
    monkeypatch.setattr(phrases, "MOST_PHRASES", held)
    many = docs.unionAll(docs).unionAll(docs).unionAll(docs)  # so that many phrases reach 30
    got = [tuple(r) for r in phrases.mined(many).collect()]
    want = duck(phrases.SQL, many.select("text", "lang"))
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_phrases_take_three_passes_whatever_the_candidates(spark, monkeypatch):
    """Texts are read as often with thousands of candidates as with few, and groups of a task add up."""
    passes, by_task = [], phrases.by_task
    monkeypatch.setattr(phrases, "by_task", lambda *given: passes.append(1) or by_task(*given))
    monkeypatch.setattr(phrases, "MOST_CELLS", 2)
    monkeypatch.setattr(phrases, "MOST_PHRASES", 3)
    monkeypatch.setattr(phrases, "GROUP", 50, raising=False)
    rows = spark.createDataFrame([("a b c d e f g h. a b", k) for k in ("en", None)] * 40, "text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in phrases.mined(rows).collect())
    assert got and got == sorted(duck(phrases.SQL, rows))
    assert len(passes) == 3


def test_phrases_of_odd_rows(spark, odd):
    assert sorted(tuple(r) for r in phrases.mined(odd).collect()) == sorted(duck(phrases.SQL, odd.select("text", "lang")))
    assert phrases.mined(odd.limit(0)).collect() == []


def test_matches_stay_within_pieces_and_words(spark):
    rows = [("New York. york, new\nyork NEW york newyork new yorker", None)] * 20 + [("a a a a b", "xx")] * 10
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n) for r in phrases.mined(spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert got["und", "new york"] == (40, 80, 80, 200)
    assert ("und", "york new") not in got  # 20 times within a piece
    assert got["xx", "a a"][:3] == (30, 40, 40)


def test_records_keep_their_virtual_slots(spark, docs, odd):
    """Another layout of the files and added rows move no record: slots depend on id, checksum and number of copy alone."""
    rows = docs.select("doc_id", "text").unionAll(odd.select("doc_id", "text")).unionAll(odd.select("doc_id", "text"))
    found = lambda df: sorted(((r.doc_id, r.text_crc32, r["size"], r.nth, r.vslot) for r in slots.measured(df).collect()), key=str)
    first = found(rows)
    assert len(first) == rows.count() and found(rows.repartition(7).orderBy("text")) == first
    more = found(rows.unionAll(docs.select(F.col("doc_id") + 1_000_000, "text")).unionAll(odd.select("doc_id", "text")))
    assert set(first) <= set(more)
    want, seen = [], {}
    for r in rows.collect():
        text = (r.text or "").encode()
        key = (r.doc_id, zlib.crc32(text), len(text) + 1)
        seen[key] = seen.get(key, -1) + 1
        want.append((*key, seen[key]))
    assert sorted(map(str, want)) == sorted(str(r[:4]) for r in first)


def test_law_of_bytes_with_hot_and_null_ids(spark):
    rows = spark.createDataFrame([(7 if k % 3 == 0 else None if k % 3 == 1 else k, "same text" if k % 2 else f"text {k} " * (k % 40)) for k in range(6000)], "doc_id long, text string")
    made = slots.measured(rows)
    sizes, counts = slots.slot_sizes(made)
    placed = slots.placed(made, slots.SlotMap.build(sizes, 8), counts).collect()
    filled = [sum(r["size"] for r in placed if r.shard == s) for s in range(8)]
    assert max(filled) - min(filled) < 0.02 * max(filled)
    for s in range(8):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))
