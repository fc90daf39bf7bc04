"""The pipeline's stages, each on what its predecessor kept, against plain Python or SQL."""

import hashlib

import corpus_pipeline
import duckdb
import sentencepiece
from test_operators import components_by_hand, leaks_by_hand

from textlode.llm import line_dedup, quality_rules
from textlode.llm.queries import PIECES, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    long = [f"word{k}" for k in range(200)]
    copies = [(9000 + k, " ".join([*long[: 20 * k], "quite-another", *long[20 * k + 1 :]]), "en", "s", 0) for k in range(4)]
    docs = docs.unionByName(spark.createDataFrame(copies, docs.schema))
    given = docs.toPandas()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names[0] == "quality rules" and len(names) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    db = duckdb.connect()
    db.register("documents", given)
    good = {r[0] for r in db.sql(f"SELECT doc_id FROM ({quality_rules.SQL.format(rows='documents')}) WHERE kept").fetchall()}
    assert set(kept["quality rules"]) == good
    db.sql(f"CREATE TABLE good AS SELECT d.doc_id, d.text FROM documents d JOIN ({quality_rules.SQL.format(rows='documents')}) q ON d.doc_id = q.doc_id WHERE q.kept")
    lines = {r[0]: r[1] for r in db.sql(f"SELECT doc_id, text FROM ({line_dedup.SQL.format(rows='good')}) WHERE n_removed = 0 OR regexp_matches(text, '[^\\s]')").fetchall()}
    assert kept["line dedup"] == lines
    first = {d: t for d, t in lines.items() if d in {c for _, _, c in components_by_hand(sorted(lines.items()), 5, 80)}}
    assert kept["n-gram Jaccard join"] == first and len(first) < len(lines)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d: t for d, t in first.items() if not any(leaks_by_hand(t, i) for i in items)}
    assert kept["benchmark decontamination"] == clean and len(clean) < len(first)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.ids for r in tokens} == {d: library.encode(t) for d, t in clean.items()}
    for r in tokens:
        assert r.n_tokens == len(r.starts) == len(r.ends) and r.decoded_sha256 == hashlib.sha256(library.decode(r.ids).encode()).hexdigest()
        assert r.ends[-1] == len(clean[r.doc_id].encode())


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, and an extra column with a name that the stages use themselves."""
    text = " ".join(f"word{k}" for k in range(80))
    other = " ".join(f"term{k}" for k in range(80))
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, None, "c"), (None, other, "d"), (None, other, "d"), (3, "", "e")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, other), (1, text)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
