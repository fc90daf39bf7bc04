"""The registered queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.llm import cotraining, decontaminate, html_text, jaccard, line_dedup, periodic_runs, phrases, pii, quality_rules, sentencepieces, slots, substring_dedup, token_records
from textlode.session import workspace

PIECES, BYTES, END_ID = "piece_bpe_32k.model", "byte_bpe_50k.json", 2
SHARDS = 8


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(sentencepieces.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path(PIECES)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.measured(table(spark, sf_dir, "documents"))
    sizes, counts = slots.slot_sizes(rows)
    path = workspace(spark, "slot-map")
    slots.SlotMap.build(sizes, SHARDS).store(spark, path)
    shard_map = slots.SlotMap.load(spark, path, 1, SHARDS)
    return slots.placed(rows, shard_map, counts).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, views = cotraining.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return cotraining.score_views(views, model)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BYTES), END_ID, workspace(spark, "token-records"))
    return token_records.read_tokens(manifest)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"), 3, 90)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find(table(spark, sf_dir, "documents"), prepare=periodic_runs.tail_repeated))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"), digest=True)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_html_extraction, op2_sentencepiece, op3_sharding, op4_pii, op5_line_dedup,
        op6_cotraining, op7_quality_rules, op8_decontamination, op9_token_records, op10_jaccard_join,
        op11_periodic_runs, op12_substring_dedup, op13_phrases,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.SQL.format(rows="documents"), "op7_quality_rules": quality_rules.SQL.format(rows="documents"), "op12_substring_dedup": substring_dedup.SQL.format(rows="documents"), "op13_phrases": phrases.SQL.format(rows="documents")}
