"""The stateless part of a search over a stream of files or rows: the same filter and lines, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlode.operators.search import Search
from textlode.plans.query import SearchQuery


def stream_lines(stream: DataFrame, query: SearchQuery, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Selected lines of a streaming corpus. Limits by file need the whole file in order and are refused."""
    if query.max_count is not None or query.stop_on_nonmatch or query.lines_before or query.lines_after:
        raise ValueError("limits and context are not available on streams")
    return Search(stream, query, keys, text).lines()


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)
