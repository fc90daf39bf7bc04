"""A total order of rows by ranges: no task sorts, numbers or holds more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.session import materialise, workspace

_INDEX = (1 << 33) - 1  # the part of a row's generated id that counts within its partition


def numbered(rows: DataFrame, *keys: Column, name: str = "place") -> DataFrame:
    """`rows` with their places (from 1) in the order of `keys`. Equal keys have different places, in no given order. The
    rows are written once, between the sort and the sums over partitions; these are as many as there are partitions."""
    made = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX)))
    made = materialise(made, workspace(rows.sparkSession, "order"))
    counts = made.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return made.join(F.broadcast(before), "_part").withColumn(name, (F.col("_at") + F.col("_before") + 1).cast("long")).select(*rows.columns, name)
