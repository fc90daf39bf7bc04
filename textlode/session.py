"""Session helpers shared by the whole library: start-up, code shipping and the shared work folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textlode")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers: on other machines whatever the driver's own path is, on this one
    unless PYTHONPATH or the working folder does so already."""
    on_path = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if (_local(spark) and str(ROOT) in on_path) or getattr(spark.sparkContext, "_textlode_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "textlode.zip"  # on the driver, which serves it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for p in ROOT.joinpath("textlode").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._textlode_shipped = True


def bounded_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Bound the session's Arrow batches by bytes, however long the texts are, and ship this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local runs get a temporary one;
    a cluster has no folder of its own that all machines see, so that this is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textlode-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def workspace(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/textlode/{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write `df` as Parquet and read it back: later stages depend on files and not on the lineage."""
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API (works for every store that Spark reads)."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: its cleaner waits for the driver to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
