"""Small shared pieces of the Spark plans in this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; in local mode, a folder of one's own where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and read again after a loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def erase(*frames: DataFrame) -> None:
    """Removes tables that written() made and that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it is open, Arrow batches hold at most so many rows, so that long rows don't fill a task's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hidden(df: DataFrame, keep: Iterable[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns renamed to c0, c1, ... so that a plan's own names can't clash; and old names by new."""
    names = {f"c{i}": n for i, n in enumerate(df.columns)}
    return df.toDF(*names), names


def restored(df: DataFrame, names: dict[str, str], **own: str | Column) -> DataFrame:
    """The original columns and `own` columns; one of the same name replaces the original."""
    old = [F.col(c).alias(n) for c, n in names.items() if n not in own]
    return df.select(*old, *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in own.items()))
