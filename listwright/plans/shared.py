"""Tables that a plan writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; in local mode, a folder of the session's own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        session = spark.sparkContext.applicationId
        if session not in _LOCAL:
            _LOCAL[session] = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        found = _LOCAL[session]
    return found.rstrip("/")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for a row, however many expressions and filters after it read them: a generator stands between."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(row)).alias("_once")).select(*[F.col(f"`{n}`") for n in df.columns if n not in columns], *[F.col(f"_once.{n}").alias(n) for n in columns])


def kept_table(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and read again from then on, also after a loss of executors."""
    path = f"{folder(df.sparkSession)}/listings/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
