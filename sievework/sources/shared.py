"""Tables written in the shared folder, so that what many branches of a plan read is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a session on one machine that names none gets one of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-sievework-"))


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read back: without its lineage, and safe from lost executors."""
    path = f"{folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
