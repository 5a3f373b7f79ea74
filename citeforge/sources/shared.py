"""Paths for files that one job writes and another reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's ``spark.checkpoint.dir``. Where that is unset it is a local one, in
    local mode only: on a cluster each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or f'/tmp/checkpoints/{spark.sparkContext.applicationId}'}/files/{uuid.uuid4().hex}-{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, written as Parquet to the shared folder and read back: several jobs read the
    same rows in the same places, whichever executors are lost. Whoever clears that folder removes it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
