"""References that arrive over time: each micro-batch is resolved once and stored by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from citeforge.operators.store import missing_keys, upsert


def stream_references(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Files that arrive in a folder, a bounded number in each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def fill_store(stream: DataFrame, resolve: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, key: str = "key", once: bool = False) -> StreamingQuery:
    """Appends ``resolve`` of the keys that the store lacks, a part for each micro-batch.

    With ``once`` the stream's own state, which the checkpoint keeps, lets each key through once, so that
    batches are small before they meet the store. A part's name is its batch id, and a repeated batch overwrites its own part: so a restart after
    a failure neither loses nor doubles answers.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            have = spark.read.parquet(store).filter(f"batch <> {batch_id}")
            keys = missing_keys(batch, have, key)
        except Exception as e:  # the first batch: there is no store yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            keys = batch.select(key).distinct()
        resolve(keys).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    if once:
        stream = stream.dropDuplicates([key])
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(old: DataFrame, new: DataFrame, keys: list[str], time: str) -> DataFrame:
    """A snapshot of the store with a batch merged in."""
    return upsert(old, new, keys, time)
