"""Queries over a store that fills from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.plans.registry import query
from citeforge.plans.views import table
from citeforge.sources.shared import shared_path
from citeforge.streaming import incremental


@query("""SELECT 'user:' || user_id || ':' || event_type AS key, CASE WHEN user_id % 5 = 0 THEN 'not_found' ELSE 'ok' END AS status, CAST(min(event_id % 4 >= 2) AS BOOLEAN) AS after_restart FROM events GROUP BY ALL""")
def streamed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of arriving files looked up once each, in micro-batches; half of the files arrive after a stop, and
    the second run goes on from the first one's checkpoint and state."""
    source, store, checkpoint = (shared_path(spark, n) for n in ("arriving", "looked_up", "stream_checkpoint"))
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))
    events = table(spark, sf_dir, "events").select(key.alias("key"), (F.col("event_id") % 4).alias("part"))

    def resolve(late: bool):
        status = F.when(F.split("key", ":")[1].cast("long") % 5 == 0, "not_found").otherwise("ok")
        return lambda keys: keys.select("key", status.alias("status"), F.lit(late).alias("after_restart"))

    for late in (False, True):
        for part in (2 * late, 2 * late + 1):
            events.filter(F.col("part") == part).select("key").write.mode("append").parquet(source)
        stream = incremental.stream_references(spark, source, "key string", max_files=8)
        incremental.fill_store(stream, resolve(late), store, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(store).select("key", "status", "after_restart")
