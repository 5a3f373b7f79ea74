"""Tables written between jobs, in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on this machine alone, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A local folder where that is unset, in local mode only:
    on a cluster each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or f"{LOCAL_FALLBACK}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: written as Parquet to the shared folder and read back.

    The result has no lineage beyond those files, so a lost executor costs no recomputation,
    and it can be scanned several times at the price of a read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df`` with numbers from 0 without gaps in a column ``name``, in no given order. The rows are written
    with their places, so the numbers never change; the driver sees one size a part."""
    placed = written(df.withColumn("_place", F.monotonically_increasing_id()), label)
    sizes = placed.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((r["_part"], before))
        before += r["n"]
    small = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _before long"))  # a row a part
    at = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", F.shiftright("_place", 33)).join(small, "_part").withColumn(name, at).drop("_part", "_place", "_before")


def apart(df: DataFrame) -> DataFrame:
    """An exchange between an aggregate and a join on the same key.

    Without it the join takes over the aggregate's partitioning, and AQE, which splits hot keys only
    where both inputs of a join are exchanges made for it, must leave a hot key in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs whose result has been written out."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
