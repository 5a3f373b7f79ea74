"""What is resolved, by which stage: one long table instead of a set for each resolver.

``resolution``: sample_index, stage, resolver, status and more. A policy names, for each resolver,
the statuses that count as found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.functions.text import percent
from citeforge.operators.ranking import best, running_total
from citeforge.sources.shared import shared_path, stored

#: Stages in order, and what counts as found: the compatible policy takes ``possible`` matches of
#: the early stages as found; the strict one never does.
STAGES = ("doi", "bibliographic", "form", "works", "repository", "cleanup", "medical", "article_file", "parsed", "target", "title_search", "hidden_doi", "file_record", "isbn", "citation", "reparse")
_EARLY = ("bibliographic", "works", "repository", "cleanup", "medical", "parsed")
COMPATIBLE = {s: ("found", "strong", "possible") if s in _EARLY else ("found", "strong") for s in STAGES}
STRICT = {s: ("found", "strong") for s in STAGES}


def found(resolution: DataFrame, policy: dict[str, tuple[str, ...]], upto: int | None = None) -> DataFrame:
    """Rows that count as found, on demand only of stages up to a number."""
    ok = F.lit(False)
    for resolver, statuses in policy.items():
        ok = ok | ((F.col("resolver") == resolver) & F.col("status").isin(*statuses))
    rows = resolution.filter(ok)
    return rows if upto is None else rows.filter(F.col("stage") <= upto)


def found_set(resolution: DataFrame, policy: dict[str, tuple[str, ...]], resolvers: list[str] | None = None) -> DataFrame:
    """The distinct sample_index of found rows, on demand of some resolvers only."""
    rows = found(resolution, policy)
    return (rows if resolvers is None else rows.filter(F.col("resolver").isin(*resolvers))).select("sample_index").distinct()


def provenance(resolution: DataFrame, policy: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per found reference: the first stage that found it."""
    return best(found(resolution, policy), ["sample_index"], [F.col("stage"), F.col("resolver")])


def remaining(refs: DataFrame, found_rows: DataFrame) -> DataFrame:
    # Ids compress so well that their file would pass for one to broadcast.
    return refs.join(found_rows.hint("merge"), "sample_index", "left_anti")


def cumulative(resolution: DataFrame, policy: dict[str, tuple[str, ...]], total: DataFrame) -> DataFrame:
    """For each stage: newly found, found so far, and the rate over ``total`` (column n)."""
    first = found(resolution, policy).groupBy("sample_index").agg(F.min("stage").alias("stage"))
    counts = first.groupBy("stage").agg(F.count(F.lit(1)).alias("new_found"))
    return running_total(counts, "stage", "new_found").withColumn("rate", percent(F.col("cumulative"), total.select("n").scalar()))


def scoped(refs: DataFrame, resolution: DataFrame, scope: str) -> DataFrame:
    """References that a scope leaves open: form, strict, broad, union or union_works."""
    resolvers = {"form": ["form"], "strict": ["doi", "bibliographic"], "broad": ["doi", "bibliographic"], "union": ["doi", "bibliographic", "form"], "union_works": ["doi", "bibliographic", "form", "works"]}[scope]
    policy = STRICT if scope == "strict" else COMPATIBLE
    return remaining(refs, found_set(resolution, policy, resolvers))


def run_stages(targets: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], ends: tuple[str, ...] = ("found", "strong"), table: str | None = None) -> DataFrame:
    """The resolution table of stages in turn: sample_index, status and what else a stage gives, with stage (from 1) and
    resolver.

    A stage, a name and a function of the targets (sample_index), is only asked for targets that no stage
    before it has found, with a status in ``ends``; once none is open the rest are not run. Each stage's rows
    are appended to the Parquet table ``table`` (by default a new one in the shared folder) as a part of
    its own, and what each leaves open is stored, so the stages before are read, never computed again. A table that holds stages already is gone
    on with: those are not asked again. Statuses that don't end keep a target open; ``cascade`` settles them.
    """
    spark = targets.sparkSession
    table = table or shared_path(spark, "resolution")
    fs = spark._jvm.org.apache.hadoop.fs.Path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/stage={n}/_SUCCESS"))
    open_ = stored(targets.select("sample_index").distinct(), "open")
    rows = None
    for n, (name, stage) in enumerate(stages, 1):
        part = f"{table}/stage={n}"
        if not done(n):
            if not open_.limit(1).count():
                break
            stage(open_).withColumn("resolver", F.lit(name)).write.mode("overwrite").parquet(part)
        own = spark.read.parquet(part).withColumn("stage", F.lit(n))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if n < len(stages):
            open_ = stored(remaining(open_, own.filter(F.col("status").isin(*ends)).select("sample_index")), "open")
    if rows is None:
        return spark.createDataFrame([], "sample_index long, status string, resolver string, stage int")
    return rows


def cascade(scored: DataFrame, ends: tuple[str, ...] = ("strong",)) -> DataFrame:
    """Of rows (sample_index, stage, resolver, status, confidence) the one that a cascade ends with:
    a later stage only takes over with a strictly higher status, and a status in ``ends`` ends the search."""
    rank = F.when(F.col("status").isin(*ends), 2).when(F.col("status") == "possible", 1).otherwise(0)
    return best(scored, ["sample_index"], [-rank, F.col("stage")])
