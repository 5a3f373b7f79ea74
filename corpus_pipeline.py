"""The corpus pipeline: quality, exact copies, near copies, secrets, packing.

Each stage takes documents and, but for the last, returns documents with the same columns. A stage
works on every row of its input. Where ids are missing or repeated, rows are told apart by id and text, and
rows that repeat both by their place in the input: of a group of copies, exact or near, one row stays,
whatever its ids. Rows without an id are judged like others, and come after those with one.
Further columns of any name pass through, and ``n_chars`` need not be there. Null texts count as empty, and fail the quality rules. An empty
input gives an empty output with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm.exact_dedup import exact_dedup
from citeforge.llm.packing import pack
from citeforge.llm.quality_rules import kept_rows
from citeforge.llm.scratch import written
from citeforge.llm.secret_scan import redacted
from citeforge.llm.simhash import simhash_components

REDACTED = "[SECRET]"


def _repeated(docs: DataFrame) -> bool:
    """Whether some id is missing or comes twice."""
    return bool(docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count())


def _only(docs: DataFrame, verdict: DataFrame, repeated: bool) -> DataFrame:
    """The rows of ``docs`` whose id, a missing one too, and text are in ``verdict``; of rows that repeat both the first."""
    kept = verdict.select(F.struct("doc_id", "text_tag").alias("kept"))
    row = "_row" + "_" * max(len(c) for c in docs.columns)  # no column of the documents can clash
    if repeated:
        docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows_with_places")
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_tag"))
    # The right side's column is named by its own table.
    rows = docs.alias("d").join(kept.alias("k"), own.eqNullSafe(F.col("k.kept")), "left_semi")
    if not repeated:
        return rows
    first = rows.groupBy(F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).alias("same")).agg(F.min(row).alias(row)).select(row)
    return docs.join(first, row, "left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return kept_rows(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in either case) the one with the largest id stays."""
    verdict = exact_dedup(docs, keep="max", ignore_ascii_case=True)
    return _only(docs, verdict.filter("kept"), _repeated(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id stays, one without an id only if none has one."""
    found, repeated = simhash_components(docs), _repeated(docs)
    if not repeated:
        return _only(docs, found.filter(F.col("doc_id") == F.col("component_id")), repeated)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_tag")).alias("m")
    return _only(docs, found.groupBy("component").agg(least).select("m.doc_id", "m.text_tag"), repeated)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced, and ``n_chars`` follows; every document stays. A map: no join back."""
    return redacted(docs, REDACTED, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1,024."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: Compression ratios, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
