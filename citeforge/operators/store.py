"""Stores that fill over time: lookups, links, run logs. Plain Parquet, one folder a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.operators.summary import count_where


def missing_keys(keys: DataFrame, lookup: DataFrame, key: str = "key", retry: tuple[str, ...] = ()) -> DataFrame:
    """Distinct keys that the lookup lacks; stored rows with a status in ``retry`` count as lacking."""
    have = lookup.filter(~F.coalesce(F.col("status").isin(*retry), F.lit(False))) if retry else lookup
    return keys.select(key).distinct().join(have, key, "left_anti")


def cacheable(results: DataFrame, keep_errors: bool = True, keep_limited: bool = False) -> DataFrame:
    """Results that a store may keep: rate-limited answers, and on demand errors, are asked again."""
    drop = [*([] if keep_limited else ["rate_limited"]), *([] if keep_errors else ["error"])]
    return results.filter(~F.col("status").isin(*drop)) if drop else results


def resume(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't stored yet."""
    return rows.join(stored, keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One row per key: the new one where there is one, the latest of several."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.struct(F.col("_new"), F.col(time))
    others = [c for c in old.columns if c not in keys]
    packed = both.groupBy(*keys).agg(F.max_by(F.struct(*others), latest).alias("_row"))
    return packed.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in others)).select(*old.columns)


def run_log(rows: DataFrame, provider: Column) -> DataFrame:
    """Counters of a collecting run: processed, unique, null links, errors."""
    return rows.groupBy(provider.alias("provider")).agg(
        F.count(F.lit(1)).alias("processed"),
        count_where(F.col("status") == "unique_result").alias("unique_count"),
        count_where(F.col("link").isNull()).alias("null_count"),
        count_where(F.col("status") == "error").alias("error_count"),
    )


def review_queue(rows: DataFrame, status: str = "possible") -> DataFrame:
    return rows.filter(F.col("status") == status)


