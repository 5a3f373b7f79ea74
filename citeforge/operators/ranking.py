"""Best rows, numbering, runs, chunks, running totals, deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeforge.sources.shared import stored


def best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, all columns.

    A minimum over structs, so tasks combine before the shuffle and a hot key arrives as one row
    from each. ``order`` must sort ascending; negate numbers for descending ones.
    """
    names = rows.columns
    others = [n for n in names if n not in keys]
    packed = F.min(F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*others).alias("_row"))).alias("_m")
    return rows.groupBy(*keys).agg(packed).select(*keys, *(F.col(f"_m._row.{n}").alias(n) for n in others)).select(*names)


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Up to ``k`` rows of each key in the given order, with ``place`` from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)


def nonzero_best(rows: DataFrame, keys: list[str], score: Column, order: list[Column]) -> DataFrame:
    """As ``best`` among rows with a score over zero."""
    return best(rows.filter(score > 0), keys, order)


def numbered(rows: DataFrame, order: list[str], name: str = "number", start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole table in the given order, without a single task.

    Rows are range-sorted and written with their places (``shared.stored``), so a part that has to be read
    again has its rows where they were, and nothing is kept in memory; only the parts' sizes reach the
    driver. All columns close the order; rows that are equal throughout are alike.
    """
    order = [*order, *(c for c in rows.columns if c not in order)]
    parts = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before, offsets = start, []
    for r in sorted(parts.groupBy(part.alias("_p")).count().collect(), key=lambda r: r["_p"]):
        offsets.append((r["_p"], before))
        before += r["count"]
    small = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_p long, _b long"))  # a row for each part
    number = F.col("_b") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.withColumn("_p", part).join(small, "_p").withColumn(name, number).drop("_p", "_b", "_at")


def chunked(rows: DataFrame, order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Chunks of ``size`` rows in order, from 0, and the line in the chunk from 1."""
    n = F.col("_n")
    return numbered(rows, order, "_n", 0).withColumn(name, F.floor(n / size).cast("long")).withColumn("line", (n % size + 1).cast("long")).drop("_n")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): distinct keys with their first place."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def streaks(rows: DataFrame, keys: list[str], order: list[str], failed: Column) -> DataFrame:
    """Adds ``streak``: how many failures in a row end here, 0 after a success."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = rows.withColumn("_f", failed).withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(inside).cast("long")).drop("_f", "_g")


def running_total(counts: DataFrame, order: str, value: str, name: str = "cumulative") -> DataFrame:
    """A running sum over an aggregate that is small by its nature, as one row for each stage."""
    return counts.withColumn(name, F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def sample_hash(key: Column, seed: int) -> Column:
    """A reproducible order by arithmetic alone, the same in any engine."""
    mixed = (key.cast("long") * 2654435761 + seed * 40503) % 4294967296
    return (mixed * 69069 + 1) % 4294967296


def sample(rows: DataFrame, key: str, n: int, mode: str = "random", seed: int = 20260804, check: bool = True) -> DataFrame:
    """The first or a seeded random ``n`` rows by an integer key; more than there are is an error."""
    if check and (have := rows.limit(n).count()) < n:
        raise ValueError(f"sample size {n} exceeds the {have} rows there are")
    order = [F.col(key)] if mode == "first" else [sample_hash(F.col(key), seed), F.col(key)]
    return rows.orderBy(*order).limit(n)
