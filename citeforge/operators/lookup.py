"""Joins of references to looked-up records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.operators.ranking import best
from citeforge.sources.shared import stored


def first_success(rows: DataFrame, id_col: str, keys: str, lookup: DataFrame, ranks: dict[str, int], carry: list[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per id with candidates: the first candidate with the best-ranked status. Ids come once.

    ``keys``: array column, in order of preference; ``lookup``: key, status and more. Statuses that
    ``ranks`` doesn't name, and missing keys, rank last; then the first candidate wins. ``carry``: more
    columns of ``rows`` to keep; ``keep_empty``: ids without candidates too, with nulls.

    Equal arrays are looked up once. Ids without candidates meet nothing: their null keys would be one task's.
    """
    carry, keep = carry or [], [c for c in lookup.columns if c != "key"]
    rows = stored(rows.select(id_col, *carry, F.col(keys).alias("_keys")), "lookups")
    some = F.coalesce(F.size("_keys") > 0, F.lit(False))
    each = rows.filter(some).select("_keys").distinct().select("_keys", F.posexplode("_keys").alias("pos", "key")).join(lookup, "key", "left")
    order = F.coalesce(*(F.when(F.col("status") == s, F.lit(r)) for s, r in ranks.items()), F.lit(len(ranks) + 1))
    chosen = best(each.withColumn("_rank", order), ["_keys"], [F.col("_rank"), F.col("pos")]).drop("_rank")
    out = rows.filter(some).join(chosen, "_keys").select("key", id_col, *carry, "pos", *keep)
    return out.unionByName(rows.filter(~some).drop("_keys"), allowMissingColumns=True) if keep_empty else out


def distinct_texts(rows: DataFrame, column: str, *others: Column) -> tuple[DataFrame, Column]:
    """(``column``, ``others`` over its rows, _text) for each distinct text, and the number ``_text`` for rows: a hash that no two of these
    texts share, which is counted, so that rows meet what was made of their text by the number alone."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # what is made of a text takes far longer than its bytes would need
    texts = stored(rows.groupBy(column).agg(*(others or [F.first(F.lit(True)).alias("_any")])).repartition(parts, column), "texts")
    for seed in range(8):
        number = F.xxhash64(F.lit(seed), F.col(column))
        own = texts.withColumn("_text", number)
        if own.groupBy("_text").count().filter("count > 1").isEmpty():
            return own, number
    raise ValueError("eight hashes are each shared by several texts")


def prioritised_lookup(rows: DataFrame, lookup: DataFrame, id_key: str, search_key: str) -> DataFrame:
    """Adds key, status, n_items of the identifier key if it is ok and not empty, else of the
    search key if that was looked up, else of the identifier key whatever it gave."""
    a = lookup.select(F.col("key").alias("_a"), F.col("status").alias("_as"), F.col("n_items").alias("_an"))
    b = lookup.select(F.col("key").alias("_b"), F.col("status").alias("_bs"), F.col("n_items").alias("_bn"))
    both = rows.join(a, F.col(id_key) == F.col("_a"), "left").join(b, F.col(search_key) == F.col("_b"), "left")
    use_a = (F.col("_as") == "ok") & (F.col("_an") > 0)
    pick = lambda x, y: F.when(use_a, F.col(x)).when(F.col("_b").isNotNull(), F.col(y)).otherwise(F.col(x))
    return both.select(rows["*"], pick("_a", "_b").alias("key"), F.coalesce(pick("_as", "_bs"), F.lit("not_checked")).alias("status"), F.coalesce(pick("_an", "_bn"), F.lit(0)).alias("n_items"))


def composite_join(sample: DataFrame, source: DataFrame, keys: list[str], prefilter: str) -> DataFrame:
    """Inner join on composite keys; the source is first reduced to the sample's ``prefilter``
    values, which prunes nested source rows before they are unnested."""
    wanted = sample.select(prefilter).distinct()
    return sample.join(source.join(wanted, prefilter, "left_semi"), keys)


def two_hop(rows: DataFrame, first: DataFrame, first_key: str, second: DataFrame, second_key: str) -> DataFrame:
    """rows -> first on first_key -> second on second_key, both left."""
    return rows.join(first, first_key, "left").join(second, second_key, "left")


def prefer_exact(candidates: DataFrame, id_col: str, exact: Column) -> DataFrame:
    """If any candidate of an id is exact, only the exact ones; else all.

    One aggregate of a flag and a join on the ids that have it, which AQE may split, rather than
    a window that sorts all candidates.
    """
    flagged = candidates.withColumn("_exact", F.coalesce(exact, F.lit(False)))
    some = flagged.filter("_exact").select(F.col(id_col).alias("_id")).distinct()
    kept = flagged.join(some, F.col(id_col) == F.col("_id"), "left").filter(F.col("_id").isNull() | F.col("_exact"))
    return kept.drop("_exact", "_id")


def positional_zip(rows: DataFrame, id_col: str, *arrays: str) -> DataFrame:
    """One row per place of equally long arrays: id, pos from 1, and an item of each."""
    zipped = F.arrays_zip(*arrays)
    each = rows.select(id_col, F.posexplode(zipped).alias("pos", "_z"))
    return each.select(id_col, (F.col("pos") + 1).alias("pos"), *(F.col("_z")[a].alias(a) for a in arrays))


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key of either side: in_a, in_b, and whether the values differ in both."""
    left = a.select(key, F.lit(True).alias("_a"), F.col(value).alias("value_a"))
    right = b.select(key, F.lit(True).alias("_b"), F.col(value).alias("value_b"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return left.join(right, key, "full_outer").select(
        key, flag("_a").alias("in_a"), flag("_b").alias("in_b"), "value_a", "value_b", flag(F.col("value_a") != F.col("value_b")).alias("differs")
    )


def route(rows: DataFrame, key: str = "key") -> DataFrame:
    """Splits request keys kind:value into kind and value; a key without a kind has a null one."""
    parts = F.split(key, ":", 2)
    return rows.withColumns({"kind": F.when(F.size(parts) == 2, parts[0]), "value": F.element_at(parts, -1)})
