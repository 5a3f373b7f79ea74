"""Exact deduplication: group by a 128-bit content hash, keep one id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.llm.columns import ascii_lower, id_and_text
from citeforge.llm.scratch import apart, dropped, written


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _judged(rows: DataFrame, keys: list[str], largest: bool) -> DataFrame:
    """Each row (doc_id, rid, ...) with its group's ``keep_id``, ``group_size``, and ``kept``.

    Two numbers a group, each a hash aggregate that combines in the tasks: the id that stays, then
    the place of the row that stays among those that repeat it. The group's verdict comes back
    by a join that AQE may split, so a group with a third of all rows is never in one task.
    """
    least = F.coalesce("doc_id", F.lit(-(1 << 63)))  # null ids come first
    rows = rows.withColumn("_i", least)
    ids = rows.groupBy(*keys).agg((F.max if largest else F.min)("_i").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    rows = rows.join(apart(ids), keys)
    place = rows.filter(F.col("_i") == F.col("keep")).groupBy(*keys).agg(F.min("rid").alias("stays"))
    return rows.join(apart(place), keys).withColumns({
        "keep_id": F.when(F.col("keep") != -(1 << 63), F.col("keep")), "kept": F.col("rid") == F.col("stays"),
    })


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    ignore_ascii_case: bool = False,
    hash128: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_tag
    (a 64-bit hash of the text as it is, to find the row again where ids are missing or repeated).

    Rows (id, hash) are grouped by ``hash128``. Then the bytes of groups of two or more are compared: of
    a hash, the distinct texts. A hash with several, which no one has seen of MD5 by chance, is split
    by text. The texts of other rows stay where they are as long as the list of shared hashes is small
    enough for Spark to broadcast it; beyond that they move once.

    Null text counts as empty, and empty texts are equal to each other. Null ids sort lowest.
    Rows that repeat an id and a text are told apart by their place in the input, so exactly
    one row of a group is kept. An empty table gives an empty result. Other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep}")
    norm = ascii_lower(F.col("text")) if ignore_ascii_case else F.col("text")
    rows = id_and_text(docs, id_col, text_col).withColumn("norm", norm)
    # ``rid`` tells repeated rows apart; it is fixed once the digests are written.
    digest = [F.sha2("norm", 256).alias("sha"), F.xxhash64("text").alias("tag"), F.monotonically_increasing_id().alias("rid")]
    digests = written(rows.select("doc_id", hash128(F.col("norm")).alias("h128"), *digest), "exact_digests")
    shared = written(digests.groupBy("h128").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h128"), "shared_hashes")
    hashed = rows.withColumn("h128", hash128(F.col("norm")))
    texts = hashed.join(shared, "h128", "left_semi").groupBy("h128", "norm").agg(F.lit(1).alias("one"))
    clashes = written(texts.groupBy("h128").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h128"), "hash_clashes")
    dropped(shared)

    judged = _judged(digests, ["h128"], keep == "max")
    columns = ["doc_id", "keep_id", "group_size", "kept", "sha", "tag"]
    if clashes.limit(1).count():
        # The few rows of these hashes, with their texts.
        several = written(hashed.join(clashes, "h128", "left_semi").select("doc_id", "norm", *digest), "clashing_texts")
        judged = judged.join(clashes, "h128", "left_anti").select(*columns).unionByName(_judged(several, ["norm"], keep == "max").select(*columns))
    return judged.select(*columns[:4], F.col("sha").alias("text_sha256"), F.col("tag").alias("text_tag"))
