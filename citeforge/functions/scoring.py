"""Scores of candidate works: weights and thresholds as conditions over columns.

Statuses are judged on unrounded parts; what is returned is rounded to four decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANK = {"strong": 2, "possible": 1, "no_match": 0}


def rank(status: Column) -> Column:
    return F.when(status == "strong", 2).when(status == "possible", 1).otherwise(0)


def confidence(parts: list[tuple[float, Column]]) -> Column:
    total = None
    for weight, part in parts:
        total = part * weight if total is None else total + part * weight
    return F.round(total, 4)


def _number(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


def bibliographic_score(cov: Column, sim: Column, authors: Column, year: Column, n: Column) -> Column:
    """struct(status, confidence) of title coverage, similarity, author coverage, year match and
    number of title tokens."""
    known = year | (authors >= 0.34)
    strong = ((sim >= 0.98) & known) | ((n >= 6) & (cov >= 0.88) & known) | ((n >= 8) & (cov >= 0.78) & (authors >= 0.34) & year)
    possible = ((n >= 6) & (cov >= 0.68) & known) | ((n >= 8) & (cov >= 0.58) & (authors >= 0.34))
    return F.struct(
        F.when(strong, "strong").when(possible, "possible").otherwise("no_match").alias("status"),
        confidence([(0.55, cov), (0.20, sim), (0.15, F.least(authors, F.lit(1.0))), (0.10, _number(year))]).alias("confidence"),
    )


def harvested_score(cov: Column, sim: Column, authors: Column, year: Column, n: Column) -> Column:
    """struct(status, confidence) for harvested repository records."""
    strong = ((n >= 5) & (cov >= 0.88) & (year | (authors >= 0.34))) | ((n >= 6) & (cov >= 0.78) & (authors >= 0.34) & year)
    possible = (n >= 6) & (cov >= 0.70) & (authors >= 0.34)
    return F.struct(
        F.when(strong, "strong").when(possible, "possible").otherwise("no_match").alias("status"),
        confidence([(0.56, cov), (0.22, sim), (0.14, authors), (0.08, _number(year))]).alias("confidence"),
    )


def index_score(sim: Column, cov: Column, year: Column, journal: Column, authors: Column, n: Column, own: Column) -> Column:
    """struct(status, confidence) for a title search; a work never matches its ``own`` reference."""
    support = (journal >= 0.55) | (authors >= 0.25)
    usable = ~own & (n >= 4)
    strong = ((sim >= 0.96) & year) | ((sim >= 0.92) & year & support) | ((cov >= 0.9) & (sim >= 0.86) & year & support)
    possible = ((sim >= 0.88) & year) | ((cov >= 0.82) & (sim >= 0.82) & year & support)
    return F.struct(
        F.when(usable & strong, "strong").when(usable & possible, "possible").otherwise("no_match").alias("status"),
        confidence([(0.52, sim), (0.22, cov), (0.14, _number(year)), (0.07, journal), (0.05, authors)]).alias("confidence"),
    )


def safe_cleanup(status: Column, n: Column, cov: Column, year: Column, authors: Column) -> Column:
    return status.isin("strong", "possible") & (n >= 6) & (cov >= 0.88) & year & (authors >= 0.34)


def safe_parsed(status: Column, n: Column, cov: Column, year: Column, authors: Column, sim: Column) -> Column:
    return status.isin("strong", "possible") & (n >= 6) & (cov >= 0.9) & year & ((authors >= 0.34) | (sim >= 0.97))


def isbn_status(cov: Column, any_item: Column) -> Column:
    return F.when(any_item & (cov >= 0.55), "strong").when(any_item, "possible").otherwise("no_match")


def citation_status(cov: Column, year: Column, has_metadata: Column) -> Column:
    return F.when(has_metadata & (cov >= 0.88) & year, "strong").when(has_metadata, "possible").otherwise("no_match")


def pair_supported(n: Column, sim: Column, cov: Column) -> Column:
    """Whether two titles support each other; ``n`` is the lesser number of tokens."""
    return (n >= 4) & ((sim >= 0.88) | (cov >= 0.86))


def supported_status(status: Column, supported: Column) -> Column:
    """A strong match whose title isn't that which was parsed is possible only."""
    return F.when((status == "strong") & ~F.coalesce(supported, F.lit(False)), "possible").otherwise(status)


def exact_record_status(status: Column, conf: Column, exact: Column) -> Column:
    """struct: a record with the very id that was asked for is strong where its score had none."""
    lift = exact & (status == "no_match")
    return F.struct(F.when(lift, "strong").otherwise(status).alias("status"), F.when(lift, F.greatest(conf, F.lit(0.95))).otherwise(conf).alias("confidence"))
