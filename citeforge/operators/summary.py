"""Counts, rates, histograms and denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.functions import fixed
from citeforge.functions.text import percent


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def identifier_summary(rows: DataFrame) -> DataFrame:
    """Of columns doi, status: totals, found, not found, errors, distinct DOIs, and rates."""
    has = F.col("doi").isNotNull()
    one = rows.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(has).alias("with_doi"),
        count_where(F.col("status") == "found").alias("found"),
        count_where(F.col("status") == "not_found").alias("not_found"),
        count_where(F.col("status") == "error").alias("errors"),
        F.count_distinct("doi").alias("distinct_dois"),
        F.count_distinct(F.when(F.col("status") == "found", F.col("doi"))).alias("distinct_found"),
    )
    return one.withColumns({
        "without_doi": F.col("total") - F.col("with_doi"),
        "doi_rate": percent(F.col("with_doi"), F.col("total")),
        "found_rate_all": percent(F.col("found"), F.col("total")),
        "found_rate_doi": percent(F.col("found"), F.col("with_doi")),
        "not_found_rate_doi": percent(F.col("not_found"), F.col("with_doi")),
        "error_rate_doi": percent(F.col("errors"), F.col("with_doi")),
    })


def match_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of a column status: strong, possible, none, errors, unchecked; recovery over the checked
    and over all targets; whether the run is complete."""
    is_ = lambda *s: count_where(F.col("status").isin(*s))
    one = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("target"), is_("strong").alias("strong"), is_("possible").alias("possible"), is_("no_match").alias("no_match"),
        is_("search_error").alias("search_error"), is_("not_checked").alias("not_checked"),
    )
    checked = F.col("target") - F.col("not_checked")
    return one.withColumns({
        "checked": checked,
        "recovery_checked": percent(F.col("strong"), checked),
        "recovery_target": percent(F.col("strong"), F.col("target")),
        "complete": F.col("not_checked") == 0,
    })


def histogram(rows: DataFrame, column: str = "category", order: tuple[str, ...] = fixed.CATEGORY_ORDER, total: Column | None = None) -> DataFrame:
    """A row for each value of ``order``, zero where there is none, with its share of the rows and,
    given ``total`` (a constant), of that."""
    counts = rows.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    values = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(order)], "place int, category string")
    filled = values.join(counts, "category", "left").fillna(0, ["n"])
    whole = rows.agg(F.count(F.lit(1))).scalar()
    shares = {"share": percent(F.col("n"), whole)} | ({"share_of_total": percent(F.col("n"), total)} if total is not None else {})
    return filled.withColumns(shares)


def flag_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """(flag, n): how many rows set each flag, in one pass."""
    one = rows.agg(*(count_where(F.col(n)).alias(n) for n in names))
    return one.unpivot([], names, "flag", "n")


def eligible_denominator(remaining_rows: DataFrame, total: int, unlikely: tuple[str, ...] = fixed.DOI_UNLIKELY) -> DataFrame:
    """Found and rate over all references, and over those that may have a DOI at all."""
    one = remaining_rows.agg(F.count(F.lit(1)).alias("remaining"), count_where(F.col("category").isin(*unlikely)).alias("doi_unlikely"))
    found = F.lit(total) - F.col("remaining")
    eligible = F.lit(total) - F.col("doi_unlikely")
    return one.withColumns({
        "total": F.lit(total).cast("long"), "found": found.cast("long"), "eligible": eligible.cast("long"),
        "rate": percent(found, F.lit(total)), "eligible_rate": percent(found, eligible),
    })


def grouped_counts(rows: DataFrame, *keys: str, unknown: str = "unknown") -> DataFrame:
    return rows.groupBy(*(F.coalesce(F.col(k), F.lit(unknown)).alias(k) for k in keys)).agg(F.count(F.lit(1)).alias("n"))


def last_filled(rows: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """The last value that isn't null, in the given order."""
    return rows.groupBy(*by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


#: Statuses of a looked-up target that count as resolved.
ACCEPTED = ("strong_doi_crossref", "strong_doi_not_crossref_verified", "strong_trdizin_id")


def _is(*statuses: str) -> Column:
    return count_where(F.col("status").isin(*statuses))


def fallback_summary(rows: DataFrame, base: int, sampled: int, with_doi: int) -> DataFrame:
    """Of columns status, scope: for each scope the outcomes, and what is found with the ``base`` found
    before, strictly and with possible matches, of all ``sampled`` and of those ``with_doi``. The last
    rates are null for the scope ``no_doi``."""
    one = rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("target"), _is("strong").alias("strong"), _is("possible").alias("possible"), _is("no_match").alias("no_match"), _is("search_error").alias("search_error")
    )
    strict, broad = F.lit(base) + F.col("strong"), F.lit(base) + F.col("strong") + F.col("possible")
    applies = F.col("scope") != "no_doi"
    return one.withColumns({
        "strict_found": strict, "broad_found": broad, "strict_rate": percent(strict, F.lit(sampled)), "broad_rate": percent(broad, F.lit(sampled)),
        "strict_rate_doi": F.when(applies, percent(strict, F.lit(with_doi))), "broad_rate_doi": F.when(applies, percent(broad, F.lit(with_doi))), "doi_rate_applies": applies,
        "recovery_strong": percent(F.col("strong"), F.col("target")), "recovery_broad": percent(F.col("strong") + F.col("possible"), F.col("target")),
    })


def form_summary(rows: DataFrame) -> DataFrame:
    """Of columns doi, found: how many answers there are among references with a DOI and without."""
    has, found = F.coalesce("doi", F.lit("")) != "", F.col("found")
    one = rows.agg(
        F.count(F.lit(1)).alias("sampled"), count_where(found).alias("found"), count_where(has).alias("with_doi"), count_where(has & found).alias("found_with_doi"), count_where(~has & found).alias("found_without_doi")
    )
    without = F.col("sampled") - F.col("with_doi")
    return one.withColumns({"without_doi": without, "found_rate": percent(F.col("found"), F.col("sampled")), "found_rate_without_doi": percent(F.col("found_without_doi"), without)})


def repository_summary(rows: DataFrame, base: int, sampled: int) -> DataFrame:
    """Of columns query_mode, status: targets by mode, outcomes, cumulative totals and rates."""
    mode = lambda *m: count_where(F.col("query_mode").isin(*m))
    one = rows.agg(
        F.count(F.lit(1)).alias("target"), mode("get_record", "list_records").alias("queryable"), *(mode(m).alias(m) for m in ("get_record", "list_records", "file_url_only", "no_oai_filter")),
        *(_is(s).alias(s) for s in ("strong", "possible", "no_match", "search_error")),
    )
    strict, broad = F.lit(base) + F.col("strong"), F.lit(base) + F.col("strong") + F.col("possible")
    return one.withColumns({"strict_found": strict, "broad_found": broad, "strict_rate": percent(strict, F.lit(sampled)), "broad_rate": percent(broad, F.lit(sampled)), "complete": F.col("search_error") == 0})


def target_summary(rows: DataFrame, base: int, sampled: int) -> DataFrame:
    """Of columns status, doi of looked-up targets: resolved ones by kind, failures, and totals."""
    one = rows.agg(
        F.count(F.lit(1)).alias("target"), _is(*ACCEPTED).alias("strong"), _is(ACCEPTED[0]).alias("doi_verified"), _is(ACCEPTED[1]).alias("doi_unverified"), _is(ACCEPTED[2]).alias("id_only"),
        _is("error", "rate_limited").alias("errors"), _is("not_found").alias("not_found"), count_where(F.coalesce("doi", F.lit("")) != "").alias("with_doi"),
    )
    found = F.lit(base) + F.col("strong")
    return one.withColumns({"found": found, "found_rate": percent(found, F.lit(sampled)), "new_rate": percent(F.col("strong"), F.lit(sampled))})


def stage_summary(rows: DataFrame, sampled: int) -> DataFrame:
    """Of columns resolver, status: a row for each stage."""
    one = rows.groupBy("resolver").agg(F.count(F.lit(1)).alias("target"), _is("strong").alias("strong"), _is("possible").alias("possible"), count_where(~F.col("status").isin("strong", "possible")).alias("unmatched"))
    return one.withColumns({"strong_rate": percent(F.col("strong"), F.col("target")), "new_rate": percent(F.col("strong"), F.lit(sampled))})
