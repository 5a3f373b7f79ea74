"""Summaries of single runs, each with the counts that its kind of run reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.operators import ranking, summary
from citeforge.plans import oracle as o
from citeforge.plans.registry import query
from citeforge.plans.views import refs, table
from citeforge.sources import sinks

_S = "CASE k % 8 WHEN 0 THEN 'strong' WHEN 1 THEN 'strong' WHEN 2 THEN 'possible' WHEN 3 THEN 'search_error' ELSE 'no_match' END"
_n = lambda cond: f"count(*) FILTER ({cond})"


def _k(divisor: int) -> Column:
    return F.col("k") % divisor


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = refs(spark, sf_dir).select("sample_index", "k", "part")
    return r.withColumn("status", F.when(_k(8) <= 1, "strong").when(_k(8) == 2, "possible").when(_k(8) == 3, "search_error").otherwise("no_match"))


_FALLBACK = f"""{o.WITH_REFS}, a AS (SELECT scope, count(*) AS target, {_n("s = 'strong'")} AS strong, {_n("s = 'possible'")} AS possible, {_n("s = 'no_match'")} AS no_match, {_n("s = 'search_error'")} AS search_error
  FROM (SELECT CASE WHEN k % 3 = 0 THEN 'no_doi' ELSE 'not_found' END AS scope, {_S} AS s FROM refs) GROUP BY scope)
  SELECT *, 700 + strong AS strict_found, 700 + strong + possible AS broad_found, {o.percent("700 + strong", "60000")} AS strict_rate, {o.percent("700 + strong + possible", "60000")} AS broad_rate,
  CASE WHEN scope <> 'no_doi' THEN {o.percent("700 + strong", "50000")} END AS strict_rate_doi, CASE WHEN scope <> 'no_doi' THEN {o.percent("700 + strong + possible", "50000")} END AS broad_rate_doi,
  scope <> 'no_doi' AS doi_rate_applies, {o.percent("strong", "target")} AS recovery_strong, {o.percent("strong + possible", "target")} AS recovery_broad FROM a"""


@query(_FALLBACK)
def fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fallback adds, strict and broad; no rate over DOIs for references without one."""
    scope = F.when(_k(3) == 0, "no_doi").otherwise("not_found").alias("scope")
    return summary.fallback_summary(_status(spark, sf_dir).select("status", scope), base=700, sampled=60_000, with_doi=50_000)


#: The report of a fallback: fixed lines and what stands in them.
_REPORT = (
    "# Crossref Bibliographic Fallback Stats", "", "- Scope: {scope}", "- Checked fallback references: {target}", "- Strong bibliographic matches: {strong}", "- Possible bibliographic matches: {possible}",
    "- No match: {no_match}", "- Search errors: {search_error}", "", "## Updated Stats", "", "- Strict found after fallback: {strict_found} ({strict_rate}% of all refs)", "- Broad found after fallback: {broad_found} ({broad_rate}% of all refs)",
)
_REPORT_DOI = ("- Strict found rate among DOI refs: {strict_rate_doi}%", "- Broad found rate among DOI refs: {broad_rate_doi}%")
_REPORT_END = ("- Fallback recovery, strong only: {recovery_strong}%", "- Fallback recovery, strong + possible: {recovery_broad}%", "", "`strong` is the safer count. `possible` should be manually reviewed before treating it as ground truth.")


def _report_sql() -> str:
    def line(text: str) -> str:
        parts = re.split(r"\{(\w+)\}", text)
        return " || ".join(f"CAST({p} AS VARCHAR)" if i % 2 else o.q(p) for i, p in enumerate(parts))

    both = lambda lines: " || chr(10) || ".join(line(x) for x in lines)
    return f"WITH s AS ({_FALLBACK}) SELECT scope, {both(_REPORT)} || chr(10) || CASE WHEN doi_rate_applies THEN {both(_REPORT_DOI)} || chr(10) ELSE '' END || {both(_REPORT_END)} || chr(10) AS report FROM s"


@query(_report_sql())
def fallback_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fallback's report with its own sections, one for each scope; rates over DOIs only where they apply."""
    lines = [*_REPORT, *((x, F.col("doi_rate_applies")) for x in _REPORT_DOI), *_REPORT_END]
    return fallback_summary(spark, sf_dir).select("scope", sinks.report(lines).alias("report"))


@query(f"""{o.WITH_REFS}, a AS (SELECT count(*) AS sampled, {_n("k % 6 = 1")} AS found, {_n("k % 5 <> 0")} AS with_doi, {_n("k % 5 <> 0 AND k % 6 = 1")} AS found_with_doi, {_n("k % 5 = 0 AND k % 6 = 1")} AS found_without_doi FROM refs)
  SELECT *, sampled - with_doi AS without_doi, {o.percent("found", "sampled")} AS found_rate, {o.percent("found_without_doi", "sampled - with_doi")} AS found_rate_without_doi FROM a""")
def form_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matching form's answers, with a DOI of their own and without."""
    doi = F.when(_k(5) != 0, F.lit("10.1/x"))
    return summary.form_summary(refs(spark, sf_dir).select(doi.alias("doi"), (_k(6) == 1).alias("found")))


@query(f"""{o.WITH_REFS}, a AS (SELECT count(*) AS target, {_n("m IN ('get_record', 'list_records')")} AS queryable, {_n("m = 'get_record'")} AS get_record, {_n("m = 'list_records'")} AS list_records, {_n("m = 'file_url_only'")} AS file_url_only, {_n("m = 'no_oai_filter'")} AS no_oai_filter,
  {_n("s = 'strong'")} AS strong, {_n("s = 'possible'")} AS possible, {_n("s = 'no_match'")} AS no_match, {_n("s = 'search_error'")} AS search_error FROM (SELECT CASE part % 5 WHEN 0 THEN 'get_record' WHEN 1 THEN 'list_records' WHEN 2 THEN 'file_url_only' ELSE 'no_oai_filter' END AS m, {_S} AS s FROM refs))
  SELECT *, 500 + strong AS strict_found, 500 + strong + possible AS broad_found, {o.percent("500 + strong", "50000")} AS strict_rate, {o.percent("500 + strong + possible", "50000")} AS broad_rate, search_error = 0 AS complete FROM a""")
def repository_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository run by how it could ask, and what it found."""
    p = F.col("part") % 5
    mode = F.when(p == 0, "get_record").when(p == 1, "list_records").when(p == 2, "file_url_only").otherwise("no_oai_filter")
    return summary.repository_summary(_status(spark, sf_dir).select("status", mode.alias("query_mode")), base=500, sampled=50_000)


_T = "CASE k % 6 WHEN 0 THEN 'strong_doi_crossref' WHEN 1 THEN 'strong_doi_not_crossref_verified' WHEN 2 THEN 'strong_trdizin_id' WHEN 3 THEN 'not_found' WHEN 4 THEN 'error' ELSE 'rate_limited' END"


@query(f"""{o.WITH_REFS}, a AS (SELECT count(*) AS target, {_n("s IN ('strong_doi_crossref', 'strong_doi_not_crossref_verified', 'strong_trdizin_id')")} AS strong, {_n("s = 'strong_doi_crossref'")} AS doi_verified, {_n("s = 'strong_doi_not_crossref_verified'")} AS doi_unverified,
  {_n("s = 'strong_trdizin_id'")} AS id_only, {_n("s IN ('error', 'rate_limited')")} AS errors, {_n("s = 'not_found'")} AS not_found, {_n("k % 2 = 0")} AS with_doi FROM (SELECT k, {_T} AS s FROM refs))
  SELECT *, 300 + strong AS found, {o.percent("300 + strong", "50000")} AS found_rate, {o.percent("strong", "50000")} AS new_rate FROM a""")
def target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that references name as their target, by what they led to."""
    k = _k(6)
    status = F.when(k == 0, summary.ACCEPTED[0]).when(k == 1, summary.ACCEPTED[1]).when(k == 2, summary.ACCEPTED[2]).when(k == 3, "not_found").when(k == 4, "error").otherwise("rate_limited")
    return summary.target_summary(refs(spark, sf_dir).select(status.alias("status"), F.when(_k(2) == 0, F.lit("10.1/x")).alias("doi")), base=300, sampled=50_000)


@query(f"""{o.WITH_REFS}, a AS (SELECT e AS resolver, count(*) AS target, {_n("s = 'strong'")} AS strong, {_n("s = 'possible'")} AS possible, {_n("s NOT IN ('strong', 'possible')")} AS unmatched FROM (SELECT 'stage' || k % 4 AS e, {_S} AS s FROM refs) GROUP BY e)
  SELECT *, {o.percent("strong", "target")} AS strong_rate, {o.percent("strong", "60000")} AS new_rate FROM a""")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later stages in one table, a row each."""
    stage = F.concat(F.lit("stage"), (_k(4)).cast("string"))
    return summary.stage_summary(_status(spark, sf_dir).select("status", stage.alias("resolver")), sampled=60_000)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY ((o_orderkey * 2654435761 + CAST(7 AS BIGINT) * 40503) % 4294967296 * 69069 + 1) % 4294967296, o_orderkey) AS place FROM orders")
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in an order that a seed fixes."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey").withColumn("h", ranking.sample_hash(F.col("o_orderkey"), 7))
    return ranking.numbered(rows, ["h", "o_orderkey"], "place").select("o_orderkey", "place")
