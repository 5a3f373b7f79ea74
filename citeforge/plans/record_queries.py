"""Queries over records as the sources answer them, built from works as JSON and parsed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.functions import payloads
from citeforge.plans import oracle as o
from citeforge.plans.registry import query
from citeforge.plans.views import refs, works

def _key() -> Column:
    return F.col("work_id")


def listed(array: Column) -> Column:
    return F.array_join(array, ";")


def _record(spark: SparkSession, sf_dir: str, json: Column, ddl: str) -> DataFrame:
    return works(spark, sf_dir).select("work_id", F.from_json(json, ddl).alias("r"))


def _object(**fields: Column) -> Column:
    """A JSON object; null fields are left out."""
    return F.to_json(F.struct(*(c.alias(n.replace("__", "-")) for n, c in fields.items())))


def _dated(year: Column) -> Column:
    return F.struct(F.array(F.array(year.cast("int"), F.lit(5))).alias("date-parts"))


def _at(remainder: int, of: int, value: Column) -> Column:
    return F.when(_key() % of == remainder, value)


def _name() -> Column:
    return F.concat(F.lit("van Author"), (_key() % 37).cast("string"))


def _padded() -> Column:
    return F.concat(F.lit(" "), F.col("title"), F.lit("  "))


@query(f"""{o.WITH_BOTH} SELECT work_id, doi, title, publisher, CASE work_id % 5 WHEN 0 THEN year WHEN 1 THEN year - 1 WHEN 2 THEN year + 1 WHEN 3 THEN year + 2 ELSE -1 END AS year,
  surname || CASE WHEN work_id % 2 = 0 THEN ';zeta' ELSE '' END AS surnames FROM works""")
def crossref_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year by precedence, first title, family names, the pruned record."""
    year = F.col("year")
    family = lambda n: F.struct(n.alias("family"), F.lit("A. B.").alias("given"))
    authors = F.array(family(_name()), family(F.lit(None).cast("string")), family(F.when(_key() % 2 == 0, "de Zéta").otherwise("Ö")))
    json = _object(
        DOI=F.concat(F.lit("https://doi.org/"), F.upper("doi"), F.lit(".")), title=F.array(_padded(), F.lit("alternative")), publisher=F.col("publisher"), abstract=F.lit("dropped"),
        issued=F.when(_key() % 5 == 0, _dated(year)).otherwise(_dated(F.lit(None))), published__print=_at(1, 5, _dated(year - 1)), published__online=_at(2, 5, _dated(year + 1)),
        published=F.when(_key() % 5 != 4, _dated(year + 2)), author=authors,
    )
    r = payloads.compact_crossref(F.col("r"))
    return _record(spark, sf_dir, json, payloads.CROSSREF).select("work_id", r.alias("c")).select("work_id", "c.doi", "c.title", "c.publisher", F.coalesce(F.col("c.year").cast("long"), F.lit(-1)).alias("year"), listed(F.col("c.surnames")).alias("surnames"))


@query(f"""{o.WITH_BOTH} SELECT work_id, 'W' || work_id AS id, doi, CASE WHEN work_id % 3 = 0 THEN 'display ' || title ELSE title END AS title, CASE WHEN work_id % 4 <> 0 THEN year ELSE -1 END AS year,
  CASE WHEN work_id % 2 = 0 THEN journal ELSE '' END AS source_title, CASE WHEN work_id % 2 = 0 THEN 'Raw van Author' || work_id % 37 ELSE 'Display Person' END || ';Second Person' AS authors,
  CASE WHEN work_id % 2 = 0 THEN surname ELSE 'person' END || ';person' AS surnames FROM works""")
def works_index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, years and names of an open index."""
    person = lambda raw, shown: F.struct(raw.alias("raw_author_name"), F.struct(shown.alias("display_name")).alias("author"))
    people = F.array(person(F.when(_key() % 2 == 0, F.concat(F.lit(" Raw "), _name())).otherwise("  "), F.lit("Display Person")), person(F.lit(None).cast("string"), F.lit("Second Person")), person(F.lit(""), F.lit(None).cast("string")))
    json = _object(
        id=F.concat(F.lit("W"), _key().cast("string")), doi=F.concat(F.lit("https://doi.org/"), "doi"), title=F.when(_key() % 3 != 0, _padded()).otherwise(""), display_name=F.concat(F.lit("display "), "title"),
        publication_year=F.when(_key() % 4 != 0, F.col("year").cast("int")), primary_location=_at(0, 2, F.struct(F.struct(F.col("journal").alias("display_name")).alias("source"))), authorships=people, concepts=F.lit("dropped"),
    )
    c = _record(spark, sf_dir, json, payloads.OPENALEX).select("work_id", payloads.compact_openalex(F.col("r")).alias("c"))
    return c.select("work_id", "c.id", "c.doi", "c.title", F.coalesce(F.col("c.year").cast("long"), F.lit(-1)).alias("year"), "c.source_title", listed(F.col("c.authors")).alias("authors"), listed(F.col("c.surnames")).alias("surnames"))


@query(f"""{o.WITH_BOTH} SELECT work_id, doi, title, publisher, CASE WHEN work_id % 3 <> 2 THEN year ELSE -1 END AS year, CASE WHEN work_id % 2 = 0 THEN 'Text' ELSE 'report' END AS resource_type,
  CASE WHEN work_id % 2 = 0 THEN 'Doe, Jane' ELSE 'Jane van Author' || work_id % 37 END || ';Solo Name' AS authors, CASE WHEN work_id % 2 = 0 THEN 'doe' ELSE surname END || ';name' AS surnames, work_id % 5 AS search_rank FROM works""")
def datacite_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First title, year as number or digits, creators."""
    text = lambda v: F.lit(v).cast("string")
    creator = lambda name, given, family: F.struct(name.alias("name"), given.alias("givenName"), family.alias("familyName"))
    creators = F.array(F.when(_key() % 2 == 0, creator(F.lit("Doe, Jane"), text(None), text(None))).otherwise(creator(F.lit(" "), F.lit("Jane"), _name())), creator(F.lit("Solo Name"), text(None), F.lit(" ")), creator(text(None), text(None), text(None)))
    year = F.col("year").cast("string")
    attributes = F.struct(
        F.upper("doi").alias("doi"), F.col("publisher").alias("publisher"), F.when(_key() % 3 == 2, F.concat(F.lit("c"), year)).otherwise(year).alias("publicationYear"),
        F.array(F.struct(text(None).alias("title")), F.struct(_padded().alias("title"))).alias("titles"),
        F.struct(F.when(_key() % 2 == 0, "Text").alias("resourceTypeGeneral"), F.lit("report").alias("resourceType")).alias("types"), creators.alias("creators"),
    )
    rows = works(spark, sf_dir).select("work_id", F.from_json(_object(id=F.lit("x"), attributes=attributes), payloads.DATACITE).alias("r"))
    c = rows.select("work_id", payloads.compact_datacite(F.col("r"), _key() % 5).alias("c"))
    return c.select("work_id", "c.doi", "c.title", "c.publisher", F.coalesce(F.col("c.year").cast("long"), F.lit(-1)).alias("year"), "c.resource_type", listed(F.col("c.authors")).alias("authors"), listed(F.col("c.surnames")).alias("surnames"), "c.search_rank")


@query(f"""{o.WITH_BOTH} SELECT work_id, CASE WHEN work_id % 3 = 0 THEN title ELSE 'plain ' || title END AS title, CASE WHEN work_id % 2 = 0 THEN CAST(year AS VARCHAR) ELSE '1990' END AS year, journal, 'J' || work_id % 25 AS journal_code, doi, 'PAPER' AS doc_type,
  CASE WHEN work_id % 2 = 0 THEN surname ELSE 'veli' END || ';darc' AS surnames, CASE WHEN work_id % 2 = 0 THEN 'doe;' || surname ELSE surname END AS creators FROM works""")
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a national index, and creators of harvested ones."""
    author = lambda printed, name: F.struct(printed.alias("inPublicationName"), F.lit(name).alias("name"))
    json = _object(
        id=_key(), orderTitle=F.when(_key() % 3 == 0, _padded()).otherwise(""), title=F.concat(F.lit("plain  "), "title"), publicationYear=_at(0, 2, F.col("year")), issue=F.struct(F.lit(1990).alias("year")), publicationType=F.lit("PAPER"),
        journal=F.struct(F.concat(F.lit("J"), (_key() % 25).cast("string")).alias("id"), F.col("journal").alias("name")), doi=F.col("doi"), authors=F.array(author(F.when(_key() % 2 == 0, _name()).otherwise(""), "Ali Veli"), author(F.lit("Jo D’Arc"), "x")),
    )
    rows = works(spark, sf_dir).select("work_id", F.from_json(json, payloads.INDEX).alias("r"), F.array_compact(F.array(_at(0, 2, F.lit("Doe, Jane")), _name(), F.lit(","))).alias("creators"))
    c = rows.select("work_id", payloads.compact_index(F.col("r")).alias("c"), payloads.harvested_surnames(F.col("creators")).alias("h"))
    return c.select("work_id", "c.title", "c.year", "c.journal", "c.journal_code", "c.doi", "c.doc_type", listed(F.col("c.surnames")).alias("surnames"), listed(F.col("h")).alias("creators"))


_HEAD = "CASE WHEN length({q}) <= {n} THEN {q} ELSE trim(coalesce(nullif(regexp_extract(substr({q}, 1, {n}), '^(.*) ', 1), ''), substr({q}, 1, {n}))) END"


@query(f"""{o.WITH_BOTH}, q AS (SELECT work_id, title || CASE WHEN work_id % 2 = 0 THEN ' ' || surname ELSE '' END || ' ' || year || ' ' || journal AS a, title || ' ' || year || CASE WHEN work_id % 2 = 0 THEN ' ' || surname ELSE '' END || ' ' || journal AS b,
  array_to_string((string_split({o.fold("title")}, ' '))[1:5], ' ') AS safe FROM works) SELECT work_id, a AS crossref, b AS openalex, {_HEAD.format(q="a", n=60)} AS crossref_cut, {_HEAD.format(q="b", n=7)} AS openalex_cut, safe FROM q""")
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries for two services, cut at a word, and a query of plain tokens."""
    parts = (F.col("title"), F.when(_key() % 2 == 0, F.array("surname")).otherwise(F.array().cast("array<string>")), F.col("year").cast("string"), F.col("journal"))
    return works(spark, sf_dir).select(
        "work_id", payloads.crossref_query(*parts).alias("crossref"), payloads.openalex_query(*parts).alias("openalex"),
        payloads.crossref_query(*parts, most=60).alias("crossref_cut"), payloads.openalex_query(*parts, most=7).alias("openalex_cut"), payloads.safe_query(F.col("title"), 5).alias("safe"),
    )


_STATUS = "CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'error' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'not_found' ELSE 'ok' END"


@query(f"""{o.WITH_REFS}, a AS (SELECT sample_index, k, part, {_STATUS} AS s, CASE WHEN k % 7 = 4 THEN 0 ELSE 2 END AS n, CASE WHEN k % 3 = 0 THEN '' ELSE 'query ' || part END AS query, CASE WHEN k % 5 = 0 THEN '10.5555/part.' || part END AS doi FROM refs),
  b AS (SELECT *, CASE WHEN query = '' AND coalesce(doi, '') = '' THEN 'unqueryable' WHEN s IS NULL THEN 'not_checked' WHEN s = 'error' THEN 'search_error' WHEN s = 'rate_limited' THEN s WHEN s = 'not_found' OR n = 0 THEN 'no_match' ELSE 'candidates' END AS status FROM a)
  SELECT CAST(sample_index AS VARCHAR) AS sample_index, CASE WHEN coalesce(doi, '') <> '' THEN 'doi:' || doi WHEN query <> '' THEN 'search:' || query ELSE '' END AS request_key, query, status, coalesce(doi, '') AS doi, '' AS title, '' AS publisher, CASE WHEN status = 'candidates' THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, 0.0::DOUBLE AS title_coverage FROM b""")
def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers looked up and mapped to outcomes, in wide rows with defaults."""
    k = F.col("k")
    r = refs(spark, sf_dir).select(
        "sample_index", F.when(k % 7 == 0, None).when(k % 7 == 1, "error").when(k % 7 == 2, "rate_limited").when(k % 7 == 3, "not_found").otherwise("ok").alias("s"), F.when(k % 7 == 4, 0).otherwise(2).alias("n"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("query "), F.col("part").cast("string"))).alias("query"), F.when(k % 5 == 0, F.concat(F.lit("10.5555/part."), F.col("part").cast("string"))).alias("doi"),
    )
    r = r.withColumn("status", payloads.outcome(F.col("s"), F.col("n"), F.col("query"), F.col("doi")))
    key = F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("doi:"), "doi")).when(F.col("query") != "", F.concat(F.lit("search:"), "query"))
    fields = {"sample_index": F.col("sample_index"), "request_key": key, "query": F.col("query"), "status": F.col("status"), "doi": F.col("doi"), "confidence": F.when(F.col("status") == "candidates", 0.5)}
    return r.select(payloads.output_row(fields, ("sample_index", "request_key", "query", "status", "doi", "title", "publisher"), ("confidence", "title_coverage")))
