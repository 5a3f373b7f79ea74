"""Fields of records as the sources answer them: years, titles, names, and the pruned record.

A payload is a struct of the source's schema (``CROSSREF``, ``OPENALEX``, ``DATACITE``, ``INDEX``),
for instance from ``from_json``, which leaves out every field that isn't named there. Missing and
ill-typed fields are null in it, and count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeforge.functions import fixed
from citeforge.functions.identifiers import normalize_doi_works
from citeforge.functions.text import let, normalize_joined, normalize_text, squeeze, tokens

_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = (
    f"DOI string, title array<string>, publisher string, score double, author array<struct<family:string,given:string>>, "
    f"issued {_DATE}, `published-print` {_DATE}, `published-online` {_DATE}, published {_DATE}"
)
OPENALEX = (
    "id string, doi string, title string, display_name string, publication_year int, type string, relevance_score double, "
    "primary_location struct<source:struct<display_name:string>>, authorships array<struct<raw_author_name:string,author:struct<display_name:string>>>"
)
DATACITE = (
    "id string, attributes struct<doi:string,publisher:string,publicationYear:string,url:string,titles:array<struct<title:string>>,"
    "types:struct<resourceTypeGeneral:string,resourceType:string>,creators:array<struct<name:string,givenName:string,familyName:string>>>"
)
INDEX = (
    "id string, orderTitle string, title string, publicationYear string, doi string, docType string, publicationType string, issue struct<year:string>, "
    "journal struct<id:string,name:string,issn:string,eissn:string>, authors array<struct<inPublicationName:string,name:string>>"
)


def _filled(*values: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def _list(array: Column) -> Column:
    return F.coalesce(array, F.array())


def _last_tokens(names: Column, normal=normalize_text, stop: tuple[str, ...] = fixed.STOP_BASE) -> Column:
    """The last token of each name that has any."""
    return F.array_compact(F.transform(names, lambda n: F.try_element_at(tokens(normal(n), stop), F.lit(-1))))


def _before_comma(name: Column) -> Column:
    return F.element_at(F.split(name, ",", 2), 1)


# --- years -----------------------------------------------------------------------------------------


def issued_year(work: Column) -> Column:
    """The year issued, else printed, else online, else published: of the first with a first date part."""
    part = lambda f: F.get(F.get(work[f]["date-parts"], F.lit(0)), F.lit(0))
    return F.coalesce(*(part(f) for f in ("issued", "published-print", "published-online", "published")))


def publication_year(attributes: Column) -> Column:
    """A whole number or a string of digits; else null."""
    year = attributes["publicationYear"]
    return F.when(year.rlike("^[0-9]+$"), year.try_cast("int"))


def index_year(source: Column) -> Column:
    return _filled(source["publicationYear"], source["issue"]["year"])


# --- titles ----------------------------------------------------------------------------------------


def first_text(values: Column) -> Column:
    """The first of a list, with single spaces; null of none."""
    return squeeze(F.get(values, F.lit(0)))


def openalex_title(work: Column) -> Column:
    return _filled(squeeze(work["title"]), squeeze(work["display_name"]))


def first_title(attributes: Column) -> Column:
    """The first title that is there, with single spaces, else ''."""
    there = F.filter(attributes["titles"], lambda t: t["title"].isNotNull())
    return F.coalesce(squeeze(F.get(there, F.lit(0))["title"]), F.lit(""))


def index_title(source: Column) -> Column:
    return _filled(squeeze(source["orderTitle"]), squeeze(source["title"]))


# --- names -----------------------------------------------------------------------------------------


def crossref_surnames(work: Column) -> Column:
    """Of each author the last token of the family name."""
    return _last_tokens(F.transform(_list(work["author"]), lambda a: F.coalesce(a["family"], F.lit(""))))


def _openalex_name(a: Column) -> Column:
    raw = a["raw_author_name"]
    return F.when(F.trim(raw) != "", raw).otherwise(F.coalesce(a["author"]["display_name"], F.lit("")))


def openalex_surnames(work: Column) -> Column:
    """Of each author the last token of the name as printed, else of the display name."""
    return _last_tokens(F.transform(_list(work["authorships"]), _openalex_name), stop=fixed.STOP_WORKS)


def openalex_authors(work: Column, most: int = 8) -> Column:
    """Names of the first authors, trimmed; those without any are passed over."""
    names = F.transform(F.slice(_list(work["authorships"]), 1, most), lambda a: F.when(F.trim(a["raw_author_name"]) != "", F.trim(a["raw_author_name"])).otherwise(F.trim(a["author"]["display_name"])))
    return F.array_compact(names)


def creator_names(attributes: Column) -> Column:
    """Names of creators: as given, else given and family name."""
    pieces = lambda c: F.concat_ws(" ", F.when(F.trim(c["givenName"]) != "", c["givenName"]), F.when(F.trim(c["familyName"]) != "", c["familyName"]))
    names = F.transform(_list(attributes["creators"]), lambda c: F.when(F.trim(c["name"]) != "", F.trim(c["name"])).otherwise(pieces(c)))
    return F.filter(names, lambda n: n != "")


def creator_surnames(attributes: Column) -> Column:
    """The last token of the family name; without one, of the name up to a comma."""
    return _last_tokens(F.transform(_list(attributes["creators"]), lambda c: F.when(F.trim(c["familyName"]) != "", c["familyName"]).otherwise(_before_comma(F.coalesce(c["name"], F.lit(""))))))


def harvested_surnames(creators: Column) -> Column:
    """Of each creator the last token of the name up to a comma."""
    return _last_tokens(F.transform(_list(creators), _before_comma))


def index_surnames(source: Column) -> Column:
    """The last token of the name in the publication, else of the name."""
    names = F.transform(_list(source["authors"]), lambda a: _filled(a["inPublicationName"], a["name"]))
    return _last_tokens(names, normalize_joined, fixed.STOP_INDEX)


# --- pruned records --------------------------------------------------------------------------------


def compact_crossref(work: Column) -> Column:
    """struct(doi, title, publisher, year, score, surnames)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        normalize_doi_works(work["DOI"]).alias("doi"), text(first_text(work["title"])).alias("title"), text(work["publisher"]).alias("publisher"),
        issued_year(work).alias("year"), work["score"].alias("score"), crossref_surnames(work).alias("surnames"),
    )


def compact_openalex(work: Column) -> Column:
    """struct(id, doi, title, year, source_title, type, authors, surnames, score)."""
    return F.struct(
        _filled(work["id"]).alias("id"), normalize_doi_works(work["doi"]).alias("doi"), openalex_title(work).alias("title"), work["publication_year"].alias("year"),
        F.coalesce(work["primary_location"]["source"]["display_name"], F.lit("")).alias("source_title"), _filled(work["type"]).alias("type"),
        openalex_authors(work).alias("authors"), openalex_surnames(work).alias("surnames"), work["relevance_score"].alias("score"),
    )


def compact_datacite(record: Column, rank: Column) -> Column:
    """struct(id, doi, title, publisher, year, resource_type, url, authors, surnames, search_rank)."""
    a = record["attributes"]
    return F.struct(
        _filled(record["id"], a["doi"]).alias("id"), normalize_doi_works(_filled(a["doi"], record["id"])).alias("doi"), first_title(a).alias("title"), _filled(a["publisher"]).alias("publisher"),
        publication_year(a).alias("year"), _filled(a["types"]["resourceTypeGeneral"], a["types"]["resourceType"]).alias("resource_type"), _filled(a["url"]).alias("url"),
        creator_names(a).alias("authors"), creator_surnames(a).alias("surnames"), rank.alias("search_rank"),
    )


def compact_index(source: Column) -> Column:
    """struct(id, title, year, journal, journal_code, issn, eissn, doi, doc_type, surnames)."""
    j = source["journal"]
    return F.struct(
        _filled(source["id"]).alias("id"), index_title(source).alias("title"), index_year(source).alias("year"), _filled(j["name"]).alias("journal"), _filled(j["id"]).alias("journal_code"),
        _filled(j["issn"]).alias("issn"), _filled(j["eissn"]).alias("eissn"), normalize_doi_works(source["doi"]).alias("doi"), _filled(source["docType"], source["publicationType"]).alias("doc_type"),
        index_surnames(source).alias("surnames"),
    )


# --- queries ---------------------------------------------------------------------------------------


def _query(pieces: tuple[Column, ...], most: int) -> Column:
    """Filled pieces in order, single spaces, cut back to a whole word."""
    joined = squeeze(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in pieces)))
    head = lambda q: F.substring(q, 1, most)
    cut = lambda q: F.when(F.length(q) <= most, q).otherwise(F.trim(F.coalesce(F.nullif(F.regexp_extract(head(q), "^(.*) ", 1), F.lit("")), head(q))))
    return let(joined, cut)


def crossref_query(title: Column, surnames: Column, year: Column, journal: Column, most: int = 260) -> Column:
    """Title, first surname, year, journal."""
    return _query((title, F.get(surnames, F.lit(0)), year, journal), most)


def openalex_query(title: Column, surnames: Column, year: Column, journal: Column, most: int = 220) -> Column:
    """Title, year, first surname, journal."""
    return _query((title, year, F.get(surnames, F.lit(0)), journal), most)


def safe_query(query: Column, most: int = 60) -> Column:
    """The first tokens of a query, for a search that chokes on punctuation."""
    return F.array_join(F.slice(tokens(normalize_text(query)), 1, most), " ")


# --- output rows -----------------------------------------------------------------------------------


def outcome(status: Column, n_items: Column, query: Column, doi: Column) -> Column:
    """What an answer means: ``unqueryable`` without query and DOI, ``not_checked`` without an
    answer, else search_error, rate_limited, no_match, or ``candidates`` to score."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(empty(query) & empty(doi), "unqueryable")
        .when(status.isNull(), "not_checked")
        .when(status == "error", "search_error")
        .when(status == "rate_limited", "rate_limited")
        .when((status == "not_found") | (F.coalesce(n_items, F.lit(0)) == 0), "no_match")
        .otherwise("candidates")
    )


def output_row(fields: dict[str, Column], texts: tuple[str, ...], numbers: tuple[str, ...] = ()) -> list[Column]:
    """A wide row in a fixed order: fields that are missing or null are '' (texts) or 0 (numbers)."""
    row = [F.coalesce(fields[n].cast("string") if n in fields else F.lit(None).cast("string"), F.lit("")).alias(n) for n in texts]
    return row + [F.coalesce(fields[n].cast("double") if n in fields else F.lit(None).cast("double"), F.lit(0.0)).alias(n) for n in numbers]
