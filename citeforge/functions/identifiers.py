"""Identifiers in free text: DOIs, ISBNs, volume and page, repository URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeforge.functions import fixed
from citeforge.functions.text import let, strip, unescape, unquote


def _before_fragment(doi: Column) -> Column:
    return F.element_at(F.split(doi, "[#?]", 2), 1)


def _balanced(doi: Column, left: str, right: str) -> Column:
    """Cuts closing brackets from the end as long as there are more of them than opening ones."""

    def cut(x: Column) -> Column:
        count = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
        run = F.length(F.regexp_extract(x, rf"(\{right}+)$", 1))
        return F.substring(x, F.lit(1), F.length(x) - F.greatest(F.lit(0), F.least(run, count(right) - count(left))))

    return let(doi, cut)


def normalize_doi(value: Column) -> Column:
    """Decoded, without prefix, quotes, fragment, endpoint suffix and unbalanced brackets."""
    doi = F.replace(F.trim(unescape(unquote(F.coalesce(value, F.lit(""))))), F.lit(" "), F.lit(" "))
    doi = strip(F.regexp_replace(doi, fixed.DOI_PREFIX, ""), fixed.TRIM_DOI)
    doi = F.rtrim(F.regexp_replace(_before_fragment(doi), fixed.DOI_ENDPOINT, ""), F.lit(".,;:"))
    return F.lower(_balanced(_balanced(doi, "(", ")"), "[", "]"))


def _simple(value: Column, prefix: str) -> Column:
    doi = F.regexp_replace(F.trim(unquote(F.coalesce(value, F.lit("")))), prefix, "")
    return F.lower(F.rtrim(_before_fragment(strip(doi, fixed.TRIM_DOI)), F.lit(".,;:")))


def normalize_doi_form(value: Column) -> Column:
    """For a matching form's answers: only the plain resolver prefix is known."""
    return _simple(value, fixed.DOI_PREFIX_PLAIN)


def normalize_doi_works(value: Column) -> Column:
    """For records of work indexes: neither endpoint suffixes nor brackets are touched."""
    return _simple(value, fixed.DOI_PREFIX)


def normalize_doi_spaced(value: Column) -> Column:
    """For spaced-out DOIs: all inner space goes, and all closing punctuation at the end."""
    doi = F.regexp_replace(F.trim(unquote(F.coalesce(value, F.lit("")))), fixed.DOI_PREFIX, "")
    doi = F.regexp_replace(F.regexp_replace(doi, r"\s*/\s*", "/"), r"\s+", "")
    return F.lower(F.regexp_replace(_before_fragment(strip(doi, fixed.TRIM_DOI)), r"[.,;:)\]}]+$", ""))


def _candidates(text: Column, pattern: str) -> Column:
    """Each DOI of the pattern, then with a numeric continuation after a space, normalised."""
    ahead = f"{pattern}(?=(?:{fixed.DOI_CONTINUATION})?)"
    raw = F.regexp_extract_all(text, F.lit(ahead), F.lit(1))
    more = F.transform(F.regexp_extract_all(text, F.lit(ahead), F.lit(2)), lambda m: F.rtrim(m, F.lit(".,;:")))
    pairs = F.zip_with(raw, more, lambda r, m: F.when(m == "", F.array(r)).otherwise(F.array(r, F.concat(r, m))))
    dois = F.transform(F.flatten(pairs), normalize_doi)
    return F.array_distinct(F.filter(dois, lambda d: d.rlike(r"^10\.\d{4,9}/[^\s\"<>]+")))


def doi_candidates(context: Column) -> Column:
    """DOIs with a prefix; only without any, bare ones. Distinct, in order."""
    text = F.replace(unescape(F.coalesce(context, F.lit(""))), F.lit(" "), F.lit(" "))
    prefixed = _candidates(text, fixed.DOI_PREFIXED)
    return F.when(F.size(prefixed) > 0, prefixed).otherwise(_candidates(text, fixed.DOI))


def hidden_dois(context: Column) -> Column:
    """DOIs with spaces around the slash too."""
    raw = F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(fixed.DOI_HIDDEN), F.lit(1))
    dois = F.transform(raw, lambda r: normalize_doi_works(F.regexp_replace(r, r"\s*/\s*", "/")))
    return F.array_distinct(F.filter(dois, lambda d: d.startswith("10.")))


def other_hidden_dois(context: Column, known: Column) -> Column:
    """``hidden_dois`` but for the one that is known already."""
    return F.filter(hidden_dois(context), lambda d: (d != "") & (d != F.coalesce(known, F.lit(""))))


def first_doi(context: Column) -> Column:
    return normalize_doi_spaced(F.regexp_extract(F.coalesce(context, F.lit("")), fixed.DOI_LOOSE, 1))


def spaced_dois(context: Column) -> Column:
    raw = F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(fixed.DOI_LOOSE), F.lit(1))
    dois = F.transform(raw, lambda r: F.rtrim(normalize_doi_spaced(r), F.lit(".")))
    return F.array_distinct(F.filter(dois, lambda d: d.startswith("10.")))


def repository_evidence(context: Column) -> Column:
    """struct(article_id, issue_id, slug, article_file_id) of a repository URL; '' if absent.

    An issue URL has precedence over a direct article URL, either over a journal's slug alone.
    """
    def of(url: Column) -> Column:
        get = lambda tail, g: F.regexp_extract(url, fixed.REPOSITORY + tail, g)
        issue, direct = r"pub/([^/\s]+)/issue/([0-9]+)/([0-9]+)", r"pub/([^/\s]+)/article/([0-9]+)"
        filled = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c), F.lit(""))
        return F.struct(
            filled(get(issue, 3), get(direct, 2)).alias("article_id"),
            get(issue, 2).alias("issue_id"),
            F.lower(filled(get(issue, 1), get(direct, 1), get(r"pub/([^/\s?#.,)]+)", 1))).alias("slug"),
            get(r"download/article-file/([0-9]+)", 1).alias("article_file_id"),
        )

    return let(unquote(F.regexp_replace(F.coalesce(context, F.lit("")), r"\s+", "")), of)


def isbn_digits(value: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9Xx]", ""))


def _digit(value: Column, i: Column) -> Column:
    c = F.substring(value, i + 1, F.lit(1))
    return F.when(c == "X", 10).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)))


def valid_isbn10(value: Column) -> Column:
    """Weights 10 to 1, modulo 11; X is ten wherever it stands."""
    total = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0), lambda s, i: s + _digit(value, i) * (10 - i))
    return value.rlike("^[0-9X]{10}$") & (total % 11 == 0)


def valid_isbn13(value: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(0), F.lit(12)), F.lit(0), lambda s, i: s + _digit(value, i) * (1 + 2 * (i % 2)))
    return value.rlike("^97[89][0-9]{10}$") & (total % 10 == 0)


def isbns(context: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(fixed.ISBN), F.lit(1)), isbn_digits)
    return F.array_distinct(F.filter(found, lambda v: valid_isbn13(v) | valid_isbn10(v)))


def volume_first_page(context: Column) -> Column:
    """struct(volume, page) of the first pattern that fits; '' if none."""
    text = F.coalesce(context, F.lit(""))
    get = lambda g: F.coalesce(*(F.nullif(F.regexp_extract(text, p, g), F.lit("")) for p in fixed.VOLUME_PAGE), F.lit(""))
    return F.struct(get(1).alias("volume"), get(2).alias("page"))


def first_surname(authors: Column) -> Column:
    """The last word before the first comma."""
    return F.coalesce(F.regexp_extract(F.trim(F.split_part(F.coalesce(authors, F.lit("")), F.lit(","), F.lit(1))), r"(\S+)$", 1), F.lit(""))


def citation_key(journal: Column, year: Column, context: Column, authors: Column) -> Column:
    """journal|year|volume|page|author|| for a citation matcher."""
    filled = lambda c: F.coalesce(c, F.lit(""))
    vp = volume_first_page(context)
    return F.concat_ws("|", filled(journal), filled(year), vp["volume"], vp["page"], first_surname(authors), F.lit(""), F.lit(""))
