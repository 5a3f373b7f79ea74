"""Flags and the exclusive category of an unresolved reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeforge.functions import fixed


def flags(context: Column) -> dict[str, Column]:
    """A boolean for each category; the repository file one looks past spaces."""
    text = F.coalesce(context, F.lit(""))
    packed = F.replace(text, F.lit(" "), F.lit(""))
    return {name: (packed if name == "dergipark_file" else text).rlike(pattern) for name, pattern in fixed.CATEGORIES.items()}


def exclusive_category(own: dict[str, Column]) -> Column:
    """The first category, in the order of precedence, whose flag is set."""
    return F.coalesce(*(F.when(own[name], F.lit(name)) for name in fixed.CATEGORIES), F.lit("other"))


def link_outcome(results: Column) -> Column:
    """struct(status, link, title) of a web search: one result with a link is unique; two or more
    are ambiguous and give no link."""
    n = F.size(F.coalesce(results, F.array().cast("array<struct<link:string,title:string>>")))
    one = lambda f: F.when(n == 1, F.nullif(F.try_element_at(results, F.lit(1))[f], F.lit("")))
    return F.struct(
        F.when(n == 0, "no_result").when(n > 1, "ambiguous").when(one("link").isNotNull(), "unique_result").otherwise("unique_no_link").alias("status"),
        one("link").alias("link"),
        one("title").alias("title"),
    )


def article_like(context: Column) -> Column:
    return F.coalesce(context, F.lit("")).rlike(fixed.ARTICLE_LIKE)


def biomedical(context: Column) -> Column:
    return F.coalesce(context, F.lit("")).rlike(fixed.BIOMEDICAL)


def citation_searchable(context: Column, title: Column, year: Column, journal: Column, page: Column) -> Column:
    """Whether a citation matcher of the biomedical field is asked: all of these known, and a context of its field."""
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    return known(title) & known(year) & known(journal) & known(page) & biomedical(context)


#: Categories whose re-parsed references are worth a search.
SEARCHED = ("journal_like_left", "other", "hidden_doi", "dergipark_file", "conference")


def searchable(doi: Column, year: Column, n_tokens: Column, category: Column, any_category: bool = False) -> Column:
    """Whether a re-parsed reference is searched: with a DOI always, else with a title of four
    tokens, a year, and a category that is searched."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    allowed = F.lit(True) if any_category else category.isin(*SEARCHED)
    return filled(doi) | ((n_tokens >= 4) & filled(year) & allowed)


def blocked_page(url: Column, text: Column) -> Column:
    """Whether a result page is a block or captcha page."""
    hay = F.lower(F.concat_ws(" ", url, text))
    marks = ("/sorry/", "captcha", "unusual traffic", "not a robot", "our systems have detected")
    found = F.lit(False)
    for m in marks:
        found = found | hay.contains(m)
    return found
