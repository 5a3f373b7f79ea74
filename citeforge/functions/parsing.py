"""Citation parsers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeforge.functions import fixed
from citeforge.functions.text import clean_context, clean_reference_query, compact_query, compact_spaces, dehyphenated, first_year, let, limit_query, normalize_text, normalized_reference, salient_query, strip, tokens


def sentences(text: Column, trim: str = fixed.TRIM_PART) -> Column:
    """Parts between full stops with a space after them, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(text, r"\.\s+"), lambda p: strip(p, trim)), lambda p: p != "")


def plausible_title(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(fixed.WORD_TR)).between(4, 28)


def title_and_journal(context: Column) -> Column:
    """struct(title, journal): after the first year, else the two sentences before it; '' if none."""
    none = F.struct(F.lit("").alias("title"), F.lit("").alias("journal"))
    at = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))

    def around(text: Column) -> Column:
        year = F.regexp_extract(text, fixed.YEAR, 1)
        place = F.instr(text, year)
        after = sentences(F.trim(F.substring(text, place + 4, F.length(text)), F.lit(" .;:,()")))
        before = sentences(strip(F.substring(text, F.lit(1), place - 1), fixed.TRIM_PART))
        return F.when(year == "", none).otherwise(
            let(F.struct(after.alias("a"), before.alias("b")), lambda s: (
                F.when(plausible_title(at(s["a"], 1)), F.struct(at(s["a"], 1).alias("title"), at(s["a"], 2).alias("journal")))
                .when((F.size(s["b"]) >= 2) & plausible_title(at(s["b"], -2)), F.struct(at(s["b"], -2).alias("title"), at(s["b"], -1).alias("journal")))
                .otherwise(none)
            ))
        )

    return let(normalized_reference(context), around)


def trim_journal(text: Column) -> Column:
    text = F.trim(compact_spaces(text), F.lit(" .;,:\"“”'[]()"))
    text = F.regexp_replace(text, r"(?i)^(?:in|ve|and)\s+", "")
    text = F.regexp_replace(text, r"(?iu)\s+(?:vol|cilt|sayı|sy)\.?$", "")
    return strip(text, fixed.TRIM_PART)


def first_author_piece(text: Column) -> Column:
    text = F.regexp_replace(compact_spaces(text), r"(?i)\bet\s+al\.?", "")
    return strip(F.element_at(F.split(text, r"\.\s+|\s+\(\d{4}\)|\s+(?:18|19|20)\d{2}\.?"), 1), fixed.TRIM_QUERY)


def useful_phrase(text: Column, least: int = 4, most: int = 32) -> Column:
    return F.size(tokens(normalize_text(text))).between(least, most)


def parse_reference(context: Column) -> Column:
    """struct(title, journal, year, authors, query, parser).

    Five patterns in order: a quoted title, author-year-title, sentences with year;volume:pages,
    a loose year, volume and pages; what fits none is ``unparsed``, with the first year if any.
    """
    return let(clean_context(context), _parsed)


def _entry(title: Column, journal: Column, year: Column, authors: Column, parser: str) -> Column:
    fields = {"title": compact_spaces(title), "journal": trim_journal(journal), "year": year, "authors": first_author_piece(authors)}
    return F.struct(*(c.alias(n) for n, c in fields.items()), F.lit(parser).alias("parser"))


#: Between the groups of a match; no cleaned context has it.
_BETWEEN = "\x01\x02\x01"


def _match(text: Column, pattern: str, groups: int) -> Column:
    """What stands before the first match and the groups of it, in one pass; null where there is none."""
    whole = rf"\A((?s:.*?))(?:{pattern})(?s:.*)\z"
    found = F.regexp_replace(text, whole, _BETWEEN + _BETWEEN.join(f"${i}" for i in range(1, groups + 2)))
    return let(found, lambda x: F.when(x.startswith(_BETWEEN), F.slice(F.split(x, _BETWEEN), 2, groups + 1)))


def _parsed(text: Column) -> Column:
    def quoted(m: Column) -> Column:
        return F.when(m.isNotNull(), _entry(m[1], m[2], m[3], m[0], "quoted"))

    def dated(m: Column, parser: str) -> Column:
        return F.when(m.isNotNull() & useful_phrase(m[3]), _entry(m[3], m[4], m[2], m[1], parser))

    def by_sentence(parts: Column) -> Column:
        rest = lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), ". ")
        places = F.filter(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda i: (i <= F.size(parts) - 1) & F.coalesce(rest(i).rlike(fixed.VANCOUVER) & useful_phrase(F.try_element_at(parts, i)), F.lit(False)))
        found = lambda i: let(_match(rest(i), fixed.VANCOUVER, 2), lambda m: _entry(F.element_at(parts, i), m[1], m[2], F.element_at(parts, 1), "vancouver"))
        return F.when(F.size(places) > 0, let(F.try_element_at(places, F.lit(1)), found))

    def by_volume(last: Column) -> Column:
        ahead = F.length(text) - F.length(last) - F.length(F.call_function("substring_index", text, last, F.lit(-1)))
        before = sentences(strip(F.substring(text, F.lit(1), ahead), fixed.TRIM_QUERY), fixed.TRIM_QUERY)
        year = F.coalesce(F.nullif(F.regexp_extract(last, fixed.VOLUME_PAGES, 2), F.lit("")), F.regexp_extract(text, fixed.YEAR_WIDE, 1))
        return let(before, lambda b: F.when(
            (F.size(b) >= 2) & useful_phrase(F.try_element_at(b, F.lit(-1))),
            _entry(F.try_element_at(b, F.lit(-1)), F.regexp_extract(last, fixed.VOLUME_PAGES, 1), year, F.try_element_at(b, F.lit(1)), "volume_pages"),
        ))

    vancouver = let(sentences(text, fixed.TRIM_QUERY), by_sentence)
    whole = F.regexp_extract_all(text, F.lit(fixed.VOLUME_PAGES), F.lit(0))
    pages = let(F.try_element_at(whole, F.lit(-1)), lambda last: F.when(last.isNotNull(), by_volume(last)))
    in_quotes, apa, loose = let(_match(text, fixed.QUOTED, 4), quoted), let(_match(text, fixed.APA, 4), lambda m: dated(m, "apa")), let(_match(text, fixed.LOOSE, 4), lambda m: dated(m, "loose_year"))
    nothing = F.struct(*(F.lit("").alias(n) for n in ("title", "journal")), F.regexp_extract(text, fixed.YEAR_WIDE, 1).alias("year"), F.lit("").alias("authors"), F.lit("unparsed").alias("parser"))
    chosen = F.coalesce(in_quotes, apa, vancouver, loose, pages, nothing)
    pieces = lambda p: F.concat_ws(" ", *(F.nullif(p[n], F.lit("")) for n in ("title", "authors", "journal", "year")))
    query = lambda p: F.when(p["parser"] == "unparsed", F.lit("")).otherwise(strip(F.substring(compact_spaces(pieces(p)), 1, 280), fixed.TRIM_QUERY))
    return let(chosen, lambda p: F.struct(p["title"].alias("title"), p["journal"].alias("journal"), p["year"].alias("year"), p["authors"].alias("authors"), query(p).alias("query"), p["parser"].alias("parser")))


def _distinct_by(items: Column, key) -> Column:
    """Items whose key hasn't come before."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def cleanup_queries(context: Column, doi: Column, most: int = 300) -> Column:
    """array<struct<mode, query>>: cleaned, dehyphenated if that differs, title-journal-year;
    those of 12 characters or more, distinct without regard to case."""

    def rows(s: Column) -> Column:
        parts = s["parts"]
        titled = F.concat_ws(" ", F.nullif(parts["title"], F.lit("")), F.nullif(parts["journal"], F.lit("")), F.nullif(first_year(context), F.lit("")))
        row = lambda mode, q, ok: F.when(ok, F.struct(F.lit(mode).alias("mode"), F.trim(F.regexp_replace(limit_query(q, most), r"\s+", " ")).alias("query")))
        made = F.array(
            row("cleaned_context", s["cleaned"], s["cleaned"] != ""),
            row("dehyphenated_context", s["joined"], (s["joined"] != "") & (s["joined"] != s["cleaned"])),
            row("title_journal_year", titled, parts["title"] != ""),
        )
        return let(F.filter(made, lambda x: x.isNotNull() & (F.length(x["query"]) >= 12)), lambda a: _distinct_by(a, lambda x: F.lower(x["query"])))

    forms = lambda base: F.struct(normalized_reference(base).alias("cleaned"), dehyphenated(base).alias("joined"), title_and_journal(context).alias("parts"))
    return let(let(clean_reference_query(context, doi), forms), rows)


def title_queries(title: Column, year: Column, most: int = 4) -> Column:
    """array<struct<mode, key, query>>: full and salient title, each with the year and without;
    those of 8 characters or more, distinct by key."""
    words = F.struct(compact_query(title).alias("full"), salient_query(title).alias("salient"))
    return let(words, lambda w: queries_of(w["full"], w["salient"], year, most))


def queries_of(full: Column, salient: Column, year: Column, most: int = 4) -> Column:
    """``title_queries`` of a title's two forms that are there already."""
    def of(mode: str, query: Column) -> list[Column]:
        dated = F.coalesce(year, F.lit("")) != ""
        plain = F.concat(F.lit("title||"), query)
        keyed = F.when(dated, F.concat(F.lit("year|"), year, F.lit("|"), query)).otherwise(plain)
        return [F.struct(F.lit(m).alias("mode"), k.alias("key"), query.alias("query")) for m, k in ((f"{mode}_year", keyed), (mode, plain))]

    made = F.array(*of("title_full", full), *of("title_salient", salient))
    kept = let(F.filter(made, lambda x: F.length(x["query"]) >= 8), lambda a: _distinct_by(a, lambda x: x["key"]))
    return F.slice(kept, 1, most)


def parse_query_key(key: Column) -> Column:
    """struct(mode, year, query) of a key mode|year|query."""
    part = lambda i: F.coalesce(F.try_element_at(F.split(key, r"\|", 3), F.lit(i)), F.lit(""))
    return F.struct(part(1).alias("mode"), part(2).alias("year"), part(3).alias("query"))


def title_searchable(title: Column, year: Column, n_tokens: Column, n_queries: Column | None = None) -> Column:
    """Whether a parsed title can be searched for: with a year, four tokens, and at least one query
    (eight letters); ``n_queries``: how many, where that is known."""
    n_queries = F.size(title_queries(title, year)) if n_queries is None else n_queries
    return (title != "") & (year != "") & (n_tokens >= 4) & (n_queries > 0)
