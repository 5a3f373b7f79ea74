"""Text functions over columns: folding, tokens, cleaning, query building."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeforge.functions import fixed


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that it names several times, without copying its expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """(from, to) for ``translate``: each character whose compatibility form, lower-cased and
    without combining marks, is one of a-z0-9; then the combining marks, which go."""
    single, gone = [], []
    for code in range(0x80, 0x1D800):
        if 0xD800 <= code < 0xE000 or 0x3000 <= code < 0xA000 or 0xAC00 <= code < 0xD7A4:
            continue
        c = chr(code)
        if unicodedata.combining(c):
            gone.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).replace("ı", "i")
        if re.fullmatch("[a-z0-9]", plain):
            single.append((c, plain))
    return "".join(c for c, _ in single) + "".join(gone), "".join(p for _, p in single)


# Characters that fold to several letters; sharp s only where case is folded fully.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "Ĳ": "ij", "ĳ": "ij", "Ǆ": "dz", "ǅ": "dz", "ǆ": "dz"}


def unescape(text: Column) -> Column:
    """The entities that texts carry; ``unescape_exact`` knows all of HTML's."""
    for name, char in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


@F.pandas_udf(T.StringType())
def unescape_exact(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone; a malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def fold(text: Column, casefold: bool = False) -> Column:
    """a-z0-9 words joined by one space, accents and case folded; null stays null."""
    for c, plain in LIGATURES.items():
        text = F.replace(text, F.lit(c), F.lit(plain))
    if casefold:
        text = F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))
    a, b = fold_table()
    return F.trim(F.regexp_replace(F.lower(F.translate(text, a, b)), "[^a-z0-9]+", " "))


def normalize_text(text: Column) -> Column:
    """Entities, case and accents folded."""
    return fold(unescape(F.coalesce(text, F.lit(""))))


def normalize_casefold(text: Column) -> Column:
    """Without entities, with full case folding."""
    return fold(F.coalesce(text, F.lit("")), casefold=True)


def normalize_joined(text: Column) -> Column:
    """Without entities; letters on both sides of an apostrophe are joined."""
    return fold(F.regexp_replace(F.coalesce(text, F.lit("")), fixed.JOINING_APOSTROPHE, ""))


@F.pandas_udf(T.StringType())
def normalize_text_exact(text: pd.Series) -> pd.Series:
    """``normalize_text`` for any character, all entities included."""

    def one(value: str | None) -> str:
        value = unicodedata.normalize("NFKD", html.unescape(value or "").lower())
        kept = "".join(c for c in value if not unicodedata.combining(c)).replace("ı", "i")
        return " ".join(re.findall("[a-z0-9]+", kept))

    return text.map(one)


def tokens(normal: Column, stop: tuple[str, ...] = fixed.STOP_BASE) -> Column:
    """Words of a normalised text of over two letters that aren't stop words, repeats kept."""
    words = F.array(*(F.lit(w) for w in stop))
    return F.filter(F.split(normal, " "), lambda t: (F.length(t) > 2) & ~F.array_contains(words, t))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Blanks at the ends of a field; the built-in trim takes spaces alone.
WHITE = " \t\r\n\f\v"


def strip(text: Column, chars: str) -> Column:
    return F.trim(text, F.lit(chars))


def compact_spaces(text: Column) -> Column:
    return squeeze(F.replace(F.coalesce(text, F.lit("")), F.lit("­"), F.lit("")))


def limit_query(query: Column, most: int) -> Column:
    """At most ``most`` characters, cut back to the last space."""
    if most <= 0:
        return query
    head = F.substring(query, 1, most)
    cut = strip(F.when(F.instr(head, " ") > 0, F.regexp_extract(head, "^(.*) ", 1)).otherwise(head), fixed.TRIM_QUERY)
    return F.when(F.length(query) <= most, query).when(cut != "", cut).otherwise(strip(head, fixed.TRIM_QUERY))


def clean_reference_query(context: Column, doi: Column | None = None, leading_number: bool = False) -> Column:
    """A reference without its DOI, other DOIs and URLs, source tags and, on demand, number."""
    query = unescape(F.coalesce(context, F.lit("")))
    if doi is not None:
        known = F.concat(F.lit("(?i)\\Q"), doi, F.lit("\\E"))
        query = F.when(F.coalesce(doi, F.lit("")) != "", F.regexp_replace(query, known, F.lit(" "))).otherwise(query)
    for pattern in (fixed.DOI_OR_URL, fixed.URL, fixed.SOURCE_TAG):
        query = F.regexp_replace(query, pattern, " ")
    if leading_number:
        query = F.regexp_replace(query, fixed.LEADING_NUMBER, "")
    return strip(F.regexp_replace(query, r"\s+", " "), fixed.TRIM_QUERY)


def normalized_reference(context: Column) -> Column:
    text = F.replace(unescape(F.coalesce(context, F.lit(""))), F.lit("­"), F.lit(""))
    text = F.regexp_replace(text, fixed.LEADING_NUMBER, "")
    text = F.regexp_replace(text, fixed.BROKEN_WORD, "$1$2")
    text = F.regexp_replace(text, fixed.NOISE, " ")
    return strip(F.regexp_replace(text, r"\s+", " "), fixed.TRIM_QUERY)


def dehyphenated(context: Column) -> Column:
    return strip(F.regexp_replace(normalized_reference(context), fixed.HYPHENATED, "$1$2"), fixed.TRIM_QUERY)


def clean_context(context: Column) -> Column:
    text = F.regexp_replace(unescape(F.coalesce(context, F.lit(""))), fixed.LEADING_NUMBER, "")
    text = F.regexp_replace(text, fixed.SOURCE_TAG_WIDE, " ")
    text = F.regexp_replace(text, r"https?://\S+|www\.\S+", " ")
    text = F.regexp_replace(text, fixed.BROKEN_WORD, "$1$2")
    return strip(compact_spaces(text), fixed.TRIM_QUERY)


def clean_link_query(text: Column, most: int = 0) -> Column:
    """A reference as a web query: no URL, access tail, number or soft hyphen."""
    query = F.regexp_replace(F.coalesce(text, F.lit("")), fixed.URL, " ")
    query = F.regexp_replace(query, fixed.ACCESS_TAIL, " ")
    query = F.replace(F.regexp_replace(query, fixed.LEADING_NUMBER, ""), F.lit("­"), F.lit(""))
    query = strip(F.regexp_replace(query, r"\s+", " "), fixed.TRIM_QUERY)
    if most <= 0:
        return query
    head = F.substring(query, 1, most)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, "^(.*) ", 1)).otherwise(head)
    return F.when(F.length(query) <= most, query).otherwise(strip(cut, fixed.TRIM_QUERY))


def clean_reference(text: Column) -> Column:
    return F.trim(F.regexp_replace(squeeze(F.coalesce(text, F.lit(""))), fixed.LEADING_NUMBER, ""))


def cache_key(payload: Column) -> Column:
    return F.sha2(payload, 256)


def compact_query(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), fixed.JOINING_APOSTROPHE, "")
    return F.array_join(F.regexp_extract_all(F.replace(text, F.lit("­"), F.lit("")), F.lit(f"({fixed.WORD_TR})"), F.lit(1)), " ")


def salient_query(text: Column, most: int = 10) -> Column:
    """The first words that would be title tokens, as they are written."""
    return let(compact_query(text), lambda words: salient_words(words, most))


def salient_words(words: Column, most: int = 10) -> Column:
    """``salient_query`` of a ``compact_query``. Each of its letters folds to one, so it is folded whole and has its words where they were."""
    stop = F.array(*(F.lit(w) for w in fixed.STOP_INDEX))
    both = F.struct(F.split(words, " ").alias("w"), F.split(normalize_joined(words), " ").alias("n"))
    useful = lambda s: F.filter(s["w"], lambda _, i: (F.length(s["n"][i]) > 2) & ~F.array_contains(stop, s["n"][i]))
    return F.array_join(F.slice(let(both, useful), 1, most), " ")


def years(text: Column) -> Column:
    """Distinct years 1900-2039 of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.YEAR), F.lit(1)), lambda y: y.cast("int")))


def first_year(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), fixed.YEAR, 1)


def latest_year(text: Column) -> Column:
    return F.array_max(years(text))


def utc_now() -> Column:
    """The current time as an ISO string with its zone, to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


# The response headers that tell how much of a quota is left.
LIMIT_HEADERS = ("x-ratelimit-credits-used", "x-ratelimit-remaining", "x-ratelimit-limit", "x-ratelimit-reset", "x-ratelimit-cost-usd", "x-ratelimit-remaining-usd")


def limit_headers(headers: Column) -> Column:
    """The quota's entries of a map of response headers."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(*LIMIT_HEADERS) & v.isNotNull())


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(strip(value.cast("string"), WHITE)).isin("1", "true", "yes", "y"), F.lit(False))


def as_int(value: Column) -> Column:
    return F.when(value.cast("string").rlike("^[0-9]+$"), value.cast("string").try_cast("bigint"))


def first_filled(*values: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(strip(v, WHITE), F.lit("")) for v in values))


def percent(part: Column, whole: Column) -> Column:
    """Two decimals, halves up, from whole numbers alone, so that no binary fraction decides a tie;
    null of an empty whole."""
    return F.floor((part * 20000 + whole) / F.nullif(whole * 2, F.lit(0))) / 100.0
