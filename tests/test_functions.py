"""Column functions on single values, some of them published examples of what references look like."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeforge.functions import classify, fixed, identifiers, parsing, scoring, similarity, text


def each(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_doi_forms(spark):
    values = [None, "", " https://doi.org/10.1234/ABC.1 ", "doi: 10.1234/a(b)c).", "10.1/x", "10.1234/x/pdf", "10.1234/x#frag", "10.1234/x?y=1", "10.1234/a%2Fb", "10.1234/a+b", "<10.1234/x>", "10.1234/x]])", "http://dx.doi.org/10.1234/x;", "10.1234/%zz"]
    assert each(spark, values, identifiers.normalize_doi) == ["", "", "10.1234/abc.1", "10.1234/a(b)c", "10.1/x", "10.1234/x", "10.1234/x", "10.1234/x", "10.1234/a/b", "10.1234/a+b", "10.1234/x", "10.1234/x", "10.1234/x", "10.1234/%zz"]
    assert each(spark, ["10.1234 / a b ).", "doi 10.1234/x}."], identifiers.normalize_doi_spaced) == ["10.1234/ab", "10.1234/x"]
    assert each(spark, ["http://dx.doi.org/10.1/x", "https://doi.org/10.1/X."], identifiers.normalize_doi_form) == ["http://dx.doi.org/10.1/x", "10.1/x"]
    assert each(spark, ["http://dx.doi.org/10.1/X/full"], identifiers.normalize_doi_works) == ["10.1/x/full"]


def test_doi_candidates(spark):
    values = [
        "see https://doi.org/10.1016/j.abrep.2018. 100148 and 10.9999/zz",
        "bare 10.1234/x. and 10.1234/X again 10.5678/y",
        "10.1234/abc. 10.5678/def",
        "none 10.12/x",
        "doi.org/10.1234/q) &amp; doi:10.1234/q",
    ]
    assert each(spark, values, identifiers.doi_candidates) == [
        ["10.1016/j.abrep.2018", "10.1016/j.abrep.2018.100148"],
        ["10.1234/x", "10.5678/y"],
        ["10.1234/abc", "10.1234/abc.10.5678/", "10.5678/def"],
        [],
        ["10.1234/q"],
    ]
    assert each(spark, ["doi: 10.1234 / ab.c, 10.1234/ab.c", None], identifiers.hidden_dois) == [["10.1234/ab.c"], []]


def test_identifiers(spark):
    assert each(spark, ["ISBN 978-0-306-40615-7", "0306406152", "ISBN 9780306406158", "097522980X", "X975229800"], identifiers.isbns)[:4] == [["9780306406157"], ["0306406152"], [], ["097522980X"]]
    vp = lambda c: F.concat_ws("|", identifiers.volume_first_page(c)["volume"], identifiers.volume_first_page(c)["page"])
    assert each(spark, ["J 12(3): 45-6", "J 12, 45", "J 12;3:45", "x", None], vp) == ["12|45", "12|45", "3|45", "|", "|"]
    key = lambda c: identifiers.citation_key(F.lit("J"), F.lit("1999"), c, F.lit("Jane van Doe, B."))
    assert each(spark, ["J 12(3): 45-6"], key) == ["J|1999|12|45|Doe||"]
    urls = ["https://dergipark.org.tr/tr/pub/AbC/issue/1/22", "dergipark.gov.tr/pub/x y/article/7", "https://dergipark.org.tr/en/pub/slug.", "dergipark.org.tr/tr/download/article-file/99", "none"]
    assert [tuple(r) for r in each(spark, urls, identifiers.repository_evidence)] == [("22", "1", "abc", ""), ("7", "", "xy", ""), ("", "", "slug", ""), ("", "", "", "99"), ("", "", "", "")]


def plain(value: str) -> str:
    import re

    low = unicodedata.normalize("NFKD", html.unescape(value).lower())
    return " ".join(re.findall("[a-z0-9]+", "".join(c for c in low if not unicodedata.combining(c)).replace("ı", "i")))


def test_folding(spark):
    values = ["Çalışma İLE ığdır", "naïve ﬁne", "Åse Ærø", "a&amp;b &lt;c&gt;", "éa", "", "日本 x²", "Ǆ 5"]
    assert each(spark, values, text.normalize_text) == [plain(v) for v in values]
    assert each(spark, values, text.normalize_text_exact) == [plain(v) for v in values]
    assert each(spark, ["Straße"], text.normalize_casefold) == ["strasse"]
    assert each(spark, ["Türkiye’nin O'Neil"], text.normalize_joined) == ["turkiyenin oneil"]


def test_folding_any_letter(spark):
    bare = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
    letters = [c for c in map(chr, range(0x80, 0x2000)) if unicodedata.category(c)[0] == "L" and len(bare(c)) == 1]
    assert each(spark, letters, text.normalize_text) == [plain(c) for c in letters]


def test_query_building(spark):
    assert each(spark, ["[3] A-\nb co- operation. https://x.y/z [CrossRef] Accessed from here", None], text.normalized_reference) == ["Ab cooperation. https://x.y/z", ""]
    assert each(spark, ["word word-wide"], text.dehyphenated) == ["word wordwide"]
    assert each(spark, ["T. doi:10.1234/x http://a.b c [PubMed].", None], text.clean_reference_query) == ["T. c", ""]
    assert each(spark, ["one two three", "abcdefghijkl", "one"], lambda c: text.limit_query(c, 9)) == ["one two", "abcdefghi", "one"]
    assert each(spark, ["12) Abc  retrieved 2001. ­"], lambda c: text.clean_link_query(c, 40)) == ["Abc"]
    assert each(spark, ["x 1999 y 2040 1999 2001a (2002)"], text.years) == [[1999, 2002]]
    assert each(spark, ["x 1999 2005", "none"], text.latest_year) == [2005, None]
    assert each(spark, [" YES", "y", "0", None], text.truthy) == [True, True, False, False]
    assert each(spark, ["12", "1x", "", None], text.as_int) == [12, None, None, None]
    assert each(spark, ["the Analysis of small Çay's things"], text.salient_query) == ["small Çays things"]


APA = "Doe, J., & Roe, R. (2018). A study of very small things in tall places. Journal of Things, 12(3), 45-67."
VANCOUVER = "3. Doe J, Roe R. Effects of tall towers on small birds. J Birds. 2015;8(1 Pt A):60-9."
LOOSE = "Doe J. 2014. Effects of tall towers on small brown birds. Journal of Birds; 17(1): 252-266."
QUOTED = "Doe, J., “Effects of tall towers on birds”, Journal of Birds, 12 (1999), 5-9."
PAGES = "Doe J. Effects of tall towers on small brown birds. Journal of Birds, 17(1): 252-266"


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (APA, ("A study of very small things in tall places", "Journal of Things", "2018", "Doe, J., & Roe, R", "apa")),
        (VANCOUVER, ("Effects of tall towers on small birds", "J Birds", "2015", "Doe J, Roe R", "vancouver")),
        (LOOSE, ("Effects of tall towers on small brown birds", "Journal of Birds", "2014", "Doe J", "loose_year")),
        (QUOTED, ("Effects of tall towers on birds", "Journal of Birds", "1999", "Doe, J", "quoted")),
        (PAGES, ("Effects of tall towers on small brown birds", "Journal of Birds", "", "Doe J", "volume_pages")),
        ("nothing in 1850 here", ("", "", "1850", "", "unparsed")),
        (None, ("", "", "", "", "unparsed")),
    ],
)
def test_parsers(spark, value, want):
    got = each(spark, [value], parsing.parse_reference)[0]
    assert (got.title, got.journal, got.year, got.authors, got.parser) == want


def test_title_around_the_year(spark):
    values = ["Doe J (1999) Birds of the tall towers. J Birds. 3", "Doe J. Birds of the tall towers. J Birds. 1999", "no year at all"]
    assert [tuple(r) for r in each(spark, values, parsing.title_and_journal)] == [("Birds of the tall towers", "J Birds"), ("Birds of the tall towers", "J Birds"), ("", "")]


def test_similarity(spark):
    two = spark.createDataFrame([("Small birds of towers", "x small BIRDS of towers y 1999"), ("Small birds", "Birds smaller " * 30), ("", "x")], "a string, b string")
    sims = [r[0] for r in two.select(similarity.title_similarity(F.col("a"), F.col("b"))).collect()]
    assert sims == [1.0, SequenceMatcher(None, plain("Small birds"), plain("Birds smaller " * 30)).ratio(), 0.0]
    covs = [r[0] for r in two.select(similarity.title_coverage(F.col("a"), F.col("b"))).collect()]
    assert covs == [1.0, 0.5, 0.0]
    names = spark.createDataFrame([("J Birds", "The J Birds", 1.0), ("", "x", 0.0), ("small birds", "small beasts", round(0.65 / 3 + 0.35 * SequenceMatcher(None, "small birds", "small beasts").ratio(), 4))], "a string, b string, w double")
    assert all(abs(r[0] - r[1]) < 1e-9 for r in names.select(similarity.name_similarity(F.col("a"), F.col("b")), "w").collect())
    authors = spark.createDataFrame([(["doe", "roe", "poe", "moe"], "doe roe x"), ([], "x"), (None, "x"), (["ab"], "ab")], "s array<string>, c string")
    assert [r[0] for r in authors.select(similarity.author_coverage(F.col("s"), F.col("c"))).collect()] == [2 / 3, 0.0, 0.0, 0.0]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab cé", max_size=30), st.text("ab cé", max_size=300)), min_size=1, max_size=8))
def test_ratio_is_the_matching_blocks_ratio(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(similarity.ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


@pytest.mark.parametrize(
    ("cov", "sim", "auth", "year", "n", "want"),
    [(0.5, 0.98, 0.0, True, 3, "strong"), (0.88, 0.1, 0.34, False, 6, "strong"), (0.78, 0.1, 0.34, True, 8, "strong"), (0.78, 0.1, 0.34, True, 7, "possible"), (0.58, 0.1, 0.34, False, 8, "possible"), (0.9, 0.5, 0.0, False, 9, "no_match")],
)
def test_statuses(spark, cov, sim, auth, year, n, want):
    lit = [F.lit(x) for x in (cov, sim, auth, year, n)]
    got = spark.range(1).select(scoring.bibliographic_score(*lit).alias("s")).first().s
    assert got.status == want
    assert abs(got.confidence - round(0.55 * cov + 0.2 * sim + 0.15 * auth + 0.1 * year, 4)) < 1e-9


def test_categories(spark):
    values = ["x 10.1234 / y thesis", "dergipark.org.tr/x/ download/article-file/3", "Yüksek Lisans Tezi", "BAKANLIĞI rapor", "see www.x.org", "Proc. Kongre", "Springer", "J 12(3): 4-5", "plain", None]
    own = lambda c: classify.exclusive_category(classify.flags(c))
    assert each(spark, values, own) == ["hidden_doi", "dergipark_file", "thesis", "report_policy_legal", "url_web", "conference", "book_or_chapter", "journal_like_left", "other", "other"]
    assert fixed.CATEGORY_ORDER[-1] == "other" and len(fixed.CATEGORY_ORDER) == 9


def test_link_outcomes(spark):
    from citeforge.sources.records import mock_results

    got = each(spark, ["a unique thing", "empty", "other"], lambda c: classify.link_outcome(mock_results(c)))
    assert [r.status for r in got] == ["unique_result", "no_result", "ambiguous"]
    assert [r.link is None for r in got] == [False, True, True]
