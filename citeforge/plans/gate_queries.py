"""Queries of the gates before a search, of parsed citations of every form, and of the ways to fold a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.functions import classify, fixed, identifiers, parsing, similarity, text
from citeforge.operators import candidates, lookup
from citeforge.plans import oracle as o
from citeforge.plans.registry import query
from citeforge.plans.views import own_works, refs, works
from citeforge.sources.shared import stored


def _join(*parts: Column | str) -> Column:
    """Texts and columns in a row; plain strings are texts, not names."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- gates ---------------------------------------------------------------------------------------------


@query(f"""{o.WITH_REFS}, e AS (SELECT sample_index, unnest({o.every("context", fixed.DOI_HIDDEN)}) AS r, generate_subscripts({o.every("context", fixed.DOI_HIDDEN)}, 1) AS i FROM refs),
  n AS (SELECT sample_index, i, {o.doi_simple("regexp_replace(r, '\\s*/\\s*', '/', 'g')", fixed.DOI_PREFIX)} AS d FROM e),
  s AS (SELECT *, CASE WHEN k % 3 <> 0 THEN '10.5555/part.' || part ELSE '' END AS source_doi, regexp_matches(context, {o.rx(fixed.ARTICLE_LIKE)}) AS article_like FROM refs),
  g AS (SELECT s.sample_index, any_value(article_like) AS article_like, coalesce(string_agg(d, ';' ORDER BY i) FILTER (d LIKE '10.%' AND d <> source_doi), '') AS hidden FROM s LEFT JOIN n USING (sample_index) GROUP BY s.sample_index)
  SELECT sample_index, hidden, CASE WHEN hidden <> '' THEN 'hidden_doi' WHEN article_like THEN 'article_like' ELSE 'not_article_like' END AS query_mode FROM g""")
def hidden_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs in a context other than the one that is known, and what is asked then."""
    r = refs(spark, sf_dir).withColumn("source_doi", F.when(F.col("k") % 3 != 0, _join("10.5555/part.", F.col("part"))))
    hidden = identifiers.other_hidden_dois(F.col("context"), F.col("source_doi"))
    r = r.select("sample_index", F.array_join(hidden, ";").alias("hidden"), classify.article_like(F.col("context")).alias("a"))
    mode = F.when(F.col("hidden") != "", "hidden_doi").when(F.col("a"), "article_like").otherwise("not_article_like")
    return r.select("sample_index", "hidden", mode.alias("query_mode"))


_SHORT = "CASE k % 6 WHEN 0 THEN title WHEN 1 THEN 'the and for with into title of it' WHEN 2 THEN '' WHEN 3 THEN string_split(title, ' ')[1] || ' study of birds' WHEN 4 THEN 'çok ünlü şair üç' ELSE title END"


@query(f"""{o.WITH_BOTH}, t AS (SELECT sample_index, {_SHORT} AS title, CASE WHEN k % 4 = 1 THEN '' ELSE CAST(r.year AS VARCHAR) END AS year FROM (SELECT sample_index, k, title, works.year FROM refs JOIN works ON work_id = part) r),
  q AS (SELECT *, len({o.tokens(o.fold("title"), fixed.STOP_INDEX)}) AS n, array_to_string(regexp_extract_all(title, '{fixed.WORD_TR}'), ' ') AS full_q,
    array_to_string(list_filter(regexp_extract_all(title, '{fixed.WORD_TR}'), lambda w: length(lower(w)) > 2 AND lower(w) NOT IN ({", ".join(o.q(w) for w in fixed.STOP_INDEX)}))[1:10], ' ') AS sal FROM t),
  v AS (SELECT *, (CASE WHEN length(full_q) >= 8 THEN 1 ELSE 0 END + CASE WHEN length(sal) >= 8 AND sal <> full_q THEN 1 ELSE 0 END) * (CASE WHEN year = '' THEN 1 ELSE 2 END) AS n_variants FROM q)
  SELECT sample_index, n::INTEGER AS n_tokens, n_variants::INTEGER AS n_variants, title <> '' AND year <> '' AND n >= 4 AND n_variants > 0 AS searchable FROM v""")
def title_search_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed titles that are searched for: with a year, four tokens and at least one query."""
    k, title = F.col("k"), F.col("title")
    made = F.when(k % 6 == 1, "the and for with into title of it").when(k % 6 == 2, "").when(k % 6 == 3, _join(F.split("title", " ")[0], " study of birds")).when(k % 6 == 4, "çok ünlü şair üç").otherwise(title)
    year = F.when(k % 4 == 1, "").otherwise(F.col("year").cast("string"))
    r = refs(spark, sf_dir).select("sample_index", "k", F.col("part").alias("work_id")).join(own_works(spark, sf_dir).select("work_id", "title", "year"), "work_id")
    r = r.select("sample_index", F.struct(made.alias("title"), year.alias("year")).alias("asked"))
    texts, number = lookup.distinct_texts(r, "asked")
    # Generators, so that no expression is copied into what comes after.
    n = F.size(text.tokens(text.normalize_joined(F.col("asked.title")), fixed.STOP_INDEX))
    counts = F.struct(n.alias("n_tokens"), F.size(parsing.title_queries(F.col("asked.title"), F.col("asked.year"))).alias("n_variants"))
    t = texts.select("_text", "asked", F.inline(F.array(counts)))
    t = t.select("_text", "n_tokens", "n_variants", parsing.title_searchable(F.col("asked.title"), F.col("asked.year"), F.col("n_tokens"), F.col("n_variants")).alias("searchable"))
    return r.select("sample_index", number.alias("_text")).join(stored(t, "counted_texts"), "_text").drop("_text")


_PAGES = ", ".join(f"nullif({o.ext('context', p, 2)}, '')" for p in fixed.VOLUME_PAGE)
_PAGE = f"coalesce({_PAGES}, '')"


@query(f"""{o.WITH_REFS}, f AS (SELECT sample_index, context, k % 5 AS m, regexp_matches(context, {o.rx(fixed.BIOMEDICAL)}) AS field, {_PAGE} AS page FROM refs)
  SELECT sample_index, field AS biomedical, page, field AND page <> '' AND m <> 0 AND m <> 1 AND m <> 2 AS searchable FROM f""")
def citation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that a biomedical citation matcher is asked for: with title, year, journal and first page."""
    r = refs(spark, sf_dir).select("sample_index", "context", "k", F.explode(F.array(parsing.parse_reference(F.col("context")))).alias("p"))
    lost = lambda name, m: F.when(F.col("k") % 5 == m, "").otherwise(F.col(f"p.{name}"))  # noqa: E731  # as where a parser found none
    page = identifiers.volume_first_page(F.col("context"))["page"]
    return r.select("sample_index", classify.biomedical(F.col("context")).alias("biomedical"), page.alias("page"), classify.citation_searchable(F.col("context"), lost("title", 0), lost("year", 1), lost("journal", 2), page).alias("searchable"))


# --- names that are alike ---------------------------------------------------------------------------------


def _journals_and_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References with the journal that a parser found, none in a quarter; works with their collection's name. Words are
    swapped, left out and added, so that names are alike by words and letters, not by containment."""
    number = (F.col("part") % 25).cast("string")
    form = F.col("k") % 4
    journal = F.when(form == 0, "").when(form == 1, _join("Dergisi Calisma No", number)).when(form == 2, _join("Çalışma Dergisi Yeni No", number, " Serisi")).otherwise(_join("Calismalar Dergileri No", number))
    r = refs(spark, sf_dir).select("sample_index", "context", journal.alias("parsed_journal"))
    w = works(spark, sf_dir).select("work_id", "title", _join("Calisma Dergisi No", F.col("work_id") % 25, F.when(F.col("work_id") % 3 == 0, " Ankara").otherwise("")).alias("set_name"))
    return r, w


@query()
def alike_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals and collections whose names are 0.55 or more alike, by words and by the ratio. No SQL, for the ratio."""
    r, w = _journals_and_sets(spark, sf_dir)
    return candidates.similar_names(r.filter("parsed_journal <> ''"), w, "parsed_journal", "set_name", similarity.name_similarity, 0.55)


@query()
def collection_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the records of collections named 0.55 or more like a reference's journal, or of all where it has none, the one
    that shares most title tokens. No SQL, for the ratio."""
    r, w = _journals_and_sets(spark, sf_dir)
    tokens = lambda c: text.tokens(text.normalize_text(F.col(c))).alias("tokens")
    return candidates.best_of_collections(r.select("sample_index", "parsed_journal", tokens("context")), w.select("work_id", "set_name", tokens("title")), "sample_index", "work_id", "parsed_journal", "set_name", "tokens", similarity.name_similarity, 0.55, 5)


# --- citations of every form -----------------------------------------------------------------------------


@query(f"""{o.WITH_BOTH}, c AS (SELECT sample_index, k, part, w.title AS t, 'Calisma Dergisi ' || part % 25 AS j, 1992 + part % 7 AS y FROM refs JOIN works w ON w.work_id = part)
  SELECT sample_index, CASE k % 7 WHEN 0 THEN 'quoted' WHEN 1 THEN 'apa' WHEN 2 THEN 'vancouver' WHEN 3 THEN 'loose_year' WHEN 4 THEN 'volume_pages' ELSE 'unparsed' END AS parser,
    CASE WHEN k % 7 < 5 THEN t ELSE '' END AS title, CASE WHEN k % 7 < 5 THEN j ELSE '' END AS journal, CASE WHEN k % 7 IN (4, 5) THEN '' ELSE CAST(y AS VARCHAR) END AS year,
    CASE WHEN k % 7 < 5 THEN 'Author' || part % 37 || CASE WHEN k % 7 IN (1, 2, 4) THEN ', A' ELSE '' END ELSE '' END AS authors,
    CASE WHEN k % 7 = 6 THEN t ELSE '' END AS title_before_year, CASE WHEN k % 7 = 6 THEN j ELSE '' END AS journal_before_year FROM c""")
def citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations written in each of the five forms and in none are parsed to what they were written from; title
    and journal before the year."""
    k, part = F.col("k"), F.col("part")
    r = refs(spark, sf_dir).select("sample_index", "k", "part").join(own_works(spark, sf_dir).select(F.col("work_id").alias("part"), F.col("title").alias("t")), "part")
    a, j, y = _join("Author", part % 37), _join("Calisma Dergisi ", part % 25), 1992 + part % 7
    t, v, i, p, q = F.col("t"), k % 40 + 1, k % 4 + 1, k % 90 + 1, k % 90 + 9
    pages = _join(p, "-", q)
    made = (
        F.when(k % 7 == 0, _join(a, ', "', t, '", ', j, ", ", v, "(", i, "), ", y, ", ", pages, "."))
        .when(k % 7 == 1, _join("[3] ", a, ", A. (", y, "). ", t, ". ", j, ", ", v, "(", i, "), ", pages, "."))
        .when(k % 7 == 2, _join(a, ", A. ", t, ". ", j, ". ", y, ";", v, "(", i, "):", pages, "."))
        .when(k % 7 == 3, _join(a, " ", y, ". ", t, ". ", j, ", ", v, "(", i, "): ", pages, "."))
        .when(k % 7 == 4, _join(a, ", A. ", t, ". ", j, ", ", v, "(", i, "): ", pages, "."))
        .when(k % 7 == 5, _join("Short note of ", a))
        .otherwise(_join(a, ", A. ", t, ". ", j, ". ", y))
    )
    r = r.select("sample_index", "k", made.alias("context"))
    parsed, around = parsing.parse_reference(F.col("context")), parsing.title_and_journal(F.col("context"))
    texts, number = lookup.distinct_texts(r, "context")
    made = texts.select("_text", F.explode(F.array(F.struct(parsed.alias("p"), around.alias("b")))).alias("s"))
    rows = r.select("sample_index", "k", number.alias("_text")).join(stored(made, "parsed_texts"), "_text")
    last = lambda n: F.when(k % 7 == 6, F.col(f"s.b.{n}")).otherwise("").alias(f"{n}_before_year")
    return rows.select("sample_index", "s.p.parser", "s.p.title", "s.p.journal", "s.p.year", "s.p.authors", last("title"), last("journal"))


# --- folding ---------------------------------------------------------------------------------------------

_ODD = "'Straße ẞ İstanbul’un IŞIK &amp; ' || context || ' l''été d’une çağ`ın using article international üzerine 1999'"
_LETTER = "[A-Za-zÇĞİÖŞÜçğıöşü]"
_JOINED = f"regexp_replace({_ODD}, '({_LETTER})[’''`´]({_LETTER})', '\\1\\2', 'g')"
_CASEFOLD = f"replace(replace({_ODD}, 'ß', 'ss'), 'ẞ', 'ss')"


@query(f"""{o.WITH_REFS}, f AS (SELECT sample_index, {o.fold(o.unescape(_ODD))} AS plain, {o.fold(_CASEFOLD)} AS casefold, {o.fold(_JOINED)} AS joined FROM refs)
  SELECT sample_index, sha256(plain) AS plain, sha256(casefold) AS casefold, sha256(joined) AS joined, array_to_string({o.tokens("plain", fixed.STOP_WORKS)}, ' ') AS works_tokens,
    len({o.tokens("casefold", fixed.STOP_REPARSE)})::INTEGER AS reparse_tokens, len({o.tokens("joined", fixed.STOP_INDEX)})::INTEGER AS index_tokens FROM f""")
def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways to fold a text, and the stop lists."""
    odd = _join("Straße ẞ İstanbul’un IŞIK &amp; ", F.col("context"), " l'été d’une çağ`ın using article international üzerine 1999")
    forms = F.struct(text.normalize_text(odd).alias("plain"), text.normalize_casefold(odd).alias("casefold"), text.normalize_joined(odd).alias("joined"))
    r = refs(spark, sf_dir).select("sample_index", F.inline(F.array(forms)))
    size = lambda c, stop: F.size(text.tokens(F.col(c), stop))
    return r.select(
        "sample_index", *(F.sha2(c, 256).alias(c) for c in ("plain", "casefold", "joined")), F.array_join(text.tokens(F.col("plain"), fixed.STOP_WORKS), " ").alias("works_tokens"),
        size("casefold", fixed.STOP_REPARSE).alias("reparse_tokens"), size("joined", fixed.STOP_INDEX).alias("index_tokens"),
    )
