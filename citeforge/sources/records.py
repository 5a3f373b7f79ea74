"""Structured records: TEI references, harvested metadata, result pages, search results."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.functions import fixed
from citeforge.functions.identifiers import normalize_doi_form, normalize_doi_works
from citeforge.functions.text import WHITE, latest_year, let, normalize_casefold, squeeze, strip, tokens
from citeforge.operators.ranking import best

# --- TEI ---------------------------------------------------------------------------------------------

_TEI = "publication_id string, parsed_index int, raw string, title string, journal string, date string, authors array<string>, surnames array<string>, idno string, volume string, issue string, pages string"


def _said(node) -> str:
    return "" if node is None else " ".join("".join(node.itertext()).split())


def _scope(bibl, *units: str) -> str:
    for node in bibl.iterfind(".//{*}biblScope"):
        if (node.get("unit") or node.get("type") or "").lower() in units:
            ends = [x for x in (node.get("from"), node.get("to")) if x]
            return "-".join(dict.fromkeys(ends)) if node.get("from") else _said(node)
    return ""


def _bibl(bibl) -> dict:
    people = bibl.findall("{*}analytic//{*}author") or bibl.findall("{*}monogr//{*}author")
    names, last = [], []
    for person in people:
        name = person.find(".//{*}persName")
        parts = [] if name is None else [_said(x) for x in name.iterfind(".//{*}forename")] + [_said(name.find(".//{*}surname"))]
        full = " ".join(filter(None, parts)) or _said(person)
        if full:
            names.append(full)
            last.append(_said(person.find(".//{*}surname")) or full)
    dates = (x for d in bibl.iterfind(".//{*}date") for x in (d.get("when") or "", _said(d)))
    ids = (_said(x) for x in bibl.iterfind(".//{*}idno") if (x.get("type") or "").lower() == "doi")
    return {
        "raw": _said(bibl.find(".//{*}note[@type='raw_reference']")),
        "title": _said(bibl.find("{*}analytic//{*}title[@level='a']")) or _said(bibl.find("{*}monogr//{*}title[@level='m']")),
        "journal": _said(bibl.find("{*}monogr//{*}title[@level='j']")),
        "date": next((d for d in dates if re.search(fixed.YEAR, d)), ""), "authors": names, "surnames": last,
        "idno": next((i for i in ids if re.sub(fixed.DOI_PREFIX, "", i.strip()).lstrip(fixed.TRIM_DOI).startswith("10.")), ""),
        "volume": _scope(bibl, "volume", "vol"), "issue": _scope(bibl, "issue"), "pages": _scope(bibl, "page", "pp"),
    }


def _tei_files(spark: SparkSession, directory: str, suffix: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory)
    return found.select(F.regexp_extract("path", rf"([^/]+){re.escape(suffix)}$", 1).alias("publication_id"), "content")


def first_place(files: DataFrame) -> DataFrame:
    """Of files of one publication (publication_id, place, content) those of its least place."""
    chosen = files.groupBy("publication_id").agg(F.min("place").alias("place"))
    return files.join(chosen, ["publication_id", "place"]).select("publication_id", "content")


def read_tei(spark: SparkSession, directories: list[str], suffix: str = ".tei.xml") -> DataFrame:
    """``tei_references`` of <publication id>.tei.xml files; of several directories the first that has a
    publication counts."""
    files = [_tei_files(spark, d, suffix).withColumn("place", F.lit(i)) for i, d in enumerate(directories)]
    return tei_references(first_place(functools.reduce(DataFrame.unionByName, files)))


def tei_references(files: DataFrame) -> DataFrame:
    """Structured references of documents (publication_id, content), numbered from 1 in each.

    A document that is no XML gives no rows. Years, DOIs and surnames are then taken by column functions.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _TEI.split(", ")]
        for batch in batches:
            rows = []
            for pub, content in zip(batch["publication_id"], batch["content"], strict=True):
                try:
                    root = ElementTree.fromstring(content)
                except ElementTree.ParseError:
                    continue
                rows += [{"publication_id": pub, "parsed_index": i} | _bibl(b) for i, b in enumerate(root.iterfind(".//{*}biblStruct"), 1)]
            yield pd.DataFrame(rows, columns=columns)

    raw = files.mapInPandas(parse, _TEI)
    year = F.coalesce(latest_year(F.col("date")), latest_year(F.col("raw"))).cast("string")
    given = normalize_doi_works(F.col("idno"))
    loose = normalize_doi_works(F.regexp_replace(F.regexp_extract("raw", fixed.DOI_LOOSE, 1), r"\s*/\s*", "/"))
    surname = lambda s: F.element_at(tokens(normalize_casefold(s), fixed.STOP_REPARSE), -1)
    named = F.filter(F.transform("surnames", lambda s: F.when(F.size(tokens(normalize_casefold(s), fixed.STOP_REPARSE)) > 0, surname(s))), lambda s: s.isNotNull())
    return raw.select(
        "publication_id", "parsed_index", "raw", "title", "journal", F.coalesce(year, F.lit("")).alias("year"), F.array_join("authors", "; ").alias("authors"), named.alias("surnames"),
        F.when(given.startswith("10."), given).otherwise(loose).alias("doi"), "volume", "issue", "pages",
    )


_TRAINING = "publication_id string, reference_order int, main string, author string, date string, journal string"


def read_training_tei(spark: SparkSession, directory: str) -> DataFrame:
    """``training_queries`` of <publication id>.training.references.tei.xml files."""
    return training_queries(_tei_files(spark, directory, ".training.references.tei.xml"))


def training_queries(files: DataFrame) -> DataFrame:
    """(publication_id, reference_order, query) of training documents, whose entries start ``N.``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pub, content in zip(batch["publication_id"], batch["content"], strict=True):
                try:
                    root = ElementTree.fromstring(content)
                except ElementTree.ParseError:
                    continue
                for bibl in root.iterfind(".//{*}bibl"):
                    number = re.match(r"(\d+)\s*[.)]", _said(bibl))
                    title = lambda level, b=bibl: _said(b.find(f".//{{*}}title[@level='{level}']"))
                    if number:
                        rows.append((pub, int(number[1]), title("a") or title("m"), _said(bibl.find(".//{*}author")), _said(bibl.find(".//{*}date")), title("j")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TRAINING.split(", ")])

    parts = [F.col("main"), F.split_part("author", F.lit(","), F.lit(1)), F.col("date"), F.col("journal")]
    rows = files.mapInPandas(parse, _TRAINING)
    query = squeeze(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))
    rows = rows.withColumns({"query": query, "at": F.monotonically_increasing_id()})
    return best(rows, ["publication_id", "reference_order"], [F.col("at")]).select("publication_id", "reference_order", F.nullif("query", F.lit("")).alias("query"))


# --- harvested records -------------------------------------------------------------------------------

_DC = "array<string>"
OAI_RECORD = (
    "header struct<identifier:string,datestamp:string>, metadata struct<dc:struct<"
    f"title:{_DC},creator:{_DC},identifier:{_DC},date:{_DC},publisher:{_DC},source:{_DC},type:{_DC}>>"
)


def _identified(ids: Column) -> tuple[Column, Column]:
    """(doi, url): of several the last counts."""
    dois = F.filter(F.transform(ids, normalize_doi_works), lambda d: d.startswith("10."))
    urls = F.filter(ids, lambda u: u.startswith("http"))
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
    return last(dois), last(urls)


def read_oai(spark: SparkSession, path: str) -> DataFrame:
    """``oai_records`` of a repository's XML answers."""
    return oai_records(spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", True).schema(OAI_RECORD).load(path))


def oai_records(raw: DataFrame) -> DataFrame:
    """Dublin Core records (columns as in OAI_RECORD) as flat rows."""
    clean = lambda n: F.filter(F.transform(F.coalesce(F.col(f"metadata.dc.{n}"), F.array().cast(_DC)), squeeze), lambda x: x != "")
    first = lambda n: F.coalesce(F.try_element_at(clean(n), F.lit(1)), F.lit(""))
    doi, url = _identified(clean("identifier"))
    by_id = F.regexp_extract("header.identifier", "article/([0-9]+)", 1)
    by_url = F.filter(F.transform(clean("identifier"), lambda u: F.regexp_extract(u, "/(?:article|issue/[0-9]+)/([0-9]+)", 1)), lambda x: x != "")
    dated = F.filter(F.transform(clean("date"), lambda d: F.regexp_extract(d, "(19[0-9]{2}|20[0-3][0-9])", 1)), lambda y: y != "")
    return raw.select(
        F.trim(F.coalesce("header.identifier", F.lit(""))).alias("oai_identifier"), F.trim(F.coalesce("header.datestamp", F.lit(""))).alias("oai_datestamp"),
        F.coalesce(F.nullif(by_id, F.lit("")), F.try_element_at(by_url, F.lit(1)), F.lit("")).alias("article_id"), first("title").alias("title"), clean("creator").alias("creators"),
        clean("identifier").alias("identifiers"), doi.alias("doi"), url.alias("url"), F.try_element_at(dated, F.lit(1)).cast("int").alias("year"),
        first("publisher").alias("publisher"), first("source").alias("source"), first("type").alias("type"),
    )


def _lines_of(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: strip(x, WHITE))


def _after(lines: Column, prefix: str) -> Column:
    """What follows a prefix in the lines that have it."""
    return F.transform(F.filter(lines, lambda x: x.startswith(prefix)), lambda x: squeeze(F.substring(x, F.lit(len(prefix) + 1), F.length(x))))


def _described(lines: Column, year: str) -> dict[str, Column]:
    first = lambda p: F.coalesce(F.try_element_at(_after(lines, p), F.lit(1)), F.lit(""))
    ids = _after(lines, "Resource Identifier ")
    doi, url = _identified(ids)
    years = F.filter(F.transform(_after(lines, "Date "), lambda d: F.regexp_extract(d, year, 1)), lambda y: y != "")
    return {
        "title": first("Title "), "creators": _after(lines, "Author or Creator "), "identifiers": ids, "doi": doi, "url": url, "year": F.try_element_at(years, F.lit(1)).cast("int"),
        "publisher": first("Publisher "), "source": first("Source "), "type": first("Resource Type "),
    }


def record_page(markdown: Column, article_id: Column) -> Column:
    """struct of a record shown as Markdown, null if there is no such section."""
    section = F.split(F.when(markdown.contains("### Dublin Core Metadata"), F.element_at(F.split(markdown, "### Dublin Core Metadata", 2), -1)).otherwise(F.element_at(F.split(markdown, "Markdown Content:", 2), -1)), r"\n\*   \[Identify\]|\n## \[About", 2)[0]
    named = F.nullif(F.trim(F.regexp_extract(markdown, r"OAI Record:\s*([^\n]+)", 1)), F.lit(""))

    def of(lines: Column) -> Column:
        d = _described(lines, "(19[0-9]{2}|20[0-3][0-9])")
        return F.struct(F.coalesce(named, F.concat(F.lit("article/"), article_id)).alias("oai_identifier"), article_id.alias("article_id"), *(c.alias(n) for n, c in d.items()))

    return F.when(markdown.contains("Markdown Content:"), let(_lines_of(section), of))


def record_list(pages: DataFrame) -> DataFrame:
    """One row per titled record of Markdown list pages (columns markdown, set_spec, set_name)."""
    chunks = F.split("markdown", r"\n## OAI Record:\s*")
    each = pages.select("set_spec", "set_name", F.explode(F.slice(chunks, F.lit(2), F.size(chunks))).alias("chunk"))
    each = each.withColumn("lines", _lines_of(F.col("chunk")))
    d = _described(F.col("lines"), fixed.YEAR_WIDE)
    rows = each.select(F.element_at("lines", 1).alias("oai_identifier"), "set_spec", "set_name", *(d[n].alias(n) for n in ("title", "creators", "year", "doi", "url", "source")))
    return rows.filter("title <> ''").withColumn("source", F.coalesce(F.nullif("source", F.lit("")), "set_name"))


def set_list(markdown: Column) -> Column:
    """array<struct<set_name, set_spec>> of a page that lists collections."""
    get = lambda g: F.regexp_extract_all(markdown, F.lit(fixed.SET_PAIR), F.lit(g))
    return F.zip_with(get(1), get(2), lambda n, s: F.struct(squeeze(n).alias("set_name"), s.alias("set_spec")))


# --- result pages and searches -----------------------------------------------------------------------


class _Lines(HTMLParser):
    """Visible text pieces of a page, and its links."""

    def __init__(self) -> None:
        super().__init__()
        self.pieces: list[str] = []
        self.links: list[str] = []

    def handle_data(self, data: str) -> None:
        self.pieces += filter(None, (x.strip() for x in data.splitlines()))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.links.append(dict(attrs).get("href") or "")


def form_answers(pages: DataFrame) -> DataFrame:
    """(batch, pos, doi) of a matching form's result pages (columns batch, html, n).

    Under each numbered line the first DOI link belongs to it. If no line has any, links count in
    their order on the page.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        link = re.compile(r"https?://doi\.org/(10\.\S+)", re.I)
        for b in batches:
            rows = []
            for batch, html, n in zip(b["batch"], b["html"], b["n"], strict=True):
                page = _Lines()
                page.feed(html or "")
                at, found = None, {}
                for piece in page.pieces:
                    number, doi = re.match(r"([0-9]{1,4})\.\s+", piece), link.search(piece)
                    if number:
                        at = int(number[1])
                    elif doi and at is not None and 1 <= at <= n:
                        found.setdefault(at, doi[1])
                if not found:
                    found = dict(enumerate([m[1] for m in map(link.match, page.links) if m][:n], 1))
                rows += [(batch, i, found.get(i)) for i in range(1, n + 1)]
            yield pd.DataFrame(rows, columns=["batch", "pos", "doi"])

    rows = pages.select("batch", "html", "n").mapInPandas(parse, "batch long, pos int, doi string")
    return rows.withColumn("doi", F.when(F.col("doi").isNotNull(), normalize_doi_form(F.col("doi"))))


def form_key(html: Column, name: str = "key") -> Column:
    """The value of a hidden form field."""
    return F.regexp_extract(html, rf"(?i)name=[\"']{name}[\"'][^>]*value=[\"']([^\"']+)", 1)


def citation_answer(raw: Column) -> Column:
    """The numeric id that ends a pipe-separated answer, else ''."""
    last = strip(F.element_at(F.split(raw, r"\|"), -1), WHITE)
    return F.when(last.rlike("^[0-9]+$"), last).otherwise(F.lit(""))


def mock_results(query: Column) -> Column:
    """array<struct<link, title>>: a deterministic provider for tests and offline runs."""
    hit = lambda n, t: F.struct(F.lit(f"https://example.org/{n}").alias("link"), F.lit(t).alias("title"))
    low = F.lower(query)
    return F.when(low.contains("unique"), F.array(hit("mock", "Mock unique result"))).when(low.contains("empty"), F.array().cast("array<struct<link:string,title:string>>")).otherwise(F.array(hit("mock-1", "Mock result 1"), hit("mock-2", "Mock result 2")))
