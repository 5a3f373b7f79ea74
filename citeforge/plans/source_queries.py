"""Queries over what the readers and writers do: rows become files or pages and are read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.functions import fixed, text
from citeforge.operators import summary
from citeforge.plans import oracle as o
from citeforge.plans.registry import query
from citeforge.plans.views import refs, table, works
from citeforge.sources import files, records, sinks
from citeforge.sources.shared import shared_path


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _join(*parts: Column | str) -> Column:
    """Texts and columns in a row; plain strings are texts, not names."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def listed(array: Column) -> Column:
    return F.array_join(array, ";")


def _known(name: str, of: str = "") -> Column:
    """A number; -1 for none."""
    return F.coalesce(F.col(of or name), F.lit(-1)).alias(name)


# --- files -------------------------------------------------------------------------------------------


@query(f"""{o.WITH_REFS} SELECT publication_id + CASE WHEN k % 2 = 0 THEN 7 ELSE 0 END AS publication_id, CASE WHEN k % 5 <> 0 THEN k ELSE -1 END AS reference_id, CAST(reference_order AS INT) AS reference_order,
  trim(regexp_replace(context, '\\s+', ' ', 'g')) || ' end' AS context, 'J' || part % 25 AS journal_code, CASE WHEN k % 4 > 0 THEN k % 4 ELSE -1 END AS target_id FROM refs WHERE k % 13 <> 0""")
def stored_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested publications as JSON lines, blank lines between; blank contexts and
    publications without metadata go."""
    k = F.col("k")
    own = F.struct(
        F.when(k % 5 != 0, k.cast("string")).otherwise("none").alias("id"), _text("reference_order").alias("order"), _join("  ", F.col("context"), " \n end ").alias("context"),
        F.lit("1999").alias("year"), _join("J", F.col("part") % 25).alias("journalCode"), (k % 4).cast("string").alias("targetPublication"),
    )
    blank = F.struct(F.lit("1").alias("id"), F.lit("1").alias("order"), F.lit(" \t ").alias("context"), *(F.lit(None).cast("string").alias(n) for n in ("year", "journalCode", "targetPublication")))
    meta = F.struct(F.when(k % 2 == 0, (F.col("publication_id") + 7).cast("string")).alias("id"), F.array(own, blank).alias("references"))
    line = F.to_json(F.struct(_text("publication_id").alias("id"), F.when(k % 13 != 0, meta).alias("metadata")))
    path = shared_path(spark, "publications.jsonl")
    refs(spark, sf_dir).select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    rows = files.references(files.read_publications(spark, path))
    return rows.select("publication_id", _known("reference_id"), "reference_order", "context", "journal_code", _known("target_id"))


@query("""WITH r AS (SELECT c_custkey AS id, '0' || c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 THEN 'a "' || c_name || '", b' || chr(10) || 'next' ELSE '' END AS note FROM customer)
  SELECT 'csv' AS form, key, note, '' AS absent FROM r UNION ALL SELECT 'jsonl', key, note, '' FROM r""")
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat tables as CSV and JSON lines, read back by their paths' endings."""
    note = F.when(F.col("c_custkey") % 3 != 0, _join('a "', F.col("c_name"), '", b\nnext'))
    rows = table(spark, sf_dir, "customer").select(_join("0", F.col("c_custkey")).alias("key"), note.alias("note"), F.lit("left out").alias("other"))
    csv, jsonl = shared_path(spark, "table.csv"), shared_path(spark, "table.jsonl")
    sinks.write_csv(rows, csv, ["key", "note", "absent"])
    sinks.write_jsonl(rows, jsonl)
    filled = lambda c: F.coalesce(c, F.lit("")).alias
    a = files.read_rows(spark, csv, "").select(F.lit("csv").alias("form"), "key", filled(F.col("note"))("note"), filled(F.col("absent"))("absent"))
    b = files.read_rows(spark, jsonl, "key string, note string").select(F.lit("jsonl").alias("form"), "key", filled(F.col("note"))("note"), F.lit("").alias("absent"))
    return a.unionByName(b)


@query(f"""{o.WITH_BOTH}, lk AS (SELECT 'doi:' || doi AS key, status, CASE WHEN status = 'found' THEN title ELSE '' END AS title FROM works WHERE work_id % 4 <> 3)
  SELECT r.sample_index, coalesce(lk.status, 'not_checked') AS status, coalesce(lk.title, '') AS title FROM refs r LEFT JOIN lk ON lk.key = 'doi:10.5555/part.' || r.part""")
def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as JSON lines and as batches of a store, read and joined by request key."""
    w = works(spark, sf_dir).withColumn("key", _join("doi:", F.col("doi")))
    item = F.array(F.struct("doi", "title", F.col("year").cast("int").alias("year")))
    answer = w.select("work_id", "key", "status", F.when(F.col("status") == "found", item).alias("items"))
    lines, store = shared_path(spark, "lookup.jsonl"), shared_path(spark, "lookup")
    sinks.write_jsonl(answer.filter("work_id % 4 = 0").drop("work_id"), lines)
    for part in (1, 2):
        sinks.append_lookup(answer.filter(f"work_id % 4 = {part}").select("key", "status", F.col("items")[0]["title"].alias("title")), store)
    known = files.read_lookup_lines(spark, lines).select("key", "status", F.col("items")[0]["title"].alias("title")).unionByName(spark.read.parquet(store))
    r = refs(spark, sf_dir).select("sample_index", _join("doi:10.5555/part.", F.col("part")).alias("key"))
    return r.join(known, "key", "left").select("sample_index", F.coalesce("status", F.lit("not_checked")).alias("status"), F.coalesce("title", F.lit("")).alias("title"))


@query("""SELECT 'doi:' || n_nationkey AS key, 'ok' AS status, CAST(200 AS INT) AS http_status, n_name AS title, CAST(1 AS INT) AS pos, '10.5555/n.' || n_nationkey AS doi FROM nation
  UNION ALL SELECT 'doi:' || n_nationkey, 'ok', CAST(200 AS INT), n_name, CAST(2 AS INT), NULL FROM nation""")
def lookup_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: whole-file JSON objects, of answers and of arrays by payload. The nations are a table of fixed size."""
    key = _join("doi:", F.col("n_nationkey"))
    answer = F.struct(F.lit("ok").alias("status"), F.lit(200).alias("http_status"), F.array(F.struct(F.col("n_name").alias("title"))).alias("items"))
    found = F.array(_join("10.5555/n.", F.col("n_nationkey")), F.lit(None).cast("string"))
    nations = table(spark, sf_dir, "nation")
    paths = []
    for name, value in (("lookup.json", answer), ("answers.json", found)):
        whole = nations.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("v")).first().v
        paths.append(shared_path(spark, name))
        sinks.write_text(spark, paths[-1], whole)
    rows = files.read_lookup(spark, paths[0]).select("key", "status", "http_status", F.col("items")[0]["title"].alias("title"))
    return rows.join(files.read_answers(spark, paths[1]), "key")


@query("""SELECT o_orderkey AS publication_id, o_custkey AS reference_order, CAST(o_orderkey % 9 AS INT) AS parsed_index, CASE WHEN o_orderkey % 9 = 0 THEN 'no_match' ELSE 'matched' END AS status FROM orders""")
def match_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of match reports; orders that are no integer go, the last decision wins."""
    k = F.col("o_orderkey")
    d = lambda order, index, status: F.struct(order.alias("order"), index.cast("int").alias("parsed_index"), status.alias("status"))
    own = _text("o_custkey")
    decisions = F.array(d(own, F.lit(99), F.lit("first")), d(F.lit("x"), F.lit(1), F.lit("odd")), d(own, k % 9, F.when(k % 9 == 0, "no_match").otherwise("matched")))
    path = shared_path(spark, "report.jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "orders").select(k.alias("publication_id"), decisions.alias("decisions")), path)
    return files.read_match_report(spark, path).drop("score")


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_mktsegment = 'MACHINERY') AS m FROM customer)
  SELECT 'json' AS form, '{' || chr(10) || '  "machinery": ' || m || ',' || chr(10) || '  "total": ' || n || chr(10) || '}' || chr(10) AS report FROM c
  UNION ALL SELECT 'markdown', '# Customers' || chr(10) || chr(10) || '| measure | value |' || chr(10) || '|---|---:|' || chr(10) || '| total | ' || n || ' |' || chr(10) || '| machinery | ' || m || ' |' || chr(10) FROM c""")
def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-row summary as sorted JSON and as Markdown, written and read back."""
    counts = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("total"), summary.count_where(F.col("c_mktsegment") == "MACHINERY").alias("machinery"))
    out = None
    for form, report in (("json", sinks.summary_json(counts)), ("markdown", sinks.summary_markdown(counts, "Customers"))):
        path = shared_path(spark, f"summary.{form}")
        sinks.write_text(spark, path, report)
        rows = spark.read.text(path, wholetext=True).select(F.lit(form).alias("form"), F.col("value").alias("report"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- XML ---------------------------------------------------------------------------------------------


def _tag(name: str, *body: Column | str, attributes: str = "") -> Column:
    return _join(f"<{name}{attributes}>", *body, f"</{name}>")


@query(f"""{o.WITH_BOTH} SELECT CAST(work_id AS VARCHAR) AS publication_id, CAST(1 AS INT) AS parsed_index, CASE WHEN work_id % 3 = 0 THEN 'Early ' ELSE '' END || title AS title, CASE WHEN work_id % 2 = 0 THEN journal ELSE '' END AS journal,
  CAST(CASE WHEN work_id % 5 = 0 THEN list_max(list_transform({o.every("'Raw ' || (year - 3) || ', ' || (year + 1) || ' 10.7777 / RAW.' || work_id", fixed.YEAR)}, lambda v: CAST(v AS INT))) ELSE year END AS VARCHAR) AS year, CASE WHEN work_id % 2 = 0 THEN 'Jane van Author' || work_id % 37 || '; Roe' ELSE 'Poe' END AS authors,
  CASE WHEN work_id % 2 = 0 THEN surname || ';roe' ELSE 'poe' END AS surnames, CASE WHEN work_id % 7 = 0 THEN '10.7777/raw.' || work_id ELSE doi END AS doi, CAST(work_id % 40 AS VARCHAR) AS volume,
  CASE WHEN work_id % 2 = 0 THEN work_id || '-' || (work_id + 9) ELSE 'p. ' || work_id END AS pages, 'Raw ' || (year - 3) || ', ' || (year + 1) || ' 10.7777 / RAW.' || work_id AS raw FROM works WHERE work_id % 11 <> 0""")
def tei_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured references in XML; the first place that has a publication counts, broken
    XML gives nothing; titles, dates and DOIs by precedence."""
    k = F.col("work_id")
    even = k % 2 == 0
    title = _join(F.when((k % 3 == 0) & (F.col("place") == 0), "Early\n ").otherwise(""), F.col("title"))
    people = F.when(even, _join(_tag("author", _tag("persName", _tag("forename", "Jane"), _tag("surname", "van  Author", k % 37))), _tag("author", "Roe"))).otherwise(_tag("author", _tag("persName", _tag("surname", "Poe"))))
    date = F.when(k % 5 == 0, _join('<date when="n.d."/>')).otherwise(_join('<date when="', F.col("year"), '-03"/>'))
    page = F.when(even, _join('<biblScope unit="page" from="', k, '" to="', k + 9, '"/>')).otherwise(_tag("biblScope", "p. ", k, attributes=' unit="pp"'))
    imprint = _tag("imprint", date, _tag("biblScope", k % 40, attributes=' unit="volume"'), page)
    monogr = F.when(even, _tag("monogr", _tag("title", F.col("journal"), attributes=' level="j"'), imprint)).otherwise(_tag("monogr", _tag("title", title, attributes=' level="m"'), people, imprint))
    analytic = F.when(even, _tag("analytic", _tag("title", title, attributes=' level="a"'), people)).otherwise("")
    doi = _join(_tag("idno", "see PMID", attributes=' type="DOI"'), F.when(k % 7 == 0, "").otherwise(_tag("idno", "https://doi.org/", F.col("doi"), attributes=' type="doi"')))
    note = _tag("note", "Raw ", F.col("year") - 3, ", ", F.col("year") + 1, " 10.7777 / RAW.", k, attributes=' type="raw_reference"')
    whole = _tag("TEI", _tag("listBibl", _tag("biblStruct", analytic, monogr, doi, note)), attributes=' xmlns="http://www.tei-c.org/ns/1.0"')
    xml = F.when(k % 11 == 0, "<TEI><broken").otherwise(whole)
    placed = works(spark, sf_dir).withColumn("place", F.explode(F.array(F.lit(0), F.lit(1)))).filter((F.col("place") == 1) | (k % 3 == 0))
    rows = records.tei_references(records.first_place(placed.select(k.cast("string").alias("publication_id"), "place", F.encode(xml, "UTF-8").alias("content"))))
    return rows.select("publication_id", "parsed_index", "title", "journal", "year", "authors", listed(F.col("surnames")).alias("surnames"), "doi", "volume", "pages", "raw")


@query(f"""{o.WITH_BOTH} SELECT CAST(work_id AS VARCHAR) AS publication_id, CAST(work_id % 40 + 1 AS INT) AS reference_order,
  CASE WHEN work_id % 5 = 0 THEN NULL ELSE title || ' Author' || work_id % 37 || CASE WHEN work_id % 2 = 0 THEN ' ' || year || ' ' || journal ELSE '' END END AS query FROM works""")
def training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from numbered entries of training documents; of two with one number the first counts."""
    k = F.col("work_id")
    kind = F.when(k % 3 == 0, _tag("title", F.col("title"), attributes=' level="m"')).otherwise(_tag("title", F.col("title"), attributes=' level="a"'))
    end = F.when(k % 2 == 0, _join(_tag("date", F.col("year")), _tag("title", F.col("journal"), attributes=' level="j"'))).otherwise("")
    number = _join(k % 40 + 1, F.when(k % 4 == 0, ") ").otherwise(". "))
    filled = _tag("bibl", number, _tag("author", "Author", k % 37, ", J."), kind, end)
    xml = _tag("tei", F.when(k % 5 == 0, _tag("bibl", number)).otherwise(filled), _tag("bibl", number, _tag("date", "1900")), _tag("bibl", "no number"))
    return records.training_queries(works(spark, sf_dir).select(k.cast("string").alias("publication_id"), F.encode(xml, "UTF-8").alias("content")))


@query(f"""{o.WITH_BOTH} SELECT 'oai:x:' || CASE WHEN work_id % 2 = 0 THEN 'article/' || work_id ELSE 'none' END AS oai_identifier, '2020-01-02' AS oai_datestamp, CAST(CASE WHEN work_id % 2 = 0 THEN work_id ELSE work_id + 1 END AS VARCHAR) AS article_id,
  title, 'Doe, J;' || surname AS creators, doi, 'https://doi.org/' || doi AS url, CAST(CASE WHEN work_id % 3 <> 0 THEN year ELSE -1 END AS INT) AS year, publisher, CASE WHEN work_id % 2 = 0 THEN journal ELSE '' END AS source, 'text' AS type FROM works""")
def harvested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dublin Core records of XML answers; the last DOI and URL count, the first date with a year."""
    k = F.col("work_id")
    dc = lambda name, *body: _tag(f"dc:{name}", *body)
    head = _tag("header", _tag("identifier", "oai:x:", F.when(k % 2 == 0, _join("article/", k)).otherwise("none")), _tag("datestamp", "2020-01-02"))
    ids = _join(dc("identifier", "https://x.org/y/issue/3/", k + 1), dc("identifier", "10.1/other"), dc("identifier", "https://doi.org/", F.col("doi")))
    dates = _join(dc("date", "undated"), F.when(k % 3 == 0, "").otherwise(_join(dc("date", "in ", F.col("year")), dc("date", "2039"))))
    source = F.when(k % 2 == 0, dc("source", F.col("journal"))).otherwise("")
    body = _join(dc("title", "  ", F.col("title"), "\n"), dc("creator", "Doe, J"), dc("creator", " "), dc("creator", F.col("surname")), ids, dates, dc("publisher", F.col("publisher")), source, dc("type", "text"))
    record = _tag("record", head, _tag("metadata", _tag("oai_dc:dc", body, attributes=' xmlns:oai_dc="o" xmlns:dc="d"')))
    raw = works(spark, sf_dir).select(F.from_xml(record, records.OAI_RECORD, {"ignoreNamespace": "true"}).alias("r")).select("r.*")
    rows = records.oai_records(raw)
    return rows.select("oai_identifier", "oai_datestamp", "article_id", "title", listed(F.col("creators")).alias("creators"), "doi", "url", _known("year"), "publisher", "source", "type")


# --- pages -------------------------------------------------------------------------------------------


@query(f"""{o.WITH_BOTH} SELECT work_id, CASE WHEN work_id % 2 = 0 THEN 'oai:' || work_id ELSE 'article/' || work_id END AS oai_identifier, title, 'Doe;' || surname AS creators,
  CAST(CASE WHEN work_id % 3 <> 0 THEN year ELSE -1 END AS INT) AS year, doi, 'http://x.org/' || work_id AS url, publisher FROM works WHERE work_id % 7 <> 0""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records shown as Markdown; single fields keep the first line, lists all; a page without content is none."""
    k = F.col("work_id")
    lines = _join(
        "Title ", F.col("title"), "\nTitle Second\nAuthor or Creator Doe\n  Author or Creator  ", F.col("surname"), F.when(k % 3 == 0, "").otherwise(_join("\nDate in ", F.col("year"), "-02\nDate 2039")),
        "\nResource Identifier http://x.org/", k, "\nResource Identifier 10.1/other\nResource Identifier ", F.upper("doi"), "\nPublisher ", F.col("publisher"), "\n*   [Identify] \nTitle Not this",
    )
    page = F.when(k % 7 == 0, "nothing").otherwise(_join("Markdown Content:\nTitle Menu\n", F.when(k % 2 == 0, _join("OAI Record: oai:", k, "\n")).otherwise(""), "### Dublin Core Metadata\n", lines))
    rows = works(spark, sf_dir).select(k, records.record_page(page, k.cast("string")).alias("r")).filter("r is not null")
    return rows.select("work_id", "r.oai_identifier", "r.title", listed(F.col("r.creators")).alias("creators"), _known("year", "r.year"), "r.doi", "r.url", "r.publisher")


@query(f"""{o.WITH_BOTH} SELECT 'r' || work_id AS oai_identifier, 's' || work_id % 9 AS set_spec, title, surname AS creators, CAST(year - 120 AS INT) AS year, CASE WHEN work_id % 2 = 0 THEN journal ELSE 'Set ' || work_id % 9 END AS source FROM works
  UNION ALL SELECT 'x' || work_id, 's' || work_id % 9, 'Second', '', -1, 'Set ' || work_id % 9 FROM works""")
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titled records of list pages; the source defaults to the collection's name."""
    k = F.col("work_id")
    page = _join(
        "head\n## OAI Record: r", k, "\nTitle ", F.col("title"), "\nAuthor or Creator ", F.col("surname"), "\nDate ", F.col("year") - 120, F.when(k % 2 == 0, _join("\nSource ", F.col("journal"))).otherwise(""),
        "\n## OAI Record: n", k, "\nDate 2000\n## OAI Record: x", k, "\nTitle  Second",
    )
    rows = records.record_list(works(spark, sf_dir).select(page.alias("markdown"), _join("s", k % 9).alias("set_spec"), _join("Set ", k % 9).alias("set_name")))
    return rows.select("oai_identifier", "set_spec", "title", listed(F.col("creators")).alias("creators"), _known("year"), "source")


@query("""SELECT n_nationkey AS page, n_name AS set_name, 's.' || n_nationkey AS set_spec FROM nation UNION ALL SELECT n_nationkey, 'Other ' || n_nationkey, 'o-' || n_nationkey FROM nation""")
def page_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and key of every collection that a page lists."""
    k = F.col("n_nationkey")
    page = _join("List setName  ", F.col("n_name"), " setSpec s.", k, " \n setName Other\n", k, "  setSpec o-", k, "\nend")
    return table(spark, sf_dir, "nation").select(k.alias("page"), F.explode(records.set_list(page)).alias("s")).select("page", "s.set_name", "s.set_spec")


@query("""SELECT o_orderkey AS batch, CAST(pos AS INT) AS pos, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN pos < 3 THEN '10.5555/l' || pos || '.' || o_orderkey END
  WHEN pos = 1 THEN '10.5555/a.' || o_orderkey WHEN pos = 3 THEN '10.5555/c.' || o_orderkey END AS doi, 'k' || o_orderkey AS form_key FROM orders, (SELECT unnest([1, 2, 3]) AS pos)""")
def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a matching form under their numbered lines, else by the order of links; its hidden key."""
    k = F.col("o_orderkey")
    hidden = _join('<input type="hidden" name="key" id="a" value="k', k, '">')
    numbered = _join("<p>1. Doe 1999.</p><p>https://doi.org/10.5555/A.", k, ".</p><p>https://doi.org/10.5555/b</p><p>2. Roe</p><p>3. Poe</p><p>see https://doi.org/10.5555/C.", k, "</p><p>9. Out https</p><p>https://doi.org/10.5555/z</p>")
    links = _join("<a href='https://doi.org/10.5555/l1.", k, "'>x</a><a href='https://other.org/'>y</a><a href='https://doi.org/10.5555/L2.", k, "'>z</a>")
    pages = table(spark, sf_dir, "orders").select(k.alias("batch"), _join(hidden, F.when(k % 3 == 0, links).otherwise(numbered)).alias("html"), F.lit(3).alias("n"))
    keys = pages.select("batch", records.form_key(F.col("html")).alias("form_key"))
    return records.form_answers(pages).join(keys, "batch").select("batch", "pos", "doi", "form_key")


@query("""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Unique query' WHEN 1 THEN 'an EMPTY one' ELSE 'other' END AS q FROM events)
  SELECT event_id, 'https://example.org/mock' AS link, 'Mock unique result' AS title FROM e WHERE q LIKE 'Unique%' UNION ALL SELECT event_id, 'https://example.org/mock-' || i, 'Mock result ' || i FROM e, (SELECT unnest([1, 2]) AS i) WHERE q = 'other'""")
def mock_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic provider: one result, none or two."""
    k = F.col("event_id") % 3
    q = F.when(k == 0, "Unique query").when(k == 1, "an EMPTY one").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", F.explode(records.mock_results(q)).alias("r")).select("event_id", "r.link", "r.title")


@query("""SELECT o_orderkey, o_orderkey % 5 < 4 AS truthy, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE -1 END AS number, CASE o_orderkey % 4 WHEN 0 THEN 'a' || o_orderkey WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS filled,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS answer, CASE WHEN o_orderkey % 2 = 0 THEN 'X-RateLimit-Limit=' || o_orderkey || ';x-ratelimit-reset=5' ELSE 'x-ratelimit-reset=5' END AS limits, true AS stamped FROM orders""")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and numbers of fields, the first filled alias, the id of a piped answer, the
    quota's headers, the form of a time stamp."""
    k = F.col("o_orderkey")
    said = F.element_at(F.array(*(F.lit(v) for v in (" YES ", "1", "True", "y", "no"))), (k % 5 + 1).cast("int"))
    number = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, _join("-", k)).otherwise(_join(k, ".0"))
    aliases = (F.when(k % 4 == 0, _join(" a", k)), F.when(k % 4 == 1, "b ").otherwise(" "), F.when(k % 4 == 2, "c"), F.lit(""))
    answer = _join("J|1999|2||a||", F.when(k % 2 == 0, k.cast("string")).otherwise("NOT_FOUND"), "\n")
    headers = F.create_map(F.lit("X-RateLimit-Limit"), F.when(k % 2 == 0, k.cast("string")), F.lit("server"), F.lit("x"), F.lit("x-ratelimit-reset"), F.lit("5"))
    limits = F.array_join(F.transform(F.map_entries(text.limit_headers(headers)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.truthy(said).alias("truthy"), F.coalesce(text.as_int(number), F.lit(-1)).alias("number"), text.first_filled(*aliases).alias("filled"), records.citation_answer(answer).alias("answer"),
        limits.alias("limits"), text.utc_now().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$").alias("stamped"),
    )
