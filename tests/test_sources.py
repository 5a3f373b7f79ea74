"""Readers, writers and the incremental store on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from citeforge.operators.summary import match_summary
from citeforge.sources import files, records, sinks
from citeforge.streaming import incremental


def test_publications(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    rows = [
        {"id": 1, "metadata": {"id": "7", "references": [{"id": 3, "order": "2", "context": " a\n b ", "targetPublication": "12"}, {"id": "x", "order": None, "context": "  "}]}},
        {"id": "9", "metadata": {"references": [{"context": "c", "targetPublication": 0}, {"context": "\t\n"}]}},
        {"id": 2},
    ]
    p.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    got = files.references(files.read_publications(spark, str(p))).orderBy("publication_id").collect()
    assert [(r.publication_id, r.reference_id, r.reference_order, r.context, r.target_id) for r in got] == [(7, 3, 2, "a b", 12), (9, None, None, "c", None)]
    p.write_text('{"id": 1}\n{broken\n')
    with pytest.raises(Exception, match="invalid JSON line"):
        files.read_publications(spark, str(p)).collect()
    assert files.read_publications(spark, str(p), strict=False).count() == 1


def test_tables(spark, tmp_path):
    c = tmp_path / "t.csv"
    c.write_text('﻿id,context\n01,"two\nlines, ""quoted"""\n')
    assert [tuple(r) for r in files.read_rows(spark, str(c), "").collect()] == [("01", 'two\nlines, "quoted"')]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_csv(spark, str(tmp_path / "none.csv"), ["id"])
    assert files.read_csv(spark, str(tmp_path / "none.csv"), ["id"], optional=True).count() == 0
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int", optional=True).count() == 0
    with pytest.raises(ValueError, match="neither"):
        files.read_rows(spark, "x.txt", "")


def test_lookup_files(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"doi:a": {"status": "ok", "http_status": 200, "items": [{"doi": "a", "title": "T"}]}, "b": None}))
    assert [(r.key, r.status, r["items"][0].title) for r in files.read_lookup(spark, str(p)).collect()] == [("doi:a", "ok", "T")]
    p.write_text(json.dumps({"k": ["10.1/a", None]}))
    assert [tuple(r) for r in files.read_answers(spark, str(p)).collect()] == [("k", 1, "10.1/a"), ("k", 2, None)]
    p.write_text('{"publication_id": 1, "decisions": [{"order": "1", "parsed_index": 2}, {"order": "x", "parsed_index": 3}, {"order": 1, "parsed_index": 4}]}\n')
    assert [(r.reference_order, r.parsed_index) for r in files.read_match_report(spark, str(p)).collect()] == [(1, 4)]


def test_lookup_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"key": "doi:a", "status": "ok", "items": [{"doi": "a"}]}\n{"status": "ok"}\n')
    assert [(r.key, r.status, r["items"][0].doi) for r in files.read_lookup_lines(spark, str(p)).collect()] == [("doi:a", "ok", "a")]
    (tmp_path / "broken.json").write_text("[1]")
    assert files.read_lookup(spark, str(tmp_path / "broken.json")).collect() == []


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><listBibl>
<biblStruct><analytic><title level="a">Small  birds</title><author><persName><forename>Jane</forename><surname>van Doe</surname></persName></author><author>Roe</author></analytic>
<monogr><title level="j">J Birds</title><imprint><date when="n.d."/><date when="2015-03"/><biblScope unit="volume">8</biblScope><biblScope unit="page" from="60" to="69"/></imprint></monogr>
<idno type="DOI">see PMID</idno><idno type="DOI">10.1234/X.</idno><note type="raw_reference">raw one</note></biblStruct>
<biblStruct><monogr><title level="m">A book</title><author><persName><surname>Poe</surname></persName></author></monogr><note type="raw_reference">Poe 1999, 2001. 10.5555 / zz</note></biblStruct>
</listBibl></text></TEI>"""


def test_tei(spark, tmp_path):
    for d, body in (("a", TEI), ("b", TEI.replace("Small", "Large"))):
        (tmp_path / d).mkdir()
        (tmp_path / d / "5.tei.xml").write_text(body)
    (tmp_path / "b" / "6.tei.xml").write_text("<broken")
    got = records.read_tei(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("publication_id", "parsed_index").collect()
    assert len(got) == 2
    one, two = got
    assert (one.title, one.journal, one.year, one.authors, list(one.surnames), one.doi, one.volume, one.pages) == ("Small birds", "J Birds", "2015", "Jane van Doe; Roe", ["doe", "roe"], "10.1234/x", "8", "60-69")
    assert (two.title, two.year, two.doi, two.raw) == ("A book", "2001", "10.5555/zz", "Poe 1999, 2001. 10.5555 / zz")


def test_training_tei(spark, tmp_path):
    (tmp_path / "5.training.references.tei.xml").write_text('<tei><bibl>3. <author>Doe, J.</author> <title level="a">Small birds</title> <date>1999</date> <title level="j">J</title></bibl><bibl>no number</bibl></tei>')
    assert [tuple(r) for r in records.read_training_tei(spark, str(tmp_path)).collect()] == [("5", 3, "Small birds Doe 1999 J")]


OAI = """<OAI><ListRecords><record><header><identifier>oai:x:article/12</identifier><datestamp>2020</datestamp></header><metadata><oai_dc:dc xmlns:oai_dc="o" xmlns:dc="d">
<dc:title>Small  birds</dc:title><dc:creator>Doe, J</dc:creator><dc:creator>Roe</dc:creator><dc:identifier>https://x/y/issue/3/4</dc:identifier><dc:identifier>https://doi.org/10.1234/A</dc:identifier><dc:date>in 1999</dc:date></oai_dc:dc></metadata></record></ListRecords></OAI>"""


def test_harvested(spark, tmp_path):
    p = tmp_path / "o.xml"
    p.write_text(OAI)
    r = records.read_oai(spark, str(p)).first()
    assert (r.article_id, r.title, list(r.creators), r.doi, r.url, r.year) == ("12", "Small birds", ["Doe, J", "Roe"], "10.1234/a", "https://doi.org/10.1234/A", 1999)
    page = "Markdown Content:\nOAI Record: oai:7\n### Dublin Core Metadata\nTitle One  two\nTitle Second\nAuthor or Creator Doe\nAuthor or Creator Roe\nDate 2001-02\nResource Identifier http://a\nResource Identifier 10.1234/Q\n*   [Identify] Title no"
    m = spark.createDataFrame([(page, "7")], "m string, i string").select(records.record_page(F.col("m"), F.col("i")).alias("r")).first().r
    assert (m.oai_identifier, m.title, list(m.creators), m.year, m.doi, m.url) == ("oai:7", "One two", ["Doe", "Roe"], 2001, "10.1234/q", "http://a")
    pages = spark.createDataFrame([("head\n## OAI Record: r1\nTitle A b\nDate 1850\n\n## OAI Record: r2\nDate 2000\n\n## OAI Record: r3\nTitle C\nSource S", "spec", "Name")], "markdown string, set_spec string, set_name string")
    assert [(r.oai_identifier, r.title, r.year, r.source) for r in records.record_list(pages).collect()] == [("r1", "A b", 1850, "Name"), ("r3", "C", None, "S")]
    # Lines that end in their own number keep it.
    lines = "Markdown Content:\n" + "\n".join(f"Author or Creator A{i}{i}" for i in range(1, 9))
    m = spark.createDataFrame([(lines, "7")], "m string, i string").select(records.record_page(F.col("m"), F.col("i")).alias("r")).first().r
    assert list(m.creators) == [f"A{i}{i}" for i in range(1, 9)]
    sets = spark.createDataFrame([("setName J  Birds setSpec jb \nsetName K setSpec k-1 \n",)], "m string").select(records.set_list(F.col("m")).alias("s")).first().s
    assert [tuple(x) for x in sets] == [("J Birds", "jb"), ("K", "k-1")]


def test_form_pages(spark):
    page = "<p>1. Doe.</p><p>https://doi.org/10.1/A.</p><p>https://doi.org/10.1/B</p><p>2. Roe</p><p>3. Poe https</p><p><a href='https://doi.org/10.1/C'>https://doi.org/10.1/C</a></p>"
    links = "<a href='https://doi.org/10.1/x'>x</a><a href='https://other/'>y</a><a href='https://doi.org/10.1/y'>z</a>"
    df = spark.createDataFrame([(1, page, 3), (2, links, 3)], "batch long, html string, n int")
    assert [tuple(r) for r in records.form_answers(df).orderBy("batch", "pos").collect()] == [(1, 1, "10.1/a"), (1, 2, None), (1, 3, "10.1/c"), (2, 1, "10.1/x"), (2, 2, "10.1/y"), (2, 3, None)]
    one = spark.createDataFrame([("J|1|2||a||k| 12345\n", "<input name='key' type=x value='abc'>")], "raw string, html string")
    assert tuple(one.select(records.citation_answer(F.col("raw")), records.form_key(F.col("html"))).first()) == ("12345", "abc")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 'a "b", c')], "id int, v string, t string")
    sinks.write_csv(df, str(tmp_path / "c"), ["t", "v", "nope"])
    assert files.read_csv(spark, str(tmp_path / "c")).columns == ["t", "v", "nope"]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id int, v string").first().id == 1
    s = match_summary(spark.createDataFrame([("strong",)], "status string"))
    sinks.write_text(spark, str(tmp_path / "s.json"), sinks.summary_json(s))
    assert json.loads((tmp_path / "s.json").read_text())["strong"] == 1
    assert "| strong | 1 |" in sinks.summary_markdown(s, "T")


def test_incremental_store(spark, tmp_path):
    src, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    asked = []

    def resolve(keys):
        asked.append(sorted(r.key for r in keys.collect()))
        return keys.withColumn("status", F.lit("ok"))

    for batch in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(k,) for k in batch], "key string").write.mode("append").parquet(src)
        incremental.fill_store(incremental.stream_references(spark, src, "key string"), resolve, store, check).awaitTermination()
    assert asked == [["a", "b"], ["c"]]
    assert sorted(r.key for r in spark.read.parquet(store).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("once", [False, True])
def test_a_stream_that_stops_in_the_middle(spark, tmp_path, once):
    """A failure after a part was written: the restart repeats that batch, nothing is lost or there twice."""
    src, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    for batch in (["a", "b", "a"], ["b", "c"], ["c", "d", "a"]):
        spark.createDataFrame([(k,) for k in batch], "key string").coalesce(1).write.mode("append").parquet(src)
    calls = []

    def resolve(keys):
        calls.append(sorted(r.key for r in keys.collect()))
        if len(calls) == 2:
            keys.withColumn("status", F.lit("half")).write.mode("overwrite").parquet(f"{store}/batch=1")
            raise RuntimeError("lost")
        return keys.withColumn("status", F.lit("ok"))

    run = lambda: incremental.fill_store(incremental.stream_references(spark, src, "key string", max_files=1), resolve, store, check, once=once).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert sorted((r.key, r.status) for r in spark.read.parquet(store).collect()) == [(k, "ok") for k in "abcd"]
    assert calls[1] == calls[2] and len(calls) == 4


def _split(spark, size: int):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that keys, quotes and escapes lie across their ends."""
    _split(spark, 37)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 1])
def test_json_objects_are_split_at_members(spark, tmp_path, small_splits, indent):
    odd = ['a,"b', "{", "}", "]\\", 'x\\"y,', "ü\n,", ",", "", "\\\\"]
    answers = {f"{k} {i}": {"status": f"{odd[i % 9]}, {{ok", "http_status": i, "items": [{"doi": f"10.1/{i}", "title": o, "surnames": ["a,b", "]"]}, {"doi": None}]} for i, (k, o) in enumerate(zip(odd * 4, odd[::-1] * 4, strict=True))}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps(answers, indent=indent) + "\n")
    (tmp_path / "a" / "two.json").write_text("﻿ " + json.dumps({"last": {"status": "s"}, "none": None}, indent=indent))
    for name, text in (("empty", "{}"), ("nothing", ""), ("list", '[{"k": {"status": "x"}}, 2]'), ("text", '"k"')):
        (tmp_path / "a" / f"{name}.json").write_text(text)
    got = files.read_lookup(spark, str(tmp_path / "a"))
    assert {r.key: (r.status, r.http_status, [(x.doi, x.title, x.surnames) for x in r["items"] or []]) for r in got.collect()} == {
        k: (v["status"], v["http_status"], [(x["doi"], x.get("title"), x.get("surnames")) for x in v["items"]]) for k, v in answers.items()
    } | {"last": ("s", None, [])}
    from citeforge.sources.split import read_members

    assert read_members(spark, str(tmp_path / "a" / "one.json")).select("start").distinct().count() > 5
    (tmp_path / "twice.json").write_text('{"k": ["a"], "b": [], "k": ["c", null, ",}"]}')
    assert sorted(tuple(r) for r in files.read_answers(spark, str(tmp_path / "twice.json")).collect()) == [("k", 1, "c"), ("k", 2, None), ("k", 3, ",}")]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_are_split_by_quotes(spark, tmp_path, small_splits, end):
    import csv

    cells = ["plain", 'two\nlines, "quoted"', "", "a\r\nb", '"', '""\n""', "x,y", "\n", "ü" * 30, 'say "hi"']
    table = [[str(i), cells[i % 10], cells[(i * 3 + i // 10) % 10]] for i in range(60)]
    (tmp_path / "t").mkdir()
    for part in (0, 1):
        with open(tmp_path / "t" / f"{part}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator=end).writerows([["id", "first name", "b.c"], *table[part::2]])
    got = files.read_csv(spark, str(tmp_path / "t"))
    assert got.columns == ["id", "first name", "b.c"]
    assert sorted([r[0], r[1] or "", r[2] or ""] for r in got.collect()) == sorted(table)
    (tmp_path / "loose.csv").write_text('id,size\n1,5" disk\n2,"7"\n3,8" tape\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "loose.csv"), ["id", "size"]).orderBy("id").collect()] == [("1", '5" disk'), ("2", "7"), ("3", '8" tape')]
