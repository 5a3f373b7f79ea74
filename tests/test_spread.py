"""Few keys, null keys and ids that compress well put no more in one task, or on the driver, than their share."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from citeforge.functions import text
from citeforge.operators import lookup, resolution
from citeforge.plans import gate_queries, queries, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def no_small_tables(spark):
    """Tables of any size are dealt out by their keys, but for those that a plan sends to the tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@needs_tables
def test_f20_works_and_references_are_not_dealt_by_remainders(no_small_tables):
    for df in (views.works(no_small_tables, SF), views.refs(no_small_tables, SF)):
        assert df.count() and "SortMergeJoin" not in plan(df) and "BroadcastHashJoin" in plan(df)
    assert "SortMergeJoin" not in plan(queries.title_queries(no_small_tables, SF))


def test_f20_words_fold_alike_alone_and_together(spark):
    titles = ["Işık'ın Çöl Ğ İÖ 12 ve için", "the ÜÇ of şair's  Study -- bird", "", "İİİ ııı Ünlü and", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    stop = F.array(*(F.lit(w) for w in text.fixed.STOP_INDEX))
    own = F.filter(F.split(text.compact_query(F.col("t")), " "), lambda w: text.let(text.normalize_joined(w), lambda n: (F.length(n) > 2) & ~F.array_contains(stop, n)))
    for got, want in df.select(text.salient_query(F.col("t")), F.array_join(F.slice(own, 1, 10), " ")).collect():
        assert got == want


@needs_tables
def test_f26_titles_of_references_are_not_dealt_by_work(no_small_tables):
    joins = [line for line in plan(gate_queries.title_search_targets(no_small_tables, SF)).splitlines() if "SortMergeJoin" in line]
    assert all("_text" in line for line in joins)  # by the number of a text, never by the work


@needs_tables
def test_f27_each_text_is_parsed_once(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", None, "a", "a", "b"])], "i int, t string")
    texts, number = lookup.distinct_texts(df, "t", F.min("i").alias("first"))
    assert sorted((r.first, r.t) for r in texts.collect()) == [(0, "a"), (1, "b"), (2, None)]
    met = df.select("i", number.alias("_text")).join(texts, "_text").select("i", "first")
    assert sorted(map(tuple, met.collect())) == [(0, 0), (1, 1), (2, 2), (3, 0), (4, 0), (5, 1)]


def test_f22_equal_keys_are_looked_up_once_and_no_keys_never(spark, monkeypatch):
    rows = [(i, i * 2, ["x", "y"] if i % 3 == 0 else ["y"] if i % 3 == 1 else []) for i in range(30)] + [(30, 60, None)]
    df = spark.createDataFrame(rows, "id int, k int, keys array<string>")
    known = spark.createDataFrame([("y", "found"), ("x", "error")], "key string, status string")
    seen = []
    best = lookup.best
    monkeypatch.setattr(lookup, "best", lambda d, *a: seen.append(d.count()) or best(d, *a))
    got = lookup.first_success(df, "id", "keys", known, {"found": 0, "error": 1}, carry=["k"], keep_empty=True)
    want = [(i, k, "y" if keys else None, "found" if keys else None) for i, k, keys in rows]
    assert sorted(map(tuple, got.select("id", "k", "key", "status").collect())) == want
    assert seen == [3]


def test_f6_ids_are_not_sent_to_the_driver(spark):
    ids = spark.range(100).select(F.col("id").alias("sample_index"))
    got = resolution.remaining(ids, ids.filter("sample_index < 90"))
    assert got.count() == 10 and "Broadcast" not in plan(got)


def test_f10_what_is_open_is_worked_out_once(spark):
    targets = spark.range(9).select(F.col("id").alias("sample_index"))
    asked = []

    def stage(only):
        asked.append(only)
        return only.filter(f"sample_index < {3 * len(asked)}").withColumn("status", F.lit("found"))

    got = resolution.run_stages(targets, [("a", stage), ("b", stage), ("c", stage)])
    assert sorted((r.sample_index, r.resolver) for r in got.collect()) == [(i, "abc"[i // 3]) for i in range(9)]
    assert all("Join" not in plan(only) for only in asked)
