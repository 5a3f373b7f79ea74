"""Relational operators on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citeforge.functions import similarity
from citeforge.operators import candidates, lookup, ranking, resolution, store, summary


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_success_prefers_found_then_error_then_first(spark):
    refs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x", "b"]), (3, ["x", "y"]), (4, [])], "id int, keys array<string>")
    known = spark.createDataFrame([("b", "error"), ("c", "found")], "key string, status string")
    got = lookup.first_success(refs, "id", "keys", known, {"found": 0, "error": 1})
    assert rows(got.select("id", "key")) == [(1, "c"), (2, "b"), (3, "x")]


def test_prioritised_lookup(spark):
    k = spark.createDataFrame([(1, "d1", "s1"), (2, "d2", "s2"), (3, "d3", "s3"), (4, "d4", "s4")], "i int, a string, b string")
    lk = spark.createDataFrame([("d1", "ok", 1), ("s1", "ok", 5), ("d2", "ok", 0), ("s2", "ok", 2), ("d3", "error", 0)], "key string, status string, n_items int")
    assert rows(lookup.prioritised_lookup(k, lk, "a", "b").select("i", "key", "status", "n_items")) == [(1, "d1", "ok", 1), (2, "s2", "ok", 2), (3, "d3", "error", 0), (4, None, "not_checked", 0)]


def test_prefer_exact_and_compare(spark):
    c = spark.createDataFrame([(1, True), (1, False), (2, False), (2, None)], "id int, e boolean")
    assert lookup.prefer_exact(c, "id", F.col("e")).groupBy("id").count().orderBy("id").collect() == [(1, 1), (2, 2)]
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert rows(lookup.compare(a, b, "k", "v").select("k", "in_a", "in_b", "differs")) == [(1, True, False, False), (2, True, True, True), (3, True, True, False), (4, False, True, False)]
    assert rows(lookup.route(spark.createDataFrame([("doi:10.1/a:b",), ("plain",)], "key string")).fillna("")) == [("doi:10.1/a:b", "doi", "10.1/a:b"), ("plain", "", "plain")]


def test_best_and_top_break_ties_by_place(spark):
    t = spark.createDataFrame([(1, 5.0, 2, "b"), (1, 5.0, 1, "a"), (1, 4.0, 0, "c"), (2, None, 1, "d")], "id int, s double, pos int, v string")
    assert rows(ranking.best(t, ["id"], [-F.col("s"), F.col("pos")]).select("id", "v")) == [(1, "a"), (2, "d")]
    assert rows(ranking.top(t, ["id"], [F.desc("s"), F.col("pos")], 2).select("id", "v", "place")) == [(1, "a", 1), (1, "b", 2), (2, "d", 1)]
    assert rows(ranking.nonzero_best(t.fillna(0), ["id"], F.col("s"), [F.col("pos")]).select("v")) == [("c",)]


def test_numbering_chunks_and_samples(spark):
    t = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k")).repartition(7)
    n = ranking.numbered(t, ["k"]).collect()
    assert [r.number for r in sorted(n, key=lambda r: r.k)] == list(range(1, 1001))
    c = ranking.chunked(t, ["k"], 300).groupBy("chunk").agg(F.count("*").alias("n"), F.max("line").alias("m")).orderBy("chunk")
    assert [tuple(r) for r in c.collect()] == [(0, 300, 300), (1, 300, 300), (2, 300, 300), (3, 100, 100)]
    assert [r.k for r in ranking.sample(t, "k", 3, mode="first").orderBy("k").collect()] == sorted(r.k for r in n)[:3]
    assert rows(ranking.sample(t, "k", 50)) == rows(ranking.sample(t.repartition(3), "k", 50))
    with pytest.raises(ValueError, match="exceeds"):
        ranking.sample(t, "k", 1001)


def test_streaks(spark):
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate([True, True, False, True, False, False, True, True, True])], "u int, i int, f boolean")
    assert [r.streak for r in ranking.streaks(t, ["u"], ["i"], F.col("f")).orderBy("i").collect()] == [1, 2, 0, 1, 0, 0, 1, 2, 3]


def test_token_candidates(spark):
    refs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "z"]), (3, ["c", "b", "a", "a"]), (4, None), (5, [])], "r int, t array<string>")
    works = spark.createDataFrame([(i, ["a", "b"] if i else ["a", "b", "c"]) for i in range(5)] + [(9, None)], "w int, t array<string>")
    assert rows(candidates.token_candidates(refs, works, "r", "w", "t", 2)) == sorted((r, w, 3 if w == 0 else 2) for r in (1, 3) for w in range(5))
    first = candidates.relevance_search(refs, works, "r", "w", "t", 2, 2, [F.desc("w")])
    assert rows(first) == [(1, 0, 3), (1, 4, 2), (3, 0, 3), (3, 4, 2)]


@pytest.mark.parametrize("least", [1, 3, 5])
def test_token_candidates_lose_no_pair_of_common_tokens(spark, least):
    import random

    rng = random.Random(3)
    sets = [[(i, rng.sample("abcdefghijklmno", rng.randint(0, 9))) for i in range(n)] for n in (40, 120)]
    refs, works = (spark.createDataFrame(s, f"{k} int, t array<string>") for s, k in zip(sets, "rw", strict=True))
    want = sorted((i, j, len(set(a) & set(b))) for i, a in sets[0] for j, b in sets[1] if len(set(a) & set(b)) >= least)
    assert want and rows(candidates.token_candidates(refs, works, "r", "w", "t", least)) == want


def test_similar_names_lose_no_pair(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    words = ["journal", "of", "the", "a", "birds", "bird", "stones", "review", "j", "ab", "nal of"]
    names = [sorted({" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(40)}) for _ in "ab"]

    def score(a, b):
        if not a or not b:
            return 0.0
        if a in b or b in a:
            return 1.0
        x, y = set(a.split()), set(b.split())
        return round(0.65 * len(x & y) / len(x | y) + 0.35 * SequenceMatcher(None, a, b).ratio(), 4)

    sides = [spark.createDataFrame([(n,) for n in own], f"{c} string") for own, c in zip(names, "xy", strict=True)]
    for threshold in (0.55, 0.72):
        want = sorted((a, b) for a in names[0] for b in names[1] if score(a, b) >= threshold)
        assert rows(candidates.similar_names(*sides, "x", "y", similarity.name_similarity, threshold).select("x", "y")) == want
    with pytest.raises(ValueError, match="in common"):
        candidates.similar_names(*sides, "x", "y", similarity.name_similarity, 0.3)


def test_records_of_collections(spark):
    refs = spark.createDataFrame([(1, ["a", "b"], "J Birds"), (2, ["a", "b"], ""), (3, ["a"], None)], "r int, t array<string>, j string")
    records = spark.createDataFrame([(10, ["a", "b"], "The J Birds"), (11, ["a", "b"], "Stones")], "w int, t array<string>, s string")
    got = candidates.records_of_collections(refs, records, "r", "w", "j", "s", "t", similarity.name_similarity, 0.55, 2)
    assert rows(got) == [(1, 10, 2), (2, 10, 2), (2, 11, 2)]


def test_alignment_and_collections(spark):
    listed = spark.createDataFrame([("p", 1, "small birds of towers"), ("p", 2, "zzz")], "publication_id string, reference_order int, context string")
    parsed = spark.createDataFrame([("p", 1, "small birds of tower"), ("p", 2, "qq"), ("q", 1, "zzz")], "publication_id string, parsed_index int, raw string")
    decided = spark.createDataFrame([("p", 2, 2, 0.8)], "publication_id string, reference_order int, parsed_index int, score double")
    got = candidates.aligned(listed, parsed, 0.72, decided)
    assert rows(got.select("reference_order", "parsed_index", "alignment_source")) == [(1, 1, "raw_similarity"), (2, 2, "match_report")]
    journals = spark.createDataFrame([("J Birds", 3), ("The J Birds", 2), ("Other", 1)], "journal string, n long")
    sets = spark.createDataFrame([("J Birds", "b"), ("Stones", "s")], "set_name string, set_spec string")
    assert rows(candidates.best_collection(journals, sets, similarity.name_similarity, 0.72).select("set_spec", "score", "target_count")) == [("b", 1.0, 5)]


def _resolution(spark):
    return spark.createDataFrame(
        [(1, 1, "doi", "found"), (1, 2, "bibliographic", "strong"), (2, 2, "bibliographic", "possible"), (3, 11, "title_search", "possible"), (4, 11, "title_search", "strong"), (2, 11, "title_search", "strong"), (5, 2, "bibliographic", "no_match")],
        "sample_index long, stage int, resolver string, status string",
    )


def test_policies(spark):
    r = _resolution(spark)
    assert rows(resolution.found_set(r, resolution.COMPATIBLE)) == [(1,), (2,), (4,)]
    assert rows(resolution.provenance(r, resolution.STRICT).select("sample_index", "resolver")) == [(1, "doi"), (2, "title_search"), (4, "title_search")]
    total = spark.createDataFrame([(10,)], "n long")
    assert rows(resolution.cumulative(r, resolution.COMPATIBLE, total)) == [(1, 1, 1, 10.0), (2, 1, 2, 20.0), (11, 1, 3, 30.0)]
    refs = spark.range(1, 6).withColumnRenamed("id", "sample_index")
    assert rows(resolution.scoped(refs, r, "strict")) == [(2,), (3,), (4,), (5,)]
    assert rows(resolution.scoped(refs, r, "broad")) == [(3,), (4,), (5,)]


def test_cascade_takes_over_only_with_a_higher_status(spark):
    got = resolution.cascade(_resolution(spark))
    assert rows(got.select("sample_index", "resolver")) == [(1, "bibliographic"), (2, "title_search"), (3, "title_search"), (4, "title_search"), (5, "bibliographic")]


def test_summaries(spark):
    t = spark.createDataFrame([("strong",), ("possible",), ("not_checked",), ("no_match",)], "status string")
    s = summary.match_summary(t).first()
    assert (s.target, s.checked, s.recovery_checked, s.recovery_target, s.complete) == (4, 3, 33.33, 25.0, False)
    h = summary.histogram(spark.createDataFrame([("thesis",), ("thesis",), ("other",)], "category string"), total=F.lit(10)).orderBy("place").collect()
    assert [r.category for r in h] == list(summary.fixed.CATEGORY_ORDER)
    assert [(r.n, r.share, r.share_of_total) for r in h if r.n] == [(2, 66.67, 20.0), (1, 33.33, 10.0)]
    e = summary.eligible_denominator(spark.createDataFrame([("thesis",), ("other",)], "category string"), 10).first()
    assert (e.found, e.eligible, e.rate, e.eligible_rate) == (8, 9, 80.0, 88.89)
    empty = summary.match_summary(t.limit(0)).first()
    assert (empty.target, empty.recovery_target) == (0, None)


def test_upsert_and_missing(spark):
    old = spark.createDataFrame([(1, "p", "a", 5), (2, "p", "b", 9)], "k int, provider string, v string, t int")
    new = spark.createDataFrame([(2, "p", "c", 1), (2, "p", "d", 3), (3, "p", None, 1)], "k int, provider string, v string, t int")
    assert rows(store.upsert(old, new, ["k", "provider"], "t").fillna("-")) == [(1, "p", "a", 5), (2, "p", "d", 3), (3, "p", "-", 1)]
    have = spark.createDataFrame([("a", "ok"), ("b", "error")], "key string, status string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "key string")
    assert rows(store.missing_keys(keys, have)) == [("c",)]
    assert rows(store.missing_keys(keys, have, retry=("error",))) == [("b",), ("c",)]
    assert rows(store.cacheable(have.union(spark.createDataFrame([("z", "rate_limited")])), keep_errors=False).select("key")) == [("a",)]


@pytest.mark.parametrize(("k", "least", "steps"), [(3, 2, candidates.STEPS), (1, 3, candidates.STEPS), (5, 2, ()), (2, 2, (1.0, 0.9))])
def test_relevance_search_loses_no_pair(spark, k, least, steps):
    import random

    rng = random.Random(k)
    words = [w for i, w in enumerate("abcdefghijklmnop") for _ in range(1 + i // 3)]
    sets = [[(i, rng.choices(words, k=rng.randint(0, 12)), float(rng.randint(0, 3))) for i in range(n)] for n in (40, 150)]
    refs, works = (spark.createDataFrame(s, f"{c} int, t array<string>, score double") for s, c in zip(sets, "rw", strict=True))
    want = []
    for i, a, _ in sets[0]:
        own = sorted((-len(set(a) & set(b)), -s, j) for j, b, s in sets[1] if len(set(a) & set(b)) >= least)
        want += [(i, j, -n) for n, _, j in own[:k]]
    order = [candidates.F.desc("score"), candidates.F.col("w")]
    got = candidates.relevance_search(refs.drop("score"), works, "r", "w", "t", k, least, order, steps)
    assert want and rows(got) == sorted(want)
    assert candidates.relevance_search(refs.drop("score").limit(0), works, "r", "w", "t", k, least, order).count() == 0
    assert candidates.relevance_search(refs.drop("score"), works.limit(0), "r", "w", "t", k, least, order).count() == 0


def test_stages_are_asked_for_what_is_open_only(spark, tmp_path):
    """The found-set goes from stage to stage; an end before the last stage; a table that is gone on with."""
    asked = []

    def stage(name, answers):
        def run(open_):
            asked.append((name, sorted(r[0] for r in open_.collect())))
            return spark.createDataFrame([(i, s) for i, s in answers if i in asked[-1][1]], "sample_index long, status string")

        return name, run

    targets = spark.range(1, 6).withColumnRenamed("id", "sample_index")
    stages = [stage("doi", [(1, "found"), (2, "possible")]), stage("form", [(2, "strong"), (1, "strong"), (3, "no_match")]), stage("works", [(3, "possible"), (4, "strong"), (5, "strong")]), stage("last", [(3, "strong")]), stage("never", [])]
    path = str(tmp_path / "table")
    got = resolution.run_stages(targets, stages, table=path)
    assert asked == [("doi", [1, 2, 3, 4, 5]), ("form", [2, 3, 4, 5]), ("works", [3, 4, 5]), ("last", [3])]
    want = [(1, "found", "doi", 1), (2, "possible", "doi", 1), (2, "strong", "form", 2), (3, "no_match", "form", 2), (3, "possible", "works", 3), (3, "strong", "last", 4), (4, "strong", "works", 3), (5, "strong", "works", 3)]
    assert rows(got.select("sample_index", "status", "resolver", "stage")) == want
    asked.clear()
    assert rows(resolution.run_stages(targets, stages, table=path).select("sample_index", "status", "resolver", "stage")) == want and asked == []
    assert rows(resolution.cascade(got, ("found", "strong")).select("sample_index", "resolver")) == [(1, "doi"), (2, "form"), (3, "last"), (4, "works"), (5, "works")]
    assert resolution.run_stages(targets.limit(0), stages).count() == 0
