"""Copies add no comparisons: equal texts, sets and kinds are compared once, and no row is lost for it."""

from __future__ import annotations

import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeforge.functions import similarity
from citeforge.operators import candidates
from citeforge.plans import queries
from citeforge.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [("J Birds", "The J Birds"), ("J Stones", "Stones"), ("", "J Birds of Towers"), (None, "Other")]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def doubled(spark, tmp_path_factory):
    """The tables with each order twice: a key on by 79,200 gives the same text and the same last digit."""
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    path = str(tmp_path_factory.mktemp("doubled"))
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.unionByName(orders.withColumn("o_orderkey", F.col("o_orderkey") + 79200)).write.parquet(f"{path}/orders.parquet")
    for t in ("part", "supplier"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return path


def test_equal_texts_are_searched_once(spark, doubled):
    once, twice = queries._found(spark, SF), queries._found(spark, doubled)
    assert twice.texts.count() == once.texts.count() and rows(twice.found) == rows(once.found)
    assert twice.members.count() == 2 * once.members.count()


@pytest.mark.parametrize("name", ["title_ratio", "harvested_best", "index_best"])
def test_copies_get_what_their_text_gets(spark, doubled, name):
    once = rows(QUERIES[name](spark, SF))
    assert once and rows(QUERIES[name](spark, doubled)) == sorted(once + [(i + 79200, *rest) for i, *rest in once])


def _collections(spark, copies):
    rng = random.Random(7)
    refs = [(rng.sample("abcdefgh", rng.randint(0, 6)), rng.choice(NAMES)[0]) for _ in range(12)]
    records = [(rng.sample("abcdefgh", rng.randint(0, 6)), rng.choice(NAMES)[1]) for _ in range(12)]
    refs, records = ([(i, *r) for i, r in enumerate(side * copies)] for side in (refs, records))
    sides = spark.createDataFrame(refs, "r int, t array<string>, j string"), spark.createDataFrame(records, "w int, t array<string>, s string")
    return refs, records, (*sides, "r", "w", "j", "s", "t", similarity.name_similarity, 0.55, 2)


def test_kinds_of_references_and_records_are_compared_once(spark):
    refs, records, args = _collections(spark, 3)
    like = lambda j, s: not j or j.lower() in s.lower() or s.lower() in j.lower()
    want = sorted((i, k, len(set(t) & set(u))) for i, t, j in refs for k, u, s in records if len(set(t) & set(u)) >= 2 and like(j, s))
    assert want and rows(candidates.records_of_collections(*args)) == want
    first = {}
    for i, k, n in want:
        first[i] = min(first.get(i, (0, 0)), (-n, k))
    assert rows(candidates.best_of_collections(*args)) == sorted((i, k, -n) for i, (n, k) in first.items())
    assert candidates._collection_pairs(*args)[0].count() == candidates._collection_pairs(*_collections(spark, 1)[2])[0].count()


def test_sets_of_tokens_are_compared_once(spark):
    """Works that differ in tokens only that no reference has are one set."""
    refs = spark.createDataFrame([(i, list("abc")) for i in range(20)], "r int, t array<string>")
    works = spark.createDataFrame([(i, ["a", "b", f"own{i}"]) for i in range(30)], "w int, t array<string>")
    of_lists, of_works, _ = candidates._known(refs, works, "r", "w", "t", 2)
    assert candidates._set_pairs(of_lists, of_works, 2).count() == 1
    assert candidates.token_candidates(refs, works, "r", "w", "t", 2).count() == 600


def test_only_ratios_that_may_be_the_best_are_made(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abcd ") for _ in range(30))
    own = [text() for _ in range(20)]
    cut = lambda s, n: s[:n] + "x" * (30 - n)
    pairs = [(i, j, cut(s, 30 - j), s, j == 0) for i, s in enumerate(own) for j in range(9)]
    pairs = [(i, j, a, c, inside, 1.0 if inside else 2 * sum(min(a.count(x), c.count(x)) for x in set(a)) / 60) for i, j, a, c, inside in pairs]
    df = spark.createDataFrame(pairs, "k int, j int, _r string, _c string, _inside boolean, _bound double").coalesce(1)
    got = rows(similarity.best_ratios(df, ["k"], "j", 0.6))
    assert got == [(i, 0, 1.0) for i in range(20)]
    rest = df.filter("not _inside")
    best = {}
    for i, j, a, c, _, _ in pairs:
        if j:
            best[i] = max(best.get(i, (0.0, 0)), (SequenceMatcher(None, a, c).ratio(), -j))
    found = {}
    for i, j, s in rows(similarity.best_ratios(rest, ["k"], "j", 0.6)):
        found[i] = max(found.get(i, (0.0, 0)), (s, -j))
    assert found == best


def test_f11_words_of_a_title_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def split(title):
        made.add(1)
        return title.split(" ")

    works = spark.createDataFrame([(i, f"a b own{i}", 1.0) for i in range(30)], "w int, title string, score double")
    works = works.select("w", "score", F.udf(split, "array<string>")("title").alias("t"))
    refs = spark.createDataFrame([(i, list("abc")) for i in range(20)], "r int, t array<string>")
    got = candidates.relevance_search(refs, works, "r", "w", "t", 5, 2, [F.col("w")])
    assert rows(got) == [(i, k, 2) for i in range(20) for k in range(5)] and made.value == 30


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_f11_works_are_dealt_before_their_titles_are_folded(spark):
    """Parts come in few files, however many they are."""
    assert queries._token_sides(spark, SF)[1].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_f16_both_stages_of_a_resolution_share_the_texts(spark, doubled, monkeypatch):
    """References are read and dealt by their texts once, and each text's outcome meets them once."""
    read, made = [], []
    refs, distinct = queries.refs, queries.lookup.distinct_texts
    monkeypatch.setattr(queries, "refs", lambda *a: read.append(1) or refs(*a))
    monkeypatch.setattr(queries.lookup, "distinct_texts", lambda *a: made.append(1) or distinct(*a))
    got = rows(queries._resolution(spark, doubled))
    assert len(read) == len(made) == 1
    monkeypatch.undo()
    kept = {1: ("doi", "found"), 3: ("form", "found")}
    dois = {r.sample_index for r in queries._doi_stage(spark, doubled).collect() if r.status == "found"}
    searched = {r.sample_index: r.status for r in queries._best_status(spark, doubled, queries._found(spark, doubled)).collect()}
    want = []
    for k in (r.k for r in refs(spark, doubled).select("k").collect()):
        i = k + 1
        want += [(i, 1, *kept[1])] * (i in dois) + [(i, 3, *kept[3])] * (k % 6 == 1)
        want += [(i, 2, "bibliographic", searched[i])] if i in searched else []
        want += [(i, 11, "title_search", "possible" if k % 2 else "strong")] if k % 9 == 4 else []
    assert got == sorted(want)


def _partitions(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().collect()


def test_f4_pairs_of_a_hot_kind_are_spread(spark, monkeypatch):
    """All references and all works are of one kind: its pairs are made in all tasks, though little is shuffled."""
    monkeypatch.setattr(candidates, "BLOCK", 4)
    refs = spark.createDataFrame([(i, list("abc")) for i in range(40)], "r int, t array<string>")
    works = spark.createDataFrame([(i, ["a", "b", f"own{i}"]) for i in range(50)], "w int, t array<string>")
    got = candidates.token_candidates(refs, works, "r", "w", "t", 2)
    assert rows(got) == [(i, k, 2) for i in range(40) for k in range(50)]
    made = _partitions(got)
    assert len(made) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in made) < 1000


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_f4_references_are_dealt_before_their_texts_are_folded(spark):
    assert queries._token_sides(spark, SF)[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_f3_records_of_a_hot_collection_are_spread(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 4)
    refs = spark.createDataFrame([(i, list("abc"), "J Birds") for i in range(40)], "r int, t array<string>, j string")
    records = spark.createDataFrame([(i, ["a", "b", f"own{i}"], "The J Birds") for i in range(50)], "w int, t array<string>, s string")
    got = candidates.records_of_collections(refs, records, "r", "w", "j", "s", "t", similarity.name_similarity, 0.55, 2)
    assert rows(got) == [(i, k, 2) for i in range(40) for k in range(50)]
    made = _partitions(got)
    assert len(made) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in made) < 1000


def _texts(rng):
    letters = rng.choice(["ab", "abcde ", similarity.LETTERS])
    a = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 199, 200, 230, 320]))]
    b = a[:]
    for _ in range(rng.randint(0, 40)):
        b.pop(rng.randrange(len(b))) if b else None
        b.insert(rng.randint(0, len(b)), rng.choice(letters))
    return "".join(a), " ".join(reversed("".join(b).split(" "))) if rng.random() < 0.3 else "".join(b)


def test_f2_matching_blocks_as_difflib_has_them():
    rng = random.Random(2)
    for a, b in (_texts(rng) for _ in range(1500)):
        assert similarity.matched_letters(a, b) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def test_f2_subsequences_of_all_texts_of_a_row_at_once():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    rng, known = random.Random(4), {}
    for _ in range(40):
        texts = tuple("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 7)))
        for b in ("".join(rng.choice("abcde ") for _ in range(rng.randint(0, 50))) for _ in range(3)):
            assert similarity.common_with_each(texts, b, known) == [common(a, b) for a in texts]


def test_f2_rows_of_one_key_keep_their_own_texts(spark):
    pairs = [(1, 0, "abcdefgh", "abcdxxxx", False, 1.0), (1, 1, "qrstuvwx", "qrstuvyx", False, 1.0), (1, 2, "zzzzzzzz", "abcdxxxx", False, 1.0)]
    df = spark.createDataFrame(pairs, "k int, j int, _r string, _c string, _inside boolean, _bound double").coalesce(1)
    assert max((r.alignment_score, r.j) for r in similarity.best_ratios(df, ["k"], "j", 0.4).collect()) == (0.875, 1)
