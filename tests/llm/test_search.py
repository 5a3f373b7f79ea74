"""Ranked search, nearest neighbours and collocations against plain search."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from citeforge.llm import collocations as co
from citeforge.llm import ranked_search as rs
from citeforge.llm import rotated_codes as rc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs: list[tuple], items: list[tuple], k: int = 10) -> Counter:
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    words = [(i, w, Counter(w)) for i, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w, _ in words)
    df = Counter(t for _, _, c in words for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, w, c in words:
            m = 10 + 90 * len(w) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if score > 0:
                scored.append((-score, i is not None, i))
        for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[(item, rank, i, -s)] += 1
    return out


@pytest.mark.parametrize(("shard_docs", "block_bytes"), [(7, 60), (1 << 15, 1 << 22)])
def test_ranked_search(spark, docs, shard_docs, block_bytes):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(i, (t or "")[:200]) for i, t in rows[:12]] + [(3, None), (None, "one two"), (4, ""), (4, "ONE ﬁ 日本語"), (4, "ONE ﬁ 日本語"), (5, "nothing7here")]
    frame = spark.createDataFrame([(*x, 1.0, "s") for x in items], "item_id long, text string, score double, shard string")
    got = rs.ranked_search(docs, frame, shard_docs=shard_docs, block_bytes=block_bytes)
    assert Counter(tuple(r) for r in got.collect()) == ranked(rows, items)


@pytest.mark.parametrize("leaf", [1, 8, 1024])
@pytest.mark.parametrize("seed", range(6))
def test_treaps_walk_as_plain_sums(monkeypatch, leaf, seed):
    """Random postings with many equal impacts; zero impacts; terms that no document has."""
    monkeypatch.setattr(rs, "LEAF", leaf)
    rng = np.random.default_rng(seed)
    docs, n_terms = int(rng.integers(1, 200)), 12
    pairs = np.argwhere(rng.random((n_terms, docs)) < rng.random((n_terms, 1)))
    if not len(pairs):
        return
    impact = rng.integers(0, 6, len(pairs)) * (1 << 51 if seed == 5 else 1)
    order = rng.permutation(len(pairs))
    treaps = rs.Treaps(pairs[order, 0], pairs[order, 1], impact[order], docs)
    for _ in range(20):
        wanted = np.array(sorted(rng.choice(n_terms + 3, int(rng.integers(1, 8)), replace=False)), np.int64)
        score = Counter()
        for (t, d), x in zip(pairs.tolist(), impact.tolist(), strict=True):
            score[d] += x if t in wanted else 0
        want = sorted((-s, d) for d, s in score.items() if s > 0)[:10]
        assert treaps.best(wanted, 10) == [(-s, d) for s, d in want]


def test_ranked_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert rs.ranked_search(empty, items).count() == 0
    assert rs.ranked_search(docs, items.limit(0)).count() == 0
    assert rs.ranked_search(docs.filter("text is null"), items).count() == 0


def expected_collocations(rows: list[tuple], least: int, first: int, max_n: int = 5) -> Counter:
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for i in range(len(w)) for k in range(1, max_n + 1) if i + k <= len(w))
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in cands.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[(lang, p[i:j])] = max(inside[(lang, p[i:j])], a)
    by = {}
    for (lang, p), a in cands.items():
        if inside[(lang, p)] >= a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[(lang, p[:k])] * f[(lang, p[k:])]), k, f[(lang, p[:k])], f[(lang, p[k:])]) for k in range(1, len(p)))
        by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right, n[lang]))
    return Counter((lang, rank, p.decode(), -a, x, y, m, -s) for lang, own in by.items() for rank, (s, a, p, x, y, m) in enumerate(sorted(own)[:first], 1))


def _speech(rng: random.Random, n: int) -> str:
    words = ["a", "A", "b", "c", "dé", "É", "日本", "x\x1fy", "e"]
    return "".join(rng.choice(words) + rng.choice([" "] * 12 + ["\t", ", ", ".", "\n", "\r", "  "]) for _ in range(n))


@pytest.mark.parametrize(("sent_words", "share", "sent_pairs"), [(co.SENT_WORDS, 256, co.SENT_PAIRS), (0, 256, 0), (co.SENT_WORDS, 12, 0), (0, 40, co.SENT_PAIRS)])
def test_collocations(spark, monkeypatch, sent_words, share, sent_pairs):
    """Words sent or joined; suffixes ended at rare pairs or not; prefixes of a large share split by further words."""
    monkeypatch.setattr(co, "SHARE", share)
    rng = random.Random(share)
    rows = [(_speech(rng, rng.randint(0, 120)), rng.choice(["en", "de", None, "", "und"]), 1, "p") for _ in range(60)]
    rows += [("b c b c b c b c b c", "en", 1, "p")] * 30 + [(None, "en", 1, "p"), ("", None, 1, "p"), ("zz yy. zz yy", "fr", 1, "p")]
    frame = spark.createDataFrame(rows, "text string, lang string, rank long, phrase string").repartition(5)
    for least, first, max_n in ((4, 2000, 5), (1, 7, 3)):
        got = co.collocations(frame, least=least, first=first, sent_words=sent_words, max_n=max_n, sent_pairs=sent_pairs)
        assert Counter(tuple(r) for r in got.collect()) == expected_collocations([r[:2] for r in rows], least, first, max_n)


@pytest.mark.parametrize("sent_words", [co.SENT_WORDS, 0])
def test_f1_collocations_of_text_in_short_rows(spark, monkeypatch, sent_words):
    """Texts are written in short rows, cut inside pieces too; no phrase is lost or counted twice there."""
    rng = random.Random(11)
    rows = [(_speech(rng, rng.randint(0, 120)), rng.choice(["en", None]), 1, "p") for _ in range(30)] + [("b c d " * 40, "en", 1, "p")] * 3
    frame = spark.createDataFrame(rows, "text string, lang string, rank long, phrase string").repartition(3)
    kept = []
    monkeypatch.setattr(co, "dropped", kept.append)
    got = co.collocations(frame, least=3, first=2000, sent_words=sent_words, sizes=(3, 16))
    assert Counter(tuple(r) for r in got.collect()) == expected_collocations([r[:2] for r in rows], 3, 2000)
    assert max(len(r.ids) for r in kept[0].collect()) == 3 + co.MAX_N - 1


def test_collocations_of_nothing(spark, docs, empty):
    assert co.collocations(empty).count() == 0
    assert co.collocations(docs.filter("text is null")).count() == 0


def expected_nearest(rows: list[tuple], k: int, every: int) -> dict[int, list[tuple]]:
    """Of each query row, in order of id: (-score, id) of its nearest."""
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (i, v) in enumerate(usable):
        if i is not None and i % every == 0:
            scored = [(-float(rc.cosines(v[None], w[None])[0]), -1 << 63 if j is None else j) for m, (j, w) in enumerate(usable) if m != n and len(w) == len(v)]
            out[n] = (i, sorted(scored)[:k])
    return out


def test_nearest_with_oddities(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    rows += [(i, rows[50][1]) for i in range(100, 130)] + [(50, rows[50][1])] * 2 + [(None, rows[50][1]), (None, rows[3][1]), (0, rows[7][1])]
    rows += [(200, None), (201, []), (250, [0.0] * 5), (251, [1.0, None, 0.0, 0.0, 0.0]), (252, [float("nan")] * 5), (300, [float("inf")] + [1.0] * 4), (350, [1.0, 2.0]), (351, [2.0, 1.0]), (400, [3.0])]
    rows += [(450, [1e-30, 0.0, 0.0, 0.0, 0.0]), (451, [1e30, 1e30, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "vec_id long, embedding array<double>, score double, row int").repartition(4)
    table = sorted(rc.nearest(frame).collect(), key=lambda r: (r.query_id, r.rank))
    assert all(r.query_id != 400 for r in table)
    want = expected_nearest(rows, 5, 50)
    assert Counter((q, -s, None if i == -1 << 63 else i) for q, own in want.values() for s, i in own) == Counter((r.query_id, r.score, r.vec_id) for r in table)
    ranks = Counter((r.query_id, r.rank) for r in table)
    assert ranks[(50, 1)] == 3 and ranks[(0, 5)] == 2 and ranks[(350, 1)] == 1 and (350, 2) not in ranks
    assert rc.nearest(frame.limit(0)).count() == 0 and rc.nearest(frame.filter("embedding is null")).count() == 0


def test_nearest_recall(spark, monkeypatch):
    """Of the whole table at sf0.01, and of a larger one without clusters: at least nine in ten found, scores exact."""
    monkeypatch.setattr(rc, "SAMPLE", 100)  # most thresholds then come from the tasks
    monkeypatch.setattr(rc, "BLOCK_NUMBERS", 64 * 4)
    rng = np.random.default_rng(8)
    noise = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 48)).astype(np.float32))]
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    for rows in (given, noise):
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in rc.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
        want = {(q, rank): (i, -s) for q, own in expected_nearest(rows, 5, 50).values() for rank, (s, i) in enumerate(own, 1)}
        assert got.keys() == want.keys()
        assert sum(got[x] == want[x] for x in want) >= 0.98 * len(want)


def test_errors_of_estimates_stay_below_their_bounds():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64)) + 0.5
    y = rc.units(rng.standard_normal((50, 64)) + 0.5)
    mean, turn = rc.units(x).mean(axis=0), rc.rotation(64)
    code, *scalars = rc.encode(x, mean, turn)
    guess, error = rc.estimates(code, *scalars, y, mean, turn)
    true = rc.units(x) @ y.T
    assert (np.abs(guess - true) <= error).mean() > 0.99
    assert abs((guess - true).mean()) < 0.005
    for t in (rotation := rc.rotation(7),):
        assert t.shape == (256, 7) and np.allclose(rotation.T @ rotation, np.eye(7), atol=1e-5)
