"""The operators against brute force, on rows with every oddity."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from citeforge.llm import bpe, exact_dedup, line_dedup, packing, quality_rules, secret_scan, simhash, substring_dedup, suffix_dedup, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(tuple(r) for r in rows)


def expected_quality(text: str) -> tuple:
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def test_quality_counts_and_bands(docs):
    got = quality_rules.quality_rules(docs)
    base = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert bag(base) == bag((i, *expected_quality(t)) for i, t in pairs(docs))
    rows = got.collect()
    assert all(not (r.base_failed and r.kept) for r in rows)
    assert all((r.reason is None) == r.kept for r in rows)


def test_quality_rejects_repetitive_and_incompressible(spark):
    import base64
    import random

    rng = random.Random(1)
    noise = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(400))
    blocks = [" ".join(f"{a}{i}" for i in range(6)) for a in "abcdefghijklmnop"]
    flat = " ".join(f"{'x' * 30}{i:02d} {'y' * 30}" for i in range(60))
    rows = [(1, noise), (2, flat), (3, " ".join(blocks))]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].reason == "incompressible"
    assert got[2].reason == "repetitive"


def expected_verdict(text: str) -> str | None:
    """The bands once more, by other means."""
    import zstandard

    raw, b = text.encode(), quality_rules.Bands()
    ratio = lambda x: len(zstandard.compress(x, b.level)) / len(x)
    band = lambda n: max(k for k, edge in enumerate(b.edges) if edge <= n)
    if expected_quality(text)[-1]:
        return "base"
    if ratio(raw) < b.low[band(len(raw))]:
        return "repetitive"
    if ratio(raw) > b.high[band(len(raw))]:
        return "incompressible"
    bad, n = 0, 0
    while len(raw) > 2048 and n * 2048 < len(raw):
        chunk = raw[n * 2048 : n * 2048 + 2048]
        low, high = (b.chunk_low, b.chunk_high) if len(chunk) == 2048 else (b.low[band(len(chunk))], b.high[band(len(chunk))])
        bad, n = bad + (not low <= ratio(chunk) <= high), n + 1
    return "chunks" if bad > b.max_bad_chunks * n else None


def test_quality_verdicts_once_more(spark, docs):
    import base64
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    clean = " ".join(rng.choice(words) for _ in range(9000))
    junk = base64.b64encode(rng.randbytes(9000)).decode()
    texts = [clean, clean[:20000] + " " + junk + " " + clean[20000:], clean[:4097], clean[:2100] + "x" * 1500, clean[:2048], clean[:2049]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.reason for r in quality_rules.quality_rules(rows).collect()}
    assert (got[0], got[1]) == (None, "chunks")  # junk in a fifth of a long text
    assert got == {i: expected_verdict(t) for i, t in enumerate(texts)}
    kept = quality_rules.quality_rules(docs).select("doc_id", "kept", "reason").collect()
    assert Counter((r.doc_id, r.kept, r.reason) for r in kept) == Counter((i, (v := expected_verdict(t)) is None, v) for i, t in pairs(docs))


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_path(packing.TOKENIZER_FILE))
    rows = packing.pack(docs).collect()
    want = Counter()
    for i, t in pairs(docs):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        ends = [0, *range(first, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= sum(r.length for r in rows) // 1024 + 2


def check_sequences(rows, lengths, capacity):
    """Every piece is placed once, gapless from 0; returns the number of sequences."""
    assert Counter((r.doc_id, r.length) for r in rows) == Counter(enumerate(lengths))
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def plain_best_fit(lengths, capacity):
    """Sequences of the loop that takes piece by piece, longest first."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize(
    ("name", "capacity", "sizes_a_part"),
    [("even", 64, 64), ("even", 64, 10), ("even", 64, 3), ("small", 64, 10), ("thirds", 64, 8), ("full", 64, 20), ("ones", 1, 1), ("hot", 64, 5)],
)
def test_supersteps_pack_as_best_fit_does(spark, name, capacity, sizes_a_part):
    """As few sequences as the plain best-fit decreasing loop, whether one part sweeps all or many do."""
    rng = np.random.default_rng(3)
    lengths = {
        "even": rng.integers(1, 65, 240), "small": rng.integers(1, 6, 300), "thirds": rng.integers(17, 30, 150),
        "full": np.append(rng.integers(1, 9, 40), [64] * 40), "ones": np.ones(60, int),
        "hot": np.append(rng.integers(1, 65, 60), [23] * 500),
    }[name].tolist()
    seen: Counter = Counter()
    rows = []
    for i, n in enumerate(lengths):
        rows.append((i, 0, 0, n, 7, i % 3, seen[n, i % 3]))
        seen[n, i % 3] += 1
    pieces = spark.createDataFrame(rows, packing.PIECE + ", part int, nth long")
    got = check_sequences(packing.place(pieces, capacity, sizes_a_part).collect(), lengths, capacity)
    assert got <= plain_best_fit(lengths, capacity) * 1.02 + 1


@pytest.mark.parametrize("seed", range(20))
def test_runs_pack_as_single_pieces_do(seed):
    """One sweep over runs is the plain loop: as many sequences, every piece once, no place twice."""
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100])
    lengths = Counter(rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.choice([0, 1, 30, 400])))
    taken, gaps, rest = packing.best_fit([(length, 0, n) for length, n in lengths.items()], [], capacity, 5)
    assert not rest
    places: dict = {}
    ranks: Counter = Counter()
    for length, first, n, sequence, per, at in taken:
        for i in range(n):
            places.setdefault(sequence + i // per, []).append((at + i % per * length, length))
            ranks[length, first + i] += 1
    assert ranks == Counter((length, i) for length, n in lengths.items() for i in range(n))
    used = {}
    for sequence, own in places.items():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        used[sequence] = capacity - end
    assert {s + i: free for s, n, free in gaps for i in range(n)} == {s: free for s, free in used.items() if free}
    assert len(places) == plain_best_fit(lengths.elements(), capacity)


def test_runs_without_a_gap_stay_open():
    """Without new sequences, pieces that no gap holds come back, and gaps keep what they have left."""
    taken, gaps, rest = packing.best_fit([(5, 0, 4), (2, 0, 3)], [(9, 1, 6), (3, 2, 5)], 8)
    assert rest == [(5, 3, 1), (2, 0, 3)] and gaps == [(9, 1, 1)]
    assert taken == [(5, 0, 2, 3, 1, 3), (5, 2, 1, 9, 1, 2)]


def test_tokens_agree_with_the_library():
    own = packing.tokens(packing.default_path(packing.TOKENIZER_FILE), packing.default_path(packing.RANKS_FILE))
    for text in ("", "Hello  world\n\n\t x's É ü ñ 123,456", "aÀɏ × ÷ \r\n", "a<|endoftext|>b", "日本 🎉 x", " "):
        assert own.ids(text).tolist() == own.library(text).tolist()


def test_exact_groups(docs):
    rows = exact_dedup.exact_dedup(docs, keep="max", ignore_ascii_case=True).collect()
    groups: dict = {}
    for i, t in pairs(docs):
        groups.setdefault(t.translate(LOWER), []).append(i)
    top = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((i, top[t], len(g), sha(t)) for t, g in groups.items() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(map(sha, groups))  # one of each group


def test_exact_keeps_smallest_too(docs):
    rows = exact_dedup.exact_dedup(docs.filter("doc_id is not null"), keep="min").collect()
    least: dict = {}
    for i, t in pairs(docs):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    assert {(r.doc_id, r.keep_id) for r in rows} == {(i, least[t]) for i, t in pairs(docs) if i is not None}


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups_survive_a_weak_hash(spark, docs, keep):
    """Equal hashes of different texts split into groups by their bytes."""
    from pyspark.sql import functions as F

    weak = lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 7), 32, "0"))
    strong, split = (bag(exact_dedup.exact_dedup(docs, keep=keep, **kw).drop("kept").collect()) for kw in ({}, {"hash128": weak}))
    assert split == strong
    rows = exact_dedup.exact_dedup(docs, keep=keep, hash128=weak).collect()
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({sha(t) for _, t in pairs(docs)})


def test_substring_windows(docs):
    words = [(i, WORD.findall(t)) for i, t in pairs(docs)]
    order = lambda i: -1 if i is None else i
    first: dict = {}
    for i, w in words:
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(order(i), first.get(x, order(i)))
    want = Counter()
    for i, w in words:
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < order(i) for j in range(k, k + 50)}
        want[(i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    assert bag(substring_dedup.substring_digest(docs).collect()) == want


def test_suffix_strings(docs):
    texts = [(i, t.encode()) for i, t in pairs(docs)]
    order = lambda i: -1 if i is None else i
    first: dict = {}
    for i, b in texts:
        for k in range(len(b) - 99):
            first[b[k : k + 100]] = min((order(i), k), first.get(b[k : k + 100], (order(i), k)))
    want = Counter()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (order(i), k):
                gone[k : k + 100] = True
        gone = gone[: len(b)]
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[(i, len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))] += 1
    assert bag(suffix_dedup.suffix_digest(docs).collect()) == want


def test_repeats_on_small_alphabets(spark):
    """Periodic texts, runs and overlaps, where anchors are hardest to place."""
    every = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        alphabet = ["a", "b", "cc"][: 1 + seed % 3]
        texts = [" ".join(rng.choice(alphabet, int(rng.integers(0, 160)))) for _ in range(12)]
        every += [*texts, " ".join(["a", "b"] * 70), " ".join(["a"] * 130), texts[0] + " " + texts[1]]
    for size in (15, len(every)):  # those of one letter alone, and all
        docs = spark.createDataFrame(list(enumerate(every[:size])), "doc_id long, text string")
        test_substring_windows(docs)
        test_suffix_strings(docs)


def anchors_of_windows(texts: list[str]) -> list[dict[int, tuple[int, int]]]:
    """Of each text: window to (name of its anchor, the anchor's place in the window)."""
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "tag": pa.array([0] * len(texts), pa.int64())})
    out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    for q, _, doc, _, p, n, o, _ in substring_dedup.word_anchors(batch, 50, lambda t: substring_dedup.word_names(t, 0)):
        for row in zip(q.tolist(), doc.tolist(), p.tolist(), n.tolist(), o.tolist(), strict=True):
            out[row[1]] |= {row[2] + i: (row[0], row[4] - i) for i in range(row[3])}
    return out


def test_equal_windows_have_equal_anchors():
    """Windows with runs at their ends, between all kinds of neighbours, the run's own word too."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    for _ in range(400):
        own = [rng.choice(words) for _ in range(rng.randint(30, 50))]
        run = [rng.choice(words)] * rng.randint(1, 12)
        tail = [rng.choice(words)] * (50 - len(own) - min(len(run), 50 - len(own)))
        window = ([*run[: 50 - len(own)], *own, *tail])[:50]
        texts, places = [], []
        for _ in range(8):
            before = [rng.choice([*words, window[0]]) for _ in range(rng.randint(0, 6))] + [window[0]] * rng.randint(0, 3)
            after = [window[-1]] * rng.randint(0, 3) + [rng.choice([*words, window[-1]]) for _ in range(rng.randint(0, 6))]
            texts.append(" ".join([*before, *window, *after]))
            places.append(len(before))
        found = anchors_of_windows(texts)
        assert len({own[at] for own, at in zip(found, places, strict=True)}) == 1, window


def test_versions_of_one_document(spark):
    """Rows that share an id or have none are documents of their own; others are judged as ever."""
    rng = np.random.default_rng(5)
    words = [str(w) for w in rng.integers(0, 10**6, 400)]
    long, short, other = " ".join(words), " ".join(words[:70]), " ".join(["x"] * 3 + words[100:300])
    noise = rng.integers(97, 123, 400).astype(np.uint8).tobytes().decode()
    rows = [(1, long), (1, short), (1, ""), (1, long), (2, other), (2, "q"), (0, "z " + " ".join(words[110:200])), (None, "ab" * 200), (None, noise), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    test_substring_windows(docs)
    test_suffix_strings(docs)


@pytest.mark.parametrize("ids", [(1, 5), (None, 10)])
@pytest.mark.parametrize("copies", [2, 1000])
def test_repeated_rows_with_open_ends(spark, ids, copies):
    """A later row has the opening of a repeated one: the repeated rows lose nothing, however many."""
    noise = random.Random(2).choices("abcdefghijklmnopqrstuvwxyz ", k=1200)
    t, own = "".join(noise).strip(), " ".join(f"q{i}" for i in range(60))
    words = " ".join(f"{a}{b}" for a, b in zip(noise, noise[1:], strict=False) if a != " " != b)
    for op, text, opening in ((suffix_dedup.suffix_digest, t, t[:600]), (substring_dedup.substring_digest, words, " ".join(words.split()[:100]))):
        docs = spark.createDataFrame([(ids[0], text)] * copies + [(ids[1], f"{own} {opening}")], "doc_id long, text string")
        got = op(docs).collect()
        assert len(got) == copies + 1
        assert {r.n_removed for r in got if r.doc_id == ids[0]} == {0}
        kept = own + " " * (op is suffix_dedup.suffix_digest)
        assert [r.kept_sha256 for r in got if r.doc_id == ids[1]] == [sha(kept)]


def test_words_that_polynomials_modulo_a_power_of_two_confuse(spark):
    """Thue-Morse strings: equal under such a polynomial whatever its base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    opening = [f"w{i}" for i in range(49)]
    docs = spark.createDataFrame([(0, " ".join([*opening, a])), (1, " ".join([*opening, b])), (2, " ".join([*opening, b]))], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_digest(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 50}


def test_names_that_collide_are_found_out(spark, monkeypatch):
    """Under the first seed all words have one name; the comparison sees it, and another seed is taken."""
    from citeforge.llm import repeats

    rng = np.random.default_rng(9)
    texts = [" ".join(str(x) for x in rng.integers(0, 50, 70)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    checks, verified = [], repeats.verified

    def weak(texts, seed):
        names, sizes = substring_dedup.word_names(texts, seed)
        return (np.ones_like(names) if seed == 0 else names), sizes

    def noted(*args):
        checks.append(verified(*args))
        return checks[-1]

    monkeypatch.setattr(repeats, "verified", noted)
    rows = substring_dedup.substring_dedup(docs, names=weak).collect()
    assert checks == [False, True]
    assert {r.doc_id: r.n_words - r.n_kept for r in rows} == {i: 70 * (i == 6) for i in range(7)}


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.A.Example.COM/en/1?x#y", "https://example.com/en/77", "x://com/en/", "https://com#/en/", "http://a.net/de/8/q", "http://q.example.net/de/8", "ftp://Éa.org/es/1?/en/", "http://a.org/ES/1", "://only", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("www.a.example.com", "/en/1", "com/en/", "block")
    assert (got[4].rule, got[4].verdict) == ("example.com/en/7", "allow")
    assert [got[i].rule for i in (5, 6, 7, 8, 10)] == ["com/en/", None, "net/de/", "example.net/de/8", None]
    assert (got[9].host, got[9].path, got[9].rule) == ("Éa.org", "/es/1", "org/es/")
    assert all((got[i].host, got[i].path) == ("", "") for i in (0, 1, 2))
    assert (got[12].host, got[12].path) == ("b:", "//c/d")
    assert len(got) == len(urls)


def test_url_templates_reject_by_purity(spark):
    rows = [(i, f"http://s.example/buy/{i}") for i in range(60)] + [(100 + i, f"http://s.example/read/{i}") for i in range(60)]
    rows += [(300 + i, f"http://s.example/tag{chr(97 + i % 26)}{chr(97 + i // 26)}/x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, True) for i in range(40)] + [(100 + i, False) for i in range(40)], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.url_filter(pages, rules=(), labels=labels).collect()}
    assert all(got[i].verdict == "block" for i in range(60))
    assert all(got[i].verdict == "allow" for i in range(100, 360) if i in got)
    assert got[300].template == "/*/x"


def test_url_unlabelled_branches_follow_their_siblings(spark):
    rows = [(100 * k + i, f"http://s.example/{c}/item/{i}") for k, c in enumerate("abcdefgh") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for few, verdict in ((3, "allow"), (7, "block")):  # labelled branches, all bad; h has no label
        labels = spark.createDataFrame([(100 * k + i, True) for k in range(few) for i in range(5)], "page_id long, bad boolean")
        got = {r.page_id: r for r in url_filter.url_filter(pages, rules=(), labels=labels).collect()}
        assert got[0].verdict == "block"
        assert got[700].verdict == verdict
        assert got[700].purity == (few + 2) / (few + 4)


def test_url_siblings_are_pooled_at_every_level(spark):
    """Fifteen categories under one segment with three bad labels each, another with good ones; and paths
    that part after the fifth segment."""
    rows = [(100 * k + i, f"http://s.example/shop/{chr(97 + k)}/item/{i}") for k in range(15) for i in range(4)]
    rows += [(2000 + 100 * k + i, f"http://s.example/news/{chr(97 + k)}/item/{i}") for k in range(15) for i in range(4)]
    rows += [(5000 + 100 * k + i, f"http://s.example/blog/y/m/d/{c}/{i}") for k, c in enumerate(("casino", "news")) for i in range(12)]
    rows += [(9000, "http://s.example/shop/z/item/1"), (9001, "http://s.example/" + "/".join("abcdefgh" * 5000)), (9001, "http://s.example/shop/z/item/1"), (None, "http://s.example/shop/z/item/2")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = [(100 * k + i, True) for k in range(15) for i in range(3)] + [(2000 + 100 * k + i, False) for k in range(15) for i in range(3)]
    labels += [(5000 + i, True) for i in range(12)] + [(5100 + i, False) for i in range(12)]
    got = url_filter.url_filter(pages, rules=(), labels=spark.createDataFrame(labels, "page_id long, bad boolean")).collect()
    assert len(got) == len(rows)
    verdicts = {r.page_id: r for r in got if r.page_id != 9001}
    assert all(verdicts[100 * k + i].verdict == "block" for k in range(15) for i in range(4))
    assert all(verdicts[2000 + 100 * k + i].verdict == "allow" for k in range(15) for i in range(4))
    assert {verdicts[5000 + i].verdict for i in range(12)} == {"block"} and {verdicts[5100 + i].verdict for i in range(12)} == {"allow"}
    assert verdicts[100].purity == (45 + 2) / (45 + 4)
    assert verdicts[9000].purity == verdicts[None].purity == (15 + 2) / (15 + 4)
    assert sorted(r.verdict for r in got if r.page_id == 9001) == ["allow", "block"]


def test_url_segments_beyond_the_depth_count(spark):
    """Templates that differ only below the tree's depth are judged apart; a long tail is no other template."""
    tail = "/z" * 3000
    rows = [(2 * i + k, f"http://h.com/a/b/c/d/{kind}/{i}{tail if i == 29 else ''}") for i in range(30) for k, kind in enumerate(("x", "y"))]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(p, p % 2 == 0) for p, _ in rows if p < 40], "page_id long, bad boolean")
    got = url_filter.url_filter(pages, rules=(), labels=labels, tree=url_filter.Tree(depth=3)).collect()
    assert {r.page_id: r.verdict for r in got if r.page_id < 58} == {p: ("allow", "block")[p % 2 == 0] for p in range(58)}
    assert {r.template for r in got if r.page_id < 58} == {"/a/b/c/d/x/{n}", "/a/b/c/d/y/{n}"}


def test_url_rules_as_labels_against_brute_force(spark, tmp_path):
    """The registered query, on hosts with ruled and unruled pages."""
    from citeforge.llm.registry import queries

    urls = [f"http://{h}/{s}/{i}" for h in ("a.com", "b.net", "c.example.net", "d.org") for s in ("en", "de", "es", "fr") for i in range(12)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries()["op5_url_filter"](spark, str(tmp_path)).collect()
    ruled = {("a.com", "en"): 12, ("d.org", "es"): 12, ("b.net", "de"): 0, ("c.example.net", "de"): 1}  # blocked; /de/8
    for r in got:
        branch = (r.host, r.path.split("/")[1])
        other = next(v for (h, _), v in ruled.items() if h == r.host)
        purity = (ruled[branch] + 2) / (12 + 4) if branch in ruled else (other / 12 + 2) / (1 + 4)
        assert abs(r.purity - purity) < 1e-12
        assert r.verdict == ("block" if branch in ruled and (ruled[branch] == 12 or ruled[branch] == 1 and r.path == "/de/8") else "allow")


def test_line_templates(docs):
    rows = {(r.doc_id, r.n_lines): r for r in line_dedup.line_dedup(docs).collect()}
    gone = [r for r in rows.values() if r.n_removed]
    assert len(gone) == 13
    assert all("Boilerplate" not in r.kept for r in gone)
    texts = dict(pairs(docs))
    assert all(r.kept == texts[r.doc_id] for r in rows.values() if not r.n_removed and r.doc_id is not None)


def test_line_templates_leave_a_common_opening(spark):
    word = lambda i, j: hashlib.md5(f"{i} {j}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:6]
    clean = [f"One of the {' '.join(word(i, j) for j in range(5))}" for i in range(60)]
    rows = [(i, line) for i, line in enumerate(clean)]
    rows += [(100 + i, f"{word(i, 9)}\nOne of the sites that we run today\nRead more\nPage {i}") for i in range(12)]  # 12 of 72 lines of the leaf
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shortest, short in ((3, "Read more\n"), (1, "")):
        got = {r.doc_id: r for r in line_dedup.line_dedup(docs, tree=line_dedup.LogTree(shortest=shortest)).collect()}
        assert all(got[i].kept == clean[i] for i in range(60))
        assert all(got[100 + i].kept == f"{word(i, 9)}\n{short}Page {i}" for i in range(12))


def expected_spans(t: str) -> list[tuple[int, int, int]]:
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans(docs):
    want = Counter()
    for i, t in pairs(docs):
        s = expected_spans(t)
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in s)
        want[(i, *(sum(x[1] == k for x in s) for k in range(3)), sha(joined), joined)] += 1
    assert bag(secret_scan.secret_digest(docs).collect()) == want


@pytest.mark.parametrize("text", ["secret secret=abcdefg", "tokentoken = abcdef", "api_key:'x' apikey=\"abcdef\"", "PASSWD==abcdefgh", "toKen=ſecret1", "tokenſ=abcdefg", "İtoken=abcdefg", "AKIAAKIA" + "A" * 20, "password=secret=abcdef"])
def test_secret_finder_equals_plain_expressions(text):
    order = {k: n for n, k in enumerate(secret_scan.KINDS)}
    assert [(s, order[k], e) for k, s, e in secret_scan.find_spans(text)] == expected_spans(text)


def test_secret_checksums():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"x ghp_{body}{secret_scan.base62_crc32(body)} y"
    assert [k for k, _, _ in secret_scan.find_spans(good)] == ["checksum"]
    assert secret_scan.find_spans(good.replace("ghp_A", "ghp_B")) == []
    assert secret_scan.without("aXXbYYc", [("hex", 1, 3), ("assign", 2, 3), ("hex", 4, 6)], "*") == "a*b*c"


def test_bpe_round_trip(docs):
    import tiktoken

    ranks = bpe.read_ranks(bpe.default_path(bpe.VOCAB_FILE))
    library = tiktoken.Encoding("t", pat_str=bpe.pattern(), mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in pairs(docs):
        ids = library.encode_ordinary(t)
        want[(i, len(ids), sha(" ".join(map(str, ids))), sha(t))] += 1
    assert bag(bpe.bpe_digest(docs).collect()) == want


def test_perfect_hash_is_minimal():
    ranks = bpe.read_ranks(bpe.default_path(bpe.VOCAB_FILE))
    table = bpe.PerfectHash(ranks)
    assert len(table.keys) == len(ranks) and all(table.get(k) == v for k, v in ranks.items())
    assert all(table.get(x) == -1 for x in (b"", b"no such token here", b"\xff\xfe\xfd"))


def test_simhash_links(docs):
    fps = {}
    for i, t in pairs(docs):
        w = WORD.findall(t.translate(LOWER))
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps[(i, t)] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least: dict = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = Counter((i, f"{fps[(i, t)]:016x}", least.get(find(fps[(i, t)]))) for i, t in pairs(docs))
    assert bag(simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_by_comparing_and_by_probing(spark, bucket):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    values = {simhash.signed(b ^ sum(1 << int(i) for i in rng.integers(0, 64, int(rng.integers(0, 4))))) for b in base for _ in range(25)}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {tuple(r) for r in simhash.links(fps, bucket=bucket).collect()} == want


OPS = [quality_rules.quality_rules, packing.pack, substring_dedup.substring_digest, suffix_dedup.suffix_digest, line_dedup.line_digest, secret_scan.secret_digest, exact_dedup.exact_dedup, bpe.bpe_digest, simhash.simhash_components]


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_empty_tables(empty, op):
    assert op(empty).collect() == []


def test_empty_pages(spark):
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).collect() == []
