"""Substring deduplication of words by recompression.

A document is a string of word names. In each round every symbol has a type, left or right, drawn
from its name; a left symbol followed by a right one becomes the pair's symbol, and what stays in
runs of equal symbols becomes the run's symbol. Names come from content alone, so a pair or a run
has the same name wherever it stands in the corpus, and equal substrings get equal symbols but at
their ends. Along with each symbol goes its *context*: the words that settled how it was formed.
A symbol whose context lies inside a window is in every copy of that window at the same place.

Of each 50-word window the anchor is one symbol of the highest level that has any with its context
inside; words are level 0, so every window has one. Shared anchors reveal repeats, and ``repeats``
verifies them and finds their ends to the word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.llm.repeats import CHUNK, K2, Units, anchor_rows, chunks, mixed, without_repeats

WIDTH = 50
ROUNDS = 7
#: Windows that go together before single ones are compared.
BLOCK = 8
_LOW = np.uint64(0xFFFFFFFF)
_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\x0b\x0c\r")] = True
#: Bytes that one prefix sum covers, whole words only; sums of that many residues fit into 64 bits.
SEGMENT = 1 << 20
#: The two prime moduli of a word's name.
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)


@lru_cache(8)
def _field(seed: int, prime: int) -> tuple[np.ndarray, int, int]:
    """Of a seed and a prime: a residue for each byte, and a base and its inverse."""
    rng = np.random.default_rng((seed, prime))
    base = int(rng.integers(1 << 20, prime))
    return rng.integers(1, prime, 256).astype(np.uint64), base, pow(base, -1, prime)


@lru_cache(8)
def _powers(base: int, prime: int, bits: int) -> np.ndarray:
    """base ** i modulo prime for i under 2 ** bits, by doubling."""
    out = np.ones(1, _U)
    for k in range(bits):
        out = np.concatenate((out, out * _U(pow(base, 1 << k, prime)) % _U(prime)))
    return out


def word_names(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts, one after another, and how many each text has.

    A name is two polynomials over the word's bytes, modulo primes and at random places, mixed: two
    words of n bytes agree for at most (n / 2 ** 31) ** 2 of all seeds. Prefix sums over the bytes,
    a segment at a time, give them all. It is never 0, which marks the end of a document.
    """
    b = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    edge = np.flatnonzero(np.diff(_WHITE[b].view(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]
    names, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, "right")))
        first, own = start[i], b[start[i] : end[j - 1]]
        bits, parts = (len(own) - 1).bit_length(), []
        for prime in _PRIMES:
            of_byte, base, inverse = _field(seed, prime)
            terms = of_byte[own] * _powers(base, prime, bits)[: len(own)] % _U(prime)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            parts.append((total[end[i:j] - first] - total[start[i:j] - first]) % _U(prime) * _powers(inverse, prime, bits)[start[i:j] - first] % _U(prime))
        names[i:j] = mixed(parts[0] << _U(32) | parts[1], (end[i:j] - start[i:j]).astype(np.uint64))
        i = j
    names[names == 0] = 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    return names, np.diff(np.searchsorted(start, ends), prepend=0)


def levels(names: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, start, context start, context end) of the symbols of each level.

    ``names``: word names with a 0 before, between and after documents. A symbol that touches
    the end of a document has that 0 in its context, so it never counts as inside a window.
    """
    name, start = names, np.arange(len(names))
    lo, hi = start, start + 1
    yield name, start, lo, hi
    for k in range(1, rounds + 1):
        if len(name) < 3:
            return
        inner = name != 0
        right = (mixed(name, np.full(1, k, np.uint64)) >> _U(40) & _U(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = inner[:-1] & ~right[:-1] & inner[1:] & right[1:]
        second = np.concatenate(([False], pair[:-1]))
        alone = inner & ~pair & ~second
        same = np.zeros(len(name), bool)
        same[1:] = alone[1:] & alone[:-1] & (name[1:] == name[:-1])
        head = np.flatnonzero(~second & ~same)
        size = np.diff(np.append(head, len(name)))
        last = head + size - 1
        paired, run = pair[head], (size > 1) & ~pair[head]
        new = name[head]
        new[paired] = mixed(name[head[paired]], name[last[paired]])
        new[run] = mixed(name[head[run]], size[run].astype(np.uint64) ^ K2)
        low, high = np.minimum.reduceat(lo, head), np.maximum.reduceat(hi, head)
        # What is no pair depends on both neighbours, which are then not its partners.
        free = ~paired & inner[head]
        before, after = head[free] - 1, last[free] + 1
        # A neighbour of the same name is half of a pair, or else it would stand in the run: its partner counts.
        before = before - (name[before] == name[head[free]])
        after = after + (name[after] == name[head[free]])
        low[free] = np.minimum(low[free], lo[before])
        high[free] = np.maximum(high[free], hi[after])
        new[(new == 0) & inner[head]] = 1
        name, start, lo, hi = new, start[head], low, high
        yield name, start, lo, hi


def range_least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of x[a : b + 1] for each pair of bounds (a <= b)."""
    out = np.empty(len(a), x.dtype)
    power = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    for k in range(int(power.max(initial=0)) + 1):
        here = np.flatnonzero(power == k)
        if len(here):
            out[here] = np.minimum(x[a[here]], x[b[here] - (1 << k) + 1])
        if len(x) > 1 << k:
            x = np.minimum(x[: -(1 << k)], x[1 << k :])
    return out


def window_names(names: np.ndarray, p: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Names of the ``width`` words from each place: by doubling, the last step overlapping."""
    h, depth = names, 1
    while 2 * depth <= width:
        h = mixed(h[:-depth], h[depth:])
        depth *= 2
    return mixed(h[p], h[p + width - depth])


def word_strings(texts: list[bytes], of_words: Callable):
    """First places of texts, and names of their strings by (places, words)."""
    names, size = of_words(texts)
    return np.cumsum(size) - size, lambda p, size: window_names(names, p, size)


def word_anchors(batch: pa.RecordBatch, width: int, of_words: Callable) -> Iterator[list]:
    """Anchor rows of a batch of (doc_id, text, tag)."""
    ids, texts, tags = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_numpy()
    for i, j in chunks([len(t) for t in texts], 6 * CHUNK):
        words, sizes = of_words(texts[i:j])
        begin = np.cumsum(sizes + 1) - sizes
        doc = np.repeat(np.arange(j - i), sizes)
        place = np.arange(len(words)) + doc + 1
        names = np.zeros(len(words) + len(sizes) + 1, np.uint64)
        of_doc = np.zeros(len(names), np.int64)
        names[place], of_doc[place] = words, doc
        p = place[place - begin[doc] <= sizes[doc] - width]
        anchor, q, todo = np.empty(len(p), np.int64), np.empty(len(p), np.uint64), np.arange(len(p))
        for level, (name, start, lo, hi) in reversed(list(enumerate(levels(names)))):
            a, b = np.searchsorted(lo, p[todo], "left"), np.searchsorted(hi, p[todo] + width, "right") - 1
            has = a <= b
            order = mixed(name, np.full(1, level, np.uint64)) & ~_LOW | np.arange(len(name), dtype=np.uint64)
            which = (range_least(order, a[has], b[has]) & _LOW).astype(np.int64)
            done = todo[has]
            anchor[done] = start[which] << 5 | level
            q[done] = mixed(name[which], np.full(1, level, np.uint64))
            todo = todo[~has]
            if not len(todo):
                break

        def text_name(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, names: np.ndarray = names) -> np.ndarray:
            both = mixed(window_names(names, lo, width), window_names(names, hi, width))
            return mixed(both, ((hi - lo) << 20 | (at - lo)).astype(np.uint64))

        yield anchor_rows(ids[i:j], tags[i:j], begin, of_doc, p, anchor, q, anchor >> 5, text_name)


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary()), ("n_kept", pa.int64())])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, names: Callable = word_names) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (first, past last word of what goes), kept
    (UTF-8 of the other words, joined by one space), n_kept.

    Every word goes that is covered by a ``width``-word window whose words also stand in a row in
    a document with a smaller id; windows are judged on the input. Words are runs of anything but
    the six ASCII white-space characters. Null and empty texts have no words; null ids come first.
    Rows that share an id are documents of their own, none smaller than the other; equal rows get
    equal results. Columns besides the two are ignored. ``names(texts, seed)`` names words.
    """

    def taken(text: bytes):
        words = text.split()
        return lambda at, size: b" ".join(words[at : at + size])

    def cut(text: bytes, gone: list) -> tuple:
        words = text.split()
        kept, at = [], 0
        for s, e in gone:
            kept += words[at:s]
            at = e
        kept += words[at:]
        return len(words), gone, b" ".join(kept), len(kept)

    def units(seed: int) -> Units:
        of_words = lambda texts: names(texts, seed)
        return Units(lambda batch: word_anchors(batch, width, of_words), lambda texts: word_strings(texts, of_words), taken, cut)

    return without_repeats(docs, id_col, text_col, width, BLOCK, False, units, OUT, "doc_id long, n_words long, spans array<array<long>>, kept binary, n_kept long")


def substring_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from the operator's kept words."""
    return substring_dedup(docs).select(
        "doc_id", "n_words", (F.col("n_words") - F.col("n_kept")).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )
