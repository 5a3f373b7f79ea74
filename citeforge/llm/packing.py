"""Best-fit packing of token pieces into sequences of a fixed length.

Bulk-synchronous best-fit over runs. Pieces of one length are interchangeable, and so are gaps of one
size, so the tables of the supersteps have runs: pieces of a length from one rank to another, and
sequences from one number to another with the same gap. Lengths fall into bands (capacity / k),
longest first, and a band is one superstep:

1. its runs of pieces and the runs of gaps are range-sorted by size together, largest first;
2. a sweep over each sorted part hands every piece its successor, the smallest gap that holds it;
3. pieces that found none in their part, and the gaps that all parts left, are swept once more, in the
   order of their ranks, which resolves what crosses parts; new sequences open for what is left then;
4. gaps shrink by what they took, and pass to the next band.

Runs split at most twice for each run of pieces, so their number depends on ``capacity``, not on the number of
documents; what does grow is read twice (counts of lengths, then places) and never sorted. A piece knows its
rank by its part of the table, its number there among pieces of its length, and the counts of the parts before.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeforge.llm.columns import id_and_text
from citeforge.llm.scratch import written
from citeforge.llm.tokenfiles import default_path, pattern, read_ranks

TOKENIZER_FILE = "byte_bpe_50k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"
SEPARATOR_ID = 2
CAPACITY = 1024

#: A band ends at capacity // k; pieces of a band fit k times into an empty sequence.
BANDS = (1, 2, 3, 4, 5, 6, 8, 11, 16, 32, 64, 256)
#: Lengths of a band for each part of its range sort.
SIZES_A_PART = 256
#: Sequences that a band opens have numbers from its own multiple of this.
NUMBERS_A_BAND = 1 << 48
#: A run's length and first rank in one sort key: lengths times this, ranks below it.
RANKS = 1 << 44

#: Texts of these characters split into pre-tokens alike under any version of the character
#: tables, so the faster encoder of the same vocabulary may take them.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ɏ]*").fullmatch
SPECIAL = "<|endoftext|>"


class Tokens:
    """Ids as the ``tokenizers`` library gives them for the JSON file.

    A text of plain characters without special strings goes through the rank file of the same
    vocabulary, which gives the same ids in a quarter of the time; any other text goes through
    the library itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str) -> None:
        import tiktoken

        self.path = tokenizer_path
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern(), mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        self.slow = None

    def library(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if PLAIN(text) and SPECIAL not in text:
            return self.fast.encode_to_numpy(text)
        return self.library(text)


@lru_cache(2)
def tokens(tokenizer_path: str, ranks_path: str) -> Tokens:
    return Tokens(tokenizer_path, ranks_path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its place among pieces of its
    length: part, and nth there, from 0. A map without shuffle."""
    paths = tokenizer_path or default_path(TOKENIZER_FILE), ranks_path or default_path(RANKS_FILE)
    types = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokens(*paths), TaskContext.get().partitionId()
        before = [0] * (capacity + 1)
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(own.ids(text), SEPARATOR_ID).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, x in zip(out, (doc_id, k, start, length, crc, part, before[length]), strict=True):
                        column.append(x)
                    before[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, types, strict=True)], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"{PIECE}, part int, nth long")


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces (no sequence_id), gaps (no length), or pieces in their sequences: ``per`` of them to each of the
#: sequences from sequence_id, from ``at`` there.
RUN = "length long, first long, n long, sequence_id long, per long, at long, free long"


def best_fit(pieces: list[tuple], gaps: list[tuple], capacity: int, opened: int | None = None) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Runs of pieces (length, first, n), longest first, into the tightest of the gaps (sequence, n, free).

    Returns runs in place (length, first, n, sequence, per, at), the gaps then, and the pieces that none
    holds. With ``opened``, the first number of a new sequence, new ones open for those instead.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for sequence, n, free in sorted(gaps, reverse=True):
        runs[free].append((sequence, n))
    sizes, taken, rest = sorted(runs), [], []

    def offer(sequence: int, n: int, free: int) -> None:
        if n and free:
            if not runs[free]:
                insort(sizes, free)
            runs[free].append((sequence, n))

    for length, first, n in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while n:
            k = bisect_left(sizes, length)
            if k == len(sizes) and opened is None:
                rest.append((length, first, n))
                break
            if k == len(sizes):
                more = -(-n // (capacity // length))
                offer(opened, more, capacity)
                opened += more
            free = sizes[k]
            sequence, count = runs[free].pop()
            if not runs[free]:
                sizes.pop(k)
            # A gap that has taken a piece is the tightest for the next of its length, as long as it holds it.
            per = min(free // length, n)
            filled = min(count, n // per)
            taken.append((length, first, filled * per, sequence, per, capacity - free))
            offer(sequence + filled, count - filled, free)
            offer(sequence, filled, free - per * length)
            first, n = first + filled * per, n - filled * per
    return taken, [(sequence, n, free) for free in sizes for sequence, n in runs[free]], rest


def swept(rows: DataFrame, shortest: int, capacity: int, opened: int | None = None) -> DataFrame:
    """``best_fit`` over each part of ``rows``. Shorter pieces, and those in place, pass through."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in RUN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pieces, gaps = [], [], []
        for row in (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            length, first, n, sequence, per, _, free = row
            if length is None:
                gaps.append((sequence, n, free))
            elif per is None and length >= shortest:
                pieces.append((length, first, n))
            else:
                out.append(row)
        taken, left, rest = best_fit(pieces, gaps, capacity, opened)
        out += [(*t, None) for t in taken] + [(None, None, n, sequence, None, None, free) for sequence, n, free in left]
        out += [(*p, None, None, None, None) for p in rest]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return rows.mapInArrow(run, RUN)


def packed(lengths: DataFrame, capacity: int = CAPACITY, sizes_a_part: int = SIZES_A_PART) -> list[tuple]:
    """Runs in place (length, first, n, sequence_id, per, at) of rows (length, n).

    One job: two shuffles of runs for each band. The driver gets the runs, whose number depends on
    ``capacity`` only.
    """
    highs = sorted({capacity // k for k in BANDS if capacity // k} | {1}, reverse=True)
    none = (F.lit(None).cast("long").alias(c) for c in ("sequence_id", "per", "at", "free"))
    rows = lengths.select("length", F.lit(0).cast("long").alias("first"), "n", *none)
    for k, (high, low) in enumerate(zip(highs, [*highs[1:], 0], strict=True)):
        parts = 2 + (high - low) // sizes_a_part
        size = F.least(F.coalesce("length", "free"), F.lit(high))
        of_range = F.least(F.floor((high - size) * parts / (high - low)), F.lit(parts - 1)).cast("int")
        found = swept(rows.repartitionById(parts, of_range), low + 1, capacity)
        rows = swept(found.repartition(1), low + 1, capacity, k * NUMBERS_A_BAND)
    return [tuple(r)[:-1] for r in rows.filter("per is not null").collect()]


def place(pieces: DataFrame, capacity: int = CAPACITY, sizes_a_part: int = SIZES_A_PART) -> DataFrame:
    """Rows of (doc_id, piece, start, length, ids_crc32, part, nth) with sequence_id and offset instead of the last two."""
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "packing_counts")
    runs = packed(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity, sizes_a_part)
    runs.sort()
    own = pieces.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 6))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"))
    columns = [x.split()[0] for x in PIECE.split(", ")]
    ranked = pieces.join(before, ["length", "part"]).select(*columns, (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, per, at = own.value.T
        keys = length * RANKS + first
        for batch in batches:
            lengths, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, lengths * RANKS + rank, "right") - 1
            turn, place_there = np.divmod(rank - first[k], per[k])
            ours = pa.array(sequence[k] + turn), pa.array(at[k] + place_there * lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *ours], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECE}, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **paths: str) -> DataFrame:
    """One row per piece with its sequence and its place there, gapless from 0.

    A document is its ids and a closing separator, so a null or empty text is one piece of one
    token. Only documents over ``capacity`` are cut. Rows that repeat an id are documents of
    their own; pieces of equal length are interchangeable, and ties go by their places in the table.
    An empty table gives an empty result.
    """
    return place(written(token_pieces(docs, id_col, text_col, capacity, **paths), "pieces"), capacity)
