"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes else."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.llm.columns import id_and_text
from citeforge.llm.tokenfiles import default_path, pattern, read_ranks

VOCAB_FILE = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers before it starts afresh.
MEMO_SIZE = 3 << 18


class PerfectHash:
    """A minimal perfect hash over byte strings: n keys, n slots, one probe per lookup.

    Keys are thrown into buckets; from the largest bucket on, a displacement is sought that
    sends all keys of the bucket to free slots. A bucket of one key stores its slot outright.
    """

    def __init__(self, values: dict[bytes, int]) -> None:
        n = self.size = len(values)
        self.buckets = max(1, n // 3)
        members: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in values:
            b, x, y = self._split(key)
            members[b].append((x, y, key))
        self.shift = [0] * self.buckets
        self.keys: list[bytes] = [b""] * n
        self.values = [-1] * n
        used = bytearray(n)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        free = None
        for b in order:
            own = members[b]
            if len(own) < 2:
                if not own:
                    break
                if free is None:
                    free = iter([i for i in range(n) if not used[i]])
                slots, shift = [next(free)], None
                self.shift[b] = -slots[0] - 1
            else:
                shift = 0
                while True:
                    slots = [(x + shift * y) % n for x, y, _ in own]
                    if len(set(slots)) == len(own) and not any(used[s] for s in slots):
                        break
                    shift += 1
                self.shift[b] = shift
            for s, (_, _, key) in zip(slots, own, strict=True):
                used[s] = 1
                self.keys[s], self.values[s] = key, values[key]

    def _split(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32) & 0xFFFFFFFFFFF, ((h >> 80) & 0xFFFFFFFFFFF) | 1

    def get(self, key: bytes) -> int:
        """The key's value, -1 for other strings."""
        b, x, y = self._split(key)
        shift = self.shift[b]
        slot = -shift - 1 if shift < 0 else (x + shift * y) % self.size
        return self.values[slot] if self.keys[slot] == key else -1


class Decoder:
    """Decodes ids from one string of all tokens' bytes."""

    def __init__(self, path: str) -> None:
        by_id = sorted((i, t) for t, i in read_ranks(path).items())
        self.lengths = np.zeros(by_id[-1][0] + 1, np.int64)
        self.lengths[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.starts = np.zeros(len(self.lengths), np.int64)
        self.starts[[i for i, _ in by_id]] = np.cumsum([0, *(len(t) for _, t in by_id)][:-1])
        self.blob = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after another."""
        n = self.lengths[ids]
        stop = np.cumsum(n)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.starts[ids] - (stop - n), n)
        return self.blob[at]


class Encoder:
    """Encodes pre-tokens by rank, with a bounded memo of pre-tokens."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.whole = PerfectHash(self.ranks)
        self.split = regex.compile(pattern()).findall
        self.memo: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: its bytes are a linked list, a heap has the mergeable pairs.

        The lowest rank merges first and, of equal ranks, the leftmost pair. An entry of the
        heap is stale once either part has changed, which its remembered lengths show.
        """
        ranks = self.ranks
        n = len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here; 0: merged away
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapify(heap)
        while heap:
            r, i, stop = heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(piece[i : end[stop]])
                if r is not None:
                    heappush(heap, (r, i, end[stop]))
            j = before[i]
            if j >= 0:
                r = ranks.get(piece[j:stop])
                if r is not None:
                    heappush(heap, (r, j, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def piece_ids(self, word: str) -> bytes:
        """Ids of one pre-token as 32-bit integers."""
        raw = word.encode()
        whole = self.whole.get(raw)
        return array("i", [whole] if whole >= 0 else self.merge(raw)).tobytes()

    def encode(self, text: str) -> bytes:
        memo, words = self.memo, self.split(text)
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) + len(words) > MEMO_SIZE:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = self.piece_ids(w)
            return b"".join(map(memo.__getitem__, words))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: what a worker holds doesn't depend on the batch size."""
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def encode_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """One row per input row: doc_id and ``ids`` (array of int), without special tokens.

    A map without shuffle; a worker holds the vocabulary and a bounded memo. Null and empty
    texts give an empty array. Strings of special tokens in a text are ordinary text.
    """
    path = vocab or default_path(VOCAB_FILE)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in pieces(batches):
            rows = [own.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
            ids = pa.ListArray.from_arrays(pa.array(offsets), values).cast(schema.field("ids").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_bpe(encoded: DataFrame, vocab: str | None = None) -> DataFrame:
    """Adds ``decoded`` (binary) to rows of (doc_id, ids); an id outside the vocabulary fails.

    Null ids count as no ids.
    """
    path = vocab or default_path(VOCAB_FILE)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32()))), ("decoded", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for batch in pieces(batches):
            col = batch.column(1)
            rows = [own.decode(col[i].values.to_numpy()).tobytes() if col[i].is_valid and len(col[i]) else b"" for i in range(len(col))]
            yield pa.RecordBatch.from_arrays([batch.column(0), col.cast(schema.field("ids").type), pa.array(rows, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def bpe_digest(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """The contract's columns: counts and digests of the ids and of the decoded bytes."""
    return decode_bpe(encode_bpe(docs, vocab=vocab), vocab).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
