"""Suffix-array deduplication of bytes by bucket-pointer refinement.

Suffixes are put into buckets by q-grams of 1, 2, 4 ... 32 bytes: the bucket of twice the depth at
a place is named by the pair (bucket here, bucket at the later offset), the pointer refinement, and
every depth reuses the names of the last. A suffix is only carried on where its 32-byte bucket
has other members: of each 100-byte window the least bucket name is the anchor that goes to the
cluster (see ``repeats``), and members of a shared bucket are refined to depth 100 by the bucket
names at offsets 32, 36 and 68. A sorted suffix array is only built as far as it decides anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.llm.repeats import K1, Units, anchor_rows, chunks, mixed, without_repeats

WIDTH = 100
GRAM = 32
#: Windows that go together before single ones are compared.
BLOCK = 17
_BYTE = np.arange(1, 257, dtype=np.uint64) * K1
_BYTE ^= _BYTE >> np.uint64(31)
_BYTE *= np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFFFFF)


def gram_buckets(b: np.ndarray, seed: int) -> np.ndarray:
    """Bucket names of the 32-byte strings at each place (fewer places than bytes by 31)."""
    h, depth = mixed(_BYTE, np.full(1, seed, np.uint64))[b], 1
    while depth < GRAM:
        h = mixed(h[:-depth], h[depth:])
        depth *= 2
    return h


def deep_buckets(h: np.ndarray, p: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Buckets of depth ``width`` (65 to 128) at places p, refined from those of depth 32."""
    two = lambda at: mixed(h[at], h[at + GRAM])
    return mixed(two(p), two(p + (width - 2 * GRAM)))


def sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of x[i : i + span] at each i."""
    have = 1
    while 2 * have <= span:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (span - have)], x[span - have :]) if span > have else x


def byte_anchors(batch: pa.RecordBatch, width: int, seed: int) -> Iterator[list]:
    """Anchor rows of a batch of (doc_id, text, tag)."""
    ids, texts, tags = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_numpy()
    long = [i for i, t in enumerate(texts) if len(t) >= width]
    ids, tags, texts = ids[long], tags[long], [texts[i] for i in long]
    for i, j in chunks([len(t) for t in texts]):
        sizes = np.array([len(t) for t in texts[i:j]], np.int64)
        b = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        h = gram_buckets(b, seed)
        order = h & ~_LOW
        order |= np.arange(len(h), dtype=np.uint64)  # ties go to the left
        anchor = (sliding_least(order, width - GRAM + 1) & _LOW).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        of_doc = np.repeat(np.arange(j - i), sizes)
        valid = np.ones(len(b), bool)
        for end in np.cumsum(sizes).tolist():
            valid[end - width + 1 : end] = False
        p = np.flatnonzero(valid)
        anchor = anchor[p]

        def text_name(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, h: np.ndarray = h) -> np.ndarray:
            both = mixed(deep_buckets(h, lo, width), deep_buckets(h, hi, width))
            return mixed(both, ((hi - lo) << 20 | (at - lo)).astype(np.uint64))

        yield anchor_rows(ids[i:j], tags[i:j], begin, of_doc, p, anchor, h[anchor], anchor, text_name)


def byte_names(texts: list[bytes], seed: int):
    """First places of texts, and names of their strings by (places, size), from 32-byte buckets."""
    size = np.array([len(t) for t in texts], np.int64)
    h = gram_buckets(np.frombuffer(b"".join(texts), np.uint8), seed)
    return np.cumsum(size) - size, lambda p, size: deep_buckets(h, p, size)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (start, end of what goes), kept (bytes).

    Every byte goes that is covered by a ``width``-byte string (81 to 128) which also starts
    earlier, in a document with a smaller id or before in the same document; overlaps count, and
    strings are judged on the input. Null and empty texts have nothing to remove; null ids come
    first. Rows that share an id are documents of their own, none smaller than the other; equal rows
    get equal results. Columns besides the two are ignored.
    """
    if not 2 * GRAM + BLOCK <= width <= 4 * GRAM:
        raise ValueError(f"width must be from {2 * GRAM + BLOCK} to {4 * GRAM}")

    def cut(text: bytes, gone: list) -> tuple:
        parts, at = [], 0
        for s, e in gone:
            parts.append(text[at:s])
            at = e
        return len(text), gone, b"".join([*parts, text[at:]]) if gone else text

    def units(seed: int) -> Units:
        return Units(lambda batch: byte_anchors(batch, width, seed), lambda texts: byte_names(texts, seed), lambda text: lambda at, size: text[at : at + size], cut)

    return without_repeats(docs, id_col, text_col, width, BLOCK, True, units, OUT, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")


def suffix_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans and kept bytes."""
    return suffix_dedup(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
