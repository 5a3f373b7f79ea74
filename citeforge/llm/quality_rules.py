"""Quality rules: compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.llm.columns import arrow_rows, id_and_text

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of zstandard ratios (compressed / raw bytes) by length.

    ``edges`` are the lower ends of the length classes in bytes; a text whose ratio is below
    ``low`` of its class is repetitive, above ``high`` incompressible. A text over ``chunk_bytes``
    also fails if more than ``max_bad_chunks`` of its chunks leave their band, which is that of
    their length class for the shorter last one: so junk inside an otherwise clean long text shows.
    """

    edges: tuple[int, ...] = (0, 128, 256, 512, 1024, 2048, 4096, 8192)
    low: tuple[float, ...] = (0.0, 0.40, 0.36, 0.33, 0.30, 0.28, 0.26, 0.25)
    high: tuple[float, ...] = (9.0, 1.02, 0.92, 0.85, 0.80, 0.77, 0.75, 0.74)
    chunk_bytes: int = 2048
    chunk_low: float = 0.28
    chunk_high: float = 0.77
    max_bad_chunks: float = 0.1
    level: int = 3


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks int, n_low_chunks int, n_high_chunks int, reason string"
)


def word_chars(b: bytes) -> int:
    """Code points outside ASCII white space: bytes that don't continue a code point."""
    packed = b.translate(None, WHITE)
    return len(packed) if packed.isascii() else len(packed.decode())


def duplicate_lines(b: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in b.split(b"\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


class Judge:
    """The measures and the verdict of one text: the columns of ``SCHEMA`` after doc_id."""

    def __init__(self, bands: Bands, min_words: int, max_repeat_percent: int) -> None:
        self.bands, self.min_words, self.max_repeat_percent = bands, min_words, max_repeat_percent

    def chunks(self, text: bytes) -> Iterator[bytes]:
        """All of a text over one chunk, the last chunk as long as it is."""
        size = self.bands.chunk_bytes
        return (text[at : at + size] for at in range(0, len(text), size)) if len(text) > size else iter(())

    def outside(self, chunk: bytes, squeeze: Callable[[bytes], bytes]) -> str | None:
        """Which limit a chunk is beyond."""
        b, ratio = self.bands, len(squeeze(chunk)) / len(chunk)
        k = bisect_right(b.edges, len(chunk)) - 1
        least, most = (b.chunk_low, b.chunk_high) if len(chunk) == b.chunk_bytes else (b.low[k], b.high[k])
        return "low" if ratio < least else "high" if ratio > most else None

    def __call__(self, text: bytes) -> tuple:
        b = self.bands
        squeeze = zstandard.ZstdCompressor(level=b.level).compress
        words = text.split()
        n = len(words)
        repeated = repeat_words(words) if n > 2 else 0
        ratio = len(squeeze(text)) / len(text) if text else 0.0
        k = bisect_right(b.edges, len(text)) - 1
        bad = [self.outside(chunk, squeeze) for chunk in self.chunks(text)]
        low, high = bad.count("low"), bad.count("high")
        base = n < self.min_words or 100 * repeated > self.max_repeat_percent * n
        reason = (
            "base" if base
            else "repetitive" if ratio < b.low[k]
            else "incompressible" if ratio > b.high[k]
            else "chunks" if low + high > b.max_bad_chunks * len(bad)
            else None
        )
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        return n, word_chars(text), symbols, duplicate_lines(text), repeated, base, reason is None, ratio, len(bad), low, high, reason


def kept_rows(docs: DataFrame, text_col: str = "text", bands: Bands | None = None, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows whose text passes, all columns. Only the text goes to Python, and no row has to be
    found again by its id, so missing and repeated ids don't matter."""
    judge = Judge(bands or Bands(), min_words, max_repeat_percent)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return pd.Series([judge((t or "").encode())[6] for t in texts], dtype=bool)

    return docs.filter(passes(docs[text_col].cast("string")))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: Bands | None = None,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """One row per input row with word counts, zstandard ratios and the verdict ``kept``.

    A map over Arrow batches: no shuffle, and nothing is held beyond a batch. Words are runs
    of anything but space, \\t, \\n, \\v, \\f and \\r. Null and empty texts have no words, a ratio
    of 0 and fail the base rule. Repeated rows are judged alike; ties don't arise. ``reason``
    is null for kept rows, else base, repetitive, incompressible or chunks.
    """
    b = bands or Bands()

    judge = Judge(b, min_words, max_repeat_percent)

    def make(ids: list, texts: list[bytes]) -> dict[str, list]:
        rows = [(i, *judge(t)) for i, t in zip(ids, texts, strict=True)]
        return {c.split()[0]: [r[k] for r in rows] for k, c in enumerate(SCHEMA.split(", "))}

    return arrow_rows(id_and_text(docs, id_col, text_col), SCHEMA, make)
