"""Secret scans: keyword automaton, anchored expressions near hits, embedded checksums."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.llm.columns import arrow_rows, id_and_text

# The keywords, expressions and least lengths of the base kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Tokens that end in the CRC-32 of what stands between prefix and checksum, in base 62.
CHECKSUM_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKSUMMED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: base spans sort by start, then in this order; ``checksum`` is what the method adds.
KINDS = ("assign", "access", "hex", "checksum")
SPAN = "array<struct<kind:string,start:int,end:int>>"

_TO_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_HEX_RUN = b"x" * MIN_HEX


def base62_crc32(body: str) -> str:
    """The six digits that close a checksummed token."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    """One pass over the lower-cased text finds every keyword; values: (kind, length)."""
    a = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        a.add_word(w, (0, len(w)))
    a.add_word("akia", (1, 4))
    for w in CHECKSUM_PREFIXES:
        a.add_word(w, (3, len(w)))
    a.make_automaton()
    return a


def _ascii_lower(text: str) -> str:
    """Lower case of A-Z; other letters keep their place, which ``str.lower`` may not."""
    low = text.lower()
    return low if len(low) == len(text) else text.encode().lower().decode()


def find_spans(text: str, raw: bytes | None = None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start and then kind."""
    raw = text.encode() if raw is None else raw
    found: list[tuple[int, int, int]] = []
    ends = [0, 0, 0, 0]
    hits = sorted((end - n + 1, kind) for end, (kind, n) in _automaton().iter(_ascii_lower(text)))
    for start, kind in hits:
        if start < ends[kind]:  # inside the last match of its kind
            continue
        if kind == 0 and (m := ASSIGN.match(text, start)):
            ends[0] = m.end()
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                found.append((start, 0, m.end()))
        elif kind == 1 and (m := ACCESS.match(text, start)):
            ends[1] = m.end()
            if m.end() - start >= MIN_ACCESS:
                found.append((start, 1, m.end()))
        elif kind == 3 and (m := CHECKSUMMED.match(text, start)) and base62_crc32(m[1]) == m[2]:
            ends[3] = m.end()
            found.append((start, 3, m.end()))
    if _HEX_RUN in raw.translate(_TO_HEX):
        found += ((m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX)
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def without(text: str, spans: list[tuple[str, int, int]], by: str) -> str:
    """The text with each maximal run of overlapping spans replaced once."""
    parts, at = [], 0
    for _, s, e in spans:
        if s >= at:
            parts += (text[at:s], by)
        at = max(at, e)
    return "".join([*parts, text[at:]]) if spans else text


def replaced(text: str, by: str) -> tuple[str, int]:
    spans = find_spans(text)
    return without(text, spans, by), len(spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: str | None = None) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end in code points) and, with
    ``redact``, the text in which each secret is replaced by that string.

    A map without shuffle. Every keyword is looked for in one automaton pass, and expressions
    run only where it hit; a checksummed token counts only if its checksum is right. Null and
    empty texts have no spans. Overlapping spans of different kinds all stay in ``spans``;
    ``redact`` replaces their union once. Ties in start are in the order of ``KINDS``.
    """

    def make(ids: list, texts: list[bytes]) -> dict[str, list]:
        spans, clean = [], []
        for raw in texts:
            text = raw.decode()
            own = find_spans(text, raw)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
            if redact is not None:
                clean.append(without(text, own, redact))
        return {"doc_id": ids, "spans": spans, "text": clean}

    schema = f"doc_id long, spans {SPAN}" + (", text string" if redact is not None else "")
    return arrow_rows(id_and_text(docs, id_col, text_col), schema, make)


def redacted(docs: DataFrame, by: str, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All columns, with the secrets of the text replaced by ``by``; where some were, ``length_col`` becomes
    the new text's length.

    Null texts stay null. Equal rows get equal results. The text is rewritten where it stands, by
    an Arrow function of that one column, so no row has to find its way back, and no column of
    the input can clash: the result is one struct, under a name that none of them has.
    """

    @F.pandas_udf("text string, n int")
    def clean(texts: pd.Series) -> pd.DataFrame:
        done = [(None, 0) if t is None else replaced(t, by) for t in texts]
        return pd.DataFrame(done, columns=["text", "n"])

    own = "_" * (1 + max(map(len, docs.columns))) + "clean"
    out = docs.withColumn(own, clean(docs[text_col].cast("string")))
    new = {text_col: F.col(f"{own}.text")}
    if length_col is not None and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        new[length_col] = F.when(F.col(f"{own}.n") == 0, docs[length_col]).otherwise(F.length(F.col(f"{own}.text")).cast(kind))
    return out.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind != KINDS[3])
    return scan_secrets(docs).select(
        "doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


__all__ = ["find_spans", "joined", "redacted", "scan_secrets", "secret_digest"]
