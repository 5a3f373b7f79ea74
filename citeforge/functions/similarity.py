"""Similarity of titles, authors and texts over columns."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeforge.functions import fixed
from citeforge.functions.text import let, normalize_casefold, normalize_joined, normalize_text, tokens


@F.pandas_udf(T.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The matching-blocks ratio, popular characters of a long right side ignored. It depends on
    the order of its arguments. Nulls give null: so rows that need no ratio cost none."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def _places(text: str) -> dict[str, int]:
    """For each letter of a text the places where it stands, as bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(text):
        where[c] = where.get(c, 0) | 1 << i
    return where


def common_with_each(texts: tuple[str, ...], b: str, known: dict[str, dict[str, int]]) -> list[int]:
    """Letters of the longest common subsequence of each text and ``b``, in one pass: a bit for each letter of the texts
    in one number, and a spare one after each text, which is cleared in each step, so that nothing is
    carried over. ``known`` keeps the places in texts, which come again with other ``b``."""
    if len(known) > KEPT_TEXTS:
        known.clear()
    where, whole, at = dict.fromkeys(b, 0), 0, 0
    for text in texts:
        if text not in known:
            known[text] = _places(text)
        for c, bits in known[text].items():
            if c in where:
                where[c] |= bits << at
        whole |= (1 << len(text)) - 1 << at
        at += len(text) + 1
    left = whole
    for c in b:
        hit = left & where[c]
        left = (left + hit | left - hit) & whole
    counts = []
    for a in texts:
        counts.append(len(a) - (left & (1 << len(a)) - 1).bit_count())
        left >>= len(a) + 1
    return counts


def matched_letters(a: str, b: str) -> int:
    """Letters in the matching blocks of difflib's SequenceMatcher, popular letters of a long ``b`` ignored as there. A bit
    for each place of ``a`` and of ``b``, a row of bits for each letter of ``a``: of the runs along a diagonal the
    longest are found by doubling, and the lowest bit of these is the one that difflib takes."""
    where: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        where.setdefault(c, []).append(j)
    most = len(b) // 100 + 1 if len(b) >= 200 else len(b)
    size = len(b) // 8 + 1  # bytes of a row: one bit or more is spare
    width, nothing = 8 * size, bytes(size)
    rows = {c: sum(1 << j for j in js).to_bytes(size, "little") for c, js in where.items() if len(js) <= most}
    cells = int.from_bytes(b"".join([rows.get(c, nothing) for c in a]), "little")
    total, left = 0, [(0, len(a), 0, len(b))]
    while left:
        alo, ahi, blo, bhi = left.pop()
        runs = cells >> alo * width & int.from_bytes(((1 << bhi) - (1 << blo)).to_bytes(size, "little") * (ahi - alo), "little")
        i, j, k = alo, blo, 0
        if runs:
            powers, k = [runs], 1
            while longer := runs & runs >> k * (width + 1):
                runs = longer
                powers.append(runs)
                k *= 2
            for n in range(len(powers) - 2, -1, -1):
                if longer := runs & powers[n] >> k * (width + 1):
                    runs = longer
                    k += 1 << n
            at = (runs & -runs).bit_length() - 1
            i, j = alo + at // width, at % width
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        if k:
            total += k
            if alo < i and blo < j:
                left.append((alo, i, blo, j))
            if i + k < ahi and j + k < bhi:
                left.append((i + k, ahi, j + k, bhi))
    return total


#: Texts of which a task keeps the places of letters, and texts that meet another at once.
KEPT_TEXTS, TOGETHER = 4096, 64
#: Rows whose best ratio so far a task remembers.
REMEMBERED = 50_000


def best_ratios(pairs: DataFrame, keys: list[str], other: str, least: float) -> DataFrame:
    """(keys, other, alignment_score): of each row's pairs those that may be its best at ``least`` or more, with the ratio
    of ``_r`` and ``_c``, or 1 where one stands in the other (``_inside``); the best are always among them.

    A task remembers each row's best so far and leaves out what can't reach it. Of a row's pairs that it gets together it
    takes that of the largest ``_bound`` first; then, of those left, all longest common subsequences at once, as matching
    blocks are one, and ratios, from the longest, while one can be the best. Which pairs meet in a task decides how many ratios are made, not what is best.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[tuple, float] = {}
        known: dict[str, dict[str, int]] = {}
        for d in batches:
            if len(so_far) > REMEMBERED:
                so_far.clear()
            a, b, inside, bound = (d.column(c).to_pylist() for c in ("_r", "_c", "_inside", "_bound"))
            by_row: dict[tuple, list[int]] = {}
            for i, row in enumerate(zip(*(d.column(k).to_pylist() for k in keys), strict=True)):
                by_row.setdefault((row, b[i]), []).append(i)
            kept, scores = [], []
            for (row, text), own in by_row.items():
                best = so_far.get(row, least)
                whole = [i for i in own if inside[i]]
                kept += whole
                scores += [1.0] * len(whole)
                best = 1.0 if whole else best
                rest = sorted((i for i in own if not inside[i] and bound[i] >= best), key=lambda i: -bound[i])
                # The first by its letters mostly is the best, and then leaves few others to look at.
                for at, to in [(0, 1), *((k, k + TOGETHER) for k in range(1, len(rest), TOGETHER))]:
                    some = [i for i in rest[at:to] if bound[i] >= best]
                    if not some:
                        continue
                    size = {i: max(len(a[i]) + len(text), 1) for i in some}
                    common = zip(common_with_each(tuple(a[i] for i in some), text, known), some, strict=True)
                    for most, i in sorted(((2.0 * n / size[i], i) for n, i in common), key=lambda x: -x[0]):
                        if most < best:
                            break
                        score = 2.0 * matched_letters(a[i], text) / size[i]
                        if score >= best:
                            best = score
                            kept.append(i)
                            scores.append(score)
                so_far[row] = best
            own = d.select([*keys, other]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(scores, pa.float64())], [*keys, other, "alignment_score"])

    kept = [*keys, other, "_r", "_c", "_inside", "_bound"]
    schema = T.StructType([*(pairs.schema[c] for c in (*keys, other)), T.StructField("alignment_score", T.DoubleType())])
    return pairs.select(*kept).mapInArrow(of, schema)


#: What folded texts are made of; the blank is last.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(folded: Column) -> Column:
    """How often a folded text has each of ``LETTERS``: once for a text, before it meets others."""
    each = lambda t: F.transform(F.array(*(F.lit(c) for c in LETTERS)), lambda c: F.length(t) - F.length(F.replace(t, c, F.lit(""))))
    return let(folded, each)


def ratio_bound(a: Column, b: Column, a_counts: Column, b_counts: Column, blanks: bool = True) -> Column:
    """What ``ratio`` of two folded texts can't pass: the letters that both have, repeats counted, are no
    fewer than those in matching blocks. Without ``blanks``: of the texts without them."""
    both = F.zip_with(a_counts, b_counts, lambda x, y: F.least(x, y))
    gap = lambda counts: F.element_at(counts, -1)
    common = F.aggregate(both, F.lit(0), lambda total, x: total + x)
    size = F.length(a) + F.length(b)
    if not blanks:
        common, size = common - gap(both), size - gap(a_counts) - gap(b_counts)
    return 2.0 * common / F.greatest(size, F.lit(1))


def coverage(needle: Column, haystack: Column) -> Column:
    """Share of the needle's tokens, repeats counted, that the haystack's tokens include."""
    return F.when(F.size(needle) == 0, 0.0).otherwise(
        F.size(F.filter(needle, lambda t: F.array_contains(haystack, t))) / F.size(needle)
    )


def title_coverage(title: Column, context: Column, stop: tuple[str, ...] = fixed.STOP_BASE) -> Column:
    return coverage(tokens(normalize_text(title), stop), tokens(normalize_text(context), stop))


def plain_coverage(title: Column, context: Column) -> Column:
    """Without stop words: of the title's words of over two letters, the share in the context."""
    def of(s: Column) -> Column:
        return F.size(F.filter(s["t"], lambda t: F.array_contains(s["c"], t))) / F.greatest(F.lit(1), F.size(s["t"]))

    words = F.filter(F.split(normalize_casefold(title), " "), lambda t: F.length(t) > 2)
    return let(F.struct(words.alias("t"), F.split(normalize_casefold(context), " ").alias("c")), of)


def fuzzy_coverage(needle: Column, haystack: Column, stop: tuple[str, ...] = fixed.STOP_INDEX) -> Column:
    """As coverage; a token also counts if it stands in the haystack without its spaces."""
    def of(s: Column) -> Column:
        hit = lambda t: F.array_contains(s["h"], t) | s["c"].contains(t)
        return F.when(F.size(s["n"]) == 0, 0.0).otherwise(F.size(F.filter(s["n"], hit)) / F.size(s["n"]))

    hay = normalize_joined(haystack)
    return let(F.struct(tokens(normalize_joined(needle), stop).alias("n"), tokens(hay, stop).alias("h"), F.replace(hay, F.lit(" "), F.lit("")).alias("c")), of)


def author_coverage(surnames: Column, context: Column, stop: tuple[str, ...] = fixed.STOP_BASE) -> Column:
    """Of up to three surnames of over two letters, the share found among the context's tokens."""
    return author_share(surnames, tokens(normalize_text(context), stop))


def author_share(surnames: Column, words: Column) -> Column:
    """``author_coverage`` for tokens that are already there."""

    def of(s: Column) -> Column:
        most = F.least(F.size(s["u"]), F.lit(3))
        return F.when(most == 0, 0.0).otherwise(F.least(F.size(F.filter(s["u"], lambda x: F.array_contains(s["w"], x))), most) / most)

    usable = F.filter(F.coalesce(surnames, F.array().cast("array<string>")), lambda x: F.length(x) > 2)
    return let(F.struct(usable.alias("u"), words.alias("w")), of)


def contained(title_norm: Column, context_norm: Column) -> Column:
    """1 where the title stands in the context, 0 where either is empty, else null: those rows
    still need the ratio."""
    return F.when((title_norm == "") | (context_norm == ""), 0.0).when(context_norm.contains(title_norm), 1.0)


def folded_similarity(a: Column, b: Column, known: Column | None = None) -> Column:
    """Of folded texts: 1 where ``b`` contains ``a``, else the ratio, computed only for other rows."""
    known = contained(a, b) if known is None else known
    return F.coalesce(known, ratio(F.when(known.isNull(), a), F.when(known.isNull(), b)))


def similarity_bounds(a: Column, b: Column, a_counts: Column, b_counts: Column) -> tuple[Column, Column]:
    """The least and the most that ``folded_similarity`` can be, by ``letter_counts``."""
    known = contained(a, b)
    return F.coalesce(known, F.lit(0.0)), F.coalesce(known, ratio_bound(a, b, a_counts, b_counts))


def title_similarity(title: Column, context: Column, both_ways: bool = False, casefold: bool = False) -> Column:
    """1 for a contained title, else the ratio, computed only for the other rows."""
    norm = normalize_casefold if casefold else normalize_text
    a, b = norm(title), norm(context)
    known = contained(a, b)
    return folded_similarity(a, b, F.coalesce(known, F.when(a.contains(b), 1.0)) if both_ways else known)


def text_similarity(left: Column, right: Column) -> Column:
    """The larger of the ratios with and without spaces; 0 if either is empty."""
    return joined_similarity(normalize_joined(left), normalize_joined(right))


def joined_similarity(a: Column, b: Column) -> Column:
    """``text_similarity`` of texts that are folded already."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(_ratio_of(a, b), _ratio_of(bare(a), bare(b))))


def joined_bounds(a: Column, b: Column, a_counts: Column, b_counts: Column) -> tuple[Column, Column]:
    """The least and the most that ``joined_similarity`` can be."""
    known = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
    high = F.greatest(ratio_bound(a, b, a_counts, b_counts), ratio_bound(a, b, a_counts, b_counts, blanks=False))
    return F.coalesce(known, F.lit(0.0)), F.coalesce(known, high)


def _ratio_of(a: Column, b: Column) -> Column:
    """The ratio where neither is empty and they differ; those rows alone go to Python."""
    need = (a != "") & (b != "") & (a != b)
    return F.when(a == b, 1.0).otherwise(ratio(F.when(need, a), F.when(need, b)))


def jaccard(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right)) / F.greatest(F.lit(1), F.size(F.array_union(left, right)))


def name_similarity(left: Column, right: Column) -> Column:
    """Of journal and collection names: 1 if one contains the other, else 0.65 Jaccard of words
    and 0.35 ratio, four decimals."""
    a, b = normalize_text(left), normalize_text(right)
    words = jaccard(F.split(a, " "), F.split(b, " "))
    need = (a != "") & (b != "") & ~b.contains(a) & ~a.contains(b)
    return F.when((a == "") | (b == ""), 0.0).when(~need, 1.0).otherwise(F.round(0.65 * words + 0.35 * ratio(F.when(need, a), F.when(need, b)), 4))
