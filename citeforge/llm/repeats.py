"""Exact removal of repeated windows: what the two substring operators share.

A window is ``width`` consecutive units (words or bytes) of one document; it is repeated if the
same window stands earlier. Comparing every window over the cluster would shuffle a row for each
unit. Instead an operator names an *anchor* inside each window by the window's content alone, so
that equal windows have equal anchors at equal places, and consecutive windows share one. Then:

1. A row per anchor: ``q`` (the anchor's name), ``c`` (the name of all the text under the windows
   that it stands for, and of its place there), doc_id, ``p`` (first window) and ``n`` (windows).
   Anchors that occur once, most of any corpus, are dropped after one aggregation.
2. Anchors with equal (q, c) stand for equal windows: all but the earliest are repeats, settled
   without looking at single windows.
3. Where one anchor name comes with several texts, at the ends of repeats, their windows are split
   into blocks of neighbours, named by the text that a block's windows have in common, and steps 1
   and 2 are repeated on blocks.
4. What is left is settled window by window.

Names are seeded content hashes of 128 bits, (q, c) or (q, w), so a name needs no dictionary and no
exchange. They only find the repeats. At last the units themselves are compared: every stretch that
goes is held against the same stretch of the row that has it first (``verified``). Should one
differ, two texts had the same name, and all is done again with another seed; so nothing goes that
isn't repeated. That nothing stays that is repeated rests on the anchors: equal windows must have equal
anchors, under any seed. The comparison can't show that; the tests hold anchors of equal windows, and
results, against plain search.

A row is known by its id and, where ids repeat or are missing, a hash of its text (``tag``); rows that
share an id are documents of their own, of which neither comes before the other. Rows that share id and
text are worked on once, and all get the result. ``again`` marks
what has come before in the same row. Hot names are combined in the tasks before each shuffle, and
rows get their verdict by sort-merge joins, which AQE splits. No step pairs the members of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.llm.columns import id_and_text
from citeforge.llm.scratch import apart, dropped, release, written

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
S29, S32 = np.uint64(29), np.uint64(32)
NULL_ID = -(1 << 63)
#: Units that are worked on at a time; a longer document is taken whole.
CHUNK = 1 << 17

ANCHOR = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("o", pa.int32()), ("again", pa.bool_())])
PART = pa.schema([("q", pa.int64()), ("w", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("again", pa.bool_())])
ANCHOR_DDL = "q long, c long, doc_id long, tag long, p int, n int, o int, again boolean"
PART_DDL = "q long, w long, c long, doc_id long, tag long, p int, n int, again boolean"


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Names of ordered pairs of names; ``y`` may be one name for all."""
    h = y * K1
    h += K2
    h = h ^ x if h.shape != x.shape else np.bitwise_xor(h, x, out=h)
    h *= K3
    h ^= h >> S32
    h *= K1
    h ^= h >> S29
    return h


def chunks(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents with about ``most`` units."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def again(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows (a, b) have come before in the same document; rows are in order of place."""
    order = np.lexsort((np.arange(len(a)), b, a, doc))
    x, y, d = a[order], b[order], doc[order]
    out = np.zeros(len(a), bool)
    out[order[1:]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (d[1:] == d[:-1])
    return out


def anchor_rows(ids: np.ndarray, tags: np.ndarray, begin: np.ndarray, of_doc: np.ndarray, p: np.ndarray, anchor: np.ndarray, q: np.ndarray, place: np.ndarray, c: Callable) -> list[np.ndarray]:
    """Joins consecutive windows with the same anchor to rows.

    ``p``: places of windows in ascending order; ``anchor``, ``q``, ``place``: of each, the anchor,
    its name and its place; ``of_doc`` the document index of each place and ``begin`` the documents'
    first places. ``c(lo, hi, place)`` names the text under the windows lo to hi.
    """
    if not len(p):
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, bool)]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1))))
    lo, hi, at = p[new], p[np.append(new[1:], len(p)) - 1], place[new]
    doc, q, c = of_doc[lo], q[new].view(np.int64), c(lo, hi, at).view(np.int64)
    return [q, c, ids[doc], tags[doc], (lo - begin[doc]).astype(np.int32), (hi - lo + 1).astype(np.int32), (at - lo).astype(np.int32), again(q, c, doc)]


def keyed(docs: DataFrame, id_col: str, text_col: str, seed: int) -> tuple[DataFrame, bool]:
    """(doc_id without nulls, text, tag), and whether some id is missing or repeated. Only there does the
    tag tell rows apart; elsewhere it is 0, which costs nothing to carry."""
    rows = id_and_text(docs, id_col, text_col)
    versions = bool(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").limit(1).count())
    tag = F.xxhash64(F.lit(seed), F.col("text")) if versions else F.lit(0).cast("long")
    return rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text", tag.alias("tag")), versions


def distinct_rows(rows: DataFrame) -> DataFrame | None:
    """One row for each (doc_id, tag); none where two texts of an id have one tag."""
    texts = rows.groupBy("doc_id", "tag").agg(F.min("text").alias("text"), F.max("text").alias("other"))
    texts = written(texts, "distinct_rows")
    if texts.filter(F.col("text") != F.col("other")).limit(1).count():
        dropped(texts)
        return None
    texts_only = texts.select("doc_id", "text", "tag")
    texts_only.written_to = texts.written_to
    return texts_only


#: Documents of a batch that are held as Python objects at a time.
ROWS = 512


def mapped(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[list]], out: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            for cols in make(batch):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(run, ddl)


def hashed(df: DataFrame) -> DataFrame:
    """The side of a join to build a hash table of: distinct names, dealt by name, so no task's
    share is large, and the other side needn't be sorted."""
    return apart(df).hint("shuffle_hash")


def repeated_spans(
    rows: DataFrame,
    width: int,
    block: int,
    anchors: Callable[[pa.RecordBatch], Iterator[list]],
    named: Callable[[list[bytes]], tuple[np.ndarray, Callable[[np.ndarray, int], np.ndarray]]],
    within: bool,
) -> DataFrame:
    """For each row with repeats: doc_id, tag, and lists p, size (in units), first (the id of the row
    that has the same first) and hold (that row's tag and place, see ``_hold``).

    ``rows``: as ``keyed`` gives them. ``named(texts)`` gives the first places of texts
    that are put one after another, and a function of (places, size) that names the strings of ``size`` units
    there; ``block`` is how many windows go together in step 3.
    ``within``: a window that stands earlier in the same document counts as repeated.
    """
    spark = rows.sparkSession
    several = F.col("m") > 1 if within else F.col("least") < F.col("last")
    repeat = F.col("doc_id") > F.col("first")
    repeat = repeat | F.col("again") if within else repeat

    def shared(df: DataFrame, names: list[str], doc: str) -> DataFrame:
        """Names that several rows, or rows of several documents, have."""
        return df.groupBy(*names).agg(F.count(F.lit(1)).alias("m"), F.min(doc).alias("least"), F.max(doc).alias("last")).filter(several)

    def settled(every: DataFrame, names: list[str], label: str) -> DataFrame:
        """Steps 1 and 2: rows that are repeats, and rows whose name is open: it has several texts,
        so that their windows may still be repeats, or what others repeat."""
        # Written by itself, so that its shuffle is gone when all rows are dealt by name.
        frequent = written(shared(every, names, "doc_id").select(*names), f"frequent_{label}")
        release(spark)
        table = written(every.join(frequent.hint("shuffle_hash"), names, "left_semi"), f"shared_{label}")
        for t in (every, frequent):
            dropped(t)
        release(spark)
        texts = table.groupBy(*names, "c").agg(F.min("doc_id").alias("first"), F.min_by(_hold(F.col("tag"), F.col("p")), F.when(~F.col("again"), F.col("doc_id"))).alias("hold"))
        known = shared(texts, names, "first").select(*names, F.lit(True).alias("open"))
        verdict = apart(texts).join(hashed(known), names, "left")
        judged = table.join(hashed(verdict), [*names, "c"]).withColumns({"repeat": repeat, "open": F.coalesce("open", F.lit(False))})
        judged = written(judged.filter("repeat or open").drop("c", "again"), f"judged_{label}")
        dropped(table)
        release(spark)
        return judged

    def parts(found: DataFrame, fields: list[str], make: Callable, label: str) -> DataFrame:
        """Maps (text, open rows of the document) to their parts, many documents at a time."""
        grouped = found.filter("not repeat").groupBy("doc_id", "tag").agg(*(F.collect_list(f).alias(f) for f in fields))

        def run(batch: pa.RecordBatch) -> Iterator[list]:
            ids, texts, tags = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_numpy()
            ends = batch.column(3).offsets.to_numpy()
            for i, j in chunks([len(t) for t in texts], 2 * CHUNK):
                begin, names = named(texts[i:j])
                flat = lambda k, i=i, j=j: batch.column(k).values.slice(ends[i], ends[j] - ends[i]).to_numpy().astype(np.int64)
                own = dict(zip(fields, map(flat, range(3, 3 + len(fields))), strict=True))
                doc = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                own["p"] += begin[doc]
                row, w, c, p, n = make(names, **own)
                order = np.argsort(p, kind="stable")
                row, w, c, p, n = row[order], w[order], c[order], p[order], n[order]
                q, doc = own["q"][row], doc[row]
                yield [q, w.view(np.int64), c.view(np.int64), ids[i:j][doc], tags[i:j][doc], (p - begin[doc]).astype(np.int32), n.astype(np.int32), again(q, mixed(w, c), doc)]

        return written(mapped(rows.join(grouped, ["doc_id", "tag"]).select("doc_id", "text", "tag", *fields), run, PART, PART_DDL), label)

    def blocks(names: Callable, p: np.ndarray, n: np.ndarray, o: np.ndarray, q: np.ndarray) -> tuple:
        """Blocks of windows by their distance before the anchor: named by the text in common."""
        size = np.repeat(n, n)
        at = np.arange(len(size)) - np.repeat(np.cumsum(n) - n, n)
        far, own = (np.repeat(o, n) - at) // block, np.repeat(np.arange(len(n)), n)
        new = np.flatnonzero(np.concatenate(([True], (far[1:] != far[:-1]) | (own[1:] != own[:-1]))))
        which, far, lo, m = own[new], far[new], (p[own] + at)[new], np.diff(np.append(new, len(own)))
        anchor = p[which] + o[which]
        core = mixed(names(anchor - far * block, width - block + 1), far.astype(np.uint64))
        whole = mixed(mixed(names(lo, width), names(lo + m - 1, width)), (m << 20 | (anchor - lo)).astype(np.uint64))
        return which, core, whole, lo, m

    def singles(names: Callable, p: np.ndarray, n: np.ndarray, q: np.ndarray) -> tuple:
        each = np.repeat(p - np.cumsum(n) + n, n) + np.arange(n.sum())
        w = names(each, width)
        return np.repeat(np.arange(len(n)), n), w, w, each, np.ones(len(each), np.int64)

    table = written(mapped(rows, anchors, ANCHOR, ANCHOR_DDL), "anchors")
    first = settled(table, ["q"], "anchors")
    second = settled(parts(first, ["p", "n", "o", "q"], blocks, "end_blocks"), ["q", "w"], "blocks")
    third = settled(parts(second, ["p", "n", "q"], singles, "end_windows"), ["q", "w"], "windows")
    spans = None
    for t in (first, second, third):
        own = t.filter("repeat").select("doc_id", "tag", "p", (F.col("n") + (width - 1)).alias("size"), "first", "hold")
        spans = own if spans is None else spans.unionByName(own)
    spans = spans.groupBy("doc_id", "tag").agg(*(F.collect_list(c).alias(c) for c in ("p", "size", "first", "hold")))
    spans = written(spans, "repeated_spans")
    for t in (first, second, third):
        dropped(t)
    release(spark)
    return spans


TAG_BITS = 0x7FFFFFFF


def _hold(tag: Column, p: Column) -> Column:
    """A row's tag, 31 bits of it, and a place there, in one number."""
    return F.shiftleft(tag.bitwiseAND(F.lit(TAG_BITS)), 32).bitwiseOR(p.cast("long"))


def merged(p: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Maximal (start, end) runs of overlapping or touching spans."""
    order = np.argsort(p, kind="stable")
    start, reach = p[order], np.maximum.accumulate((p + size)[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return list(zip(start[new].tolist(), reach[np.append(new[1:], len(start)) - 1].tolist(), strict=True))


def stretches(p: np.ndarray, size: np.ndarray, first: np.ndarray, hold: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(first, tag, place there, place here, size): spans that go on in both rows joined to one."""
    tag, there = hold >> 32, hold & 0xFFFFFFFF
    order = np.lexsort((p, p - there, tag, first))
    p, end, first, tag, there = p[order], (p + size)[order], first[order], tag[order], there[order]
    apart_ = np.concatenate(([True], (first[1:] != first[:-1]) | (tag[1:] != tag[:-1]) | ((p - there)[1:] != (p - there)[:-1])))
    lane = (np.cumsum(apart_) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lane)
    new = np.flatnonzero(apart_ | np.concatenate(([True], (p + lane)[1:] > reach[:-1])))
    last = np.append(new[1:], len(p)) - 1
    stop = reach[last] - lane[last]
    return list(zip(first[new].tolist(), tag[new].tolist(), there[new].tolist(), p[new].tolist(), (stop - p[new]).tolist(), strict=True))


CLAIM = pa.struct([("first", pa.int64()), ("of", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("units", pa.binary())])
CLAIM_DDL = "array<struct<first:long,of:long,at:long,size:long,units:binary>>"
ANSWER = pa.schema([("first", pa.int64()), ("of", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("units", pa.binary())])


def with_spans(rows: DataFrame, spans: DataFrame, taken: Callable[[bytes], Callable[[int, int], bytes]], make: Callable[[bytes, list], tuple], out: pa.Schema, ddl: str) -> DataFrame:
    """Joins each row with its spans and maps (text, runs) to the columns after doc_id, and ``claims``:
    what each stretch that goes says, with its units, and where they stand first. ``taken(text)``
    gives the units of (place, size)."""

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        done, claims = [], []
        for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            own = [batch.column(k)[i] for k in range(2, 6)]
            runs, said = [], []
            if own[0].is_valid and len(own[0]):
                p, size, first, hold = (x.values.to_numpy().astype(np.int64) for x in own)
                runs, units = merged(p, size), taken(text)
                said = [{"first": f, "of": t, "at": there, "size": n, "units": units(here, n)} for f, t, there, here, n in stretches(p, size, first, hold)]
            done.append(make(text, runs))
            claims.append(said)
        yield [batch.column(0), *([d[i] for d in done] for i in range(len(out) - 1)), claims, batch.column(6)]

    joined = rows.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "p", "size", "first", "hold", "tag")
    schema = out.append(pa.field("claims", pa.list_(CLAIM))).append(pa.field("tag", pa.int64()))
    return mapped(joined, run, schema, f"{ddl}, claims {CLAIM_DDL}, tag long")


def verified(rows: DataFrame, table: DataFrame, taken: Callable[[bytes], Callable[[int, int], bytes]]) -> bool:
    """Whether every claim of ``table`` is true: the units that it says stand first elsewhere are
    those that stand there. Claims that are alike are one, so copies cost one comparison a task,
    and each row that has something first is read once for all that is said of it."""
    keys = ["first", "of", "at", "size"]
    claims = written(table.select(F.inline("claims")).distinct(), "claims")
    asked = claims.select(*keys).distinct().groupBy("first", "of").agg(F.collect_list("at").alias("at"), F.collect_list("size").alias("size"))
    asked = written(asked, "asked_stretches")

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            at, size, units = batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), taken(text)
            n = len(at)
            yield [[batch.column(0)[i].as_py()] * n, [batch.column(1)[i].as_py()] * n, at, size, [units(a, k) for a, k in zip(at, size, strict=True)]]

    holders = rows.select(F.col("doc_id").alias("first"), F.col("tag").bitwiseAND(F.lit(TAG_BITS)).alias("of"), "text").join(asked, ["first", "of"])
    answers = mapped(holders.select("first", "of", "text", "at", "size"), run, ANSWER, "first long, of long, at long, size long, units binary")
    false = claims.join(answers, [*keys, "units"], "left_anti").limit(1).count()
    dropped(claims, asked)
    release(rows.sparkSession)
    return not false


@dataclass(frozen=True)
class Units:
    """What an operator says of its units under a seed: ``anchors`` and ``named`` as ``repeated_spans``
    takes them, ``taken`` and ``cut`` as ``with_spans`` does."""

    anchors: Callable[[pa.RecordBatch], Iterator[list]]
    named: Callable
    taken: Callable[[bytes], Callable[[int, int], bytes]]
    cut: Callable[[bytes, list], tuple]


#: Seeds tried before a comparison that keeps failing is taken for an error: two names that meet have 128 bits each.
SEEDS = 8


def without_repeats(docs: DataFrame, id_col: str, text_col: str, width: int, block: int, within: bool, units: Callable[[int], Units], out: pa.Schema, ddl: str) -> DataFrame:
    """The rows with what ``cut`` makes of them, verified."""
    for seed in range(SEEDS):
        (every, versions), own = keyed(docs, id_col, text_col, seed), units(seed)
        rows = distinct_rows(every) if versions else every
        if rows is None:
            continue
        spans = repeated_spans(rows, width, block, own.anchors, own.named, within)
        table = written(with_spans(rows, spans, own.taken, own.cut, out, ddl), "cut_texts")
        dropped(spans)
        release(docs.sparkSession)
        right = verified(rows, table, own.taken)
        if versions:
            dropped(rows)
        if right:
            done = table.drop("claims")
            if versions:  # every copy of a row, by a join that AQE splits where one row has many
                done = every.select("doc_id", "tag").join(apart(done), ["doc_id", "tag"])
            return done.drop("tag").withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
        dropped(table)
    raise RuntimeError(f"stretches that go differ from those that stand first under each of {SEEDS} seeds")
