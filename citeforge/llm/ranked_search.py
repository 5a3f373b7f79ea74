"""Ranked lexical search over inverted treaps.

Documents are mapped once to rows of the query terms that they hold, in shards of bounded size. A
shard has a treap for each term: a search tree by document and a heap by impact, so that a subtree's
root bounds what the term adds to any document in it. A query walks the treaps of its terms together,
interval of documents by interval, best bound first; an interval whose summed maxima cannot enter
the best k is left out, a short one is added up at once. Each shard gives up to k rows an item, of
which the best k stay.

Items go in blocks of bounded size, each a pass over the documents, so what the tasks are sent does
not grow with the number of items.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeforge.llm.columns import id_and_text
from citeforge.llm.scratch import written

#: ASCII letters and digits and whatever is beyond ASCII, of lower-cased UTF-8.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A shard ends with the document that brings it to so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 20
#: Intervals of so many documents are added up instead of walked.
LEAF = 1 << 10
#: Bytes of text of the items of a block; an item is taken whole.
BLOCK_BYTES = 1 << 22
#: Length's part of the denominator, in hundredths.
LENGTH_SHARE = 90
NULL_ID = -(1 << 63)

POSTINGS = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
POSTINGS_DDL = "shard long, doc_id long, n long, term array<int>, tf array<int>"
FOUND = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "item int, item_id long, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # lower() of bytes changes A-Z only


class Treaps:
    """The treaps of a shard: postings in order of term and document, and for each its children."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> None:
        order = np.lexsort((doc, term))
        self.doc, self.impact, self.docs = doc[order], impact[order], docs
        term = term[order]
        self.key = term * docs + self.doc
        self.terms, first = np.unique(term, return_index=True)
        self.left, self.right, self.root = (np.full(n, -1, np.int64) for n in (len(term), len(term), len(first)))
        for t, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(term)], strict=True)):
            self.root[t] = self._grow(a, self.impact[a:b].tolist())

    def _grow(self, base: int, impact: list[int]) -> int:
        """Links the postings of one term, which come in order of document; returns the root."""
        left, right, spine = [-1] * len(impact), [-1] * len(impact), []
        for i, x in enumerate(impact):
            below = -1
            while spine and impact[spine[-1]] < x:
                below = spine.pop()
            if below >= 0:
                left[i] = base + below
            if spine:
                right[spine[-1]] = base + i
            spine.append(i)
        self.left[base : base + len(left)], self.right[base : base + len(right)] = left, right
        return base + spine[0]

    def _within(self, lo: int, hi: int, node: np.ndarray, term: np.ndarray) -> tuple[int, int, int, np.ndarray, np.ndarray]:
        """The subtrees' parts in documents lo to hi - 1, with minus the sum of their roots' impacts first."""
        while True:
            doc = self.doc[node]
            low, high = doc < lo, doc >= hi
            if not (low | high).any():
                return -int(self.impact[node].sum()), lo, hi, node, term
            node = np.where(low, self.right[node], np.where(high, self.left[node], node))
            node, term = node[node >= 0], term[node >= 0]

    def _sums(self, lo: int, hi: int, term: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents) from lo to hi - 1 with ``least`` or more, itself over 0."""
        a, b = np.searchsorted(self.key, term * self.docs + lo), np.searchsorted(self.key, term * self.docs + hi)
        size = b - a
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        if most < 1 << 53:  # exact in doubles
            score = np.bincount(self.doc[at] - lo, self.impact[at], hi - lo).astype(np.int64)
        else:
            score = np.zeros(hi - lo, np.int64)
            np.add.at(score, self.doc[at] - lo, self.impact[at])
        doc = np.flatnonzero(score >= max(least, 1))
        return score[doc], doc + lo

    def best(self, wanted: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, document) of a query of these terms, ties to the smaller document."""
        at = np.searchsorted(self.terms, wanted)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted)]
        if not len(at):
            return []
        top: list[tuple[int, int]] = []  # (-score, document), ascending
        count = 0  # breaks ties of the queue
        todo = [(*self._within(0, self.docs, self.root[at], self.terms[at])[:3], 0)]
        parts = {0: (self.root[at], self.terms[at])}
        while todo:
            bound, lo, hi, mark = heapq.heappop(todo)
            node, term = parts.pop(mark)
            if len(top) == k and (bound, lo) > top[-1]:
                continue  # not even the interval's first document could enter with all maxima
            if hi - lo <= LEAF:
                score, doc = self._sums(lo, hi, term, -bound, -top[-1][0] if len(top) == k else 1)
                order = np.lexsort((doc, -score))[:k]
                new = list(zip((-score[order]).tolist(), doc[order].tolist(), strict=True))
            else:
                d = int(self.doc[node[np.argmax(self.impact[node])]])
                key = term * self.docs + d
                here = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                score = int(self.impact[here[self.key[here] == key]].sum())
                new = [(-score, d)] if score else []
                for a, b in ((lo, d), (d + 1, hi)):
                    if a < b:
                        *head, node_, term_ = self._within(a, b, node, term)
                        if len(node_):
                            count += 1
                            parts[count] = node_, term_
                            heapq.heappush(todo, (*head, count))
            if new:
                top = sorted([*top, *new])[:k]
        return [(-s, d) for s, d in top]


def posting_rows(docs: DataFrame, wanted: dict[bytes, int], shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(shard, doc_id, n, term, tf) of every document with a term: its wanted terms by number."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = sent.value, TaskContext.get().partitionId()
        shard, have, held = 0, 0, 0
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                own = Counter(filter(number.__contains__, words))
                for column, value in zip(rows, (part << 32 | shard, doc_id, len(words), [number[w] for w in own], list(own.values())), strict=True):
                    column.append(value)
                have, held = have + 1, held + len(own)
                if have >= shard_docs or held >= SHARD_POSTINGS:
                    shard, have, held = shard + 1, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, POSTINGS, strict=True)], schema=POSTINGS)

    return docs.mapInArrow(run, POSTINGS_DDL)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, distinct terms) in blocks; the driver holds one at a time."""
    block, size = [], 0
    for item_id, text in items.toLocalIterator():
        own = text.encode()
        block.append((item_id, list(dict.fromkeys(terms(own)))))
        size += len(own)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _block_found(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int, shard_docs: int) -> DataFrame:
    """Up to k rows (item, item_id, doc_id, score) of each shard for each item of the block."""
    wanted: dict[bytes, int] = {}
    for _, own in block:
        for t in own:
            wanted.setdefault(t, len(wanted))
    queries = [(i, item_id, np.array(sorted(wanted[t] for t in own), np.int64)) for i, (item_id, own) in enumerate(block)]
    table = written(posting_rows(docs, wanted, shard_docs), "term_postings")
    total = table.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = total["n"], total["l"] or 1
    weight = np.zeros(len(wanted), np.int64)
    held = table.filter(F.size("term") > 0)
    for r in held.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # no more than the block's terms
        weight[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))

    def search(shard: pa.Table) -> pa.Table:
        ids, n = (shard.column(c).to_pylist() for c in ("doc_id", "n"))
        order = sorted(range(len(ids)), key=lambda i: NULL_ID if ids[i] is None else ids[i])
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        term, tf = shard.column("term").combine_chunks(), shard.column("tf").combine_chunks()
        size = np.diff(term.offsets.to_numpy())
        m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * x * n_docs // n_terms for x in n], np.int64)
        t, f = term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)
        treaps = Treaps(t, np.repeat(place, size), weight[t] * (1_000_000_000 * f // (1000 * f + 8 * np.repeat(m, size))), len(ids))
        rows = [(i, item_id, ids[order[d]], s) for i, item_id, own in queries for s, d in treaps.best(own, k)]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(FOUND)], schema=FOUND)

    return written(held.groupBy("shard").applyInArrow(search, FOUND_DDL), "ranked_in_shards")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_docs: int = SHARD_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its ``k`` best documents, from 1.

    Terms are runs of ASCII letters and digits and of whatever is beyond ASCII, A-Z in lower case;
    a document without one counts nowhere. Of N documents with n of their L terms each and df with a
    term, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))) and adds w * (10^9 tf div
    (1000 tf + 8 m)), with m = 10 + 90 n N div L: whole numbers, so scores are the same however rows
    are dealt. Scores over 0 count, ties go to the smaller doc_id, missing ids first. Null texts
    have no terms; documents that share an id are documents of their own, and so are items. Empty
    tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    own = id_and_text(docs, doc_id, doc_text)
    found = None
    for b, block in enumerate(_blocks(id_and_text(items, item_id, item_text), block_bytes)):
        rows = _block_found(own, block, k, shard_docs).withColumn("block", F.lit(b))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    first = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
