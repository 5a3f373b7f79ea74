"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: unit vectors less their mean, padded, rotated at random and cut to one sign a coordinate, with
the scalars that correct the estimate: the residual's length, its inner products with its own code and
with the mean. An inner product is estimated from a code and a rotated query, with a bound of its error
that holds with high probability; only vectors whose estimate plus bound reaches the k-th best found so far
are reranked by the cosine of the original vectors.

Vectors that are equal are one row of the index with their smallest ids: of equal vectors no query can
need more than k and its own. Queries go in blocks of bounded size, each a scan of the index; a bounded
sample of the index gives each query a cosine that its k-th neighbour reaches at least, so that tasks
give few rows that are not among the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeforge.llm.scratch import written

K = 5
EVERY = 50
#: Bits of a code at least; vectors are padded to them before the rotation.
BITS = 256
#: The error bound in standard deviations of the estimate.
DEVIATIONS = 3.0
#: Numbers (queries by dimensions) that a block sends to the tasks, and vectors of the sample for the first thresholds.
BLOCK_NUMBERS, SAMPLE = 1 << 20, 4096
#: Codes that are estimated together, and pairs that are reranked together.
CODES, PAIRS = 1 << 10, 1 << 14
SEED = 20240501
NULL_ID = -(1 << 63)

INDEX = pa.schema([("vector", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("code", pa.binary()), ("length", pa.float32()), ("fit", pa.float32()), ("mean", pa.float32())])
INDEX_DDL = "vector array<double>, ids array<long>, rows array<long>, code binary, length float, fit float, mean float"
FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])
FOUND_DDL = "query long, query_id long, vec_id long, row long, score double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The first ``dim`` columns of a random orthogonal matrix of a multiple of 64 rows, ``BITS`` at least."""
    bits = max(BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, residual length, its unit's inner product with its code, inner product with the mean)."""
    u = units(x)
    residual = u - mean
    length = np.sqrt((residual * residual).sum(axis=1))
    z = (residual / np.maximum(length, 1e-30)[:, None]).astype(np.float32) @ turn.T
    fit = np.abs(z).sum(axis=1) / np.sqrt(turn.shape[0])
    return np.packbits(z > 0, axis=1), length, np.where(length > 1e-12, fit, 1), u @ mean


def estimates(code: np.ndarray, length: np.ndarray, fit: np.ndarray, of_mean: np.ndarray, query: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cosines as estimated, bounds of their errors), a row for each code and a column for each unit query."""
    bits = turn.shape[0]
    signs = np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1
    off = query - mean
    own = signs @ (off.astype(np.float32) @ turn.T).T / np.float32(np.sqrt(bits))
    guess = own * (length / fit)[:, None] + of_mean[:, None] + (query @ mean - mean @ mean)[None, :]
    spread = length * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(bits - 1)
    reach = np.sqrt((off * off).sum(axis=1))
    return guess, DEVIATIONS * spread[:, None] * reach[None, :] + 1e-5


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row; the same for equal rows wherever they stand."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


class Best:
    """The k nearest of each query so far, as rows (query, -score, id, row) in order."""

    def __init__(self, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least
        self.rows = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        keep = score >= self.least[query]
        q, s, i, r = (np.concatenate((a, b[keep])) for a, b in zip(self.rows, (query, -score, ids, row), strict=True))
        order = np.lexsort((r, i, s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < self.k]
        self.rows = [x[order] for x in (np.concatenate((self.rows[0], query[keep])), s, i, r)]
        last = place[place < self.k] == self.k - 1
        np.maximum.at(self.least, self.rows[0][last], -self.rows[1][last])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scan(batch: pa.RecordBatch, query: np.ndarray, own: np.ndarray, unit: np.ndarray, mean: np.ndarray, turn: np.ndarray, best: Best) -> None:
    """Adds to ``best`` what a batch of the index has for queries with the row numbers ``own``."""
    vector, code = _matrix(batch.column(0)), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    scalars = [batch.column(c).to_numpy() for c in (4, 5, 6)]
    start, ids, rows = batch.column(1).offsets.to_numpy(), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
    start = start - start[0]
    for lo in range(0, batch.num_rows, CODES):
        part = slice(lo, lo + CODES)
        guess, error = estimates(code[part], *(s[part] for s in scalars), unit, mean, turn)
        # The query's own row may be among these, so one more must reach a bound before it counts.
        least = best.least
        if len(guess) > best.k:
            least = np.maximum(least, np.partition(guess - error, len(guess) - best.k - 1, axis=0)[len(guess) - best.k - 1])
        at, which = np.nonzero(guess + error >= least[None, :])
        for i in range(0, len(at), PAIRS):
            a, q = at[i : i + PAIRS] + lo, which[i : i + PAIRS]
            score = cosines(vector[a], query[q])
            n = start[a + 1] - start[a]
            flat = np.repeat(start[a] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, score = np.repeat(q, n), np.repeat(score, n)
            other = rows[flat] != own[q]
            best.add(q[other], score[other], ids[flat][other], rows[flat][other])


def _index(vectors: DataFrame, k: int, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
    """A row for each distinct vector, with its k + 1 smallest ids and its code."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id", "row"))
    few = vectors.withColumn("place", place).filter(F.col("place") <= k + 1)
    classes = few.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("m")).select("vector", F.col("m.vec_id").alias("ids"), F.col("m.row").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, *scalars = encode(_matrix(batch.column(0)), mean, turn)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), *(pa.array(s.astype(np.float32)) for s in scalars)], schema=INDEX)

    return classes.mapInArrow(run, INDEX_DDL)


def _mean(vectors: DataFrame, dim: int) -> np.ndarray:
    """The mean of the unit vectors; each task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            if batch.num_rows:
                total, n = total + units(_matrix(batch.column(0))).sum(axis=0), n + batch.num_rows
        yield pa.RecordBatch.from_pydict({"total": [total.tolist()], "n": [n]}, pa.schema([("total", pa.list_(pa.float64())), ("n", pa.int64())]))

    sums = vectors.select("vector").mapInArrow(run, "total array<double>, n long").collect()
    return np.sum([r["total"] for r in sums], axis=0) / sum(r["n"] for r in sums)


def _search(index: DataFrame, block: list, mean: np.ndarray, turn: np.ndarray, k: int, sample: pa.Table) -> DataFrame:
    """(query, query_id, vec_id, row, score): what each task of a scan has for the block's queries."""
    own, ids, query = np.array([r["row"] for r in block], np.int64), [r["vec_id"] for r in block], np.array([r["vector"] for r in block])
    unit = units(query)
    first = Best(k, np.full(len(block), -np.inf))
    for batch in sample.to_batches():
        scan(batch, query, own, unit, mean, turn, first)
    least = first.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, least.copy())
        for batch in batches:
            if batch.num_rows:
                scan(batch, query, own, unit, mean, turn, best)
        q, score, vec_id, row = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array([ids[x] for x in q.tolist()], pa.int64()), pa.array(vec_id), pa.array(row), pa.array(-score)], schema=FOUND)

    return written(index.mapInArrow(run, FOUND_DDL), "neighbours_of_block")


def nearest(rows: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by ``every`` its ``k`` nearest found,
    from 1, among all rows but itself; all of them, if fewer.

    The score is the cosine of the original vectors in doubles; ties go to the smaller id, rows
    without an id first. Vectors that are null, zero or hold null or non-finite numbers take no part; those of
    another length than a query are no candidates for it. Rows that share an id are vectors of their
    own, as are repeated rows: only the query's very row is left out. An empty table gives an empty
    result; other columns are ignored. Every row is indexed; the tests measure the recall.
    """
    spark = rows.sparkSession
    vector = F.col("vector")
    usable = F.size(F.filter(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) == 0
    vectors = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("vector"))
    vectors = vectors.filter(vector.isNotNull() & usable & F.exists(vector, lambda x: x != 0))
    vectors = written(vectors.select("vec_id", "vector", F.monotonically_increasing_id().alias("row")), "vectors")
    found = None
    for dim in sorted(r["d"] for r in vectors.select(F.size("vector").alias("d")).distinct().collect()):  # one, but for odd tables
        own = vectors.filter(F.size("vector") == dim)
        mean, turn = _mean(own, dim), rotation(dim)
        named = own.withColumn("vec_id", F.coalesce("vec_id", F.lit(NULL_ID)))
        index = written(_index(named.select("vector", "vec_id", "row"), k, mean, turn), "rotated_codes")
        sample, block = index.limit(SAMPLE).toArrow().combine_chunks(), []
        for r in chain(own.filter(F.col("vec_id") % every == 0).toLocalIterator(), [None]):
            if r is not None:
                block.append(r)
            if block and (r is None or len(block) * dim >= BLOCK_NUMBERS):
                part = _search(index, block, mean, turn, k, sample)
                found, block = part if found is None else found.unionByName(part), []
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"), "score")
