"""Records that may hold their own separator, from files that Spark splits by bytes.

Spark's text reader cuts a file at a separator wherever a split begins; whether that separator stands
inside quotes or brackets depends on all that comes before. So each split is summed up first, for both
ways it may begin (in quotes or not); the driver adds these up, a row a split, and the splits are
read again, knowing how they begin. A record over the end of a split is put together from its pieces. So a
file of any size is read by many tasks, on any store that Spark reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPED = re.compile(r"\\.", re.DOTALL)
#: From inside a quoted field to the quote that ends it; doubled ones belong to the field.
_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
_HEAD, _WHOLE, _TAIL = 0, 1, 2
_SUMS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("ends", pa.list_(pa.bool_())), ("deeper", pa.list_(pa.int64()))])
_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("value", pa.string())])


@dataclass(frozen=True)
class Form:
    """``step(text, inside)``: whether a text that begins in quotes or not ends in them, and by how much it goes
    deeper. A record begins outside quotes at a depth of ``depth`` or less."""

    separator: str
    step: Callable[[str, bool], tuple[bool, int]]
    depth: int = 0


def _csv(text: str, inside: bool) -> tuple[bool, int]:
    """A quote opens a field only at its start; elsewhere it is a letter."""
    if '"' not in text:
        return inside, 0
    at = 0
    while True:
        if inside or text.startswith('"', at):
            closed = _QUOTED.match(text, at + (not inside))
            if closed is None:
                return True, 0
            at, inside = closed.end(), False
        at = text.find(",", at) + 1
        if not at:
            return False, 0


def _json(text: str, inside: bool) -> tuple[bool, int]:
    parts = (_ESCAPED.sub("", text) if "\\" in text else text).split('"')
    deeper = sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts[inside::2])
    return inside ^ (len(parts) % 2 == 0), deeper


#: Lines.
CSV = Form("\n", _csv)
#: Members of an object: no escape can stand before a comma.
JSON_MEMBERS = Form(",", _json, 1)


def _begins(text: DataFrame, form: Form) -> dict[tuple[str, int], tuple[bool, int]]:
    """(file, first byte of a split) to (in quotes, depth) where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends, deeper = None, [False, True], [0, 0]

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*at, ends, deeper), _SUMS, strict=True)], schema=_SUMS)

        for batch in batches:
            for value, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    if at is not None:
                        yield closed()
                    at, ends, deeper = place, [False, True], [0, 0]
                for way in (0, 1):
                    ends[way], more = form.step(value, ends[way])
                    deeper[way] += more
        if at is not None:
            yield closed()

    begins, file, inside, depth = {}, None, False, 0
    for r in sorted(text.mapInArrow(run, "file string, start long, ends array<boolean>, deeper array<long>").collect(), key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        begins[(r["file"], r["start"])] = inside, depth
        inside, depth = r["ends"][inside], depth + r["deeper"][inside]
    return begins


def read_records(spark: SparkSession, path: str, form: Form) -> DataFrame:
    """(file, start, n, value): the records of the files at ``path``, in order of start and n in a file."""
    text = spark.read.option("lineSep", form.separator).text(path)
    text = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    begins = _begins(text, form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, depth, n, kind, own, out = None, False, 0, 0, _HEAD, [], []

        def piece(kind: int) -> None:
            if own:
                out.append((*at, n, kind, form.separator.join(own)))

        for batch in batches:
            for value, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    if at is not None:
                        piece(kind)
                    at, n, kind, own = place, 0, _HEAD, []
                    inside, depth = begins[tuple(place)]
                if not inside and depth <= form.depth:
                    piece(_HEAD if kind == _HEAD else _WHOLE)
                    n, kind, own = n + (kind != _HEAD), _TAIL, []
                own.append(value)
                inside, deeper = form.step(value, inside)
                depth += deeper
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_PIECES)], schema=_PIECES)
                out = []
        if at is not None:
            piece(kind)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_PIECES)], schema=_PIECES)

    pieces = text.mapInArrow(run, "file string, start long, n long, kind int, value string")
    ends = pieces.filter(F.col("kind") != _WHOLE)  # two a split at most
    begin = F.when(F.col("kind") == _TAIL, F.struct("start", "n"))
    ends = ends.withColumn("begin", F.last(begin, ignorenulls=True).over(Window.partitionBy("file").orderBy("start", "kind")))
    joined = ends.groupBy("file", "begin").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "value")))["value"].alias("v"))
    joined = joined.select("file", "begin.start", "begin.n", F.array_join("v", form.separator).alias("value"))
    return pieces.filter(F.col("kind") == _WHOLE).drop("kind").unionByName(joined)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, n, value): each member of the JSON objects at ``path`` as an object of its own."""
    rows = read_records(spark, path, JSON_MEMBERS)
    value, first = F.col("value"), (F.col("start") == 0) & (F.col("n") == 0)
    opened = F.when(first, F.regexp_replace(value, "^[﻿\\s]*\\{", "")).otherwise(value)
    rows = rows.filter(~first | value.rlike("^[﻿\\s]*\\{")).withColumn("value", opened)
    ends = rows.groupBy("file").agg(F.max(F.struct("start", "n")).alias("end"))
    rows = rows.join(ends, "file").withColumn("value", F.when(F.struct("start", "n") == F.col("end"), F.regexp_replace("value", "\\}\\s*$", "")).otherwise(F.col("value")))
    return rows.select("file", "start", "n", F.concat(F.lit("{"), "value", F.lit("}")).alias("value"))
