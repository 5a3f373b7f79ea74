"""Writers. Spark's committers make each atomic; reports are small and formatted on the driver."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """The given columns in order, a header, empty strings for nulls; unknown ones are left out,
    missing ones are empty."""
    have = set(rows.columns)
    out = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns))
    out.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_lookup(rows: DataFrame, path: str) -> None:
    """A batch of looked-up answers as a further part of the store."""
    rows.write.mode("append").parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text to any file system that Spark knows: first aside, then renamed."""
    jvm = spark._jvm
    where, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    fs.rename(aside, where)


def report(lines: list[str | tuple[str, Column]]) -> Column:
    """A Markdown report of a summary's row: lines with ``{column}`` where a value goes, ``-`` for none. A line that comes
    with a condition is left out where it doesn't hold."""

    def filled(line: str) -> Column:
        parts = re.split(r"\{(\w+)\}", line)
        return F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("-")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))

    rows = [filled(x) if isinstance(x, str) else F.when(x[1], filled(x[0])) for x in lines]
    return F.concat(F.array_join(F.array_compact(F.array(*rows)), "\n"), F.lit("\n"))


def summary_json(summary: DataFrame) -> str:
    """A one-row summary, pretty, keys sorted."""
    return json.dumps(summary.first().asDict(recursive=True), ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def summary_markdown(summary: DataFrame, title: str) -> str:
    """A one-row summary as a Markdown table."""
    row = summary.first().asDict()
    lines = [f"# {title}", "", "| measure | value |", "|---|---:|"]
    lines += [f"| {k.replace('_', ' ')} | {'-' if v is None else v} |" for k, v in row.items()]
    return "\n".join(lines) + "\n"
