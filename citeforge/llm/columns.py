"""Input columns and helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that count, renamed, so that no other column can clash with ours."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` would change other alphabets too."""
    return F.translate(text, UPPER, UPPER.lower())


def arrow_rows(
    df: DataFrame, schema: T.StructType | str, make: Callable[[list[dict]], dict[str, list]]
) -> DataFrame:
    """Maps Arrow batches: ``make`` gets (ids, texts as UTF-8 bytes) and returns columns."""
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            cols = make(ids, texts)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in ((cols[f.name], f) for f in out)],
                schema=out,
            )

    return df.mapInArrow(run, struct)
