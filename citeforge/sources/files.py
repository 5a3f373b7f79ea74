"""Publications, flat tables, lookup files and match reports. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeforge.functions.text import as_int, squeeze
from citeforge.operators.ranking import best
from citeforge.sources.split import CSV, read_members, read_records

_REFERENCE = "struct<id:string,`order`:string,context:string,year:string,journalCode:string,targetPublication:string,authors:array<string>>"
PUBLICATION = f"id string, metadata struct<id:string,references:array<{_REFERENCE}>>"
LOOKUP = "map<string,struct<status:string,http_status:int,error:string,items:array<struct<doi:string,title:string,publisher:string,url:string,type:string,year:int,surnames:array<string>,score:double>>>>"


def _lines(spark: SparkSession, path: str, ddl: str, strict: bool) -> DataFrame:
    """JSON lines of a schema; blank lines are passed over, a malformed line is an error that
    shows its file and text."""
    schema = T._parse_datatype_string(f"{ddl}, _corrupt string")
    text = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).filter(F.trim("value") != "")
    text = text.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    rows = text.withColumn("r", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    if strict:
        bad = F.raise_error(F.concat(F.lit("invalid JSON line in "), "file", F.lit(": "), F.substring("value", 1, 200)))
        rows = rows.withColumn("r", F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), bad.cast(schema)).otherwise(F.col("r")))
    else:
        rows = rows.filter(F.col("r._corrupt").isNull())
    return rows.select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in schema if f.name != "_corrupt"))


def read_publications(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Nested publications, one JSON object a line, as they are."""
    return _lines(spark, path, PUBLICATION, strict)


def references(publications: DataFrame) -> DataFrame:
    """One row per reference with a context: publication_id (the metadata's, else the record's),
    reference_id, reference_order, context with single spaces, year, journal_code, target_id."""
    own = publications.filter("metadata is not null")
    each = own.select(F.coalesce(as_int(F.col("metadata.id")), as_int(F.col("id"))).alias("publication_id"), F.explode("metadata.references").alias("r"))
    target = as_int(F.col("r.targetPublication"))
    return each.filter(squeeze(F.col("r.context")) != "").select(
        "publication_id", as_int(F.col("r.id")).alias("reference_id"), as_int(F.col("r.`order`")).cast("int").alias("reference_order"), squeeze(F.col("r.context")).alias("context"),
        "r.year", F.col("r.journalCode").alias("journal_code"), F.when(target > 0, target).alias("target_id"), "r.authors",
    )


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def read_jsonl(spark: SparkSession, path: str, ddl: str, optional: bool = False) -> DataFrame:
    """Flat JSON lines. A missing path is an error unless ``optional`` says it means no rows."""
    try:
        return _lines(spark, path, ddl, strict=True)
    except AnalysisException as e:
        if optional and "PATH_NOT_FOUND" in str(e):
            return _empty(spark, ddl)
        raise


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, optional: bool = False, multiline: bool = True) -> DataFrame:
    """A table with a header, every column a string. With ``multiline`` quoted fields may span lines, and the
    records are found by the parity of quotes (``split``), so that a large file is many tasks either way."""
    try:
        if multiline:
            rows = _csv_records(spark, path)
        else:
            rows = spark.read.option("header", True).option("escape", '"').csv(path)
        rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
        return rows.select(*columns) if columns else rows
    except AnalysisException as e:
        if optional and columns and "PATH_NOT_FOUND" in str(e):
            return _empty(spark, ", ".join(f"`{c}` string" for c in columns))
        raise


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The first file's header names the columns; each file's first record is its header."""
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    records = read_records(spark, path, CSV).withColumn("value", F.regexp_replace("value", "\r$", ""))
    first = (F.col("start") == 0) & (F.col("n") == 0)
    body = records.filter(~first & (F.col("value") != ""))
    ddl = ", ".join(f"`c{i}` string" for i in range(len(head)))  # names may have any characters
    parsed = body.select(F.from_csv("value", ddl, {"escape": '"'}).alias("r"))
    return parsed.select(*(F.col(f"r.c{i}").alias(c) for i, c in enumerate(head)))


def read_rows(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """By the path's ending: .jsonl or .csv."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, ddl)
    if path.endswith(".csv"):
        return read_csv(spark, path)
    raise ValueError(f"neither .jsonl nor .csv: {path}")


def read_lookup_lines(spark: SparkSession, path: str, optional: bool = False) -> DataFrame:
    """``read_lookup`` of JSON lines {"key": ..., "status": ..., "items": [...]}, which Spark splits at
    will: the form for lookups of any size."""
    item = LOOKUP.removeprefix("map<string,struct<").removesuffix(">>")
    return read_jsonl(spark, path, f"key string, {item}", optional).filter("key is not null")


def _members(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """(key, v): the members of the JSON objects at ``path``; of a key that comes twice the last."""
    rows = read_members(spark, path).select("file", "start", "n", F.explode(F.from_json("value", f"map<string,{value_type}>")).alias("key", "v"))
    return rows.groupBy("file", "key").agg(F.max_by("v", F.struct("start", "n")).alias("v")).select("key", "v")


def read_lookup(spark: SparkSession, path: str, optional: bool = False) -> DataFrame:
    """A JSON object of request key to answer as rows key, status, http_status, error, items; what is no
    object has no rows. A large file is split at its members, by bytes (``split``)."""
    value = LOOKUP.removeprefix("map<string,").removesuffix(">")
    try:
        each = _members(spark, path, value)
    except AnalysisException as e:
        if optional and "PATH_NOT_FOUND" in str(e):
            return _empty(spark, "key string, status string, http_status int, error string, items array<struct<doi:string>>")
        raise
    return each.filter("v is not null").select("key", "v.status", "v.http_status", "v.error", "v.items")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of payload key to an array of DOIs or nulls, as rows key, pos (from 1), doi; split as in ``read_lookup``."""
    each = _members(spark, path, "array<string>")
    return each.select("key", F.posexplode("v").alias("pos", "doi")).withColumn("pos", F.col("pos") + 1)


def read_match_report(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {publication_id, decisions: [{order, parsed_index, status, score}]} as one row per
    (publication_id, reference_order): the last decision wins, orders that are no integer go."""
    ddl = "publication_id bigint, decisions array<struct<`order`:string,parsed_index:int,status:string,score:double>>"
    rows = _lines(spark, path, ddl, strict=True).withColumn("at", F.monotonically_increasing_id())
    each = rows.select("publication_id", "at", F.posexplode("decisions").alias("pos", "d"))
    each = each.select("publication_id", as_int(F.col("d.`order`")).alias("reference_order"), "at", "pos", "d.parsed_index", "d.status", "d.score").filter("reference_order is not null")
    return best(each, ["publication_id", "reference_order"], [-F.col("at"), -F.col("pos")]).drop("at", "pos")
