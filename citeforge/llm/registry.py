"""The subpackage's queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.quality_rules import quality_rules

    return quality_rules(_docs(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.packing import pack

    return pack(_docs(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.substring_dedup import substring_digest

    return substring_digest(_docs(spark, sf_dir))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.suffix_dedup import suffix_digest

    return suffix_digest(_docs(spark, sf_dir))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.url_filter import url_filter

    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.line_dedup import line_digest

    return line_digest(_docs(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.secret_scan import secret_digest

    return secret_digest(_docs(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir), keep="max", ignore_ascii_case=True).drop("text_tag")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.bpe import bpe_digest

    return bpe_digest(_docs(spark, sf_dir))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.simhash import simhash_components

    return simhash_components(_docs(spark, sf_dir)).drop("text_tag", "component")


def op11_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.rotated_codes import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.collocations import collocations

    return collocations(_docs(spark, sf_dir))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeforge.llm.ranked_search import ranked_search

    return ranked_search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules, op2_best_fit_packing, op3_substring_dedup, op4_suffix_array_dedup, op5_url_filter,
            op6_line_dedup, op7_secret_scan, op8_exact_dedup, op9_byte_bpe, op10_simhash_dedup,
            op11_rotated_codes, op12_collocations, op13_ranked_search,
        )
    }


def oracle_sql() -> dict[str, str]:
    from citeforge.llm import oracle

    return {
        "op3_substring_dedup": oracle.OP3,
        "op4_suffix_array_dedup": oracle.OP4,
        "op6_line_dedup": oracle.OP6,
        "op8_exact_dedup": oracle.OP8,
        "op12_collocations": oracle.OP12,
        "op13_ranked_search": oracle.OP13,
    }
