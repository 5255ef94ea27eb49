"""The registered queries of the operators, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    language, licenses, minhash, mixing, negatives, pieces, quality, spotsigs, tokenfiles, topk, toxicity, variants, wrappers,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


@_register(minhash.ORACLE)
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@_register(topk.ORACLE)
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@_register(mixing.ORACLE)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@_register()
def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_index(table(spark, sf_dir, "documents"))


@_register()
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(table(spark, sf_dir, "documents"))


@_register()
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


@_register()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    found = language.identify(language.page_rows(pages), docs.select("text", "lang"))
    return found.withColumnRenamed("id", "page_id")


@_register(licenses.ORACLE)
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@_register()
def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


@_register()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register(negatives.ORACLE)
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@_register()
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))
