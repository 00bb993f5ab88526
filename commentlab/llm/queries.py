"""The registered queries of this subpackage and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, language_model, mixing, neardup, negatives, pii, quality, secrets, sharding, token_counts, token_files, urls
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.report(documents(spark, sf), documents(spark, sf, "benchmark"))


@query
def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = secrets.train(secrets.labelled_samples(docs, documents(spark, sf, "labels")))
    return secrets.report(docs, model)


@query
def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.report(documents(spark, sf))


@query
def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.report(documents(spark, sf))


@query
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return quality.report(docs, quality.fit(docs, quality.trusted_ids(documents(spark, sf, "labels"))))


@query
def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(documents(spark, sf))


ORACLE_SQL["op5_sharding"] = sharding.ORACLE_SQL
ORACLE_SQL["op10_mixing"] = mixing.ORACLE_SQL


@query
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.report(documents(spark, sf))


@query
def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.report(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.report(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.report(documents(spark, sf, "pages"))


@query
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf))


ORACLE_SQL["op12_collocations"] = collocations.ORACLE_SQL


@query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.hard_negatives(documents(spark, sf, "embeddings"))


ORACLE_SQL["op13_hard_negatives"] = negatives.ORACLE_SQL


@query
def op11_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return language_model.report(documents(spark, sf))
