"""Queries of the text operators and the SQL that some are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import abuse, boilerplate, credentials, handwritten, leakage, mixing, personal, scans, syntax
from corpusmill.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "p8_found",
    """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
    dw AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12),
    bw AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM b WHERE len(w) >= 12),
    dk AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS k FROM dw),
    bk AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS k FROM bw)
    SELECT DISTINCT item_id, doc_id FROM dk JOIN bk USING (k)""",
)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("p8_overlaps")
def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("p8_items")
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(table(spark, d, "documents"), table(spark, d, "labels"))


@query("p10_scores")
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query("p10_rates")
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"), table(spark, d, "labels"))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.found(table(spark, d, "file_nodes"))


@query("p2_articles")
def p2_articles(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_content(table(spark, d, "file_nodes"))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.found(table(spark, d, "file_nodes"))


@query("p7_files")
def p7_files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.judged(table(spark, d, "file_nodes"))


@query("p7_rates")
def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.rates(table(spark, d, "file_nodes"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.found(table(spark, d, "file_nodes"))


@query("p5_rates")
def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "file_nodes"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(table(spark, d, "file_nodes"))


@query("p6_paragraphs")
def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "file_nodes"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found(table(spark, d, "file_nodes"))


@query("p3_redacted")
def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "file_nodes"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(table(spark, d, "file_nodes"), table(spark, d, "timelines"))


@query("p4_redacted")
def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "file_nodes"), table(spark, d, "timelines"))
