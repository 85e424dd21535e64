"""Source files that do not parse, by memoised derivatives of token streams.

A file's language is what its path claims. Each token takes the derivative of what the grammar still allows; the first
token with an empty derivative is where the file breaks, and a file at whose end the grammar still wants more is cut off.
Derivatives are kept for all files a task reads, and they alone decide, in all nine languages.

Defined results: null content is no case; empty, blank and comment-only files are valid in every language; a byte order
mark at the head is skipped; each row (repeated or not) is judged by itself; other extensions are ignored. Texts of any
length and depth are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.derivatives import parser
from corpusmill.llm.grammars import LANGUAGES

SCHEMA = "ord long, repo string, language string, failure string, line int"


def failure(extension: str, content: str) -> tuple[str, int] | None:
    """None for a valid file; else ("token", line) or ("end", line)."""
    text = content.removeprefix("﻿")
    if not text or text.isspace():
        return None
    return parser(extension).parse(text)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages, contents = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = [failure(e, c) or (None, None) for e, c in zip(languages, contents)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())],
            names=["ord", "repo", "language", "failure", "line"],
        )


def judged(file_nodes: DataFrame) -> DataFrame:
    """(ord, repo, language, failure, line) of every source file; failure and line are null for valid ones."""
    language = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    rows = file_nodes.filter(F.col("content").isNotNull() & F.col("path").isNotNull() & ~F.col("path").rlike(r"^(?i)https?://"))
    rows = rows.withColumn("language", language).filter(F.col("language").isin(*LANGUAGES))
    return rows.select(
        F.col("ord").cast("long").alias("ord"), F.col("repo").cast("string").alias("repo"), "language", F.col("content").cast("string").alias("content")
    ).mapInArrow(_run, SCHEMA)


def found(file_nodes: DataFrame) -> DataFrame:
    return judged(file_nodes).filter("failure is not null").select("ord")


def rates(file_nodes: DataFrame) -> DataFrame:
    """For each repository (null too) and language: files, broken files (cut off among them) and their share."""
    return judged(file_nodes).groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count("failure").alias("broken"), F.count_if(F.col("failure") == "end").alias("cut_off"),
        F.avg(F.col("failure").isNotNull().cast("int")).alias("rate"),
    )
