"""The stages of a run in their fixed order: filter, tree, search, budget, redact, compress; then one output."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import compress, paths
from corpusmill.functions import redact as redaction
from corpusmill.operators import corpus as ops
from corpusmill.plans import sinks


@dataclass(frozen=True)
class PipelineConfig:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    depth: int | None = None
    least_rank: int = 0
    query: str | None = None
    top: int = 3
    budget: int | None = None
    redact: bool = False
    force_trigger: bool = False
    level: str | None = None
    flavor: str = "human"
    tree: bool = False
    manifest: bool = False
    summary: bool = False
    #: `combined`, `chunk`, `split`, `json` or `tokens`.
    sink: str = "combined"
    chunk: str | int = "100k"
    write: str | None = None


def run(rows: DataFrame, config: PipelineConfig) -> DataFrame:
    """(ord, path, content) after all stages. The budget is decided on texts as they came, before redaction. The tree lists
    every name, also of rows that are filtered, and is neither redacted nor compressed."""
    p = F.col("path")
    listing = ops.tree_row(rows.select("path")) if config.tree else None
    rows = rows.filter(~paths.is_secret_file(p))
    if config.include:
        rows = rows.filter(paths.included(p, config.include))
    if config.exclude:
        rows = rows.filter(~paths.excluded(p, config.exclude))
    if config.depth is not None:
        rows = rows.filter(paths.depth(p) <= config.depth)
    if config.least_rank:
        rows = rows.filter(ops.rank(p) >= config.least_rank)
    if config.query:
        rows = ops.search(rows, config.query, config.top).drop("score")
    if config.budget is not None:
        rows = ops.within_budget(rows, config.budget).withColumn("ord", F.col("at")).drop("mode", "at")
    content = F.col("content")
    if config.redact:
        content = redaction.redact(content, config.force_trigger)
    if config.level:
        content = compress.compress_markdown(content, config.level)
    out = rows.select("ord", "path", content.alias("content"))
    return listing.unionByName(out) if listing is not None else out


def output(rows: DataFrame, config: PipelineConfig, name: str) -> DataFrame:
    """The blocks of the output that the configuration asks for: chunk files, split files, tokens alone, or one combined text."""
    after = run(rows, config)
    if config.sink == "chunk":
        return sinks.chunk_files(after, config.chunk, name, config.flavor, config.write, config.summary)
    if config.sink == "split":
        return sinks.split_files(after, config.flavor)
    if config.sink == "tokens":
        return sinks.tokens_only(after)
    if config.sink == "json":
        return ops.json_nodes(after)
    scores = ops.search(rows, config.query, config.top).select("path", "score") if config.query else None
    return sinks.combined(after, name, config.flavor, config.manifest, config.summary, scores)
