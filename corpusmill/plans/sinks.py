"""A run's outputs as rows to be written in order: combined, chunk files, split files, JSON, tokens only, and the report.

Every output is (ord, block) or (name, ord, block): texts that read one after the other give it, so that no output is built
as one value. `TREE` rows stand in outputs as they are, without a header of their own.

Defined results: an empty corpus gives an empty output; rows keep the order of `ord`; names of outputs may repeat when paths
do, and their blocks then follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths, tokens
from corpusmill.operators import corpus as ops
from corpusmill.session import cut

#: Places before and after all rows.
_FIRST, _LAST = -(1 << 62), 1 << 62


def summary_text(rows: DataFrame, top: int = 5) -> str:
    """The summary as a text: the first README's introduction and the most frequent extensions."""
    found = ops.summary(rows.filter(F.col("path") != ops.TREE), top).first()
    overview = f"> **Overview:** {found['intro']}\n\n" if found["intro"] else ""
    lines = found["extensions"] + "\n" if found["extensions"] else ""
    return f"## Project Summary\n\n{overview}**Composition:**\n{lines}\n---\n\n"


def manifest_blocks(rows: DataFrame) -> DataFrame:
    """(ord, block): the lines of the table of contents; numbers count the tree's row, which has no line."""
    cost = tokens.estimate(F.col("content"), F.col("path"))
    lines = ops.in_order(rows.select("ord", "path", cost.alias("tokens")), "ord", "idx", 1).filter(F.col("path") != ops.TREE)
    return lines.select("idx", F.format_string("| %d | %s | %d |\n", "idx", "path", "tokens").alias("block"))


def combined(rows: DataFrame, name: str, flavor: str = "human", manifest: bool = False, summary: bool = False, scores: DataFrame | None = None) -> DataFrame:
    """(place, ord, block) of the combined output, to be read by place and ord: the flavor's head, the manifest (if there is more
    than one row), the summary, all rows, the flavor's end."""
    spark = rows.sparkSession
    rows = cut(rows.select("ord", "path", "content"))
    parts = []
    if manifest and rows.limit(2).count() > 1:
        head = spark.createDataFrame([(_FIRST, "| # | File | Tokens |\n|---|------|--------|\n"), (_LAST, "\n")], "ord long, block string")
        parts.append((1, head.unionByName(manifest_blocks(rows).select(F.col("idx").alias("ord"), "block"))))
    if summary:
        parts.append((2, spark.createDataFrame([(0, summary_text(rows))], "ord long, block string")))
    files = ops.combined_blocks(rows.filter(F.col("path") != ops.TREE), scores)
    parts.append((3, files.unionByName(rows.filter(F.col("path") == ops.TREE).select("ord", F.col("content").alias("block")))))
    body = None
    for place, part in parts:
        part = part.select(F.lit(place).alias("place"), "ord", "block")
        body = part if body is None else body.unionByName(part)
    return _framed(body, [], name, flavor)


def _framed(body: DataFrame, group: list[str], name: str | Column, flavor: str) -> DataFrame:
    """`body` with the flavor's head and end around each group's blocks. Trimming reaches the first and last block only."""
    named = name if isinstance(name, Column) else F.lit(name)
    edges = body.groupBy(*group).agg(
        F.min(F.struct("place", "ord")).alias("_first"), F.max(F.struct("place", "ord")).alias("_last"), F.coalesce(F.sum(F.octet_length("block")), F.lit(0)).alias("_bytes")
    ).filter("_first is not null")
    at = lambda place: [F.lit(place).alias("place"), F.lit(0).cast("long").alias("ord")]
    if flavor == "anthropic":
        head = edges.select(*group, *at(0), F.concat(F.lit('<file path="'), named, F.lit('">\n<content>\n')).alias("block"))
        return body.unionByName(head).unionByName(edges.select(*group, *at(9), F.lit("\n</content>\n</file>\n").alias("block")))
    if flavor == "gpt":
        front = F.concat(F.lit("---\nfile: "), named, F.lit("\ntokens: "), F.floor(F.col("_bytes") / 4).cast("string"), F.lit("\nmode: full\n---\n```\n"))
        return body.unionByName(edges.select(*group, *at(0), front.alias("block"))).unionByName(edges.select(*group, *at(9), F.lit("\n```\n").alias("block")))
    joined = body.join(F.broadcast(edges.drop("_bytes")), group) if group else body.crossJoin(F.broadcast(edges.drop("_bytes")))  # of one row
    here = F.struct("place", "ord")
    block = F.when(here == F.col("_first"), F.regexp_replace("block", r"(?U)^\s+", "")).otherwise(F.col("block"))
    block = F.when(here == F.col("_last"), F.concat(F.regexp_replace(block, r"(?U)\s+$", ""), F.lit("\n"))).otherwise(block)
    return joined.select(*group, "place", "ord", block.alias("block"))


def chunk_files(rows: DataFrame, threshold: int | str, name: str, flavor: str = "human", write: str | None = None, summary: bool = False) -> DataFrame:
    """(name, place, ord, block): next-fit parts, one file each. The summary stands before the first row, unless that is the
    tree's. A threshold that cannot be read packs nothing: one part."""
    limit = tokens.parse_threshold(threshold) if isinstance(threshold, str) else threshold
    rows = cut(rows.select("ord", "path", "content"))
    parts = ops.chunks(rows, limit) if limit is not None else rows.select("ord", F.lit(1).alias("part"))
    stem = (write or "gobbled").removesuffix(".md") if write is None else _without_md(write)
    blocks = ops.combined_blocks(rows.filter(F.col("path") != ops.TREE)).unionByName(rows.filter(F.col("path") == ops.TREE).select("ord", F.col("content").alias("block")))
    body = blocks.join(parts, "ord").select(F.format_string(f"{stem.replace('%', '%%')}.part%d.md", "part").alias("name"), F.lit(2).alias("place"), "ord", "block")
    first = rows.orderBy("ord").select("path").first()
    if summary and first and first["path"] != ops.TREE:
        head = rows.sparkSession.createDataFrame([(f"{stem}.part1.md", 1, 0, summary_text(rows))], "name string, place int, ord long, block string")
        body = body.unionByName(head)
    return _framed(body, ["name"], F.lit(name), flavor)


def _without_md(name: str) -> str:
    while name.endswith(".md"):
        name = name[:-3]
    return name


def split_files(rows: DataFrame, flavor: str = "human") -> DataFrame:
    """(name, ord, body): one file a row under its safe name, in the flavor and under its own path."""
    return rows.select(paths.safe_name(F.col("path")).alias("name"), "ord", ops.flavored(F.col("content"), F.col("path"), flavor).alias("body"))


def tokens_only(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(tokens.estimate(F.col("content"), F.col("path"))), F.lit(0)).alias("tokens"))


def report(before: DataFrame, after: DataFrame, threshold: int | None = None) -> DataFrame:
    """One row a model: files, bytes, tokens and tokens saved of a run, the parts it was packed into, and what it costs."""
    parts = ops.chunks(after, threshold).agg(F.coalesce(F.max("part"), F.lit(0)).alias("parts")) if threshold else after.sparkSession.createDataFrame([(1,)], "parts int")
    return tokens.costs(ops.metrics(before, after).crossJoin(F.broadcast(parts)))  # of one row each


# --- writers --------------------------------------------------------------------------------------------------------------


def _line(block: Column) -> Column:
    """A block without the line end that the writer puts after it; every block ends with one."""
    return F.when(block.endswith("\n"), F.left(block, F.length(block) - 1)).otherwise(block)


def write_blocks(blocks: DataFrame, folder: str) -> None:
    """Text files that read in the order of their names give the output."""
    order = [c for c in ("place", "ord") if c in blocks.columns]
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).select(_line(F.col("block")).alias("block")).write.text(folder)


def write_named(blocks: DataFrame, folder: str) -> None:
    """One folder a name, whose text files in the order of their names give that file."""
    order = [c for c in ("name", "place", "ord") if c in blocks.columns]
    body = F.col("block" if "block" in blocks.columns else "body")
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).select(F.replace("name", F.lit("/"), F.lit("%2F")).alias("name"), _line(body).alias("block")).write.partitionBy("name").text(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    rows.repartitionByRange("ord").sortWithinPartitions("ord").select("path", "content").write.json(folder)
