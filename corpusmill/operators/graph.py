"""Reachability over a link graph, and robots rules.

Null ends of edges reach nothing; repeated edges and cycles are visited once; an unknown seed reaches itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import html, paths
from corpusmill.operators.corpus import TREE, in_order
from corpusmill.session import BROADCAST_ROWS, cut


#: Rows, and bytes of their names, up to which nodes are broadcast to a round's joins.
SIDE_ROWS, SIDE_BYTES = BROADCAST_ROWS, 4_000_000
#: Frontiers that are kept as tables of their own.
MOST_ROUNDS = 16


def _side(nodes: DataFrame, rows: int, size: int) -> DataFrame:
    """`nodes` as a side of a join, broadcast only if few by count. Spark's own estimate is taken from the bytes of the files
    that were read; rows can be thousands of times larger, and would fill the driver."""
    return F.broadcast(nodes) if rows <= SIDE_ROWS and size <= SIDE_BYTES else nodes.hint("merge")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth) of every node, with the least number of steps from a seed. One round a step: the frontier is joined
    to the edges and nodes seen before fall out; only the frontier's extent is asked for."""
    edges = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    frontier = cut(seeds.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0)))
    extent = F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("node").cast("string"))), F.lit(0))
    rows, size = frontier.agg(*extent).first()
    seen_rows, seen_size = rows, size
    rounds, step = [frontier], 0
    while depth is None or step < depth:
        step += 1
        seen = rounds[0]
        for f in rounds[1:]:  # frontiers are written once each; what was seen is their union
            seen = seen.unionByName(f)
        found = _side(frontier, rows, size).join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(_side(seen.select("node"), seen_rows, seen_size), "node", "left_anti").withColumn("depth", F.lit(step)))
        rows, size = frontier.agg(*extent).first()
        if not rows:
            break
        seen_rows, seen_size = seen_rows + rows, seen_size + size
        rounds.append(frontier)
        if len(rounds) > MOST_ROUNDS:  # many small tables become one
            rounds = [cut(seen.unionByName(frontier))]
    out = rounds[0]
    for f in rounds[1:]:
        out = out.unionByName(f)
    return out


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, allowed) of (page_id, host, path) under (host, prefix, allow): the longest prefix decides, allowing wins
    a tie, no rule allows."""
    rules = rules.select(F.col("host").alias("_host"), "prefix", "allow")
    fits = pages.join(rules, (pages["host"] == rules["_host"]) & pages["path"].startswith(rules["prefix"]), "left")
    w = Window.partitionBy("page_id").orderBy(F.desc_nulls_last(F.length("prefix")), F.desc("allow"))
    return fits.withColumn("n", F.row_number().over(w)).filter("n = 1").select("page_id", F.coalesce("allow", F.lit(True)).alias("allowed"))


# --- crawling stored pages ------------------------------------------------------------------------------------------------


def absolute(rows: DataFrame, base: str, href: str, name: str) -> DataFrame:
    """`rows` with `name`: `href` joined to the URL `base`, without its fragment; null if it is no URL."""
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema]

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urldefrag(urljoin(b, h.strip()))[0] or None if b and h is not None else None
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [one(b, h) for b, h in zip(batch.column(base).to_pylist(), batch.column(href).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(joined, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*fields, (name, "string")]))


def admissible(src: Column, dst: Column) -> Column:
    """A link that a crawl follows: http(s), to the host it comes from."""
    return dst.rlike(r"^https?://") & (paths.url_host(src) == paths.url_host(dst))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst), distinct: the links of (url, html) that a crawl follows."""
    found = pages.select(F.col("url").alias("src"), F.explode(html.links(F.col("html"))).alias("href"))
    return absolute(found, "src", "href", "dst").filter(admissible(F.col("src"), F.col("dst"))).select("src", "dst").distinct()


def crawl(pages: DataFrame, seed: str, rules: DataFrame | None = None, depth: int | None = None, full: bool = False) -> DataFrame:
    """(ord, path, content) of the stored pages (url, html, optional content_type) that a crawl from `seed` reaches, nearest first,
    then by URL, with the tree's row before them. Links lead on from pages that are stored, of type HTML or plain text, and
    that `rules` (host, prefix, allow) do not forbid; pages of which nothing is left give no row."""
    usable = pages.filter("url is not null and html is not null").dropDuplicates(["url"])
    if "content_type" in pages.columns:
        usable = usable.filter(F.coalesce("content_type", F.lit("text/html")).rlike("^text/(?:html|plain)"))
    if rules is not None:
        path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
        asked = usable.select(F.col("url").alias("page_id"), paths.url_host(F.col("url")).alias("host"), path.alias("path"))
        usable = usable.join(allowed(asked, rules).filter("allowed").select(F.col("page_id").alias("url")).hint("merge"), "url", "left_semi")
    seeds = pages.sparkSession.createDataFrame([(seed,)], "node string")
    reached = reachable(page_links(usable), seeds, depth)
    found = usable.join(reached.withColumnRenamed("node", "url").hint("merge"), "url")  # pages lie by URL already; they are never broadcast
    found = found.select("depth", F.col("url").alias("path"), html.page_to_markdown(F.col("html"), full).alias("content"))
    found = in_order(cut(found.filter("content <> ''")), ["depth", "path"], "ord", 1).select("ord", "path", "content")
    host = urlsplit(seed).hostname or "unknown"
    tree = pages.sparkSession.createDataFrame([(0, TREE, f"```tree\n🌐 {host}\n```\n\n")], "ord long, path string, content string")
    return tree.unionByName(found)
