"""Operators on a corpus: (ord, path, content), ordered by ord.

Rows of null content are no part of a corpus (`corpus` drops them); a null path counts as ''. Repeated rows stay, each
under its ord. Additional columns are carried where an operator returns its input's rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from corpusmill.functions import compress, redact, tokens
from corpusmill.functions.paths import summary_extension
from corpusmill.session import attached, cut, small

#: The row that holds a run's tree listing (a fixed value).
TREE = "_tree.md"


def corpus(df: DataFrame, ord: str = "ord", path: str = "path", content: str = "content") -> DataFrame:
    return df.filter(F.col(content).isNotNull()).select(
        F.col(ord).cast("long").alias("ord"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(content).alias("content")
    )


def union_targets(*targets: DataFrame) -> DataFrame:
    """All targets' rows in the targets' order; `ord` is renumbered to (target, ord)."""
    out = None
    for n, t in enumerate(targets):
        part = t.select(F.lit(n).alias("target"), "ord", "path", "content")
        out = part if out is None else out.unionByName(part)
    return out


# --- ranking and selection --------------------------------------------------------------------------------------------


def rank(path: Column) -> Column:
    """0 for logs and backups, 1 for data, 2 for documents and settings, 3 for everything else."""
    low = F.lower(path)
    ends = lambda *xs: low.rlike(r"\.(?:" + "|".join(xs) + ")$")
    return F.when(ends("log", "bak", "tmp"), 0).when(ends("json", "csv", "lock"), 1).when(ends("md", "txt", "toml", "yaml", "yml"), 2).otherwise(3)


def fallback(content: Column) -> Column:
    """What a row of the highest rank is tried with if it does not fit: blanks folded, JSON and HTML minified."""
    return compress.minify_html(compress.minify_json(compress.fold_newlines(compress.fold_whitespace(content))))


#: Parts in which rows of one class are numbered before the class is; a class may hold a third of all rows.
_SALT = 64


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Rows that a token budget takes, with `mode` (the text as it is, or `folded`) and `at`, their place in the output. All,
    unchanged and in order of ord, if they fit; else in order of path: high ranks are taken first, short texts first, the
    later of equals first, each row that still fits (one of the highest rank that does not fit is tried with `fallback`).

    Sums by (rank, bytes) find how far everything fits. Of the rows beyond, those alike in rank, size and costs are taken
    from the first on until one does not fit, so that of each such class no more than what is left of the budget can pay for
    need be looked at: the sequential pass gets a number of keys that the budget bounds, not the corpus, as one sorted stream
    that is never held in memory. Rows without cost always fit. Contents move only in the join at the end."""
    cost = tokens.estimate(F.col("content"), F.col("path"))
    sized = cut(rows.select("ord", rank(F.col("path")).alias("rank"), F.octet_length("content").alias("bytes"), cost.alias("cost")))
    if (sized.agg(F.sum("cost")).first()[0] or 0) <= budget:
        return rows.withColumns({"mode": F.lit("full"), "at": F.col("ord")})
    groups = sized.groupBy("rank", "bytes").agg(F.sum("cost").alias("cost"))
    groups = cut(groups.withColumn("used", F.sum("cost").over(Window.orderBy(F.desc("rank"), "bytes"))))  # over groups, not rows
    last = groups.filter(F.col("used") <= budget).orderBy("rank", F.desc("bytes")).first()
    spent, sure = (last["used"], (F.col("rank") > last["rank"]) | ((F.col("rank") == last["rank"]) & (F.col("bytes") <= last["bytes"]))) if last else (0, F.lit(False))
    left = budget - spent
    sure = sure | (F.col("cost") == 0)
    beyond = attached(rows, cut(sized.filter(~sure & (F.col("rank") == 3))), ["ord"], F.lit(32)) if last is None or last["rank"] == 3 else None
    rest = sized.filter(~sure & (F.col("rank") < 3)).withColumn("other", F.lit(None).cast("long"))
    if beyond is not None:
        rest = rest.unionByName(beyond.select("ord", "rank", "bytes", "cost", tokens.estimate(fallback(F.col("content")), F.col("path")).alias("other")))
    rest = rest.filter(F.least("cost", F.coalesce("other", "cost")) <= left)
    alike = ["rank", "bytes", "cost", "other"]
    most = F.when(F.coalesce("other", F.lit(1)) == 0, F.floor(F.lit(left) / F.col("cost"))).otherwise(F.floor(F.lit(left) / F.least("cost", F.coalesce("other", "cost"))))
    number = lambda *more: F.row_number().over(Window.partitionBy(*alike, *more).orderBy(F.desc("ord")))
    rest = cut(rest.withColumns({"most": most, "part": F.pmod(F.xxhash64("ord"), F.lit(_SALT))}))
    free = F.coalesce(F.col("other") == 0, F.lit(False))
    some = rest.withColumn("n", number("part")).filter((F.col("n") <= F.col("most")) | free).withColumn("n", number())
    stream = some.filter(F.col("n") <= F.col("most"))
    over = some.filter((F.col("n") > F.col("most")) & free).select("ord", F.lit("folded").alias("mode"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare = left
        for batch in batches:
            ords, modes = [], []
            for o, cost, other in zip(*(batch.column(c).to_pylist() for c in ("ord", "cost", "other"))):
                if cost <= spare:
                    mode, spare = "full", spare - cost
                elif other is not None and other <= spare:
                    mode, spare = "folded", spare - other
                else:
                    continue
                ords.append(o)
                modes.append(mode)
            yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int64()), pa.array(modes, pa.string())], names=["ord", "mode"])

    stream = stream.select("rank", "bytes", "ord", "cost", "other").repartition(1).sortWithinPartitions(F.desc("rank"), "bytes", F.desc("ord"))
    kept = cut(sized.filter(sure).select("ord", F.lit("full").alias("mode")).unionByName(over).unionByName(stream.mapInArrow(take, "ord long, mode string")))
    kept = attached(rows, kept, ["ord"], F.lit(16))
    places = cut(in_order(kept.select("ord", "path"), ["path", "ord"], "at").select("ord", "at"))
    kept = kept.join(small(places), "ord")
    return kept.withColumn("content", F.when(F.col("mode") == "folded", fallback(F.col("content"))).otherwise(F.col("content")))


def pruning(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: the tokens before and after the budget, and the rows kept."""
    cost = tokens.estimate(F.col("content"), F.col("path"))
    total = rows.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("initial_tokens"))
    return kept.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("kept_tokens"), F.count("*").alias("kept_rows")).crossJoin(F.broadcast(total)).select("initial_tokens", "kept_tokens", "kept_rows")  # of one row each


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of fewer than 40 bytes."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.octet_length(w) < 40)


K1, B = 1.2, 0.75


def parse_query(query: str) -> list[tuple[str, str, list[str]]]:
    """(sign, field, words) of each part: bare terms, "phrases", +must, -not, path: and body:. Anything else is an error."""
    import re

    parts = []
    for m in re.finditer(r'([+-]?)(?:(path|body):)?(?:"([^"]+)"|([^\s":()]+))|(\S)', query):
        if m[5]:
            raise ValueError(f"cannot read the query at {m[5]!r}")
        found = [w for w in re.findall(r"[^\W_]+", (m[3] or m[4]).lower()) if len(w.encode()) < 40]
        if found and (m[4] or "").upper() not in ("OR", "AND"):
            parts.append((m[1], m[2] or "", found))
    return parts


def _is(word: str):
    return lambda w: w == word


def search(rows: DataFrame, query: str, k: int | None = 3) -> DataFrame:
    """Rows by BM25 over content and path, best first (`k` None: all that match), ties by ord. Terms are OR-ed. The corpus is
    read once for a narrow table of lengths and counts of the query's words; totals and scores work on that, and contents are
    looked up for the rows that are returned."""
    parts = parse_query(query)
    terms = sorted({w for sign, _, ws in parts if sign != "-" for w in ws})
    fields = ("body", "path")
    read = rows.select("ord", words(F.col("content")).alias("body"), words(F.col("path")).alias("path"))

    def has(field: str, ws: list[str]) -> Column:
        hits = [F.array_join(f, " ").rlike(r"(?:^| )" + " ".join(ws) + "(?: |$)") for f in ([field] if field else fields)]
        return hits[0] if len(hits) == 1 else hits[0] | hits[1]

    wanted = F.lit(True)
    for sign, field, ws in parts:
        if sign == "+" or (len(ws) > 1 and sign != "-"):
            wanted = wanted & has(field, ws)
        elif sign == "-":
            wanted = wanted & ~has(field, ws)
    hits = {f"hit_{f}": F.filter(f, lambda w: w.isin(terms) if terms else F.lit(False)) for f in fields}
    read = read.select("ord", wanted.alias("wanted"), *(F.size(f).alias(f"len_{f}") for f in fields), *(c.alias(n) for n, c in hits.items()))
    counted = cut(read.select("ord", "wanted", *(f"len_{f}" for f in fields), *(F.size(F.filter(f"hit_{f}", _is(t))).alias(f"tf_{f}_{i}") for f in fields for i, t in enumerate(terms))))
    total = counted.agg(  # one row of numbers
        F.count("*").alias("n"), *(F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields),
        *(F.sum((F.col(f"tf_{f}_{i}") > 0).cast("int")).alias(f"df_{f}_{i}") for f in fields for i in range(len(terms))),
    ).first()
    score = F.lit(0.0)
    for f in fields:
        for i in range(len(terms)):
            tf, df = F.col(f"tf_{f}_{i}"), total[f"df_{f}_{i}"] or 0
            idf = math.log(1 + (total["n"] - df + 0.5) / (df + 0.5))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"len_{f}") / (total[f"avg_{f}"] or 1.0)))
    scored = counted.select("ord", "wanted", score.alias("score")).filter(F.col("wanted") & (F.col("score") > 0)).select("ord", "score")
    if k is not None:
        scored = scored.orderBy(F.desc("score"), "ord").limit(k)
    out = attached(rows.drop("score"), cut(scored), ["ord"], F.lit(16)).select(*(c for c in rows.columns if c != "score"), "score")
    return out if k is None else out.orderBy(F.desc("score"), "ord").limit(k)


# --- accounting -------------------------------------------------------------------------------------------------------


def metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files, bytes, tokens, and the tokens saved between two stages of a corpus."""
    cost = tokens.estimate(F.col("content"), F.col("path"))
    sized = lambda df, now: df.select(F.lit(now).alias("now"), F.octet_length("content").alias("bytes"), cost.alias("cost"))
    of = lambda c, now: F.coalesce(F.sum(F.when(F.col("now") == now, F.col(c))), F.lit(0))
    both = sized(before, False).unionByName(sized(after, True))
    return both.agg(
        F.count_if("now").alias("files"), of("bytes", True).alias("bytes"), of("cost", True).alias("tokens"), F.greatest(of("cost", False) - of("cost", True), F.lit(0)).alias("tokens_saved")
    )


def extensions(rows: DataFrame) -> DataFrame:
    return rows.groupBy(summary_extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"))


def manifest(rows: DataFrame) -> DataFrame:
    """(idx, path, tokens), numbered in order. Numbers are sums over ranges of ord, so no single task sorts the corpus."""
    sized = rows.select("ord", "path", tokens.estimate(F.col("content"), F.col("path")).alias("tokens"))
    return numbered(sized, "ord", "idx").select("idx", "path", "tokens")


def in_order(rows: DataFrame, keys: str | list[str], name: str, first: int = 0) -> DataFrame:
    """Row numbers from `first` by any keys that order the rows: ranges of keys are sorted in parallel, and each adds the
    number of rows in the ranges before it."""
    keys = [keys] if isinstance(keys, str) else keys
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_range": F.shiftrightunsigned("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_at") + first).cast("long")).drop("_range", "_at", "_before")


def numbered(rows: DataFrame, order: str, name: str, width: int = 4096) -> DataFrame:
    """Row numbers from 1 by a whole-number key: ranks inside ranges of the key plus the rows of the ranges before."""
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = offsets.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_within", within).join(offsets, "_range").withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_range", "_n", "_before", "_within")


def directory_counts(paths: DataFrame) -> DataFrame:
    """(dir, files, entries): of each directory the files right in it, and its entries, directories counted once."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("dir"), F.element_at(parts, i).alias("name"), (i == F.size(parts)).alias("file")))
    entries = paths.filter("path <> ''").select(F.explode(up).alias("e")).groupBy("e.dir", "e.name").agg(F.min("e.file").alias("file"))
    return entries.groupBy("dir").agg(F.count_if("file").alias("files"), F.count("*").alias("entries"))


def directory_entries(paths: DataFrame) -> DataFrame:
    """(at, dir, name, is_dir): all entries once, directory by directory, in each its directories first, then by name."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("dir"), F.element_at(parts, i).alias("name"), (i == F.size(parts)).alias("file")))
    entries = paths.filter("path <> ''").select(F.explode(up).alias("e")).groupBy("e.dir", "e.name").agg(F.min("e.file").alias("is_file"))
    return in_order(entries, ["dir", "is_file", "name"], "at", 1).select("at", "dir", "name", (~F.col("is_file")).alias("is_dir"))


def readme_intro(content: Column) -> Column:
    """Three lines after the blank and heading lines at the head, blank lines left out, on one line."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", "")))
    skip = F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")), lambda a, x: F.struct(
        F.when(a["done"] | ~((x == "") | x.startswith("#")), a["n"]).otherwise(a["n"] + 1).alias("n"), (a["done"] | ~((x == "") | x.startswith("#"))).alias("done")
    ), lambda a: a["n"])
    body = F.filter(F.slice(lines, skip + 1, F.greatest(F.size(lines), F.lit(1))), lambda x: x != "")
    return F.array_join(F.slice(body, 1, 3), " ")


def summary(rows: DataFrame, top: int = 5) -> DataFrame:
    """One row: files, tokens, the most frequent extensions as lines, and the first README's introduction."""
    counts = extensions(rows)
    best = counts.orderBy(F.desc("files"), "ext").limit(top).collect()
    kinds = counts.count()
    lines = [f"- **{r.ext}**: {r.files} files" for r in best] + [f"- *...and {kinds - top} other types*"] * (kinds > top)
    readme = F.when(F.lower("path").endswith("readme.md"), readme_intro(F.col("content")))
    intro = F.when(readme != "", readme)
    cost = tokens.estimate(F.col("content"), F.col("path"))
    return rows.agg(
        F.count("*").alias("files"), F.coalesce(F.sum(cost), F.lit(0)).alias("tokens"), F.lit("\n".join(lines)).alias("extensions"),
        F.min_by(intro, F.when(intro.isNotNull(), F.col("ord"))).alias("intro"),
    )


# --- output -----------------------------------------------------------------------------------------------------------


def flavored(content: Column, name: Column, flavor: str) -> Column:
    """`human` and `gemini`: trimmed; `anthropic`: tags; `gpt`: front matter and a fence. Unknown names are human."""
    trimmed = F.regexp_replace(content, r"(?U)^\s+|\s+$", "")
    if flavor == "anthropic":
        return F.concat(F.lit('<file path="'), name, F.lit('">\n<content>\n'), content, F.lit("\n</content>\n</file>\n"))
    if flavor == "gpt":
        return F.concat(F.lit("---\nfile: "), name, F.lit("\ntokens: "), tokens.header_tokens(content).cast("string"), F.lit("\nmode: full\n---\n```\n"), content, F.lit("\n```\n"))
    return F.concat(trimmed, F.lit("\n"))


def combined_blocks(rows: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(ord, block) of the combined output; write in order of ord. With `scores` (path, score) relevance is noted."""
    head = F.concat(F.lit("// --- FILE_START: "), F.col("path"), F.lit(" ---"))
    if scores is not None:
        best = scores.groupBy("path").agg(F.max("score").alias("_score"))
        rows = rows.join(best, "path", "left")
        head = F.when(F.col("_score").isNotNull(), F.concat(head, F.lit(" (relevance: "), F.format_string("%.2f", F.round("_score", 2)), F.lit(")"))).otherwise(head)
    return rows.select("ord", F.concat(head, F.lit("\n"), F.col("content"), F.lit("\n\n")).alias("block"))


def chunks(rows: DataFrame, threshold: int, group: list[str] | None = None) -> DataFrame:
    """(ord, part): next-fit packing in order. A row that would take a non-empty part beyond the threshold begins the next.

    The fold is sequential by nature: keys and sizes go through it as one sorted stream a group (one for the corpus without
    `group`), a few bytes a row and nothing held in memory."""
    group = group or []
    sized = rows.select(*group, "ord", tokens.estimate(F.col("content"), F.col("path")).alias("tokens"), (F.col("content") != "").alias("filled"))
    stream = (sized.repartition(*group) if group else sized.repartition(1)).sortWithinPartitions(*group, "ord")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, used, filled = None, 0, 0, False
        for batch in batches:
            parts = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:-3] != key:
                    key, part, used, filled = row[:-3], 1, 0, False
                if filled and used + row[-2] > threshold:
                    part, used = part + 1, 0
                used, filled = used + row[-2], True
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column("ord"), pa.array(parts, pa.int32())], names=["ord", "part"])

    return stream.mapInArrow(pack, "ord long, part int")


def json_nodes(rows: DataFrame) -> DataFrame:
    """(ord, node): one JSON object a row, for `write.text`."""
    return rows.select("ord", F.to_json(F.struct("path", "content")).alias("node"))


# --- entropy ----------------------------------------------------------------------------------------------------------


def entropy(window: bytes) -> float:
    n = len(window)
    return -sum(c / n * math.log2(c / n) for c in Counter(window).values()) if n else 0.0


def entropy_spans(text: str, window: int = 16, threshold: float = 4.0, force: bool = False) -> list[tuple[int, int]]:
    """Byte windows above the threshold; counts move with the window, so a byte costs a step."""
    data = text.encode()
    if len(data) < window:
        return []
    counts, out = Counter(data[:window]), []
    plogp = [0.0] + [c / window * math.log2(c / window) for c in range(1, window + 1)]
    h = -sum(plogp[c] for c in counts.values())
    for i in range(len(data) - window + 1):
        if i:
            for b, d in ((data[i - 1], -1), (data[i + window - 1], 1)):
                h += plogp[counts[b]]
                counts[b] += d
                h -= plogp[counts[b]]
        if force or h > threshold + 1e-9:
            out.append((i, i + window))
    return out


def refined_text(text: str, window: int = 16, threshold: float = 4.0, look_back: int = 64, force: bool = False) -> str:
    """The literals of a forced refinement replaced where windows of bytes are above the entropy threshold, windows within
    `look_back` of each other taken as one stretch. By default no window of 16 bytes is above 4 bits, so nothing changes."""
    spans: list[list[int]] = []
    for a, b in entropy_spans(text, window, threshold, force):
        if spans and a <= spans[-1][1] + look_back:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    data = text.encode()
    for a, b in reversed(spans):
        part = data[a:b]
        for literal in redact.REFINED:
            part = part.replace(literal.encode(), redact.MARK.encode())
        data = data[:a] + part + data[b:]
    return data.decode()


def refined(text: Column, window: int = 16, threshold: float = 4.0, look_back: int = 64, force: bool = False) -> Column:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: refined_text(t, window, threshold, look_back, force), na_action="ignore")

    return run(text)


def entropy_table(rows: DataFrame, key: str, text: str, window: int = 16, threshold: float = 4.0, force: bool = False) -> DataFrame:
    """(key, start, stop) of each window of bytes above the threshold, for `merged_spans`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
                found = entropy_spans(t, window, threshold, force) if t is not None else []
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(a), batch.column(0).type), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[key, "start", "stop"])

    return rows.select(key, text).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, start long, stop long")


@F.pandas_udf(IntegerType())
def entropy_windows(texts: pd.Series) -> pd.Series:
    """How many 16-byte windows of a text are above 3.5 bits."""
    return texts.map(lambda t: None if t is None else len(entropy_spans(t, 16, 3.5))).astype("Int32")


def merged_spans(spans: DataFrame, key: str, look_back: int = 64) -> DataFrame:
    """(key, start, stop): spans of one key that overlap or lie within `look_back` are one."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start") > reach + look_back), 1).otherwise(0)
    islands = spans.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(w))
    return islands.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def tree(paths: DataFrame) -> DataFrame:
    """(entry, line): every directory and file of `path` once, with its line of the tree listing, to be read by entry."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("entry"), (i < F.size(parts)).alias("dir"), i.alias("depth")))
    entries = paths.filter("path <> ''").select(F.explode(prefixes).alias("e")).groupBy("e.entry").agg(F.max("e.dir").alias("dir"), F.max("e.depth").alias("depth"))
    name = F.element_at(F.split("entry", "/"), -1)
    return entries.select("entry", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("├── "), name, F.when(F.col("dir"), "/").otherwise("")).alias("line"))


def tree_row(paths: DataFrame, before: int = -1) -> DataFrame:
    """(ord, path, content): one row with the listing of all paths, to stand before them. A listing is one value by definition;
    it has the names only."""
    lines = F.array_sort(F.collect_list(F.struct(F.split("entry", "/").alias("parts"), "line")))
    body = F.concat(F.lit("```tree\n."), F.coalesce(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("\n"), x["line"])), ""), F.lit("")), F.lit("\n```\n\n"))
    return tree(paths).agg(body.alias("content")).select(F.lit(before).cast("long").alias("ord"), F.lit(TREE).alias("path"), "content")
