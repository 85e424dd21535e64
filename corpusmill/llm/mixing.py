"""Mixing sources to target weights, by hash-threshold histograms.

Each document has a fixed hash. Choosing the documents of a source below a threshold takes a uniform part of the source,
and a smaller budget's choice lies within a larger one's. The threshold for a budget is found without sorting: tokens
are summed by source and hash bucket, the bucket in which the budget ends is found from running sums over the buckets,
and only that bucket is summed again by the next bits of the hash, LEVELS times. The choice itself is a filter.

A mix's shares are divided by their sum. A source's wanted tokens are share x size_factor x tokens of all documents, at
most max_repeats x the source's tokens; every document stands floor(wanted / tokens) times and those below the threshold
once more. The remainder of the budget that is less than one document decides by rounding to the nearer side.

Defined results: a source without documents, a null or negative share or repeat count gives nothing (and is reported);
documents of a source that no mix names, or of none, stand in no mix; null texts have no tokens and are never chosen;
repeated target rows count once; repeated documents with one id are chosen or left together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut, small

#: The folder with the public tokenizers' files, and the file taken from it.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of that vocabulary (a fixed, public value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of the hash that one histogram looks at, and how often the boundary bucket is refined.
BITS, LEVELS = 10, 3


_SPLIT = regex.compile(PATTERN)
#: The encoding that this worker built last, under the hash of its file.
_BUILT: dict = {}


def _encoding(data: bytes):
    """The encoding of a vocabulary file's bytes, built once a worker."""
    name = xxhash.xxh3_64_intdigest(data)
    if name not in _BUILT:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        _BUILT.clear()
        _BUILT[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _BUILT[name]


def _pieces(text: str, size: int = 100_000) -> Iterator[str]:
    """Pieces of a very long text of at least `size` characters, cut where the pre-tokenizer cuts, so that their tokens are
    those of the whole; a stretch that it does not cut stays whole."""
    if len(text) <= size:
        yield text
        return
    start = 0
    for m in _SPLIT.finditer(text):
        if m.end() - start >= size and not m[0][-1].isspace():
            yield text[start : m.end()]
            start = m.end()
    if start < len(text):
        yield text[start:]


def with_tokens(documents: DataFrame, *keep: str, path: str = f"{TOKENIZERS}/{TOKENIZER}") -> DataFrame:
    """`keep` and `n_tokens`, the tokens of `text` (0 for null). The vocabulary is read on the driver and sent to the workers
    (one file, about a megabyte), so that no executor needs its folder."""
    with open(path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm import mixing  # the worker's own module, so that the encoding outlives the task

        encoding = mixing._encoding(shared.value)
        for batch in batches:
            counts = [sum(len(encoding.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in batch.column("text").to_pylist()]
            cols = [batch.column(c) for c in keep] + [pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_tokens"])

    kinds = dict(documents.dtypes)
    return documents.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_tokens long")


def _digit(level: int):
    """The `level`-th group of BITS bits of the document's hash."""
    return F.shiftrightunsigned(F.col("h"), 64 - BITS * (level + 1)).bitwiseAND(F.lit(2**BITS - 1))


def plan(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with hash and tokens, one row for each mix and source with `copies` for all and the threshold)."""
    docs = cut(with_tokens(documents.select("doc_id", "source", "text"), "doc_id", "source").withColumn("h", F.xxhash64("doc_id")))
    sums = docs.filter("source is not null and n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("have"))
    total = docs.agg(F.sum("n_tokens")).first()[0] or 0
    wish = targets.select("mix", "source", "target_share", "max_repeats", "size_factor").distinct()
    share = F.greatest(F.coalesce(F.when(~F.isnan("target_share"), F.col("target_share")), F.lit(0.0)), F.lit(0.0))
    all_shares = F.sum(share).over(Window.partitionBy("mix"))
    wish = (
        wish.withColumn("share", F.when(all_shares > 0, share / all_shares).otherwise(0.0))
        .join(small(sums), "source", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .withColumn("wanted", F.col("share") * F.greatest(F.coalesce("size_factor", F.lit(0.0)), F.lit(0.0)) * total)
        .withColumn("cap", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)))
        .withColumn("budget", F.least("wanted", F.col("cap") * F.col("have")))
        .withColumn("copies", F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("copies") * F.col("have"))
        .withColumn("prefix", F.array().cast("array<bigint>"))
        .withColumn("open", (F.col("rest") > 0) & (F.col("have") > 0))
    )
    wish = cut(wish)
    for level in range(LEVELS):
        wish = cut(_refine(docs, wish, level))
    return docs, wish


def _refine(docs: DataFrame, wish: DataFrame, level: int) -> DataFrame:
    """Append to each open `prefix` the digit of the bucket in which its budget ends; `rest` is what that bucket may take."""
    digits = F.array(*(_digit(i) for i in range(level))) if level else F.array().cast("array<bigint>")
    wanted = wish.filter("open").select("source", "prefix").distinct()
    inside = docs.withColumn("prefix", digits).withColumn("digit", _digit(level)).join(small(wanted), ["source", "prefix"])
    histogram = inside.groupBy("source", "prefix", "digit").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "prefix").orderBy("digit")) - F.col("n")
    histogram = histogram.withColumn("before", before)
    ends = (
        wish.filter("open").join(histogram, ["source", "prefix"])
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        .select("mix", F.col("source"), "target_share", "max_repeats", "size_factor", "digit", "before", "n")
    )
    keys = ["mix", "source", "target_share", "max_repeats", "size_factor"]
    joined = wish.alias("w").join(ends.alias("e"), [F.col(f"w.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys], "left")
    last = level == LEVELS - 1
    # in the last bucket the nearer side is taken
    digit = F.col("e.digit") + (F.when(F.col("w.rest") - F.col("e.before") > F.col("e.n") / 2, 1).otherwise(0) if last else 0)
    return joined.select(
        *(F.col(f"w.{c}") for c in wish.columns if c not in ("prefix", "rest")),
        F.when(digit.isNotNull(), F.concat("w.prefix", F.array(digit))).otherwise(F.col("w.prefix")).alias("prefix"),
        (F.col("w.rest") - F.coalesce("e.before", F.lit(0))).alias("rest"),
    )


def mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, doc_id, source, n_tokens, copies) of each document that stands in a mix at least once."""
    docs, wish = plan(documents, targets)
    return _chosen(docs, wish)


def _chosen(docs: DataFrame, wish: DataFrame) -> DataFrame:
    # arrays compare digit by digit; a closed plan has no prefix and adds nothing
    own = F.array(*(_digit(i) for i in range(LEVELS)))
    more = F.when((F.size("prefix") == LEVELS) & (own < F.col("prefix")), 1).otherwise(0)
    plans = wish.filter("have > 0 and budget > 0").select("mix", "source", "copies", "prefix")
    return (
        docs.filter("n_tokens > 0").join(small(plans), "source")
        .select("mix", "doc_id", "source", "n_tokens", (F.col("copies") + more).alias("copies"))
        .filter("copies > 0")
    )


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """For each mix and source: what was wanted and what was reached."""
    docs, wish = plan(documents, targets)
    got = _chosen(docs, wish).groupBy("mix", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    joined = wish.join(got, ["mix", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    everything = F.sum("tokens").over(Window.partitionBy("mix"))
    return joined.select(
        "mix", "source", "target_share", F.col("share").alias("normalised_share"), "max_repeats",
        F.col("have").alias("available_tokens"), F.col("wanted").alias("wanted_tokens"), "tokens",
        F.when(everything > 0, F.col("tokens") / everything).otherwise(0.0).alias("reached_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (F.col("budget") < F.col("wanted")).alias("capped"),
    )
