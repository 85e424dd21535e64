"""Evaluation texts leaking into training text, by spaced-seed hashing.

A spaced seed is a fixed mask over consecutive words that looks at some positions and ignores the others. Every mask gives
every window of a test item a hash of the words it looks at; every window of every document is hashed alike and looked up.
A window that agrees outside the ignored positions is a hit, so hits survive substituted words; the diagonal of the two
texts through each hit is then verified word by word.

The masks look at two blocks of three words that lie side by side, three apart or six apart. Whatever two words of twelve
are substituted, two of the four blocks of three stay whole and one of the masks agrees on them, so no overlap of 12 words
of which 10 are equal is missed; longer overlaps with MIN_EQUAL equal words nearly always hold such a place (measured in
the tests). A run of MIN_RUN equal words agrees under every mask, so the exact links (`found`) are complete under one mask
alone, the widest, and only that is looked up for them.

The test items are a stated query set: they are taken in blocks of at most BLOCK_CHARS characters, and one block's index
is what a Python worker holds, built once a worker. Each block is one pass over the documents; nothing of the documents is
shuffled except the verified links. Where a text repeats itself, windows of twelve equal words are looked up at their
first and last place only: the copies between have the same words, so no link is lost, and a document of one word costs no
more than another (`words` of an overlap is then that around the first or last copy).

Defined results: null and empty texts, and texts of fewer than 12 words, link to nothing; repeated rows link once; a
repeated item id with several texts links if any of its texts does; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The positions each mask looks at; the last is the widest.
MASKS = ("111111", "111000111", "111000000111")
SPAN = max(map(len, MASKS))
MIN_RUN = 12
#: Characters of test items that one pass takes.
BLOCK_CHARS = 8_000_000
#: An overlap that tolerates substitutions: at least so many words, and this share of them equal.
MIN_WORDS, MIN_EQUAL = 12, 0.8

WORD = re.compile(r"[^\W_]+")
SCHEMA = "item_id long, doc_id long, words int, equal int, run int"


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text or "")]


class Vocabulary(dict):
    """64-bit hashes of words without regard to case, computed once a form."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.lower())
        return h

    def ids(self, text: str | None) -> np.ndarray:
        found = WORD.findall(text or "")
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


_MULT = np.array([xxhash.xxh3_64_intdigest(f"position {i}") | 1 for i in range(SPAN)], dtype=np.uint64)


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window under a mask."""
    n = len(ids) - len(mask) + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for i, c in enumerate(mask):
            if c == "1":
                out += ids[i : i + n] * _MULT[i]
        out ^= out >> np.uint64(29)
    return out


def places(ids: np.ndarray) -> np.ndarray:
    """Where windows are looked up: everywhere, but of windows of SPAN equal words at the first and last place."""
    n = len(ids)
    whole = seed_hashes(ids, "1" * SPAN)
    kinds, first, back = np.unique(whole, return_index=True, return_inverse=True)
    if len(kinds) == len(whole):
        return np.arange(n)
    last = np.zeros(len(kinds), dtype=np.int64)
    last[back] = np.arange(len(whole))
    return np.unique(np.concatenate([first, last, np.arange(len(whole), n)]))


class Index:
    """The seeds of a block of test items under some of the masks."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS):
        vocabulary = Vocabulary()
        self.item, self.text, self.seeds = [], [], {}
        at: list[np.ndarray] = []
        for item, text in items:
            ids = vocabulary.ids(text)
            if len(ids) >= SPAN:
                self.item.append(item)
                self.text.append(ids)
                at.append(places(ids))
        for mask in masks:
            parts = [(seed_hashes(ids, mask), p[p <= len(ids) - len(mask)]) for ids, p in zip(self.text, at)]
            h = np.concatenate([x[p] for x, p in parts] or [np.zeros(0, dtype=np.uint64)])
            which = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for _, p in parts])
            where = np.concatenate([p for _, p in parts] or [np.zeros(0, dtype=np.int64)]).astype(np.int32)
            order = np.argsort(h, kind="stable")
            self.seeds[mask] = h[order], which[order], where[order]

    def overlaps(self, ids: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """(words, equal words, longest equal run) of the best overlap with each item that is hit."""
        if len(ids) < SPAN:
            return {}
        diagonals: set[tuple[int, int]] = set()
        at = places(ids)
        for mask, (seeds, which, where) in self.seeds.items():
            here = at[at <= len(ids) - len(mask)]
            h = seed_hashes(ids, mask)[here]
            if not len(h) or not len(seeds):
                continue
            low = np.searchsorted(seeds, h, "left")
            hit = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == h)
            high = np.searchsorted(seeds, h[hit], "right")
            for i, lo, hi in zip(here[hit].tolist(), low[hit].tolist(), high.tolist()):
                diagonals.update(zip(which[lo:hi].tolist(), (i - where[lo:hi]).tolist()))
        best: dict[int, tuple[int, int, int]] = {}
        for w, shift in diagonals:
            text = self.text[w]
            start, end = max(shift, 0), min(shift + len(text), len(ids))
            got = verify(ids[start:end] == text[start - shift : end - shift])
            if got[0]:
                item = self.item[w]
                best[item] = max(best.get(item, (0, 0, 0)), got, key=lambda x: (x[2] >= MIN_RUN, x[1], x[2], -x[0]))
        return best


def verify(equal: np.ndarray) -> tuple[int, int, int]:
    """The longest stretch of a diagonal that begins and ends with equal words, of whose words MIN_EQUAL are equal and that
    has as many equal words as MIN_WORDS words need (words beside it may make up the number): its words, its equal words, and
    the longest equal run of the whole diagonal; else zeros."""
    ones = np.flatnonzero(equal)
    least = math.ceil(MIN_EQUAL * MIN_WORDS)
    if len(ones) < least or len(equal) < MIN_WORDS:
        return 0, 0, 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.astype(np.int8), [0]))))
    run = int((edges[1::2] - edges[::2]).max())
    # a stretch from the i-th to the j-th equal word has j - i + 1 of them in ones[j] - ones[i] + 1 words
    rank = np.arange(len(ones))
    opening, closing = rank - MIN_EQUAL * ones, rank + 1 - MIN_EQUAL * (ones + 1) + 1e-9  # closing[j] >= opening[i]
    i = np.minimum(np.searchsorted(-np.minimum.accumulate(opening), -closing, "left"), rank)  # the first such i
    words = np.where((opening[i] <= closing) & (rank - i + 1 >= least), ones - ones[i] + 1, 0)
    j = int(np.argmax(words))
    return (int(words[j]), int(j - i[j] + 1), run) if words[j] else (0, 0, 0)


def overlaps(documents: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """One row for each (item, document) with a verified overlap: its words, equal words and longest equal run."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        shared = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])
        found.append(docs.mapInArrow(_search(shared, uuid.uuid4().hex, masks), SCHEMA))
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("item_id", "doc_id")
        .agg(F.max_by(F.struct("words", "equal", "run"), F.struct(F.col("run") >= MIN_RUN, "equal", "run")).alias("best"))
        .select("item_id", "doc_id", "best.words", "best.equal", "best.run")
    )


#: The index that this worker built last, under its block's name.
_BUILT: dict[str, Index] = {}


def _search(shared, name: str, masks: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm import leakage  # the worker's own module, so that the index outlives the task

        index = leakage._BUILT.get(name)
        if index is None:
            leakage._BUILT.clear()
            index = leakage._BUILT[name] = Index(shared.value, masks)
        vocabulary = Vocabulary()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(item, doc, *x) for item, x in index.overlaps(vocabulary.ids(text)).items()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                names=["item_id", "doc_id", "words", "equal", "run"],
            )

    return run


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) with a run of MIN_RUN equal words; one mask finds them all."""
    return overlaps(documents, items, MASKS[-1:]).filter(F.col("run") >= MIN_RUN).select("item_id", "doc_id")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For each test item, leaked or not: the documents with an exact run and with a tolerant overlap."""
    links = overlaps(documents, items).groupBy("item_id").agg(
        F.count_if(F.col("run") >= MIN_RUN).alias("exact_docs"), F.count("*").alias("overlap_docs"), F.max("words").alias("longest_overlap")
    )
    return (
        items.select(F.col("item_id").cast("long").alias("item_id")).distinct().join(links, "item_id", "left")
        .select("item_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("exact_docs", "overlap_docs", "longest_overlap")))
    )
