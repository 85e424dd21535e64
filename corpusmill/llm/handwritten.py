"""Generated, minified, vendored and data-only source files, by Merkle hashes and by header and layout.

Merkle part: every file of a repository has the hash of its content; a directory's hash is made bottom-up from the sum of its
children's mixed hashes (a sum, so that no list of children is ever built), and a directory with one child has its child's
hash, so that a moved copy keeps it. Names are no part of a hash. A file or subtree whose hash stands in repositories of two
or more owners was copied there. From the copied files the directories that hold copies are learned, by name and by place
under the root (one in which at least LEARNED_SHARE of the files are copies, in LEARNED_REPOS repositories), which also gives
copies of which only one was crawled.

Header and layout part, by file: a notice of generation or origin among the comments at the head; lock files; lines too long
for hands holding most of the file; a file of nothing but literals; a file of nothing but numbered accessors.

Defined results: files of null content, and paths of other languages (pages, scans, notes, logs, tables, configuration),
are no cases; empty and blank files are never copies, those under LEAST_BYTES only within a copied subtree of several files;
a null repository shares nothing; repeated rows of one repository are one file to the Merkle hashes and each row gets the
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut, small

#: File name ends of languages that are written by hand or machine (fixed values).
SOURCE = ("py", "js", "ts", "jsx", "tsx", "rs", "go", "java", "c", "h", "cpp", "hpp", "cc", "css", "scss", "rb", "php", "cs", "kt", "swift", "scala")
LOCKS = ("package-lock.json", "deps-lock.json", "yarn.lock", "Cargo.lock", "poetry.lock", "Pipfile.lock", "composer.lock", "go.sum", "pnpm-lock.yaml", "Gemfile.lock")
LEAST_BYTES = 40
LEARNED_SHARE, LEARNED_REPOS = 0.8, 3
#: A line longer than this is not written by hand; such lines must hold this share of the file.
LONG_LINE, LONG_SHARE = 300, 0.6
#: Lines of code that the head of a file may hold between its comments.
HEAD_CODE = 5
#: Languages that are minified, and the ordinary lines such a file may have beside the long ones.
MINIFIED = ("js", "ts", "jsx", "tsx", "css", "scss", "php")
FEW_LINES = 6
#: A file of at least so many lines that have at most this share of different forms was written by a loop.
LOOP_LINES, LOOP_SHARE = 15, 0.25

_COMMENT = re.compile(r"^\s*(?://|#(?!include|define)|/?\*|--|;|<!--|\"\"\"|''')")
_NOTICE = re.compile(
    r"(?i)\bdo not (?:edit|modify)|\bauto-?generated\b|@generated\b|\bautogen(?:erated)?\b|\bautomatically generated\b|\bgenerated (?:by|on|from|with)\b"
    r"|\bmachine[- ](?:written|generated)\b|\bautomatisch erzeugt|\bg[ée]n[ée]r[ée] automatiquement|\bgenerado autom[áa]ticamente"
    r"|\b(?:edits|changes) (?:are|will be|to this file will be) (?:overwritten|lost)"
)
_LOCK = re.compile(r'^\s*\{(?:\s*"[^"]*"\s*:\s*(?:"[^"]*"|[\w.]+)\s*,)*\s*"lockfileVersion"\s*:')
_NOT = re.compile(r"(?i)\b(?:not|never|nicht) (?:auto-?|automatically |automatisch )?(?:generated|erzeugt)")
_VENDORED = re.compile(
    r"(?i)\bvendored (?:unchanged|from|copy)|^\W*upstream: \S+|\bis part of \S+ v?\d+\.\d+|^\W*\w+ v\d+\.\d+\.\d+ - released under"
    r"|^\W*copyright (?:\(c\) |© )?the \w+ (?:authors|contributors)\W+version \d|^/\*!.*\bv\d+\.\d+"
)
_LITERAL = re.compile(r"0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_ACCESSOR = re.compile(r"(?m)^\s*(?:(?:export|public|private|static|final|pub|async|inline|const)\s+)*(?:def|function|fn|func(?: \([^)]*\))?|[\w:<>\[\]*&]+)\s+[*&]?[gs]et_?\w+\s*\(", re.I)
_WORD = re.compile(r"\w+")
_BLOCK = re.compile(r"(?m)^\s*(?:def|function|fn|func|if|for|while|switch|match|try|else|case|const|import|from|use|#include|require)\b")


def head(content: str) -> Iterator[str]:
    """The comment lines at the head of a file, however many: those before HEAD_CODE lines that are no comment, blank or
    preprocessor line, with the lines inside a block comment."""
    code, inside, at, n = 0, None, 0, len(content)
    while at < n and code < HEAD_CODE:
        end = content.find("\n", at)
        line = content[at : end if end >= 0 else n]
        at = end + 1 if end >= 0 else n
        text = line.strip()
        if inside:
            yield line
            if inside in text:
                inside = None
        elif _COMMENT.match(line):
            yield line
            for opening, closing in (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''")):
                if text.startswith(opening) and closing not in text[len(opening) :]:
                    inside = closing
        elif text:
            code += 1


def reason(path: str, content: str) -> str | None:
    """Why a single file, by itself, is not hand-written; None if nothing says so."""
    name = path.rsplit("/", 1)[-1]
    if name in LOCKS or (name.endswith(".json") and _LOCK.search(content)):
        return "lock file"
    if name.rsplit(".", 1)[-1].lower() not in SOURCE or "." not in name:
        return None
    for line in head(content):
        if _NOTICE.search(line) and not _NOT.search(line):
            return "generated"
        if _VENDORED.search(line):
            return "vendored"
    size = len(content)
    if size < LEAST_BYTES:
        return None
    lines = content.split("\n")
    long = sum(n for n in map(len, lines) if n > LONG_LINE)
    if long > LONG_SHARE * size:
        if len(_LITERAL.sub("", content)) < 0.5 * size:
            return "data"
        if name.rsplit(".", 1)[-1].lower() in MINIFIED and sum(1 for x in lines if x.strip() and len(x) <= LONG_LINE) <= FEW_LINES:
            return "minified"
    filled = sum(1 for x in lines if x and not x.isspace())
    if filled >= 8:
        digits = sum(map(content.count, "0123456789"))
        if digits > 0.12 * size and len(re.sub(r"[\s,\[\](){};]", "", _LITERAL.sub("", content))) < 0.25 * size:
            return "data"
        if "et_" in content:
            n = len(_ACCESSOR.findall(content))
            if n >= 6 and n >= 0.15 * filled and len(_BLOCK.findall(content)) <= 2.4 * n:
                return "generated"
        if filled >= LOOP_LINES and "(" in content and not name.endswith("css"):
            forms = {_WORD.sub("w", x.strip()) for x in lines if x and not x.isspace()}
            if len(forms) <= max(4, min(8, LOOP_SHARE * filled)) and not any(_COMMENT.match(x) for x in lines):
                return "generated"
    return None


def sources(file_nodes: DataFrame) -> DataFrame:
    """(ord, repo, path, reason, file, big): rows of all files but pages; `file` is the content's hash, null if it is blank, and
    `reason` is set for source and lock files only. Texts of other files are hashed and go no further."""
    name = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    lock = F.element_at(F.split("path", "/"), -1).isin(*LOCKS)
    rows = file_nodes.filter(F.col("content").isNotNull() & F.col("path").isNotNull() & ~F.col("path").rlike(r"^(?i)https?://")).select(
        F.col("ord").cast("long").alias("ord"),
        F.col("repo").cast("string").alias("repo"),
        F.col("path").cast("string").alias("path"),
        F.when(F.col("content").rlike(r"\S"), F.xxhash64("content")).alias("file"),
        (F.octet_length("content") >= LEAST_BYTES).alias("big"),
        F.when(name.isin(*SOURCE, "json") | lock, F.col("content").cast("string")).alias("content"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            why = [reason(p, c) for p, c in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(why, pa.string())], names=["ord", "repo", "path", "file", "big", "reason"])

    judged = rows.filter("content is not null").mapInArrow(run, "ord long, repo string, path string, file long, big boolean, reason string")
    return judged.unionByName(rows.filter("content is null").drop("content").withColumn("reason", F.lit(None).cast("string")))


def merkle(files: DataFrame) -> DataFrame:
    """(repo, dir, node, n_files) of every directory, from (repo, path, file): hashes bottom-up, level by level."""
    base = files.filter(F.col("repo").isNotNull() & F.col("file").isNotNull()).select("repo", "path", "file").distinct()
    parent = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise("")
    leaves = cut(base.select("repo", parent(F.col("path")).alias("dir"), F.col("file").alias("node"), F.lit(1).cast("long").alias("n_files")))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    deepest = leaves.agg(F.max(depth)).first()[0]
    done, below = [], None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = leaves.filter(depth == level)
        if below is not None:
            here = here.unionByName(below)
        nodes = here.groupBy("repo", "dir").agg(
            F.count("*").alias("kids"), F.sum("n_files").alias("n_files"), F.first("node").alias("only"),
            F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("total"),
        )
        nodes = nodes.select("repo", "dir", "n_files", F.when(F.col("kids") == 1, F.col("only")).otherwise(F.xxhash64("total", "kids")).alias("node"))
        if (deepest - level) % 6 == 5:
            nodes = cut(nodes)
        done.append(nodes)
        below = nodes.filter(F.col("dir") != "").select("repo", parent(F.col("dir")).alias("dir"), "node", "n_files")
    out = done[0] if done else leaves
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("repo", "dir", "node", "n_files")


def owner(repo: Column) -> Column:
    """Repositories of one owner (the part before the first slash) are related."""
    return F.substring_index(repo, "/", 1)


def shared_nodes(nodes: DataFrame) -> DataFrame:
    """(node, owners) of nodes in repositories of two or more owners; a hot hash is one row an owner before it is counted."""
    return nodes.select(owner(F.col("repo")).alias("owner"), "node").distinct().groupBy("node").agg(F.count("*").alias("owners")).filter("owners > 1")


def judged(file_nodes: DataFrame) -> DataFrame:
    """(ord, repo, path, reason) of every source or lock file; `reason` null for hand-written ones."""
    files = cut(sources(file_nodes))
    trees = cut(merkle(files)).filter("n_files > 1").select("repo", "dir", "node")  # of one file only its own hash counts
    leaf = files.filter("repo is not null and file is not null and big").select("repo", F.col("file").alias("node"))
    shared = cut(shared_nodes(leaf.unionByName(trees.select("repo", "node"))))
    near = small(shared)
    source = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*SOURCE)
    copies = files.filter(source & F.expr("repo is not null and file is not null and big")).join(near.withColumnRenamed("node", "file"), "file", "left_semi").select("ord")
    # subtrees copied as a whole, whatever the size of their files
    roots = trees.join(near, "node", "left_semi").select("repo", "dir").filter("dir <> ''").distinct()
    up = files.filter("repo is not null").select("ord", "repo", F.explode(_ancestors(F.col("path"))).alias("dir"))
    inside = up.join(roots, ["repo", "dir"], "left_semi").select("ord")
    copies = cut(copies.unionByName(inside).distinct())
    # names of directories that hold copies
    named = files.filter(source & F.expr("repo is not null and file is not null and big")).join(copies.withColumn("copy", F.lit(1)), "ord", "left")
    named = named.select("ord", "repo", F.coalesce("copy", F.lit(0)).alias("copy"), F.explode(_places(F.col("path"))).alias("name"))
    by_repo = named.groupBy("name", "repo").agg(F.count("*").alias("n"), F.sum("copy").alias("copies"))
    learned = (
        by_repo.groupBy("name").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"), F.count_if(F.col("copies") > 0).alias("repos"))
        .filter((F.col("copies") >= LEARNED_SHARE * F.col("n")) & (F.col("repos") >= LEARNED_REPOS)).select("name")
    )
    in_named = named.join(small(cut(learned)), "name", "left_semi").select("ord")
    vendored = copies.unionByName(in_named).distinct().withColumn("copied", F.lit(True))
    lock = F.element_at(F.split("path", "/"), -1).isin(*LOCKS)
    kinds = files.filter(source | lock | F.lower("path").endswith(".json"))
    return kinds.join(vendored, "ord", "left").select(
        "ord", "repo", "path", F.coalesce(F.when(source & F.col("file").isNotNull() & F.col("copied"), F.lit("vendored")), "reason").alias("reason")
    )


def _places(path):
    """What names a directory: its name anywhere, and its path from the repository's root."""
    names = F.array_distinct(_directories(path))
    return F.concat(names, F.transform(F.slice(_directories(path), 1, 1), lambda d: F.concat(F.lit("/"), d)))


def _directories(path):
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def _ancestors(path):
    parts = _directories(path)
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))


def found(file_nodes: DataFrame) -> DataFrame:
    return judged(file_nodes).filter("reason is not null").select("ord")


def rates(file_nodes: DataFrame) -> DataFrame:
    """For each repository (null too) and reason (null: hand-written) the files."""
    return judged(file_nodes).groupBy("repo", "reason").agg(F.count("*").alias("files"))
